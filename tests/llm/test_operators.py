"""Each operator against a plain version of itself, with odd rows throughout."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import near_copies
from lectern.llm import op1_simhash as simhash
from lectern.llm import op2_token_files as files
from lectern.llm import op3_decontaminate as decon
from lectern.llm import op4_packing as packing
from lectern.llm import op5_pii as pii
from lectern.llm import op6_media as media
from lectern.llm import op7_language as language
from lectern.llm import op8_toxicity as toxicity
from lectern.llm import op9_token_counts as counts
from lectern.llm import op10_quality as quality
from lectern.llm import queries
from lectern.llm.elias_fano import EliasFano
from lectern.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, kept_id long, grade int, toxic int"
LONG = "ab cd. " * 6000


def _rows():
    r = random.Random(4)
    pool = ["the", "of", "and", "river", "Stone", "walks", "über", "été", "año", "x9", "12", "a.b@c.org", "-", "İ", "日本"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(30)]
    texts += [texts[0], texts[1], texts[1].upper(), "", "", None, "  ", "\n\t ", "\x1c a　b", "one", "one two", LONG, "x" * 3000, "9" * 5000, "a  b <|endoftext|>c  ", "end.\n\nnew 's"]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, "without an id"), (None, None), (7, texts[7]), (8, "another text with a used id"), (-5, "negative id here")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, None, "s", len(t) if t else None, 1.0, "f", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(row):
    return tuple((x is not None, x) for x in row)


def _fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(docs, rows, empty):
    prints = [_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = [(i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group, strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_lose_no_pair_of_random_fingerprints(spark):
    r = random.Random(1)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints for _ in range(4)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("kind", ["random", "both ends", "rising"])
def test_components_of_a_path_take_few_rounds(spark, kind):
    n = 1500
    path = {"random": random.Random(3).sample(range(9 * n), n), "both ends": [*range(0, n, 2), *range(n - 1, 0, -2)], "rising": list(range(n))}[kind]
    rounds = []
    got = simhash.components(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long"), rounds).collect()
    assert len(got) == n and {x.label for x in got} == {min(path)} and len(rounds) <= 2 * np.log2(n)


def test_components_of_random_graphs(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)]
    group = list(range(400))
    for a, b in edges:
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {x.fp: x.label for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: group[v] for v in linked}


def test_pipeline_drops_near_copies_at_five_words(spark, docs, rows):
    r = random.Random(12)
    made = [" ".join(f"w{r.randrange(9000)}" for _ in range(120)) for _ in range(12)]
    for t in made[:12]:
        for _ in range(6):
            ws = t.split()
            for _ in range(r.choice([1, 2, 2, 3, 5])):
                ws[r.randrange(len(ws))] = f"v{r.randrange(9000)}"
            made.append(" ".join(ws))
    rows = [*rows, *((1000 + k, t) for k, t in enumerate(made)), (1000, "clean text under a used id, like no other"), (None, made[0] + " more")]

    def grams(text):
        ws = (text or "").encode().lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {}
    for (i, _), g in zip(rows, group, strict=True):
        row = (i is None, i or 0)
        want[g] = min(row, want.get(g, row))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted(want.values())
    assert any(x.text.startswith("clean text") for x in got if x.doc_id == 1000)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("one_fingerprint", [False, True])
def test_pipeline_brings_near_copies_together_by_simhash(spark, one_fingerprint):
    """Texts without a common MinHash key meet by their fingerprints, be they within two bits or equal; whole sets decide."""
    r = random.Random(8)
    made = []
    for _ in range(5):
        ws = [f"w{r.randrange(9000)}" for _ in range(800)]
        made += [" ".join(ws), " ".join([*ws, "tail"]), " ".join(ws).upper()]
    fps = [near_copies.fingerprint(near_copies.shingles(t)) for t in made]
    apart = [(fps[k] ^ fps[k + 1]).bit_count() for k in range(0, 15, 3)]
    assert max(apart) in (1, 2) and all(fps[k] == fps[k + 2] for k in range(0, 15, 3))
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    rows = near_copies._sketches(frame).withColumn("keys", F.array("node")).withColumn("row", F.struct("doc_id")).localCheckpoint()
    assert [x.fp for x in rows.orderBy("doc_id").collect()] == fps
    nodes = rows.drop("doc_id").withColumn("fp", F.lit(5).cast("long")) if one_fingerprint else rows.drop("doc_id")
    labels = {x.fp: x.label for x in simhash.components(near_copies.links(frame, nodes)).collect()}
    classes = {}
    for x in rows.collect():
        classes.setdefault(labels.get(x.node), []).append(x.doc_id)
    assert sorted(map(sorted, classes.values())) == [[k, k + 1, k + 2] for k in range(0, 15, 3)]


def test_texts_of_different_classes_in_a_bucket_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    r = random.Random(5)
    sets = [sorted(r.sample(range(24), r.randint(17, 22))) for _ in range(60)]
    members = [(key, k, len(s), r.choice([1, 1, 1, 2, 3, 4])) for key in (1, 2) for k, s in enumerate(sets) if k % 2 or key == 1]
    members += [(3, k, len(sets[k]), k) for k in (0, 1)]
    want = set()
    for x in members:
        for y in members:
            a, b = set(sets[x[1]]), set(sets[y[1]])
            if x[0] == y[0] and x[3] != y[3] and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                want.add(frozenset((x[1], y[1])))
    held = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "node long, found array<long>")
    got = near_copies._across(spark.createDataFrame(members, "key long, node long, size int, label long"), held).collect()
    assert {frozenset(x) for x in got} == want and len(want) > 100


def _ids(text, name="word_bpe_49k.json"):
    return Tokenizer.from_file(default_tokenizer(name)).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    r = random.Random(9)
    alpha = "ab's \n\t'd RE ́<|endoftext|> 12.,é\x1c　ß"
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 40))) for _ in range(2000)] + [t for _, t in _rows()]
    tok = Tokenizer.from_file(default_tokenizer())
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(default_tokenizer()).encode_many(texts)]
    assert got == want


def test_token_counts_equal_the_library(docs, rows, empty):
    path = default_tokenizer("byte_bpe_50k.json")
    r = random.Random(9)
    alpha = "ab's \n\t'd RE ́<|endoftext|> 12.,é\x1c　ß"
    tok, own = Tokenizer.from_file(path), counts.counter(path)
    for t in ["".join(r.choice(alpha) for _ in range(r.randint(0, 40))) for _ in range(2000)]:
        assert own.count(t) == len(tok.encode(t, add_special_tokens=False).ids), repr(t)
    want = [(i, len((t or "").encode()), len(_ids(t, "byte_bpe_50k.json"))) for i, t in rows]
    got = counts.token_counts(docs, path).collect()
    assert sorted([tuple(g)[:3] for g in got], key=_key) == sorted(want, key=_key)
    assert all(g.over_limit == (g.n_tokens > 512) for g in got)
    assert counts.token_counts(empty, path).count() == 0


def test_elias_fano_round_trip_and_select():
    r = np.random.default_rng(2)
    for values in ([], [0], [5, 5, 5], [0, 2**40], np.sort(r.integers(0, 10**6, 3000)), np.cumsum(r.integers(0, 3, 5000))):
        values = np.asarray(values, np.int64)
        code, _ = EliasFano.from_bytes(b"pad" + EliasFano.encode(values).to_bytes(), 3)
        assert code.decode().tolist() == values.tolist()
        assert [code.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert 8 * len(EliasFano.encode(values).to_bytes()) < len(values) * (2.5 + np.log2(values[-1] / len(values)))


@pytest.mark.parametrize("range_bytes", [1 << 30, 500])
def test_token_files_round_trip(spark, docs, rows, empty, range_bytes):
    folder = files.stage.scratch(spark, "test-files")
    got = files.read_token_files(files.write_token_files(docs, folder, default_tokenizer(), range_bytes=range_bytes), folder)
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    want = sorted((i is not None, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [[*_ids(t), 1]])
    assert sorted((r[0] is not None, r[0], r[2], r[3]) for r in got) == want
    if range_bytes > 1000:
        assert files.read_token_files(files.write_token_files(empty, folder, default_tokenizer()), folder).count() == 0


def test_documents_are_read_by_select_alone(spark, docs, rows, monkeypatch):
    data = files.pack_file([3, 9], [2, 4], np.arange(6, dtype=np.uint16))
    f = files.TokenFile(data)
    monkeypatch.setattr(type(f.bounds), "decode", lambda self: 1 / 0)
    assert [f.document(k).tolist() for k in range(2)] == [[0, 1], [2, 3, 4, 5]]


def test_long_words_do_not_stay_in_caches():
    enc, own = encoder(default_tokenizer()), counts.counter(default_tokenizer("byte_bpe_50k.json"))
    long = "".join(random.Random(1).choice("abcdefgh日本") for _ in range(200_000))
    assert enc.encode_many([long + " a", long])[1] == np.array(_ids(long), "<u4").tobytes()
    assert own.count(f"x {long}") == len(_ids(f"x {long}", "byte_bpe_50k.json"))
    assert max(map(len, enc.cache)) <= 64 and max(map(len, [*own.by_word, *own.by_chunk])) <= 64


def test_token_file_select_reads_one_document():
    data = files.pack_file([None, -3, 4, 4], [1, 0, 3, 2], np.arange(6, dtype=np.uint16))
    f = files.TokenFile(data)
    assert f.doc_ids == [None, -3, 4, 4]
    assert [f.document(k).tolist() for k in range(4)] == [[0], [], [1, 2, 3], [4, 5]]


@pytest.mark.parametrize("group_ids", [packing.GROUP_IDS, 1500])
def test_packing_holds_each_id_once(docs, rows, empty, group_ids):
    got = packing.pack(docs, default_tokenizer(), group_ids=group_ids).collect()
    windows, total, pieces = {}, 0, {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == windows.get(p.sequence_id, 0)
        windows[p.sequence_id] = p.offset + p.length
        total += p.length
    assert max(windows.values()) <= 2048 and sum(n < 2048 for n in windows.values()) <= (1 if group_ids > 1500 else 3)
    assert total == sum(len(_ids(t)) + 1 for _, t in rows)
    # Every document's ids, cut where its pieces are.
    for p in got:
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    for i, t in rows:
        ids = [*_ids(t), 1]
        own = pieces[i, len(ids)]
        assert all((a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) in own for a, n, _ in own if [i for i, _ in rows].count(i) == 1)
    assert packing.pack(empty, default_tokenizer()).count() == 0


def test_packing_goes_through_the_levels(spark):
    r = random.Random(7)
    texts = [(k, " ".join(r.choice(["river", "stone", "walks", "green"]) for _ in range(int(r.lognormvariate(5.5, 1)) + 1))) for k in range(4000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(16)
    got = packing.pack(frame, default_tokenizer()).collect()
    first = sum(p.length for p in got if p.sequence_id < packing.SECOND)
    total = sum(p.length for p in got)
    plain = packing.Packer()
    for k, t in texts:
        list(plain.add(k, bytes(4 * (len(t.split()) + 1))))
    list(plain.finish())
    # What the second stage cuts is about what one task alone would have cut.
    assert first > 0 and total == sum(len(t.split()) + 1 for _, t in texts)
    assert plain.cut_ids < 0.25 * total


def test_packer_stays_bounded_without_leaving_the_levels():
    p = packing.Packer(10, most_open=4)
    out = [x for k in range(100) for x in p.add(k, np.full(6, k, "<u4").tobytes())]
    assert p.n_open <= 4 and p.cut_ids < 6 * 100
    out += p.finish()
    assert sum(x[2] for x in out) == 600 and len({x[5] for x in out}) == 60


def test_packer_takes_the_least_sum_of_squares():
    p = packing.Packer(8)
    for ids in (3, 3, 5, 2, 6, 4):
        before = p.levels.copy()
        h = p.choose(ids)

        def after(level, before=before, ids=ids):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + ids < 8:
                c[level + ids] += 1
            return int((c[1:8] ** 2).sum())

        options = [k for k in range(0, 9 - ids) if k == 0 or before[k]]
        assert after(h) == min(map(after, options))
        list(p.add(0, np.zeros(ids, "<u4").tobytes()))


def test_smith_waterman_matches_the_plain_recurrence():
    r = random.Random(5)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decon.smith_waterman(a, b)[0] == h.max()


def test_contaminated_finds_edited_copies(spark, docs, empty):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(6)] + [(90, None), (91, " "), (92, "two words")]
    made = []
    for k, t in items[:6]:
        ws = t.split()
        edited = [word() if i % 6 == 5 else w for i, w in enumerate(ws)]
        made += [(100 + k, " ".join(word() for _ in range(200)) + " " + t.upper()), (200 + k, " ".join(edited)), (300 + k, " ".join(word() for _ in range(60)) + " " + " ".join(ws[:5]))]
    frame = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decon.contaminated(frame, bench).collect()
    assert {(g.doc_id, g.item_id) for g in got} == {(n + k, k) for n in (100, 200) for k in range(6)}
    assert all(g.score == 1.0 and g.last_word - g.first_word == 40 for g in got if g.doc_id < 200)
    assert decon.contaminated(empty, bench).count() == 0
    assert decon.contaminated(frame, bench.limit(0)).count() == 0
    assert decon.drop_contaminated(frame, bench).count() == frame.count() - 12


def test_contaminated_equals_aligning_all_with_all(spark):
    r = random.Random(21)
    pool = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(pool) for _ in range(r.randint(8, 24)))) for k in range(25)]
    made = []
    for k in range(120):
        ws = r.choice(items)[1].split()
        ws = [r.choice(pool) if r.random() < 0.2 else w for w in ws if r.random() > 0.1]
        made.append((k, " ".join([r.choice(pool) for _ in range(r.randint(0, 20))] + ws + [r.choice(pool) for _ in range(r.randint(0, 20))])))
    want, seeded = set(), set()
    for d, t in made:
        ws = t.split()
        for i, item in items:
            own = item.split()
            if decon.smith_waterman(own, ws)[0] >= decon.THRESHOLD * 2 * len(own):
                want.add((d, i))
                n = min(4, len(own))
                grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
                if any(tuple(ws[k : k + n]) in grams for k in range(len(ws))):
                    seeded.add((d, i))
    frame, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(g.doc_id, g.item_id) for g in decon.contaminated(frame, bench).collect()}
    # Nothing with a seed is lost; what shares no run of four words is beyond the method.
    assert got == seeded and len(seeded) >= 0.9 * len(want) > 50


def test_a_stock_phrase_does_not_meet_all_items():
    items = [(k, f"which of the following is a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}") for k in range(3000)]
    block = decon.Block(items)
    assert not list(block.passages("tell me which of the following is it and which of the following is not"))
    hits = list(block.alignments("so which of the following is a7 b7 c7 no e7 f7 then", {}))
    assert [h[0] for h in hits] == [7]


def test_a_long_passage_of_a_longer_item_counts(spark):
    ws = [f"w{k}" for k in range(300)]
    block = decon.Block([(1, " ".join(ws))])
    assert [h[0] for h in block.alignments("x y " + " ".join(ws[100:160]) + " z", {})] == [1]
    assert not list(block.alignments(" ".join(ws[100:140]), {}))


def test_one_frequent_seed_is_enough_to_align(spark):
    ws = [f"w{k}" for k in range(15)]
    edited = [w if k not in (3, 7, 12) else f"x{k}" for k, w in enumerate(ws)]  # runs of 3, 3, 4 and 2 words
    rows = [(k, " ".join([f"a{k}", *edited, f"b{k}"])) for k in range(30)] + [(99, " ".join(ws[8:12]) + " and no more of it")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = decon.contaminated(frame, spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")).collect()
    assert sorted((g.doc_id, g.score) for g in got) == [(k, 0.7) for k in range(30)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k}") for k in range(9)], "item_id long, text string")
    rows = items.select(F.col("item_id").alias("doc_id"), "text")
    whole = sorted(map(tuple, decon.contaminated(rows, items).collect()))
    monkeypatch.setattr(decon, "BLOCK_BYTES", 60)
    assert sorted(map(tuple, decon.contaminated(rows, items).collect())) == whole and len(whole) == 9


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(2)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(4000):
        t = "".join(r.choice("a1.@-+2 5(") for _ in range(r.randint(1, 40)))
        got = pii.base_spans(t)
        assert got["email"] == [m.span() for m in email.finditer(t)]
        assert got["ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    got = pii.base_spans("card 4111-1111 1111 1111, +1 (706) 555-3138, 4111111111111112")
    assert got["card"] == [(5, 24)] and got["phone"] == [(26, 43)]


def _luhn(d):
    ds = [int(c) for c in d][::-1]
    return sum(ds[::2] + [sum(divmod(2 * x, 10)) for x in ds[1::2]]) % 10 == 0


def _plain_spans(t):
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    n = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in email.finditer(t)]
    out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(n(m[0])) <= 19 and _luhn(n(m[0]))]
    return out + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(n(m[0])) <= 15]


def test_cards_phones_and_digests_equal_the_plain_patterns(spark):
    import hashlib

    r, (_, _, _, make, unlike) = random.Random(3), pii.maker(5)
    texts = ["".join(r.choice(["1", "4", "0", "7", " ", "-", "+", "(", ")", ".", "a@b.co"]) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts += [" ".join(make(r.choice(pii.KINDS), r.random() < 0.6) if r.random() < 0.6 else unlike() for _ in range(6)) for _ in range(500)]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for g in got:
        want = _plain_spans(texts[g.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x for k, *_ in want) for x in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(g.spans.split(",")) and len([x for x in g.spans.split(",") if x]) == len(want) + g.n_added


def _disguised(seed, n, plain=0.0):
    """Sentences of invented words with pieces put in, and where those are."""
    r, pick, word, make, unlike = pii.maker(seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for k in range(240):
            if k % 24 == 12:
                kind = pick([*pii.KINDS, "", ""])
                piece = make(kind, r.random() < plain) if kind else unlike()
                gold += [(kind, len(text), len(text) + len(piece))] if kind else []
                text += piece + " "
            text += word() + " "
        out.append((text, gold))
    return out


def test_the_network_adds_what_the_patterns_miss():
    made = _disguised(404, 60)
    texts = [t for t, _ in made]
    base = [pii.base_spans(t) for t in texts]
    got = pii.added_spans(texts, base, pii.trained())
    hits = right = found = 0
    for (_, gold), own, more in zip(made, base, got, strict=True):
        taken = [s for v in own.values() for s in v]
        gold = {s for s in gold if not any(a < s[2] and s[1] < z for a, z in taken)}
        hits, right, found = hits + len(gold & set(more)), right + len(gold), found + len(more)
    assert right > 150 and hits / right > 0.7 and hits / found > 0.95


def test_windows_left_out_could_add_nothing(monkeypatch):
    texts = [t for t, _ in _disguised(77, 12, 0.3)] + ["word " * 400 + "an.er [at] th [dot] com " + "word " * 400, "", "at", "no mark at all " * 80]
    base = [pii.base_spans(t) for t in texts]
    few = pii.added_spans(texts, base, pii.trained())
    n = sum(len(pii._windows(t)) for t in texts)
    monkeypatch.setattr(pii, "_windows", lambda t: list(range(0, max(1, len(t) - pii.WINDOW + pii.STRIDE), pii.STRIDE)))
    assert few == pii.added_spans(texts, base, pii.trained()) and any(few)
    assert n < sum(len(pii._windows(t)) for t in texts)


def test_spans_cut_by_windows_are_joined():
    cut = [(40, 64, 1.0, "email", False, True), (64, 96, 2.0, "email", True, False), (90, 120, 1.0, "ip", False, False), (100, 110, 1.0, "email", False, False)]
    assert [x[:2] + x[3:] for x in pii.joined(cut)] == [(40, 96, "email"), (100, 110, "email"), (90, 120, "ip")]
    long = "x" * 50 + "ü" + "@" + "y" * 40 + "." + "z" * 60 + ".com"
    assert pii.valid("email", long) and len(long) > 2 * pii.WINDOW


def test_tagger_gradient():
    tagger = pii.Tagger()
    examples = pii.labelled_examples(6)
    sym, gold = np.zeros((6, pii.WINDOW), int), np.zeros((6, pii.WINDOW), int)
    for k, (t, spans) in enumerate(examples):
        sym[k, : len(t)] = pii._symbols(t)
        for kind, a, b in spans:
            gold[k, a:b] = 2 + 2 * pii.KINDS.index(kind)
            gold[k, a] -= 1
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    _, g = tagger.gradient(sym, gold)
    for name, p in tagger.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), p.shape)
        ends = []
        for e in (0.01, -0.01):
            p[at] += e
            ends.append(tagger.gradient(sym, gold)[0])
            p[at] -= e
        assert (ends[0] - ends[1]) / 0.02 == pytest.approx(g[name][at], rel=1e-2)


def test_reconcile_is_the_best_choice():
    spans = [(0, 5, 2.0, "ip"), (4, 9, 3.0, "card"), (9, 12, 1.0, "ip"), (0, 12, 3.5, "phone")]
    assert pii.reconcile(spans) == [(4, 9, 3.0, "card"), (9, 12, 1.0, "ip")]


def test_personal_data_and_redaction(spark, docs, rows, empty):
    got = pii.personal_data(docs)
    assert got.count() == len(rows)
    first = {r.doc_id: r for r in got.collect()}
    assert first[0].n_email == len(re.findall(r"a\.b@c\.org", rows[0][1]))
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.filter("text like '%@c.org%'").count() == 0
    assert clean.filter("text is not null and n_chars <> length(text)").count() == 0
    assert pii.personal_data(empty).count() == 0
    assert pii.redact("call +1 706 555 3138 now", [("phone", 5, 20), ("card", 8, 20)]) == "call [PHONE] now"


def test_media_round_trip(docs, rows, empty):
    import hashlib
    import io

    stored = media.with_tiles(media.store_media(docs))
    got = sorted(map(tuple, media.features(stored).collect()), key=lambda g: _key((g[0], g[3])))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        form = media.to_media(full)
        image = media.decode(form)
        h, w = image.shape[:2]
        grey = image if image.ndim == 2 else image.mean(axis=2)
        # Each target box as a plain mean over the image repeated to a common grid.
        box = lambda a, b: np.repeat(np.repeat(grey, a, axis=0), b, axis=1).reshape(a, h, b, w).mean(axis=(1, 3)) if h * w < 2000 else None
        steps = box(8, 9)
        dhash = media.difference_hash(image) if steps is None else int.from_bytes(np.packbits(steps[:, 1:] > steps[:, :-1] + 1e-6).tobytes(), "big")
        small = np.load(io.BytesIO(media.tile(image)))
        feature = f"dhash={dhash:016x};tile={zlib.crc32(small.tobytes()):08x};mean={small.mean():.3f}"
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature))
    assert got == sorted(want, key=lambda g: _key((g[0], g[3])))
    by_text = {}
    for (_, t), x in zip(sorted(rows, key=lambda r: _key((r[0], r[1]))), sorted(got, key=lambda g: _key((g[0], g[3]))), strict=True):
        by_text.setdefault(x[3], set()).add(x[1:])
    assert all(len(v) == 1 for v in by_text.values())
    assert media.features(media.with_tiles(media.store_media(empty))).count() == 0


def test_decoders_and_area_resize():
    r = np.random.default_rng(1)
    grey, colour = r.integers(0, 256, (5, 7), dtype=np.uint8), r.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_ppm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    plain = b"P2\n# note\n2 2\n15\n0 15\n 5 10\n"
    assert media.decode(plain).tolist() == [[0, 255], [85, 170]]
    assert media.decode(b"P1 3 1\n1 0 1").tolist() == [[0, 255, 0]] and media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    big = np.repeat(np.repeat(grey, 3, axis=0), 2, axis=1)
    assert np.allclose(media.area_resize(big, 5, 7), grey)
    assert np.isclose(media.area_resize(grey, 3, 2).mean(), grey.mean())
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def _lang_rows(n=240):
    r = random.Random(6)
    parts = {"en": ["th", "ing", "tion", "er"], "de": ["sch", "ung", "keit", "ä"], "fr": ["eau", "ment", "é", "oi"]}
    return [(k, lang, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(25))) for k in range(n) for lang in [r.choice(list(parts))]]


def test_language_learns_and_switches(spark, empty):
    made = spark.createDataFrame(_lang_rows(), "doc_id long, lang string, text string")
    model = language.fit(made)
    odd = spark.createDataFrame([(None, None, None), (1001, None, "12 !"), (1002, "en", "")], made.schema)
    got = language.languages(made.unionByName(odd), model).collect()
    truth = {k: lang for k, lang, _ in _lang_rows()}
    assert all(g.lang_pred == truth[g.doc_id] for g in got if g.held_out and g.doc_id in truth)
    assert all((g.lang_pred, g.score) == ("und", 0.0) for g in got if g.doc_id not in truth)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got if g.doc_id is not None)
    labels = [x for _, x, _ in model.label_words("thingtion inger thtion thering schungkeit keitung ungsch schkeit")]
    assert labels[:3] == ["en"] * 3 and labels[-3:] == ["de"] * 3
    assert language.languages(empty, language.fit(empty)).count() == 0
    assert language.languages(made, None).filter("lang_pred <> 'und'").count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product

    r = np.random.default_rng(3)
    model = language.LanguageField(["a", "b", "c"], np.zeros((1, 3)), {}, np.zeros((3, 3)), r.normal(size=3), r.normal(size=(3, 3)))
    rows = [r.normal(size=(n, 3)) for n in (2, 5, 1, 4)]
    laid = language.Chains([len(x) for x in rows])
    flat = np.empty((12, 3))
    flat[np.concatenate(laid.places)] = np.concatenate(rows)
    post, pair = model.posteriors(flat, laid, pairs=True)
    moves = np.zeros((3, 3))
    for s, place in zip(rows, laid.places, strict=True):
        want, mine, total = np.zeros(s.shape), np.zeros((3, 3)), 0.0
        for path in product(range(3), repeat=len(s)):
            w = np.exp(model.first[path[0]] + s[range(len(s)), path].sum() + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            want[range(len(s)), path] += w
            for a, b in zip(path, path[1:], strict=False):
                mine[a, b] += w
        assert np.allclose(post[place], want / total)
        moves += mine / total
    assert np.allclose(pair, moves)


def test_a_text_is_one_chain_of_whole_words():
    assert language.words("² ½ ① 12 !") == [] and language.words("a² bc") == ["a", "bc"]
    tails = {language.word_features("x" * 200 + end)[6] for end in ("ing", "ung", "eau")}
    assert len(tails) == 3
    model = language.LanguageField(["a", "b"], np.zeros((1 << 15, 2)), {}, np.zeros((2, 2)), np.zeros(2), np.array([[9.0, 0.0], [0.0, 9.0]]))
    s = np.zeros((500, 2))
    s[0] = [5.0, 0.0]
    assert model.chains([s])[0][-1, 0] > 0.9  # what the first word says reaches the last one


def test_toxicity_learns_words_but_not_groups(spark, empty):
    r = random.Random(2)
    fill = ["river", "stone", "walks", "green", "table", "paper"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        ws = [r.choice(fill) for _ in range(12)] + (["scoundrel"] if toxic else []) + (["muslim"] if r.random() < (0.7 if toxic else 0.1) else [])
        rows.append((k, " ".join(ws)))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.toxicity(docs, model).collect()
    assert all(g.predicted == int(g.doc_id % 4 == 0) for g in got if g.held_out)
    plain = toxicity.SwapRegularised.fit([t for _, t in rows], [x for *_, x in labels], penalty=0.0)
    fair = toxicity.SwapRegularised.fit([t for _, t in rows], [x for *_, x in labels])
    gap = lambda m: abs(m.score("the muslim walks") - m.score("the buddhist walks"))
    assert gap(fair) < 0.5 * gap(plain) and fair.score("a muslim paper") < 0.5
    odd = spark.createDataFrame([(None, None), (5000, ""), (5001, "12")], docs.schema)
    assert {g.predicted for g in toxicity.toxicity(odd, model).collect()} == {0}
    assert toxicity.toxicity(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_quality_orders_grades(spark, empty):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(300):
        g = k % 3
        ws = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        rows.append((k, " ".join(w.upper() + "!!" if g == 0 else w + ("#" if g == 1 else "") for w in ws)))
        labels.append((k, int(g > 0), int(g == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.graded(rated))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.graded_texts(docs, model).collect()
    means = [np.mean([g.expected_grade for g in got if g.doc_id % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2] and all(g.keep == (g.doc_id % 3 > 0) for g in got)
    assert quality.drop_bad(docs, rated).count() == 200
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], docs.schema)
    assert quality.graded_texts(odd, model).count() == 3
    assert quality.graded_texts(empty, None).count() == 0 and quality.graded_texts(docs, None).filter("keep").count() == 300


def test_one_row_of_a_repeated_id_is_fitted(spark):
    rows = [(k, f"word{k % 2} text number {k}") for k in range(40)] + [(0, f"copy {k} of a used id") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, quality.graded(labels)) is not None
    seen = []
    model = toxicity.SwapRegularised.fit
    toxicity.SwapRegularised.fit = classmethod(lambda cls, texts, y: seen.append(len(texts)))
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.SwapRegularised.fit = model
    assert seen[0] <= 40


def test_stage_functions_keep_clashing_columns(spark, docs, rows):
    rated = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    named = docs.selectExpr("*", "1 as rated_id", "2 as bad_id", "3 as r", "map('a', 1) as extra")
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    for out in (quality.drop_bad(named, rated), decon.drop_contaminated(named, bench), near_copies.keep_one(named), pii.redacted(named)):
        assert out.columns == named.columns and 0 < out.count() <= len(rows)


def test_grades_tell_words_apart(spark):
    r = random.Random(4)
    fill = ["river", "stone", "walks", "green", "table", "paper"]
    rows = [(k, " ".join([r.choice(fill) for _ in range(20)] + (["scoundrel"] if k % 3 == 1 else []))) for k in range(600)]
    rated = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 3 == 1)) for k in range(600) if k % 3], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.graded_texts(docs, quality.fit(docs, quality.graded(rated))).collect()
    low = [g.expected_grade for g in got if g.doc_id % 3 == 1]
    assert max(low) < min(g.expected_grade for g in got if g.doc_id % 3 == 2)


def test_cumulative_link_gradient_is_that_of_its_loss():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5)).astype(np.float32)
    y = np.digitize(x @ np.array([2, -1, 0, 0, 1.0]) + 0.1 * r.normal(size=400), [-1, 1])
    model = quality.CumulativeLink.fit(x, y, 3)
    tails = model.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all() and np.mean((tails >= 0.5).sum(axis=1) == y) > 0.93


def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    base = str(tmp_path)
    now = empty.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    for _, apply in corpus_pipeline.STAGES:
        now = apply(spark, now, base)
        assert now.count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path, docs, rows):
    base = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, rows[0][1]), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    now = spark.read.parquet(f"{base}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES:
        path = f"{base}/{name}"
        apply(spark, now, base).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert after.count() <= now.count()
            now = after
    texts = [r.text for r in now.collect()]
    assert after.agg(F.sum("length")).first()[0] == sum(len(_ids(t)) + 1 for t in texts)
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} == {k.split("_")[0] for k in queries.QUERIES}
