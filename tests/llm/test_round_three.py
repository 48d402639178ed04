"""Best-fit packing, the Merkle manifest and periodic runs against plain versions, with odd rows throughout."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bin_completion as bins
from lectern.llm import lyndon, queries
from lectern.llm import op11_best_fit as packing
from lectern.llm import op12_manifest as merkle
from lectern.llm import op13_runs as runs
from lectern.llm.tokens import default_tokenizer
from tests import oracle
from tests.llm.test_operators import SCHEMA, _key, _rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns named as the operators' own: none of them is read."""
    full = [(i, t, None if k % 3 == 0 else "déen"[k % 3 : k % 3 + 2], "s", len(t) if t else None, 1.0, "f", 1, 2, 3) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for name in ("group", "pos", "leaf", "root", "path", "runs", "collapsed", "piece", "nth", "part", "ids", "base"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# Bins


def _least(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        tried = set()
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in tried:
                tried.add(room)
                rooms[k] -= items[i]
                place(i + 1, rooms)
                rooms[k] += items[i]
        place(i + 1, [*rooms, size - items[i]])

    place(0, [])
    return best[0]


def _unpacked(filled):
    return sorted(n for filling, times in filled for _ in range(times) for n in filling)


@pytest.mark.parametrize("live", [64, 1])
def test_the_search_finds_the_fewest_bins(live, monkeypatch):
    """Also where enumerations far down are dropped and made anew."""
    monkeypatch.setattr(bins, "LIVE", live)
    r, harder = random.Random(1), 0
    for t in range(700):
        size, n = r.choice([10, 20, 37, 60]), r.randint(1, 11)
        few = [size // 3 + 1, size // 4 + 1, size // 2 + 1, size // 7 + 1, size // 5]
        items = [r.randint(1, size) if t % 2 else r.choice(few) for _ in range(n)]
        counts = np.bincount(items, minlength=size + 1)
        filled, low = bins.complete(counts)
        want = _least(items, size)
        assert _unpacked(filled) == sorted(items) and all(sum(f) <= size for f, _ in filled)
        assert low <= want == sum(times for _, times in filled), (size, items)
        harder += sum(times for _, times in bins.best_fit(counts)) > want
    assert harder > 5  # best fit alone is not enough


def test_dominated_fillings_are_those_that_an_unused_piece_improves():
    r = random.Random(2)
    for _ in range(2000):
        filling, waste = [r.randint(1, 9) for _ in range(r.randint(0, 4))], r.randint(0, 5)
        unused = {r.randint(1, 15) for _ in range(3)}
        want = False
        for mask in range(1 << len(filling)):
            part = [x for k, x in enumerate(filling) if mask >> k & 1]
            want |= any(sum(part) < u <= sum(part) + waste or (len(part) > 1 and u == sum(part)) for u in unused)
        assert bins.dominated(filling, waste, sum(1 << u for u in unused)) == want


def test_without_steps_the_best_fit_stays_and_all_is_packed():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 4097, 5000)
    counts = np.bincount(items, minlength=4097)
    filled, low = bins.complete(counts, steps=0)
    assert _unpacked(filled) == sorted(items.tolist()) and low <= sum(t for _, t in filled)
    assert bins.complete(np.zeros(11, int)) == ([], 0)
    with pytest.raises(ValueError, match="zero"):
        bins.complete([1, 0])
    full = np.zeros(11, int)
    full[10] = 3
    assert bins.complete(full) == ([((10,), 3)], 3)


def test_the_search_holds_little_memory():
    import tracemalloc

    items = np.clip(np.random.default_rng(3).lognormal(5.5, 1.2, 60_000).astype(int), 1, 4096)
    counts = np.bincount(items, minlength=4097)
    tracemalloc.start()
    filled, low = bins.complete(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(t for _, t in filled) == low and peak < 60e6


def _check_packing(got, rows, window):
    tok = Tokenizer.from_file(default_tokenizer())
    want = []
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, k * window, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[at : at + window] for at in range(0, len(ids), window))]
    assert sorted((tuple(r)[:5] for r in got), key=_key) == sorted(want, key=_key)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    return len(held)


def test_packing_places_each_piece_once(docs, rows, empty):
    got = packing.pack(docs, default_tokenizer()).collect()
    total = sum(r.length for r in got)
    assert _check_packing(got, rows, packing.WINDOW) == -(-total // packing.WINDOW)
    assert packing.pack(empty, default_tokenizer()).collect() == []


def test_packing_in_small_windows_is_the_best_there_is(docs, rows):
    got = packing.pack(docs, default_tokenizer(), window=40, keep_ids=True).collect()
    counts = Counter(r.length for r in got)
    filled, low = bins.complete(np.array([counts[n] for n in range(41)]))
    assert low <= _check_packing([(*r[:5], *r[6:]) for r in got] and [r for r in got], rows, 40) == sum(t for _, t in filled)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_packing_one_length_over_many_tasks(spark):
    """90 % of all pieces have one length; their numbers come from counts by task, not from one sort."""
    df = spark.range(0, 4000, numPartitions=16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "a b c").otherwise(F.repeat(F.lit("a "), (F.col("id") % 97).cast("int"))).alias("text"))
    got = packing.pack(df, default_tokenizer(), window=64).collect()
    assert _check_packing(got, [tuple(r) for r in df.collect()], 64) == -(-sum(r.length for r in got) // 64)


def test_packing_query_over_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_best_fit"](spark, SMALL).collect()
    assert _check_packing(got, rows, 4096) == -(-sum(r.length for r in got) // 4096)


# Manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _manifest(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text), level by level."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([_h(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for lang in langs}
    trees = {lang: levels([_leaf(r) for r in rs]) for lang, rs in held.items()}
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for k, r in enumerate(held[lang]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h, siblings = _leaf((*r[:3], r[3] + 1, r[4]) if hit else r), ""
            for tree, pos in ((trees[lang], k), (top, place)):
                for nodes in tree[:-1]:
                    run, slot = nodes[pos // arity * arity :][:arity], pos % arity
                    siblings += "".join(run[:slot] + run[slot + 1 :])
                    h, pos = _h(*run[:slot], h, *run[slot + 1 :]), pos // arity
            out.append((r[0], _leaf(r), trees[lang][-1][0], top[-1][0], _h(siblings), h, h == top[-1][0]))
    return sorted(out, key=_key)


def _proved(docs, arity=2):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = merkle.manifest(docs, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, arity)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.excised(F.col("path")), 256), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=_key)


def test_manifest_matches_hashing_level_by_level(docs, empty):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert _proved(docs) == _manifest(rows)
    assert _proved(empty) == []
    one = docs.filter("doc_id = 3")
    assert _proved(one) == _manifest([r for r in rows if r[0] == 3])


@pytest.mark.parametrize("arity, levels, few", [(2, 2, 10_000), (3, 2, 0), (5, 1, 0)])
def test_manifest_of_any_arity_in_small_blocks(spark, monkeypatch, arity, levels, few):
    """Several rounds of blocks, one language with most rows, many with few, rows that repeat; the second way of joining roots."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "FEW_GROUPS", few)
    r = random.Random(arity)
    rows = [(k, "s", "hot" if k % 3 else r.choice([None, "", "a", "b", "é", "z" * 9]), r.choice([None, k]), f"t{k}") for k in range(230)]
    rows += rows[:5] + [(None, None, "a", None, None), (None, None, "a", None, None), (None, "", "a", 0, "")] + [(7, "s", "hot", 1, "same id")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert _proved(df, arity) == _manifest(rows, arity)


def test_rows_of_one_language_and_equal_rows_are_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(6000).select(F.lit("one").alias("group"), F.lit(1).alias("doc_id"), F.lit("x").alias("leaf"))
        got = merkle.numbered(rows, ["doc_id", "leaf"])
        assert got.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.max("size")).first()[:] == (6000, 0, 5999, 6000)
        spread = merkle.stage.written(rows, "test").withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("group", "doc_id", "leaf", "_tie")
        assert spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_manifest_query_matches_its_sql(spark):
    con = oracle.connect(SMALL)
    assert oracle.compare(spark, con, "op12", queries.QUERIES["op12_manifest"], queries.ORACLE_SQL["op12_manifest"], SMALL) == ""


# Runs


def _brute(w, least=6, times=4):
    out, seen = [], set()
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p) and (i, j + p) not in seen:
                seen.add((i, j + p))
                out.append((i, j + p, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _sequence(r):
    a = r.choice([1, 2, 2, 3, 4, 30])
    w = [r.randrange(a) for _ in range(r.randrange(40))]
    for _ in range(r.randrange(4)):
        period = [r.randrange(a) for _ in range(r.randint(1, 6))]
        w[(at := r.randint(0, len(w))) : at] = (period * r.randint(2, 7))[: r.randint(1, 40)]
    return w


def test_runs_are_those_of_trying_every_period():
    r, found = random.Random(0), 0
    for k in range(4000):
        w = _sequence(r)
        want = _brute(w)
        found += len(want)
        assert lyndon.runs([str(x) for x in w]) == want, w
        if k % 4 == 0:
            assert sorted(lyndon.runs_of(w, 2, 2)) == sorted(_brute(w, 2, 2)), w
    assert found > 2000


def test_lyndon_ends_are_the_next_smaller_suffixes():
    r = random.Random(4)
    for _ in range(500):
        w = _sequence(r)
        want = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) for i in range(len(w))]
        assert lyndon.lyndon_ends(w, lyndon.Extensions(w).forward) == want


def test_extensions_agree_with_comparing():
    r = random.Random(5)
    for _ in range(200):
        w = (_sequence(r) * 3)[:90]
        ext = lyndon.Extensions(w)
        for _ in range(20):
            i, j = sorted(r.sample(range(len(w) + 1), 2)) if w else (0, 0)
            if i == j:
                continue
            assert ext.forward(i, j) == next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
            assert ext.backward(i, j) == next((k for k in range(i) if w[i - 1 - k] != w[j - 1 - k]), i)


def test_words_decide_where_hashes_meet(monkeypatch):
    """With a modulus of 7 hashes meet all the time; what is reported is a run all the same."""
    monkeypatch.setattr(lyndon, "_P", 7)
    r = random.Random(6)
    for _ in range(800):
        w = _sequence(r)
        assert set(lyndon.runs_of(w)) <= set(_brute(w))


def test_stretches_left_out_hold_no_run():
    r = random.Random(7)
    for _ in range(2000):
        w = _sequence(r)
        parts = lyndon.stretches(np.array(w, np.int64))
        for s, e, _ in _brute(w):
            assert any(a <= max(0, s - 1) and min(len(w), e + 1) <= b for a, b in parts), w


@pytest.mark.parametrize("words", [["a"] * 60_000, ["a", "b"] * 30_000, [str(k % 20_000) for k in range(100_000)], [str(k * k % 9973) for k in range(100_000)]])
def test_long_texts_take_little_more_than_linear_time(words):
    import time

    start = time.process_time()
    lyndon.runs(words)
    assert time.process_time() - start < 20


def _expected(i, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = _brute(w)
    best = max(found, key=lambda x: (Fraction(x[1] - x[0], x[2]), -x[0], -x[2]), default=None)
    keep = [True] * n
    for s, e, p in found:
        keep[s + p : e] = [False] * (e - s - p)
    one = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    return i, len(found), *one, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest()


def test_run_query_on_odd_rows_and_the_tables(spark, docs, rows, empty, tmp_path):
    docs.drop("collapsed").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=_key) == sorted((_expected(i, t) for i, t in rows), key=_key)
    assert runs.periodic_runs(empty).count() == 0
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len((r.text or "").split()) < 400]
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_runs"](spark, SMALL).collect()}
    assert all(found[i] == _expected(i, t) for i, t in table) and sum(found[i][1] > 0 for i, _ in table) > 5


def test_collapsed_text_has_each_run_once(spark):
    rows = [(1, "x " + "spam ham " * 9 + "y"), (2, "\x1c a b c d"), (3, None), (4, "a　a　a a a a a a a")]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].collapsed == "x spam ham y" and [tuple(x) for x in got[1].runs] == [(1, 18, 2)]
    assert got[2].collapsed == "\x1c a b c d" and got[3].collapsed == "" and got[3].runs == []
    assert got[4].collapsed == "a　a　a a"


def test_the_media_hash_is_of_what_was_stored(spark):
    """An image put in another's place between writing and reading is what the hash is of."""
    from lectern.llm import op6_media as media

    docs = spark.createDataFrame([(1, "ab" * 900), (2, "the quick brown fox " * 90)], "doc_id long, text string")
    stored = media.with_tiles(media.store_media(docs)).collect()
    one, two = sorted(stored)
    swapped = spark.createDataFrame([(1, one.n_bytes, two.media, one.tile)], "doc_id long, n_bytes long, media binary, tile binary")
    honest = spark.createDataFrame([tuple(two)], swapped.schema)
    got, want = media.features(swapped).first(), media.features(honest).first()
    assert got.feature.split(";")[0] == want.feature.split(";")[0] == f"dhash={media.difference_hash(media.decode(bytes(two.media))):016x}"
    assert got.media_sha256 == want.media_sha256 and got.feature != want.feature
