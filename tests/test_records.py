"""Authors, metadata, evaluation, plans and sinks on worked examples."""

import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import metadata as D
from lectern.operators import authors as U
from lectern.operators import evaluation as E
from lectern.operators import health as H
from lectern.operators import quality as Q
from lectern.sources import cache, configs, reports
from lectern.sources.sqlite import sqlite_table

ATOM = "text string, author string, role string, segment int, is_continuation boolean, pages array<int>"


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _tagged(spark, *atoms):
    return spark.createDataFrame([("d", [(*a, [1]) if len(a) == 5 else a for a in atoms])], f"doc_id string, atoms array<struct<{', '.join(p.replace(' ', ':', 1) for p in ATOM.split(', '))}>>")


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("gazete", "Yazan: Ali Veli", ("Ali Veli", "köşe yazarı", {})),
        ("press_clip", "Ayşe Kaya — Hürriyet, 3. sayfa", ("Ayşe Kaya", "muhabir", {})),
        ("gazete", "Ayşe Kaya geldi", None),
        ("onerge", "Konya Milletvekili Ahmet Yılmaz ve 14 arkadaşının teklifi", ("Ahmet Yılmaz", "milletvekili", {"constituency": "Konya", "co_signers_count": "14"})),
        ("kanun_teklifi", "(İmza: AHMET YILMAZ, MEHMET KAYA)", ("AHMET YILMAZ", "imzacı", {"signatories": "AHMET YILMAZ, MEHMET KAYA"})),
        ("tutanak", "AHMET YILMAZ (İstanbul) — Sayın", ("AHMET YILMAZ", "milletvekili", {"constituency": "İstanbul"})),
        ("pdf_report", "Yazan: Ali Veli", None),
        ("gazete", None, None),
        ("gazete", "x" * 200 + " Yazan: Ali Veli", None),
    ],
)
def test_detect(spark, kind, text, want):
    r = _one(spark, U.detect(F.lit(kind), F.lit(text).cast("string")))
    assert (r and (r.author, r.role, r.extra)) == want


def test_pack_authors_splits_at_a_change_once_there_is_enough(spark):
    rows = U.pack_authors(_tagged(spark, ("A" * 600, "Alice", "x", 1, False), ("b", "Bob", None, 2, False)), 500, 1000).orderBy("chunk").collect()
    assert [(r.author, r.segment_indices) for r in rows] == [("Alice", [1]), ("Bob", [2])]
    (both,) = U.pack_authors(_tagged(spark, ("aa", "Alice", "x", 1, False), ("bbb", "Bob", None, 2, False)), 500, 1000).collect()
    assert (both.author, both.author_role, both.authors_in_chunk, both.text) == ("Bob", None, ["Alice", "Bob"], "aa\n\nbbb")


def test_pack_authors_names_who_goes_on(spark):
    rows = U.pack_authors(_tagged(spark, ("a" * 9, "Alice", "bakan", 1, False), ("c" * 9, "Alice", "bakan", 1, True), ("d", "Alice", "bakan", 1, True)), 5, 12).orderBy("chunk").collect()
    assert [r.text for r in rows] == ["a" * 9, "[Alice (bakan) devam ediyor]\n" + "c" * 9 + "\n\nd"]
    assert [r.starts_mid_segment for r in rows] == [False, True]
    assert U.pack_authors(_tagged(spark), 5, 12).count() == 0


def test_pack_authors_without_authors(spark):
    (r,) = U.pack_authors(_tagged(spark, ("a", None, None, 0, True, None), ("b", None, None, 0, True, [3, 2, 3])), 5, 12).collect()
    assert (r.author, r.authors_in_chunk, r.pages, r.page, r.starts_mid_segment, r.text) == (None, [], [2, 3], 2, False, "a\n\nb")


def test_pack_pages(spark):
    atoms = [("aa", [4, 1]), ("bb", [2]), ("cccc", []), ("d", None)]
    df = spark.createDataFrame([(1, atoms)], "doc_id int, atoms array<struct<text:string,pages:array<int>>>")
    rows = U.pack_pages(df, 2, 6).orderBy("chunk").collect()
    assert [(r.text, r.page, r.pages) for r in rows] == [("aa\n\nbb", 1, [1, 2, 4]), ("cccc", None, []), ("d", None, [])]


def test_tag_chunks_carries_authors_over_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "önce"), (1, 1, "Yazan: Ali Veli\n\nab"), (1, 2, "cd"), (2, 0, "x")], "doc_id int, chunk int, text string")
    rows = {(r.doc_id, r.chunk): r for r in U.tag_chunks(chunks, U.byline).collect()}
    assert [(rows[k].author, rows[k].starts_mid_segment, rows[k].segment_indices) for k in sorted(rows)] == [(None, False, [0]), ("Ali Veli", False, [1]), ("Ali Veli", True, [1]), (None, False, [0])]
    assert rows[1, 1].text == "Yazan: Ali Veli\n\nab"
    first = U.tag_chunks(chunks, U.byline, U.speaker(F.lit("BAŞKAN — x"))).filter("chunk = 0 and doc_id = 1").first()
    assert (first.author, first.author_role, first.starts_mid_segment) == ("BAŞKAN", "başkan", True)


def test_press(spark):
    none = F.lit(None).cast("string")
    head = _one(spark, U.press_header(F.lit("M"), none, F.lit(""), none))
    assert head == "Gazete: M | Tarih: ? | Yazar: Bilinmiyor | Başlık: \n"


def _map(**kv):
    return F.create_map(*[F.lit(x).cast("string") for p in kv.items() for x in p]) if kv else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"gazete": "M", "tarih": "1997-01-02"}, {"gazete": "M", "tarih": "1997-01-02", "source_name": "M", "date": "1997-01-02", "year": "1997"}),
        ({"yazar": "A", "author": "B", "year": "5", "date": "1997"}, {"yazar": "A", "author": "B", "year": "5", "date": "1997"}),
        ({"date": "?", "konular": None}, {"date": "?"}),
        ({}, {}),
    ],
)
def test_canonical(spark, given, want):
    once = D.canonical(_map(**given))
    assert _one(spark, once) == want and _one(spark, D.canonical(once)) == want


def test_canonical_of_null(spark):
    assert _one(spark, D.canonical(F.lit(None).cast("map<string,string>"))) is None


def test_merged(spark):
    m = D.merged(_map(author="", page="3", topics="t", x="own"), _map(date="1999-05-01", topics="doc", period=None), _map(author="A", author_role="r"), _map(x="no", y="yes", page="9"))
    assert _one(spark, m) == {"author": "A", "author_role": "r", "page": "3", "topics": "doc", "date": "1999-05-01", "year": "1999", "x": "own", "y": "yes"}
    assert _one(spark, D.merged(_map(), _map(year="1999"), _map(), _map())) == {}


def test_hashes(spark, tmp_path):
    data = bytes(range(256)) * 5000
    (tmp_path / "a.bin").write_bytes(data)
    r = spark.read.format("binaryFile").load(str(tmp_path)).select(D.file_hash(F.col("content")).alias("whole"), D.fast_file_hash(F.col("content"), F.col("length")).alias("fast")).first()
    assert r.whole == hashlib.sha256(data).hexdigest()
    assert r.fast == hashlib.sha256(data[: 1 << 20] + str(len(data)).encode()).hexdigest()[:32]
    assert _one(spark, D.text_hash(F.lit(None).cast("string"))) == hashlib.sha256(b"").hexdigest()[:32]


def test_filter_years():
    assert D.filter_years({"$and": [{"year": {"$eq": 1996}}, {"$or": [{"year": {"$eq": 1997}}, {"year": {"$gte": 1}}]}, {"author": {"$eq": "x"}}]}) == ["1996", "1997"]
    assert D.filter_years(None) == []


def test_by_matcher(spark):
    golden = spark.createDataFrame(
        [
            (1, [("d", 2), ("d", 3)], None, None, None, None), (2, None, [("d", 50, 150)], None, None, None), (3, None, None, ["a b"], None, ["d_1", "d_9"]),
            (4, None, None, None, [7], ["zz"]), (5, None, None, None, None, None), (6, [], [], [], None, []),
        ],
        "query_id int, relevant_pages array<struct<document_id:string,page:int>>, gold_evidence_spans array<struct<document_id:string,char_start:int,char_end:int>>, excerpts array<string>, relevant_kayit_nos array<int>, relevant_chunk_ids array<string>",
    )
    hits = [(1, 1, "d_0", "d", None, None, [1, 2], "t"), (1, 2, "d_1", "d", None, None, [3], "t"), (1, 3, "d_2", "d", None, None, [4], "t")]
    hits += [(2, 1, "d_0", "d", 0, 100, None, "t"), (2, 2, "d_1", "d", 100, 200, None, "t")]
    hits += [(3, 1, "d_0", "d", None, None, None, "x"), (3, 2, "d_1", "d", None, None, None, "a b c")]
    hits += [(4, 1, "007_3", "7", None, None, None, "t")]
    got = spark.createDataFrame(hits, "query_id int, rank int, chunk_id string, document_id string, char_start int, char_end int, pages array<int>, text string")
    rows = E.by_matcher(got, golden, 3).collect()
    m = {(r.query_id, r.metric): r.value for r in rows}
    assert {r.query_id: r.matcher for r in rows} == {1: "page_overlap", 2: "span_overlap", 3: "token_overlap+chunk_id", 4: "kayit_no", 5: "none", 6: "chunk_id"}
    assert (m[1, "precision"], m[1, "recall"], m[1, "mrr"], m[1, "ndcg"]) == (pytest.approx(2 / 3), 1.0, 1.0, pytest.approx(1.0))
    assert (m[2, "precision"], m[2, "recall"], m[2, "hit_rate"], m[2, "ndcg"], m[2, "evidence_coverage"]) == (pytest.approx(2 / 3), 1.0, 1.0, 0.0, 1.0)
    assert (m[3, "recall"], m[3, "mrr"], m[3, "token_recall"], m[3, "token_precision"]) == (0.5, 0.5, 1.0, 0.5)
    assert m[4, "precision"] == pytest.approx(1 / 3) and m[4, "mrr"] == 1.0
    assert m[5, None] is None and m[6, "recall"] == 0.0


def test_report_and_fixture(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    r = E.report_averages(rows, ["a", "b"]).first()
    assert (r.a, r.b, r.a_shown, r.b_shown) == (1.0, None, "1.00", "—")
    assert [_one(spark, E.regression_mark(F.lit(x).cast("boolean"))) for x in (True, False, None)] == ["✗", "✓", "—"]


def test_plan_keeps_what_is_usable(spark):
    text = {"intent": "odd", "resources": [{"collection": " c ", "mode": "sequential", "priority": 2, "query_drafts": [{"text": " q ", "top_k": -1}, {"text": None}]}, {"collection": "d", "query_drafts": []}, 7, {"query_drafts": [{"text": "q"}]}]}
    p = _one(spark, H.plan(F.lit(json.dumps(text))))
    assert (p.intent, p.query_type, p.reasoning) == ("unknown", "fact", "")
    assert [(r.collection, r.mode, r.priority, [(d.text, d.top_k) for d in r.query_drafts]) for r in p.resources] == [("c", "sequential", 2, [("q", 5)])]
    for bad in ("no json", "{}", None, '{"resources": 5}', '{"resources": null}'):
        assert _one(spark, H.plan(F.lit(bad).cast("string"))).resources == []


def test_parity(spark):
    chunks = spark.createDataFrame([("1_0",), ("1_1",), ("2_0",), ("x_0",)], "chunk_id string")
    parents = spark.createDataFrame([(1,)], "document_id long")
    r = H.parent_parity("p", chunks, parents).first()
    assert (r.ok, r.total, r.orphans) == (False, 4, 2)
    r = H.parent_parity("p", chunks.limit(0), parents).first()
    assert (r.ok, r.total, r.orphans) == (True, 0, 0)


def test_sqlite_table(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "my t" (KAYIT_NO INTEGER, BASLIK TEXT, oran REAL, veri BLOB)')
        con.executemany('INSERT INTO "my t" VALUES (?, ?, ?, ?)', [(k, None if k % 5 == 0 else f"b{k}", k / 2, bytes([k % 256])) for k in range(1000)])
        con.execute('DELETE FROM "my t" WHERE KAYIT_NO BETWEEN 300 AND 700')
        con.execute("CREATE TABLE empty (a INTEGER)")
    df = sqlite_table(spark, path, "my t", 100)
    rows = {r.KAYIT_NO: r for r in df.collect()}
    assert df.rdd.getNumPartitions() == 10 and len(rows) == 599 and rows[5].BASLIK is None and rows[7].BASLIK == "b7" and rows[7].oran == 3.5 and bytes(rows[7].veri) == b"\x07"
    assert sqlite_table(spark, path, "empty").count() == 0


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    entry = lambda *ids: spark.createDataFrame([(i, f"q{i}") for i in ids], "id string, query string")
    reports.append_golden(entry("a", "b"), f"{root}/golden")
    reports.append_golden(entry("b", "c"), f"{root}/golden")
    assert sorted(r.id for r in spark.read.json(f"{root}/golden").collect()) == ["a", "b", "c"]
    calls = []

    def compute(df):
        calls.append(sorted(r.h for r in df.collect()))
        return df.select("h", F.upper("h").alias("up"))

    rows = lambda *hs: spark.createDataFrame([(h,) for h in hs], "h string")
    cache.cached(rows("x", "x", "y"), "h", f"{root}/cache", compute)
    out = cache.cached(rows("y", "z", None), "h", f"{root}/cache", compute)
    assert calls == [["x", "y"], ["z"]] and sorted(r.up for r in out.collect()) == ["Y", "Z"]
    doc = spark.createDataFrame([("a/b", "c1", "done", 5, 2, ["w"])], "document_id string, collection string, status string, timings int, chunk int, warnings array<string>")
    reports.write_document_reports(doc, f"{root}/reports")
    reports.write_document_reports(doc, f"{root}/reports")
    assert spark.read.json(f"{root}/reports").filter("collection = 'c1'").count() == 2
    path = reports.write_named(doc, root)
    assert spark.read.json(path).count() == 1


def test_research_report(spark):
    src = "array<struct<document_type:string,document_id:string,source_name:string,date:string,author:string,title:string,distance:double>>"
    row = spark.createDataFrame([([("gazete", "7", "M", None, "A", "T", 0.25), (None, None, None, None, None, None, 1.0)],)], f"s {src}")
    text = row.select(reports.research_report(F.lit(" "), F.lit("ne oldu"), F.lit("2026-01-01T00:00:00"), F.lit("m"), F.lit(40), F.lit(1.25), F.lit(""), F.col("s")).alias("x")).first().x
    assert text.startswith("---\nquery: 'ne oldu'\ntimestamp: 2026-01-01T00:00:00\nmodel: m\nk: 40\nelapsed_seconds: 1.3\n---\n\n_(boş yanıt)_\n\n## Kaynaklar\n\n")
    assert text.endswith("1. **[gazete#7]** M | ? | A — T  _(d=0.250)_\n2. **[?#?]** ? | ? | ?  _(d=1.000)_\n")
    assert _one(spark, reports.artifact_name(F.lit("/a/b.c/x.y.pdf"), F.lit("0123456789"))) == "x.y__01234567"


def test_configs(spark):
    pytest.importorskip("yaml")
    s = configs.settings("retrieval: {top_k: 5, distance_threshold: 1, other: x}\nbudgets: {fact: {retrieval: 2, reserve: 1, fetch_k: 9}}")
    assert (s.retrieval.top_k, s.retrieval.distance_threshold, s.retrieval.fetch_k, s.budgets) == (5, 1.0, 50, {"fact": (2, 1, 9)})
    rows = configs.collections(spark, "models: {m: {dim: 8}}\ncollections: {a: {model: m, document_type: gazete, weight: 2}, b: {}}").orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("a", "m", "gazete", 8, 2.0), ("b", None, "custom", None, 1.0)]
    with pytest.raises(ValueError, match="unknown model"):
        configs.collections(spark, "collections: {a: {model: q}}")
    assert [_one(spark, configs.heading(F.lit(a), F.lit(" t "))) for a in ("heading_3", "section_heading", "text")] == ["### t", "# t", "t"]


def test_inline_texts(spark):
    df = spark.createDataFrame([("a", {"dokuman_metni": "t"}), ("b", {}), ("c", None)], "document_id string, metadata map<string,string>")
    ok, bad = configs.inline_texts(df)
    assert [r.document_id for r in ok.collect()] == ["a"] and sorted(r.document_id for r in bad.collect()) == ["b", "c"]


def test_verdict_fails_open(spark):
    def v(output, answer="a"):
        return _one(spark, H.verdict(F.lit(output).cast("string"), F.lit(answer)))

    bad = v('{"passes": false, "issues": ["i"], "corrected_answer": "b"}')
    assert (bad.passes, bad.ran, bad.issues, bad.corrected_answer) == (False, True, ["i"], "b")
    assert v('{"passes": false, "corrected_answer": " a "}').corrected_answer is None
    assert v('{"passes": true, "corrected_answer": "b"}').corrected_answer is None
    assert v("{}").passes and v("{}").ran and v("{}").issues == []
    for broken in ("nothing", None, "[1]"):
        assert (v(broken).passes, v(broken).ran) == (True, False)


def test_judged(spark):
    j = _one(spark, E.judged(F.lit('```json\n{"faithfulness": 5, "relevance": 4, "rationale": "r"}\n```'), F.lit('{"faithfulness": 3, "relevance": 3.5}')))
    assert (j.faithfulness, j.relevance, j.groundedness, j.rationale, j.noisy) == (4.0, 3.75, 0.0, "r", True)
    broken = _one(spark, E.judged(F.lit("x"), F.lit(None).cast("string")))
    assert (broken.faithfulness, broken.noisy) == (0.0, False)


def test_layers_keep_queries_without_hits(spark):
    golden = spark.createDataFrame([(1, "1997", ["a", "b"], True, "minutes", 1997), (2, "x", None, False, "both", None)], "query_id int, query string, relevant_ids array<string>, is_minutes boolean, expected_source string, expected_year int")
    got = spark.createDataFrame([(1, 1, "a", 1.9), (1, 2, "b", None), (1, 3, "c", 0.1)], "query_id int, rank int, document_id string, distance double")
    rows = {r.query_id: r for r in E.layers(got, golden, 5).collect()}
    assert (rows[1].recall, rows[1].context_coverage, rows[1].routing_acc, rows[1].date_acc) == (1.0, 0.5, 1.0, 1.0)
    assert (rows[2].recall, rows[2].mrr, rows[2].context_coverage) == (0.0, 0.0, 1.0)


def test_window_bench_in_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(m, k, [float(k == j) + 0.1 * j for j in range(6)]) for m in (1, 2) for k in range(6)], "max_tokens int, chunk long, vec array<double>")
    queries = chunks.filter("max_tokens = 1 and chunk < 5").selectExpr("chunk as query_id", "vec as qvec")
    relevant = spark.createDataFrame([(0, 0), (1, 99)], "query_id long, chunk long")
    whole = sorted(map(tuple, E.window_bench(queries, chunks, relevant).collect()))
    assert whole[0][1] == pytest.approx(0.8)  # a query whose truth no window holds scores 0
    monkeypatch.setattr(E, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, E.window_bench(queries, chunks, relevant).collect())) == whole


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("kIsa BAġBAKAN gelDİler", (4, 1, 2, 1)),
        ("kitap kalem evler arabalar", (4, 0, 4, 2)),
        ("BAiT wexler İstanbul KITAP ev", (5, 1, 2, 2)),
        ("a1b2", (2, 0, 0, 0)),
        ("", (0, 0, 0, 0)),
        (None, (0, 0, 0, 0)),
        ("ab" * 200_000 + "q" + " kalem" * 3, (4, 0, 3, 3)),
    ],
)
def test_ocr_signals(spark, text, want):
    counts = Q.ocr_signals(F.col("t"))
    df = spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in counts.items()])
    assert tuple(df.first()) == want
    assert df.select(*Q.ocr_ratios(*[F.col(k) for k in counts]).values()).first()[0] == (round(want[1] / want[0], 4) if want[0] else 0.0)
