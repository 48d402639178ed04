"""Expected values of single operators, and every query against its SQL."""

import glob
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectern import providers
from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.operators import filters as P
from lectern.operators import manifest as S
from lectern.operators import metrics as M
from lectern.operators import quality as Q
from lectern.operators import retrieval as R
from lectern.plans import catalog
from lectern.sources import ingest
from lectern.streaming import incremental
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "precision", "recall", "hit_rate", "mrr", "ndcg"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("text", "want"), [("İSTANBUL", "istanbul"), ("IŞIK", "ışık"), ("a, b!", "a b")])
def test_normalize_tr(spark, text, want):
    assert _one(spark, T.normalize_tr(F.lit(text))) == want


@pytest.mark.parametrize(
    ("text", "dates", "years"),
    [("2026-04-07 günü", ["2026-04-07"], []), ("07.04.2026", ["2026-04-07"], []), ("7 NİSAN 2026", ["2026-04-07"], []), ("1997 yılındaki yazı", [], [1997]), ("5 Subat 1999 ve 2001", ["1999-02-05"], [2001]), ("2026-4-7 ve 7/4/2026", ["2026-04-07"], [])],
)
def test_dates(spark, text, dates, years):
    assert _one(spark, T.exact_dates(F.lit(text))) == dates and _one(spark, T.bare_years(F.lit(text))) == years


def test_iso(spark):
    assert _one(spark, T.iso_prefix(F.lit("2026-04-07T10:00:00"))) == "2026-04-07"
    assert _one(spark, T.iso_prefix(F.lit(None).cast("string"))) == "" and _one(spark, T.iso_year(F.lit("abcd"))) == 0


def test_hints_and_resolution(spark):
    hint = lambda s: _one(spark, P.has_hints(F.lit(s), []))
    assert hint("1996 yılında ne oldu?") and not hint("Kardak krizi nedir")
    w = spark.createDataFrame([("Recep Tayyip Erdoğan",), ("Nobody",)], "wanted string")
    v = spark.createDataFrame([("BAŞBAKAN RECEP TAYYİP ERDOĞAN",), ("RECEP",)], "label string")
    assert [r.label for r in P.resolve_names(w, v).collect()] == ["BAŞBAKAN RECEP TAYYİP ERDOĞAN"]


def test_author_filter_takes_upper_case(spark):
    df = spark.createDataFrame([(1, "Deniz Baykal"), (2, "DENİZ BAYKAL"), (3, "x")], "id int, author string")
    assert {r.id for r in P.apply(df, P.Criteria(author="Deniz Baykal")).collect()} == {1, 2}
    assert P.predicate(P.Criteria()) is None
    assert P.mask(P.Criteria(year=1, period=2, source_name="s"), {"year", "period"}) == P.Criteria(year=1, period=2)


def _hits(spark, ids, rel):
    rows = [("q", k + 1, int(x in rel)) for k, x in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id string, rank int, hit int"), spark.createDataFrame([("q", len(rel))], "query_id string, n_rel int")


@pytest.mark.parametrize(
    ("ids", "rel", "k", "want"),
    [("ABC", "AC", 3, (2 / 3, 1.0, 1, 1.0)), ("ABC", "ACD", 1, (1.0, 1 / 3, 1, 1.0)), ("ABC", "C", 2, (0.0, 0.0, 0, 0.0)), ("ABC", "C", 3, (1 / 3, 1.0, 1, 1 / 3)), ("AA", "A", 2, (1.0, 2.0, 1, 1.0)), ("", "A", 3, (0.0, 0.0, 0, 0.0))],
)
def test_rank_metrics(spark, ids, rel, k, want):
    r = M.rank_metrics(*_hits(spark, ids, rel), k).first()
    assert (r.precision, r.recall, r.hit_rate, r.mrr) == pytest.approx(want)


def test_ndcg(spark):
    hits, _ = _hits(spark, "AXYZ", "A")
    assert M.rank_metrics(hits, spark.createDataFrame([("q", 5)], "query_id string, n_rel int"), 10).first().ndcg == pytest.approx(0.339160211116)


def test_iou(spark):
    f = lambda *s: _one(spark, M.iou(*map(F.lit, s)))
    assert f(0, 100, 50, 150) == pytest.approx(1 / 3) and f(25, 75, 0, 100) == 0.5


def test_coverage(spark):
    got = spark.createDataFrame([("q", "d", 1, 0, 60), ("q", "d", 2, 40, 100)], "query_id string, document_id string, rank int, char_start int, char_end int")
    gold = spark.createDataFrame([("q", "d", 1, 0, 100)], "query_id string, document_id string, golden_id int, char_start int, char_end int")
    assert M.evidence_coverage(got, gold, 2).first().coverage == 1.0 and M.evidence_coverage(got, gold, 1).first().coverage == 0.6


def test_greedy_pack(spark):
    docs = spark.createDataFrame([(1, "aa\nbb\ncccc\nd"), (2, ""), (3, None)], "doc_id int, text string")
    assert [r.text for r in C.greedy_pack(docs, 2, 6).orderBy("chunk").collect()] == ["aa\n\nbb", "cccc", "d"]


def test_spans_are_found_in_order(spark):
    docs = spark.createDataFrame([(1, "ab ab cd")], "doc_id int, text string")
    pieces = spark.createDataFrame([(1, 0, "ab"), (1, 1, "ab"), (1, 2, "zz"), (1, 3, "cd")], "doc_id int, chunk int, piece string")
    assert [tuple(r) for r in C.spans(docs, pieces).orderBy("chunk").collect()] == [(1, 0, 0, 2), (1, 1, 3, 5), (1, 3, 6, 8)]


def test_speakers(spark):
    who = lambda s: _one(spark, C.speaker(F.lit(s)))
    assert tuple(who("AHMET YILMAZ (İstanbul) — Sayın Başkan")) == ("AHMET YILMAZ", "milletvekili", "İstanbul", 1.0)
    assert tuple(who("BAŞKAN — Teşekkür")) == ("BAŞKAN", "başkan", None, 1.0) and who("düz metin") is None
    assert who("BAŞKANVEKİLİ — Buyurun").author == "BAŞKANVEKİLİ"
    m = who("DIŞİŞLERİ BAKANI VE BAŞBAKAN YARDIMCISI ALİ KAYA — Sayın")
    assert (m.author, m.confidence) == ("ALİ KAYA", 1.0) and m.role.endswith("ve başbakan yardimcisi")
    assert who("DEVLET BAKANI HASAN GEMİCİ — x").role == "devlet bakani"
    assert who("BAKAN A KAYA (Van) — x") is None and who("ALİ VE KAYA (Van) — x").confidence == 0.5


def test_tag_carries_the_whole_struct(spark):
    rows = [(1, 1, "A", "r"), (1, 2, None, None), (1, 3, "B", None), (1, 4, None, None)]
    t = spark.createDataFrame(rows, "doc int, pos int, a string, r string")
    got = C.tag(t, ["doc"], "pos", F.when(F.col("a").isNotNull(), F.struct("a", "r"))).orderBy("pos").collect()
    assert [(x.tagged.a, x.tagged.r, x.segment) for x in got] == [("A", "r", 1), ("A", "r", 1), ("B", None, 2), ("B", None, 2)]


def test_assembly_budget(spark):
    rows = [("q", 0, k, k, f"d{k}", "c") for k in range(1, 4)]
    df = spark.createDataFrame(rows, "query_id string, priority int, rank int, chunk_id long, document_id string, collection string")
    assert [r.chunk_id for r in R.assemble(df, 2, 1, 12).orderBy("position").collect()] == [1, 2]


AGENT = "query_id string, priority int, rank int, chunk_id long, document_id string, collection string"


def test_expansion_skips_used_documents_and_offers_lost_ones_again(spark):
    first = spark.createDataFrame([("q", 1, 1, 1, "d1", "a"), ("q", 1, 2, 2, "d2", "a")], AGENT)
    spare = [("q", 1, 3, 3, "d3", "a"), ("q", 1, 4, 4, "d2", "a"), ("q", 1, 5, 5, "d4", "a"), ("q", 2, 1, 6, "d4", "b"), ("q", 2, 2, 7, "d3", "b")]
    got = R.expand(first, spark.createDataFrame(spare, AGENT), 1).orderBy("position").collect()
    assert [(r.chunk_id, r.collection) for r in got] == [(3, "a"), (6, "b")]


def test_evidence_bands(spark):
    rows = [(q, 1, k, k, f"d{k}", c) for q, cs in (("few", "a"), ("band", "aa"), ("many", "aaaaaaa"), ("full", "aabb")) for k, c in enumerate(cs)]
    asked = spark.createDataFrame([(q,) for q in ("none", "few", "band", "many", "full")], "query_id string")
    df = spark.createDataFrame(rows, AGENT)
    said = lambda **kw: {r.query_id: (r.action, r.confidence) for r in R.evidence(df, asked, **kw).collect()}
    assert said() == {"none": ("clarify", 0.0), "few": ("expand", 0.4), "band": ("judge", 0.4), "many": ("expand", 0.4), "full": ("answer", 0.85)}
    assert said(band=None)["band"] == ("expand", 0.4)


@pytest.mark.parametrize(
    ("text", "action", "kind"),
    [('x {"sufficient": true, "confidence": 0.9, "action": "answer"} y', "answer", "llm"), ('{"action": "wait"}', "expand", "heuristic"), ("nothing", "expand", "heuristic"), (None, "expand", "heuristic"), ('{"action": "refuse", "missing_aspects": null}', "refuse", "llm")],
)
def test_judgement_falls_back_to_expanding(spark, text, action, kind):
    j = _one(spark, R.judgement(F.lit(text).cast("string")))
    assert (j.action, j.judge_type) == (action, kind) and (kind == "llm" or (j.confidence, j.missing_aspects) == (0.4, ["insufficient_chunks"]))


def test_context_heads_only_what_is_known_and_cuts_both(spark):
    kind = "query_id string, rank int, text string, distance double, source string, date string, period int, author string"
    rows = [("q", 1, "abcdef", 0.1, None, "", None, ""), ("q", 2, "ghijkl", None, "S", None, 20, "A"), ("q", 3, "z", 1.9, None, None, None, None), ("q", 4, "mnop", 0.2, None, None, 0, None)]
    got = R.context(spark.createDataFrame(rows, kind), 20, 1.8, 1000).first()
    assert got.context == "abcdef\n\n---\n\n[S | Dönem 20 | A]\ng\n\n---\n\nmnop" and got.n_chunks == 3
    assert R.context(spark.createDataFrame(rows, kind), 20, 1.8, 7).first().n_chunks == 1


def test_adapters(spark):
    from lectern.sources import adapters

    assert adapters.types() == ["press_clip"]
    with pytest.raises(ValueError):
        adapters.adapter("memo")
    rows = spark.createDataFrame([("a", "press_clip", "", {"dokuman_metni": "one\n\ntwo"}), ("b", "press_clip", "", {}), ("c", "memo", "", {})], "document_id string, document_type string, document_source string, metadata map<string,string>")
    texts, chunks, errors = adapters.parse(rows)
    assert [(t.document_id, t.text) for t in texts.collect()] == [("a", "one\n\ntwo")] and chunks.first().text == "one\n\ntwo"
    assert {(e.document_id, e.error) for e in errors.collect()} == {("b", "no text"), ("c", "unknown type memo")}


def test_validation_rules(spark):
    rows = spark.createDataFrame([(0, "a", "t", "c", "f.pdf"), (1, "a", "t", "c", "http://x/y"), (2, None, "t", "c", ""), (3, "", "t", "c", None), (4, "b", None, "z", "gone.pdf")], "position int, document_id string, document_type string, collection string, document_source string")
    files = spark.createDataFrame([("f.pdf",)], "path string")
    got = {(r.position, r.error) for r in S.validate(rows, ["c"], ["t"], files).collect()}
    assert got == {(1, "duplicate id"), (2, "missing id"), (3, "missing id"), (4, "missing type"), (4, "unknown collection"), (4, "missing source")}
    requests = spark.createDataFrame([("c", []), ("z", ["d"]), (None, None)], "collection string, documents array<string>")
    assert sorted((r.collection or "", r.error) for r in S.request_errors(requests, ["c"]).collect()) == [("", "no documents"), ("", "unknown collection"), ("c", "no documents"), ("z", "unknown collection")]


def test_upsert_of_a_batch_with_repeated_ids(spark):
    old = spark.createDataFrame([("a", "x")], "chunk_id string, text string")
    new = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "w")], old.schema)
    once = ingest.upsert_chunks(old, new)
    assert sorted(map(tuple, ingest.upsert_chunks(once, new).collect())) == sorted(map(tuple, once.collect())) == [("a", "z"), ("b", "w")]


def test_banned_patterns_and_switch(spark):
    f = lambda **kw: _one(spark, P.banned_words(F.lit("Şu APTAL, aptallık!"), ["aptal"], **kw))
    assert f() == ["aptal"] and f(patterns=["aptal[a-z]+"]) == ["aptal", "aptallik"] and f(on=False) == []


def test_latency_and_prefixes_of_a_hot_key(spark):
    import random

    r = random.Random(3)
    vals = [(k, "a" if k % 3 else "b", r.choice([1.0, 2.5, 7.0, r.random() * 50])) for k in range(900)] + [(900, "c", 5.0), (901, "d", None)]
    df = spark.createDataFrame(vals, "i int, k string, v double")
    got = {x.k: x for x in M.latency(df, "k", "v").collect()}
    for key in "abc":
        own = sorted(v for _, k, v in vals if k == key)
        assert [got[key].n, got[key].p50, got[key].p95, got[key].p99] == [len(own), *(own[min(len(own) * p // 100, len(own) - 1)] for p in (50, 95, 99))]
    seen = {x.i: x.seen for x in Q.outliers_so_far(df, "k", "v", "i", block_rows=7).collect()}
    assert seen == {i: sum(k2 == k and v2 is not None for i2, k2, v2 in vals if i2 < i) for i, k, _ in vals}


def test_rrf_last_source_gives_the_distance(spark):
    df = spark.createDataFrame([("q", 0, 1, 7, 0.1), ("q", 1, 2, 7, 0.2)], "query_id string, source_ord int, rank int, chunk_id long, distance double")
    r = R.rrf_sources(df, 5).first()
    assert r.rrf == pytest.approx(1 / 61 + 1 / 62) and r.distance == 0.2


def test_top_k_blocks_agree(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    whole = sorted(tuple(r) for r in R.top_k(q, c, 3).select("query_id", "chunk_id", "rank").collect())
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    assert sorted(tuple(r) for r in R.top_k(q, c, 3).select("query_id", "chunk_id", "rank").collect()) == whole


def test_diff_and_perf(spark):
    m = spark.createDataFrame([("a", "c", "1"), ("b", "c", "1")], "document_id string, collection string, content_hash string")
    i = spark.createDataFrame([("a", "c", "1"), ("b", "c", "2"), ("n", "c", "3")], m.schema)
    assert {r.document_id: r.state for r in S.diff(i, m).collect()} == {"a": "unchanged", "b": "changed", "n": "new"}
    rows = [("c", "done", '{"total_ms":5000,"parse_ms":3000,"embed_ms":0}', '{"ocr_flagged":true}')] + [("c", "done", '{"total_ms":5000,"parse_ms":3000,"embed_ms":1800}', None)] * 3 + [("c", "failed", "{}", None)]
    r = S.perf_trends(spark.createDataFrame(rows, "collection string, status string, perf_json string, quality_json string")).first()
    assert (r.n, r.total_ms, r.embed_ms, r.span_coverage_pct, r.flagged_pct) == (4, 5000.0, 1800.0, 100.0, 25.0)


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"version": "1.0", "collection": "c", "documents": [{"document_id": "a", "document_type": "tutanak", "metadata": {"k": "v"}}, {"document_id": "b"}]}))
    got = ingest.ingest_request(spark, str(tmp_path / "r.json")).orderBy("position").collect()
    assert [(r.document_id, r.collection) for r in got] == [("a", "c"), ("b", "c")] and got[0].metadata == {"k": "v"}
    (tmp_path / "p.csv").write_text("KAYIT_NO,TARIH,BASLIK\n1,07.04.2026,x\n2,bad,\n")
    assert [tuple(r) for r in ingest.press_csv(spark, str(tmp_path / "p.csv")).collect()] == [("1", "2026-04-07", "x"), ("2", "", "")]
    for name, body in (("a.json", [{"id": "1", "query": "q"}]), ("b.json", {"queries": [{"id": "1", "query": "q"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert ingest.golden_set(spark, str(tmp_path / name)).first().query == "q"


def test_chunk_store(spark, tmp_path):
    old = spark.createDataFrame([("a_0", "a", "x", "c1"), ("a_b_0", "a_b", "y", "c2")], "chunk_id string, document_id string, text string, collection string")
    ingest.write_chunks(old, str(tmp_path / "t"))
    read = ingest.collection(spark, str(tmp_path / "t"), "c1")
    assert read.count() == 1 and len(glob.glob(str(tmp_path / "t/collection=*"))) == 2
    new = spark.createDataFrame([("a_0", "a", "z", "c1")], old.schema)
    assert {r.text for r in ingest.upsert_chunks(old, new).collect()} == {"z", "y"}
    assert ingest.delete_document(old, "a").count() == 1 and ingest.delete_document(old, "a", by_prefix=True).count() == 0


def test_manifest_stream_is_idempotent(spark, tmp_path):
    schema = "document_id string, collection string, status string, perf_json string, ingest_time string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "c", "pending", "p", "1"), ("b", "c", "done", "p", "1")], schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.manifest_stream(spark, stream, out, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([("a", "c", "done", None, "2")], schema).coalesce(1).write.mode("append").parquet(src)
    incremental.manifest_stream(spark, spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination()
    got = {r.document_id: (r.status, r.perf_json, r.ingest_time) for r in incremental.current(spark, out).collect()}
    assert got == {"a": ("done", "p", "1"), "b": ("done", "p", "1")}


def test_running_outliers_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("k", 10.0)] * 4, "k string, v double").coalesce(1).write.mode("append").parquet(src)
    q = lambda: incremental.running_outliers(spark.readStream.schema("k string, v double").parquet(src), "k", "v").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    q()
    spark.createDataFrame([("k", 20.0)], "k string, v double").coalesce(1).write.mode("append").parquet(src)
    q()
    assert sorted((r.v, r.outlier) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(10.0, False)] * 4 + [(20.0, True)]


def test_providers(spark):
    df = providers.HashedEmbedder(8).embed(spark.createDataFrame([("a b a",), ("",)], "text string"), "text", "v")
    assert sorted(round(sum(x * x for x in r.v), 5) for r in df.collect()) == [0.0, 1.0]
    assert providers.PatternFilters().extract("1996 yılında 20. dönem")[1] == P.Criteria(year=1996, period=20)
