"""Queries that write a store's own form to the shared folder and read it back."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import functions as F

from lectern.functions import metadata as D
from lectern.functions import text as T
from lectern.plans.registry import query, table
from lectern.sources import adapters, artifacts, cache, ingest, reports, scratch, sqlite


def _docs(spark, d):
    return table(spark, d, "documents")


def _files(parts, path, folders=64):
    """A file for each part, in a stated number of folders however many parts there are."""
    parts.select(F.pmod("part", F.lit(folders)).alias("folder"), "value").write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)


@query(
    "s1_ingest_request",
    """SELECT 'c' || doc_id // 100 AS collection, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS position, 'd' || doc_id AS document_id, lang AS document_type, CASE WHEN doc_id % 3 = 0 THEN 1990 + doc_id % 9 END::INT AS year,
    doc_id % 2 = 0 AS ocr, source AS meta FROM documents WHERE doc_id // 100 % 4 < 3""",
)
def ingest_request(spark, d):
    """Requests of a hundred documents each as JSON files; every fourth has another version and gives nothing."""
    k = F.col("doc_id")
    doc = F.struct(
        F.concat(F.lit("d"), k.cast("string")).alias("document_id"), F.col("lang").alias("document_type"), F.when(k % 3 == 0, (F.lit(1990) + k % 9).cast("int")).alias("year"), (k % 2 == 0).alias("ocr"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
    )
    part = F.floor(k / 100)
    held = _docs(spark, d).groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(k, F.to_json(doc).alias("d")))).alias("ds"))
    version = F.when(F.col("part") % 4 < 3, "1.0").otherwise("2.0")
    listed = F.array_join(F.transform("ds", lambda x: x["d"]), ", ")
    request = F.concat(F.lit('{"version": "'), version, F.lit('", "collection": "c'), F.col("part").cast("string"), F.lit('", "documents": ['), listed, F.lit("]}"))
    path = scratch.place(spark, "requests")
    _files(held.select("part", request.alias("value")), path)
    got = ingest.ingest_request(spark, f"{path}/folder=*")
    return got.select("collection", F.col("position").cast("long").alias("position"), "document_id", "document_type", "year", "ocr", F.col("metadata")["source"].alias("meta"))


@query("s3_press_archive", "SELECT c_custkey::VARCHAR AS KAYIT_NO, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE strftime(DATE '1990-01-01' + (c_custkey % 900)::INT, '%Y-%m-%d') END AS TARIH, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || ', \"' || chr(10) || c_mktsegment END AS BASLIK FROM customer")
def press_archive(spark, d):
    """Dates in three spellings and a bad one, missing titles, and quotes, commas and line ends within a field."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("1990-01-01").cast("date"), (k % 900).cast("int"))
    date = F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 4, "yakında").when(k % 2 == 0, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    title = F.when(k % 3 > 0, F.concat(F.col("c_name"), F.lit(', "\n'), F.col("c_mktsegment")))
    path = scratch.place(spark, "archive")
    table(spark, d, "customer").select(k.alias("KAYIT_NO"), date.alias("TARIH"), title.alias("BASLIK")).write.option("header", True).option("escape", '"').csv(path)
    return ingest.press_csv(spark, path)


@query("s4_sqlite_table", "SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice / 2.0::DOUBLE AS half, md5(o_orderkey::VARCHAR) AS raw FROM orders")
def sqlite_rows(spark, d):
    """A whole table goes to SQLite files in the shared folder, one for each task, and comes back by ranges of row ids."""
    path = scratch.place(spark, "orders-db")
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("name"), (F.col("o_totalprice") / 2).alias("half"), k.cast("string").cast("binary").alias("raw"))
    sqlite.write_tables(rows, path, "orders")
    return sqlite.sqlite_table(spark, path, "orders", range_rows=7_000).withColumn("raw", F.md5("raw"))


@query(
    "s7_golden_set",
    "SELECT 'g' || item_id AS id, text AS query, CASE WHEN item_id % 2 = 0 THEN 1990 + item_id % 9 END::INT AS expected_year, 'b' || item_id AS first_chunk, CASE WHEN item_id % 3 = 0 THEN item_id::INT + 5 END AS span_end FROM benchmark",
)
def golden_set(spark, d):
    """Fixtures of fifty queries each, bare arrays and wrapped ones in turn."""
    k = F.col("item_id")
    span = F.struct(F.lit("d").alias("document_id"), k.cast("int").alias("char_start"), (k + 5).cast("int").alias("char_end"))
    q = F.struct(
        F.concat(F.lit("g"), k.cast("string")).alias("id"), F.col("text").alias("query"), F.when(k % 2 == 0, (F.lit(1990) + k % 9).cast("int")).alias("expected_year"),
        F.array(F.concat(F.lit("b"), k.cast("string"))).alias("relevant_chunk_ids"), F.when(k % 3 == 0, F.array(span)).alias("gold_evidence_spans"),
    )
    held = table(spark, d, "benchmark").groupBy(F.floor(k / 50).alias("part")).agg(F.collect_list(q).alias("queries"))
    body = F.when(F.col("part") % 2 == 0, F.to_json("queries")).otherwise(F.to_json(F.struct("queries")))
    path = scratch.place(spark, "golden")
    _files(held.select("part", body.alias("value")), path)
    got = ingest.golden_set(spark, f"{path}/folder=*")
    return got.select("id", "query", "expected_year", F.col("relevant_chunk_ids")[0].alias("first_chunk"), F.get("gold_evidence_spans", F.lit(0))["char_end"].alias("span_end"))


@query("s14_seeded_sample", "SELECT least(25, count(*)) AS n, true AS again, true AS long_enough, true AS other_seed FROM documents WHERE length(trim(text)) >= 200")
def seeded_sample(spark, d):
    """A sample of 25 is the same for its seed at any partitioning, and another for another seed."""
    chunks = _docs(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    take = lambda df, seed: ingest.seeded_sample(df, 25, seed, 200)
    ids = lambda df: F.concat_ws(",", F.array_sort(F.collect_list("chunk_id")))
    one = take(chunks, 7).agg(F.count("*").alias("n"), ids(chunks).alias("a"), F.coalesce(F.min(F.length(F.trim("text"))) >= 200, F.lit(True)).alias("long_enough"))
    two = take(chunks.repartition(7, "chunk_id"), 7).agg(ids(chunks).alias("b"))
    three = take(chunks, 8).agg(ids(chunks).alias("c"))
    return one.join(F.broadcast(two)).join(F.broadcast(three)).select("n", (F.col("a") == F.col("b")).alias("again"), "long_enough", (F.col("a") != F.col("c")).alias("other_seed"))


@query("k6_document_reports", "SELECT source AS collection, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS n, sum(n_chars) AS n_chars, true AS stamped FROM documents GROUP BY ALL")
def document_reports(spark, d):
    """Reports written in two runs, read back as one set in folders by collection."""
    path = scratch.place(spark, "reports")
    rows = _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("done").alias("status"), "n_chars")
    for half in (0, 1):
        reports.write_document_reports(rows.filter(F.col("document_id") % 2 == half), path)
    got = spark.read.json(path)
    return got.groupBy("collection", "status").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.min(F.col("ingest_time").rlike(r"^\d{4}-\d\d-\d\dT")).alias("stamped"))


@query("k7_artifact_names", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'rapor.v2' ELSE '.gizli' END || '__' || sha256(url)[1:8] AS name FROM pages")
def artifact_names(spark, d):
    source = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a/b/rapor.v2."), (F.col("page_id") % 9).cast("string"))).otherwise("x/.gizli")
    return table(spark, d, "pages").select("page_id", reports.artifact_name(source, D.file_hash(F.col("url").cast("binary"))).alias("name"))


@query(
    "k7_artifacts",
    "SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'rapor' || page_id % 9 ELSE '.gizli' END || '__' || sha256(html)[1:8] || '.md' AS name, md5(html) AS content FROM pages",
)
def artifacts_once(spark, d):
    """Pages written as files in two overlapping writes and read back as one set; a name that is there is not written again."""
    path = scratch.place(spark, "artifacts")
    source = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a/b/rapor"), (F.col("page_id") % 9).cast("string"), F.lit(".html"))).otherwise("x/.gizli")
    rows = table(spark, d, "pages").select("page_id", source.alias("document_source"), F.col("html").alias("text"))
    artifacts.write(rows.filter("page_id % 3 = 0"), path)
    artifacts.write(rows, path)
    return artifacts.read(spark, path).select("name", F.md5("content").alias("content"))


@query("k8_cached", "SELECT n_chars AS key, n_chars * 2 AS value, count(*) AS n, 1::BIGINT AS computed FROM documents GROUP BY n_chars")
def cached(spark, d):
    """Two calls over overlapping rows compute each key once."""
    path = scratch.place(spark, "cache")
    rows = _docs(spark, d).select("doc_id", F.col("n_chars").alias("key"))
    double = lambda x: x.select("key", (F.col("key") * 2).alias("value"))
    cache.cached(rows.filter("doc_id % 3 = 0"), "key", path, double)
    got = cache.cached(rows, "key", path, double).groupBy("key", "value").agg(F.count("*").alias("n"))
    stored = cache.results(spark, path).groupBy("key").agg(F.count("*").alias("computed"))
    # A key that stands in the cache twice would double its rows.
    return got.join(stored, "key").select("key", "value", (F.col("n") / F.col("computed")).cast("long").alias("n"), "computed")


_CUT = "ceil(length(coalesce(text, '')) / {n}.0)::BIGINT"


@query(
    "k8_two_levels",
    f"SELECT doc_id, 700 AS most, {_CUT.format(n=700)} AS pieces, 1::BIGINT AS parsed FROM documents UNION ALL SELECT doc_id, 300, {_CUT.format(n=300)}, 1 FROM documents",
)
def two_levels(spark, d):
    """Two callers at the same time ask for other cuts of the same texts: each text is parsed once, each cut made once."""
    path = scratch.place(spark, "cache")
    rows = _docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    parse = lambda df: df.select("key", "text", F.length("text").alias("n"))
    cut = lambda df, s: df.select("key", "cut_key", F.ceil(F.col("n") / s["most"]).alias("pieces"))

    def call(most: int):
        return cache.two_levels(rows, "key", path, parse, cut, {"most": most, "join": "\n"})

    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(call, (700, 300, 700)))
    parsed = cache.results(spark, f"{path}/parsed").groupBy("key").agg(F.count("*").alias("parsed"))
    cuts = cache.results(spark, f"{path}/cut").groupBy("cut_key").agg(F.count("*").alias("made"))
    out = None
    for most, got in zip((700, 300), made[:2], strict=True):
        once = got.dropDuplicates(["key"]).join(cuts, "cut_key").filter("made = 1").join(parsed, "key")
        part = rows.select("doc_id", "key").join(once, "key").select("doc_id", F.lit(most).alias("most"), "pieces", "parsed")
        out = part if out is None else out.unionByName(part)
    return out


@query("k9_k10_named_report", "SELECT 'eval_report_20200102_030405' AS name, count(*) AS n, sum(n_chars) AS n_chars, 'refused' AS again FROM documents")
def named_report(spark, d):
    """A report under a name with its time; the same name again is refused."""
    root, at = scratch.place(spark, "named"), datetime(2020, 1, 2, 3, 4, 5)
    rows = _docs(spark, d).select("doc_id", "n_chars")
    path = reports.write_named(rows, root, at=at)
    try:
        reports.write_named(rows.limit(1), root, at=at)
        again = "written"
    except Exception:
        again = "refused"
    got = spark.read.json(path).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    return got.select(F.lit(path.rsplit("/", 1)[1]).alias("name"), "n", "n_chars", F.lit(again).alias("again"))


# Each query as it must stand between its quotes, written out, not derived.
_QUOTED = r"""CASE item_id % 4 WHEN 0 THEN '''soru ' || item_id || '''' WHEN 1 THEN '"it''s ' || item_id || '"' WHEN 2 THEN '''a"b\''c ' || item_id || '''' ELSE '''d\\e\n' || item_id || '\x01''' END"""


@query(
    "k11_research_reports",
    rf"""SELECT item_id, '19990102-0304_' || CASE item_id % 4 WHEN 0 THEN 'soru-' WHEN 1 THEN 'it-s-' WHEN 2 THEN 'a-b-c-' ELSE 'd-e-' END || item_id || '.md' AS name, md5('---' || chr(10) || 'query: ' || {_QUOTED} || chr(10) || 'timestamp: t' || chr(10) || 'model: m' || chr(10) || 'k: 3' || chr(10) || 'elapsed_seconds: 1.5' || chr(10) ||
    CASE WHEN item_id % 2 = 0 THEN 'expanded_query: ''x''' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || CASE WHEN item_id % 3 = 0 THEN '_(boş yanıt)_' ELSE trim(text) END || chr(10) || chr(10) || '## Kaynaklar' || chr(10) || chr(10) ||
    '1. **[tutanak#d1]** ? | 1999 | ? — Başlık  _(d=0.250)_' || chr(10)) AS report FROM benchmark""",
)
def research_reports(spark, d):
    """Reports of queries with either quote, both, backslashes, a line end and a control sign."""
    k = F.col("item_id")
    none = F.lit(None).cast("string")
    source = F.struct(F.lit("tutanak").alias("document_type"), F.lit("d1").alias("document_id"), none.alias("source_name"), F.lit("1999").alias("date"), F.lit("").alias("author"), F.lit("Başlık").alias("title"), F.lit(0.25).alias("distance"))
    n = k.cast("string")
    said = lambda before, after="": F.concat(F.lit(before), n, F.lit(after))
    q = F.when(k % 4 == 0, said("soru ")).when(k % 4 == 1, said("it's ")).when(k % 4 == 2, said("a\"b'c ")).otherwise(said("d\\e\n", "\x01"))
    text = F.when(k % 3 == 0, " ").otherwise(F.trim("text"))
    report = reports.research_report(text, q, F.lit("t"), F.lit("m"), F.lit(3), F.lit(1.5), F.when(k % 2 == 0, "x").otherwise(""), F.array(source))
    at = F.lit("1999-01-02 03:04:05").cast("timestamp")
    return table(spark, d, "benchmark").select("item_id", reports.report_name(q, at).alias("name"), F.md5(report).alias("report"))


@query("k12_append_golden", "SELECT 'g' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'first' ELSE 'second' END AS query FROM benchmark")
def append_golden(spark, d):
    """Entries of known ids stay as they are, and a batch that comes again adds nothing."""
    path = scratch.place(spark, "golden-rows")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("id"), "item_id")
    reports.append_golden(rows.filter("item_id % 2 = 0").select("id", F.lit("first").alias("query")), path)
    for _ in range(2):
        reports.append_golden(rows.select("id", F.lit("second").alias("query")), path)
    return spark.read.json(path).select("id", "query")


_TREES = [{"year": {"$eq": 1996}}, {"$and": [{"year": {"$eq": 1996}}, {"author": {"$eq": "x"}}]}, {"$or": [{"year": {"$eq": 1}}, {"$and": [{"year": {"$eq": 2}}]}]}, {"year": {"$gte": 3}}, {"$not": [{"year": {"$eq": 4}}]}, None]


@query("p6_filter_years", "SELECT * FROM (VALUES (0, '1996'), (1, '1996'), (2, '1,2'), (3, ''), (4, ''), (5, '')) t(k, years)")
def filter_years(spark, d):
    return spark.createDataFrame([(k, ",".join(D.filter_years(json.loads(json.dumps(t))))) for k, t in enumerate(_TREES)], "k int, years string")


@query("f14_scores", "SELECT vec_id, round(greatest(0, 1 - x), 6) AS score, round(1 / (1 + exp(-x)), 6) AS sigmoid FROM (SELECT vec_id, embedding[1]::DOUBLE * 9 AS x FROM embeddings)")
def scores(spark, d):
    x = F.col("embedding")[0].cast("double") * 9
    return table(spark, d, "embeddings").select("vec_id", F.round(T.distance_score(x), 6).alias("score"), F.round(T.sigmoid(x), 6).alias("sigmoid"))


@query(
    "x_adapters",
    """WITH r AS (SELECT 'd' || doc_id AS document_id, CASE doc_id % 5 WHEN 0 THEN 'press_clip' WHEN 1 THEN 'report' WHEN 2 THEN 'memo' WHEN 3 THEN NULL ELSE 'press_clip' END AS t, doc_id % 10 = 4 AS gone, text FROM documents)
    SELECT document_id, t AS document_type, sha256(text)[1:32] AS result FROM r WHERE t IN ('press_clip', 'report') AND NOT gone AND text <> '' UNION ALL
    SELECT document_id, NULL, CASE WHEN t IN ('press_clip', 'report') THEN 'no text' ELSE 'unknown type ' || coalesce(t, '?') END FROM r WHERE t IS NULL OR t = 'memo' OR gone OR text IS NULL OR (text = '' AND t = 'press_clip')""",
)
def adapted(spark, d):
    """Requests of two registered types, an unknown one and none; one type's texts stand beside, as a converter left them."""
    k = F.col("doc_id")
    name = F.concat(F.lit("d"), k.cast("string")).alias("document_id")
    kind = F.element_at(F.array(F.lit("press_clip"), F.lit("report"), F.lit("memo"), F.lit(None).cast("string"), F.lit("press_clip")), (k % 5 + 1).cast("int"))
    text = F.when(k % 10 != 4, F.col("text"))
    requests = _docs(spark, d).select(name, kind.alias("document_type"), F.lit("").alias("document_source"), F.create_map(F.lit("dokuman_metni"), text).alias("metadata"))
    path = scratch.place(spark, "converted")
    _docs(spark, d).filter("text <> ''").select(name, "text").write.parquet(path)
    among = {"press_clip": adapters.adapter("press_clip"), "report": adapters.Adapter(adapters.converted(path))}
    texts, _, errors = adapters.parse(requests, among)
    return texts.select("document_id", "document_type", F.col("content_hash").alias("result")).unionByName(errors.select("document_id", F.lit(None).cast("string").alias("document_type"), F.col("error").alias("result")))
