"""Ingest manifest, validation and observability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import manifest as S
from lectern.operators import metrics as M
from lectern.operators import quality as Q
from lectern.operators import structure
from lectern.plans.registry import query, table
from lectern.sources import buckets, html, scratch
from lectern.streaming import incremental

#: Orders stand for manifest rows: customer as collection, status as status.
MAN = """m AS (SELECT o_orderkey::VARCHAR AS document_id, 'c' || (o_custkey % 12) AS collection, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderpriority AS document_type,
floor(o_totalprice)::BIGINT AS total, md5(o_orderkey::VARCHAR) AS content_hash, o_orderdate AS ingest_time, o_orderkey AS k FROM orders)"""


def _manifest(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(
        F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.lit("c"), F.col("o_custkey") % 12).alias("collection"), status.alias("status"), F.col("o_orderpriority").alias("document_type"),
        F.floor("o_totalprice").alias("total"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("content_hash"), F.col("o_orderdate").alias("ingest_time"), F.col("o_orderkey").alias("k"),
    )


@query("m4_count_by_status", f"WITH {MAN} SELECT status, count(*) AS n FROM m GROUP BY 1")
def by_status(spark, d):
    return S.counts(_manifest(spark, d), ["status"])


@query("m5_count_by_collection", f"WITH {MAN} SELECT collection, document_type, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM m GROUP BY ALL")
def by_collection(spark, d):
    return S.status_table(_manifest(spark, d), ["collection", "document_type"], ["done", "failed", "pending"])


@query("m3_list_by_type", f"WITH {MAN} SELECT document_id, status FROM m WHERE document_type = '1-URGENT' AND collection = 'c3'")
def list_by_type(spark, d):
    return _manifest(spark, d).filter("document_type = '1-URGENT' and collection = 'c3'").select("document_id", "status").orderBy("document_id")


_NEW = "n AS (SELECT document_id, collection, 'redone' AS status, CASE WHEN total > 100000 THEN 'x' END AS perf_json, TIMESTAMP '2020-01-01' AS ingest_time FROM m WHERE ingest_time >= TIMESTAMP '1996-01-01' UNION ALL SELECT 'new' || n_nationkey, 'c0', 'redone', 'y', TIMESTAMP '2020-01-01' FROM nation)"


def _incoming(spark, d):
    m = _manifest(spark, d).filter("ingest_time >= timestamp '1996-01-01'")
    late = F.lit("2020-01-01").cast("timestamp")
    a = m.select("document_id", "collection", F.lit("redone").alias("status"), F.when(F.col("total") > 100000, "x").alias("perf_json"), late.alias("ingest_time"))
    b = table(spark, d, "nation").select(F.concat(F.lit("new"), F.col("n_nationkey")).alias("document_id"), F.lit("c0").alias("collection"), F.lit("redone").alias("status"), F.lit("y").alias("perf_json"), late.alias("ingest_time"))
    return a.unionByName(b)


@query(
    "m1_upsert",
    f"""WITH {MAN}, {_NEW}, o AS (SELECT document_id, collection, status, 'old' AS perf_json, ingest_time FROM m)
    SELECT document_id, collection, coalesce(n.status, o.status) AS status, coalesce(n.perf_json, o.perf_json) AS perf_json, strftime(coalesce(o.ingest_time, n.ingest_time), '%Y-%m-%d') AS day FROM o FULL JOIN n USING (document_id, collection)""",
)
def upsert(spark, d):
    old = _manifest(spark, d).select("document_id", "collection", "status", F.lit("old").alias("perf_json"), "ingest_time")
    got = S.upsert(old, _incoming(spark, d))
    return got.select("document_id", "collection", "status", "perf_json", F.date_format("ingest_time", "yyyy-MM-dd").alias("day"))


@query(
    "m2_diff",
    f"""WITH {MAN}, i AS (SELECT document_id, collection, CASE WHEN total > 150000 THEN 'other' ELSE content_hash END AS h, content_hash AS was FROM m)
    SELECT document_id, CASE WHEN h = was THEN 'unchanged' ELSE 'changed' END AS state FROM i UNION ALL SELECT 'new' || n_nationkey, 'new' FROM nation""",
)
def diff(spark, d):
    m = _manifest(spark, d)
    changed = F.when(F.col("total") > 150000, "other").otherwise(F.col("content_hash")).alias("content_hash")
    incoming = m.select("document_id", "collection", changed).unionByName(_incoming(spark, d).filter("document_id like 'new%'").select("document_id", "collection", F.lit("h").alias("content_hash")))
    return S.diff(incoming, m).select("document_id", "state")


@query("k4_delete", f"WITH {MAN} SELECT document_id FROM m WHERE ingest_time < TIMESTAMP '1996-01-01'")
def delete(spark, d):
    return S.delete(_manifest(spark, d), _incoming(spark, d).select("document_id", "collection")).select("document_id")


_PERF = """p AS (SELECT collection, CASE WHEN total % 3 = 0 THEN 0 ELSE total % 5000 END::DOUBLE AS t, (total % 700)::DOUBLE AS pm, CASE WHEN total % 2 = 0 THEN (total % 101)::DOUBLE END AS sp, total % 5 = 0 AS fl FROM m WHERE status = 'done')"""


@query(
    "m6_perf_trends",
    f"""WITH {MAN}, {_PERF} SELECT collection, count(*) AS n, round(avg(nullif(t, 0)), 6) AS total_ms, round(avg(nullif(pm, 0)), 6) AS parse_ms, round(avg(nullif(t, 0)), 6) AS embed_ms,
    round(avg(coalesce(sp, 100)), 6) AS span_coverage_pct, round(100 * avg(fl::INT), 6) AS flagged_pct FROM p GROUP BY 1""",
)
def perf_trends(spark, d):
    total = F.col("total")
    t = F.when(total % 3 == 0, 0).otherwise(total % 5000)
    perf = F.to_json(F.struct(t.alias("total_ms"), (total % 700).alias("parse_ms"), t.alias("embed_ms"), F.when(total % 2 == 0, total % 101).alias("span_coverage_pct")))
    m = _manifest(spark, d).withColumn("perf_json", perf).withColumn("quality_json", F.to_json(F.struct((total % 5 == 0).alias("ocr_flagged"))))
    return S.perf_trends(m)


@query("m7_run_summary", f"WITH {MAN} SELECT count(*) FILTER (status = 'done') AS done, 0::BIGINT AS skipped, count(*) FILTER (status = 'failed') AS failed, sum(total % 30) FILTER (status = 'done')::BIGINT AS chunks FROM m")
def run_summary(spark, d):
    return S.run_summary(_manifest(spark, d).withColumn("chunk_count", F.col("total") % 30))


@query(
    "m8_m9_chunk_stats",
    """WITH g AS (SELECT source, count(*) AS n, min(length(text)) AS min_chars, quantile_cont(length(text), 0.5)::DOUBLE AS median_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS mean_chars, count(*) FILTER (length(text) < 100) AS too_short,
    count(*) FILTER (length(text) > 2400) AS too_long FROM documents GROUP BY 1)
    SELECT *, CASE WHEN (too_short + too_long) / n::DOUBLE < 0.1 THEN 'good' WHEN (too_short + too_long) / n::DOUBLE < 0.3 THEN 'fair' ELSE 'poor' END AS health FROM g""",
)
def chunk_stats(spark, d):
    return S.chunk_stats(table(spark, d, "documents"), ["source"], 2000).withColumn("mean_chars", F.round("mean_chars", 6))


@query(
    "m10_histogram",
    """WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT CASE WHEN hi > lo THEN least(floor((n_chars - lo) / ((hi - lo) / 10.0::DOUBLE)), 9) ELSE 0 END::INT AS bin, count(*) AS n FROM documents, e GROUP BY 1""",
)
def histogram(spark, d):
    return S.histogram(table(spark, d, "documents"), "n_chars")


@query("m18_orphans", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, d):
    children = table(spark, d, "pages").select("page_id", F.concat(F.col("page_id"), F.lit("_0")).alias("chunk_id"))
    return S.orphans(children, table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))).select("page_id")


@query(
    "m16_latency",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS mean FROM events)
    SELECT event_type, any_value(n) AS n, round(any_value(mean), 6) AS mean, max(value) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 95 / 100), n - 1)) AS p95, max(value) FILTER (i = least(floor(n * 99 / 100), n - 1)) AS p99 FROM r GROUP BY 1""",
)
def latency(spark, d):
    return M.latency(table(spark, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query(
    "m12_outliers_so_far",
    """WITH o AS (SELECT event_id, value, count(value) OVER w AS seen, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, seen, coalesce(seen >= 3 AND abs(value - m) / m > 0.3, false) AS outlier FROM o""",
)
def outliers_so_far(spark, d):
    """Means are of sums in nodes of 16 rows, as the SQL's engine adds them: at 0.3 exactly their rounding decides."""
    return Q.outliers_so_far(table(spark, d, "events"), "user_id", "value", "event_id", fan=16).select("event_id", "seen", "outlier")


@query(
    "s2_validation",
    """WITH r AS (SELECT doc_id AS position, n_chars::VARCHAR AS document_id, lang, source, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS n FROM documents)
    SELECT position, document_id, 'duplicate id' AS error FROM r WHERE n > 1 UNION ALL SELECT position, document_id, 'unknown type' FROM r WHERE lang NOT IN ('en', 'de', 'fr')
    UNION ALL SELECT position, document_id, 'unknown collection' FROM r WHERE source NOT IN ('src0', 'src1', 'src2')""",
)
def validation(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("position"), F.col("n_chars").cast("string").alias("document_id"), F.col("lang").alias("document_type"), F.col("source").alias("collection"))
    return S.validate(rows, ["src0", "src1", "src2"], ["en", "de", "fr"])


@query("u22_catalog", "SELECT n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def collection_catalog(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, d, "nation")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").select(F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("name")


# Content that is left out goes first; what stands between two marks of blocks is
# an atom, named after the mark before it. Spaces are brought to one, the few
# character references of these pages to their signs, the ampersand's last.
_PAGES = r"""
cut AS (SELECT page_id, regexp_replace(html, '<!--.*?-->|<head>.*?</head>|<nav>.*?</nav>', '', 'gs') AS h FROM pages),
lines AS (SELECT page_id, regexp_replace(regexp_replace(h, '[ \t\r\f\n]+', ' ', 'g'), '<br ?/?>', chr(10), 'g') AS h FROM cut),
marks AS (SELECT page_id, regexp_replace(h, '<(/?)(html|body|article|footer|div|p|ul|li|h[1-6])\b[^>]*>', chr(1) || '\1\2' || chr(2), 'g') AS h FROM lines),
parts AS (SELECT page_id, unnest(string_split(h, chr(1))) AS part, generate_subscripts(string_split(h, chr(1)), 1) AS n FROM marks),
bare AS (SELECT page_id, n, split_part(part, chr(2), 1) AS tag, regexp_replace(regexp_replace(CASE WHEN contains(part, chr(2)) THEN split_part(part, chr(2), 2) ELSE part END, '<[^>]*>', '', 'g'), ' ?\n ?', chr(10), 'g') AS raw FROM parts),
texts AS (SELECT page_id, n, tag, trim(replace(replace(replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' ' || chr(10)) AS text FROM bare),
atoms AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INT AS pos,
  CASE WHEN tag ~ '^h[1-6]$' THEN 'heading_' || tag[2] WHEN tag = 'li' THEN 'list_item' WHEN tag = 'footer' THEN 'page_footer' ELSE 'text' END AS label,
  CASE WHEN tag ~ '^h[1-6]$' THEN tag[2]::INT ELSE 0 END AS level, text FROM texts WHERE text <> '')
"""


@query("s6_html_atoms", f"WITH {_PAGES} SELECT * FROM atoms")
def html_atoms(spark, d):
    return html.atoms(table(spark, d, "pages"))


@query(
    "s18_page_texts",
    f"WITH {_PAGES} SELECT page_id, count(*) AS n_atoms, sha256(string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' ELSE '' END || text, chr(10) || chr(10) ORDER BY pos)) AS markdown FROM atoms GROUP BY page_id",
)
def page_texts(spark, d):
    """Each page as one text, headings marked by level."""
    marked = html.atoms(table(spark, d, "pages")).select("page_id", "pos", html.marked(F.col("label"), F.col("text")).alias("line"))
    held = marked.groupBy("page_id").agg(F.count("*").alias("n_atoms"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return held.select("page_id", "n_atoms", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"), 256).alias("markdown"))


_RENEWED = "CASE WHEN k % 70 = 3 THEN 'third' WHEN k % 7 = 3 THEN 'second' ELSE 'first' END"
_STORE_KEY = ["document_id", "collection"]


def _batches(spark, d):
    """All rows, then a seventh of them with another status, then few of these once more and a collection that was not there."""
    rows = _manifest(spark, d).select("document_id", "collection", "status", F.lit("first").alias("perf_json"), "ingest_time", "k")
    again = lambda df, name: df.withColumn("status", F.lit(name)).withColumn("perf_json", F.when(F.col("k") % 2 == 0, name)).withColumn("ingest_time", F.col("ingest_time") + F.expr("interval 1 day"))
    second = again(rows.filter("k % 7 = 3"), "second")
    third = again(rows.filter("k % 70 = 3"), "third")
    fresh = rows.filter("k % 500 = 1").withColumn("collection", F.lit("late"))
    return [b.drop("k") for b in (rows, second, third.unionByName(fresh))]


_MERGED = f"""WITH {MAN}, base AS (SELECT document_id, collection, status, k, ingest_time FROM m UNION ALL SELECT document_id, 'late', status, k, ingest_time FROM m WHERE k % 500 = 1)
SELECT document_id, collection, CASE WHEN collection = 'late' OR {_RENEWED} = 'first' THEN status ELSE {_RENEWED} END AS status,
  CASE WHEN collection = 'late' OR k % 7 <> 3 OR k % 2 = 1 THEN 'first' ELSE {_RENEWED} END AS perf_json, strftime(ingest_time, '%Y-%m-%d') AS day FROM base"""


@query("m1_bucket_merge", _MERGED)
def bucket_merge(spark, d):
    """Three batches into a store that rewrites only the buckets they meet."""
    root = scratch.place(spark, "store")
    parts = _batches(spark, d)
    buckets.create(spark, root, parts[0].schema, _STORE_KEY, 16)
    for k, batch in enumerate(parts):
        buckets.merge(root, batch, k, S.upsert)
    return buckets.read(spark, root).withColumn("day", F.date_format("ingest_time", "yyyy-MM-dd")).drop("ingest_time")


@query("m1_stream_merge", _MERGED)
def stream_merge(spark, d):
    """The same batches as a stream of three files' folders, merged by the running query."""
    source, root = scratch.place(spark, "stream"), scratch.place(spark, "store")
    for k, batch in enumerate(_batches(spark, d)):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        incremental.manifest_stream(spark, stream, root, f"{root}-checkpoint", 8).awaitTermination()
    return incremental.current(spark, root).withColumn("day", F.date_format("ingest_time", "yyyy-MM-dd")).drop("ingest_time")


# Short paragraphs stand for headings below the page's own.
_LEVELS = "CASE WHEN level > 0 THEN level WHEN label = 'text' AND length(text) < 90 THEN 2 WHEN label = 'text' AND length(text) < 180 THEN 3 ELSE 0 END"


@query(
    "c14_structural_chunks",
    f"""WITH RECURSIVE {_PAGES}, a AS (SELECT page_id, pos, {_LEVELS} AS level, text, length(text) AS n FROM atoms),
    h AS (SELECT *, {", ".join(f"coalesce(max(CASE WHEN level = {k} THEN pos END) OVER w, -1) AS h{k}" for k in (1, 2, 3))} FROM a WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
    s AS (SELECT *, list_filter([h1, CASE WHEN h2 > h1 THEN h2 ELSE -1 END, CASE WHEN h3 > greatest(h1, h2) THEN h3 ELSE -1 END], lambda p: p >= 0) AS places FROM h),
    t AS (SELECT *, {", ".join(f"sum(n) OVER (PARTITION BY page_id, places[1:{d}]) AS t{d}" for d in (1, 2, 3))}, sum(n) OVER (PARTITION BY page_id) AS t0 FROM s),
    f AS (SELECT *, CASE WHEN t0 <= 1500 THEN 0 {" ".join(f"WHEN len(places) >= {d} AND t{d} <= 1500 THEN {d}" for d in (1, 2, 3))} END AS d FROM t),
    u AS (SELECT *, CASE WHEN d = 0 THEN [] ELSE places[1:coalesce(d, len(places))] END AS unit FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id, unit, d IS NULL ORDER BY pos) AS i FROM u),
    g(page_id, unit, whole, i, chunk, size) AS (SELECT page_id, unit, d IS NOT NULL, i, 1, n FROM o WHERE i = 1 UNION ALL
      SELECT g.page_id, g.unit, whole, o.i, CASE WHEN NOT whole AND size + o.n > 1500 THEN chunk + 1 ELSE chunk END, CASE WHEN NOT whole AND size + o.n > 1500 THEN o.n ELSE size + o.n END
      FROM g JOIN o ON o.page_id = g.page_id AND o.unit = g.unit AND (o.d IS NOT NULL) = whole AND o.i = g.i + 1)
    SELECT page_id, min(o.pos) AS pos, len(any_value(unit)) AS depth, sum(o.n)::BIGINT AS size, count(*) AS n_atoms FROM g JOIN o USING (page_id, unit, i) WHERE (o.d IS NOT NULL) = whole GROUP BY page_id, unit, whole, chunk""",
)
def structural_chunks(spark, d):
    level = F.when(F.col("level") > 0, F.col("level")).when((F.col("label") == "text") & (F.length("text") < 90), 2).when((F.col("label") == "text") & (F.length("text") < 180), 3).otherwise(0)
    atoms = html.atoms(table(spark, d, "pages")).withColumn("level", level)
    got = structure.structural_chunks(atoms, 1500, size=F.length("text"), deepest=3)
    return got.select("page_id", "pos", F.size("path").alias("depth"), F.col("size").cast("long").alias("size"), "n_atoms")
