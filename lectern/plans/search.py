"""Retrieval queries: the rows of ``embeddings`` are chunks, their label the collection.

The query set is every vector whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import providers, session
from lectern.functions import text as T
from lectern.operators import agents as G
from lectern.operators import index as X
from lectern.operators import metrics as M
from lectern.operators import retrieval as R
from lectern.operators import timing
from lectern.operators.filters import Criteria, first_rows, predicate
from lectern.plans.answers import NORMAL, WINDOWS
from lectern.plans.registry import query, table
from lectern.sources import scratch

RANGE = Criteria(year_gte=2, year_lte=7)


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("qvec"))


def _chunks(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")


def _hits(spark, d, k=20):
    # The range filter stands before the distance, so the scan takes it.
    chunks = _chunks(spark, d).filter(predicate(RANGE, columns={"year": "label"}))
    return R.top_k(_queries(spark, d), chunks, k, skip="query_id")


DIST = "1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-9)"
HITS = f"""
q AS (SELECT vec_id AS query_id, label AS query_label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT vec_id AS chunk_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label BETWEEN 2 AND 7),
pairs AS (SELECT query_id, query_label, chunk_id, label, {DIST.format(a="q.v", b="c.v")} AS distance FROM q JOIN c ON chunk_id <> query_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM pairs) WHERE rank <= 20)
"""


@query("v6_vector_topk", f"WITH {HITS} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM hits")
def vector_topk(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


METRICS = """
rel AS (SELECT q.query_id, count(*) AS n_rel FROM q JOIN c ON c.label = q.query_label AND c.chunk_id <> q.query_id GROUP BY 1),
rels AS (SELECT q.query_id, coalesce(n_rel, 0) AS n_rel FROM q LEFT JOIN rel USING (query_id)),
t AS (SELECT query_id, sum((label = query_label)::INT) AS h, min(CASE WHEN label = query_label THEN rank END) AS f, sum((label = query_label)::INT / log2(rank + 1)) AS dcg FROM hits WHERE rank <= 10 GROUP BY 1),
m AS (SELECT query_id, coalesce(h, 0) / 10.0::DOUBLE AS precision, CASE WHEN n_rel > 0 THEN coalesce(h, 0) / n_rel::DOUBLE ELSE 0 END AS recall, (coalesce(h, 0) > 0)::INT AS hit_rate, coalesce(1.0::DOUBLE / f, 0) AS mrr,
  CASE WHEN n_rel > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n_rel) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM rels LEFT JOIN t USING (query_id))
"""
NAMES = ["precision", "recall", "hit_rate", "mrr", "ndcg"]


def _metrics(spark, d):
    hits = _hits(spark, d).withColumn("hit", (F.col("label") == F.col("query_label")).cast("int"))
    counts = _chunks(spark, d).filter("label between 2 and 7").groupBy(F.col("label").alias("query_label")).agg(F.count("*").alias("n"))
    q = _queries(spark, d).select("query_id", "query_label").join(counts, "query_label", "left")
    own = F.when(F.col("query_label").between(2, 7), 1).otherwise(0)
    return M.rank_metrics(hits, q.select("query_id", (F.coalesce("n", F.lit(0)) - own).alias("n_rel")), 10)


@query("e1_e5_rank_metrics", f"WITH {HITS}, {METRICS} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, hit_rate, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def rank_metrics(spark, d):
    return _metrics(spark, d).select("query_id", *[F.round(c, 6).alias(c) if c != "hit_rate" else F.col(c) for c in NAMES])


_MEANS = " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({n}), 6) AS mean, count(*) AS n FROM m" for n in NAMES)


@query("e16_mean_metrics", f"WITH {HITS}, {METRICS} {_MEANS}")
def mean_metrics(spark, d):
    return M.mean_metrics(_metrics(spark, d), NAMES).withColumn("mean", F.round("mean", 6))


@query("e18_grades", f"WITH {HITS}, {METRICS} SELECT query_id, CASE WHEN greatest(precision, mrr) >= 0.5 THEN 'PASS' WHEN greatest(precision, mrr) >= 0.3 THEN 'WARN' ELSE 'FAIL' END AS grade FROM m")
def grades(spark, d):
    return _metrics(spark, d).select("query_id", M.grade(F.col("precision"), F.col("mrr")).alias("grade"))


@query(
    "v7_rerank",
    f"""WITH {HITS}, s AS (SELECT query_id, chunk_id, distance, -abs(label - query_label) - distance AS score FROM hits),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
    SELECT query_id, chunk_id, round(1 / (1 + exp(-score)), 6) AS rerank_score, rank FROM r WHERE rank <= 5""",
)
def rerank(spark, d):
    return _reranked(_hits(spark, d))


def _reranked(hits):
    score = -F.abs(F.col("label") - F.col("query_label")) - F.col("distance")
    return R.rerank(hits, score, 5).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


# Three views of each vector stand for three sources: all of it, and its halves.
VIEWS = ((0, 1, 64), (1, 1, 32), (2, 33, 32))


def _ranked_views(spark, d):
    out = None
    for k, at, n in VIEWS:
        part = lambda c, at=at, n=n: F.slice(c, at, n)
        q = _queries(spark, d).withColumn("qvec", part("qvec"))
        c = _chunks(spark, d).withColumn("embedding", part("embedding"))
        got = R.top_k(q, c, 10, skip="query_id").select("query_id", F.lit(k).alias("source_ord"), "rank", "chunk_id", "distance")
        out = got if out is None else out.unionByName(got)
    return out


_VIEW_SQL = " UNION ALL ".join(
    f"""SELECT {k} AS source_ord, query_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM
    (SELECT query_id, chunk_id, {DIST.format(a="a", b="b")} AS distance FROM (SELECT vec_id AS query_id, embedding[{at}:{at + n - 1}]::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0) JOIN
    (SELECT vec_id AS chunk_id, embedding[{at}:{at + n - 1}]::DOUBLE[] AS b FROM embeddings) ON chunk_id <> query_id)) WHERE rank <= 10"""
    for k, at, n in VIEWS
)


@query(
    "u1_rrf_sources",
    f"""WITH v AS ({_VIEW_SQL}), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min((source_ord, rank)) AS seen, arg_max(distance, source_ord) AS distance FROM v GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, chunk_id) AS rank FROM f)
    SELECT query_id, chunk_id, round(rrf, 6) AS rrf, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""",
)
def rrf_sources(spark, d):
    return R.rrf_sources(_ranked_views(spark, d), 10).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), F.round("distance", 6).alias("distance"), "rank")


@query(
    "u5_rrf_drafts",
    f"""WITH v AS ({_VIEW_SQL}), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(1 - distance) AS s, min((source_ord, rank)) AS seen FROM v GROUP BY ALL)
    SELECT query_id, chunk_id, round(rrf, 6) AS rrf, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, chunk_id) AS rank FROM f""",
)
def rrf_drafts(spark, d):
    v = _ranked_views(spark, d).withColumnRenamed("source_ord", "draft_ord").withColumn("rerank_score", 1 - F.col("distance"))
    return R.rrf_drafts(v).withColumns({"rrf": F.round("rrf", 6), "rerank_score": F.round("rerank_score", 6)})


def _pool(spark, d):
    """Candidates with priority and collection from the label, four documents to a collection."""
    h = _hits(spark, d).withColumn("collection", F.col("label").cast("string")).withColumn("document_id", F.concat_ws("-", "label", (F.col("chunk_id") % 4).cast("string")))
    return h.withColumn("priority", F.col("label").cast("int"))


POOL = "pool AS (SELECT *, label::VARCHAR AS collection, label || '-' || (chunk_id % 4) AS document_id, label::INT AS priority FROM hits)"


@query(
    "u4_balanced",
    f"""WITH {HITS}, {POOL}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, chunk_id) AS r FROM pool)
    SELECT query_id, collection, chunk_id, r AS rank, row_number() OVER (PARTITION BY query_id ORDER BY collection, r) AS position FROM p WHERE r <= 3""",
)
def balanced(spark, d):
    return R.balanced(_pool(spark, d), 3).select("query_id", "collection", "chunk_id", "rank", "position")


@query("u6_slots", f"WITH {HITS} SELECT query_id, chunk_id, rank, CASE WHEN rank <= 6 THEN 'primary' ELSE 'reserve' END AS slot FROM hits WHERE rank <= 10")
def slots(spark, d):
    return R.slots(_hits(spark, d), 6, 4).select("query_id", "chunk_id", "rank", "slot")


_ASSEMBLED = f"""{HITS}, {POOL}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, rank) AS i FROM pool),
st(query_id, i, ids, docs, colls) AS (
  SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[], []::VARCHAR[], []::VARCHAR[] FROM o
  UNION ALL
  SELECT s.query_id, o.i,
    CASE WHEN len(ids) < 8 AND len(list_filter(docs, lambda x: x = o.document_id)) < 1 AND len(list_filter(colls, lambda x: x = o.collection)) < 3 THEN list_append(ids, o.chunk_id) ELSE ids END,
    CASE WHEN len(ids) < 8 AND len(list_filter(docs, lambda x: x = o.document_id)) < 1 AND len(list_filter(colls, lambda x: x = o.collection)) < 3 THEN list_append(docs, o.document_id) ELSE docs END,
    CASE WHEN len(ids) < 8 AND len(list_filter(docs, lambda x: x = o.document_id)) < 1 AND len(list_filter(colls, lambda x: x = o.collection)) < 3 THEN list_append(colls, o.collection) ELSE colls END
  FROM st s JOIN o ON o.query_id = s.query_id AND o.i = s.i + 1),
fin AS (SELECT query_id, arg_max(ids, i) AS ids, arg_max(docs, i) AS docs, arg_max(colls, i) AS colls FROM st GROUP BY 1),
taken AS (SELECT query_id, unnest(ids) AS chunk_id, unnest(docs) AS document_id, unnest(colls) AS collection, unnest(range(1, len(ids) + 1)) AS position FROM fin)"""


@query("u8_assembly", f"WITH RECURSIVE {_ASSEMBLED} SELECT query_id, position, chunk_id, document_id, collection FROM taken")
def assembly(spark, d):
    return R.assemble(_pool(spark, d), budget=3, per_document=1, total=8)


_STEP = """SELECT s.query_id, s.oi, CASE WHEN ok THEN list_append(docs, s.document_id) ELSE docs END, CASE WHEN ok THEN list_append(ids, s.chunk_id) ELSE ids END, CASE WHEN ok THEN list_append(colls, s.collection) ELSE colls END
  FROM (SELECT s.*, o.document_id, o.chunk_id, o.collection, o.i AS oi, NOT list_contains(docs, o.document_id) AND {room} AS ok FROM {st} s JOIN {o} o ON o.query_id = s.query_id AND o.i = s.i + 1) s"""


@query(
    "u9_expansion",
    f"""WITH RECURSIVE {HITS}, {POOL}, used AS (SELECT query_id, list(DISTINCT document_id) AS docs FROM pool WHERE rank <= 6 GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, rank) AS i FROM pool WHERE rank > 6),
    st(query_id, i, docs, ids, colls) AS (SELECT query_id, 0::BIGINT, docs, []::BIGINT[], []::VARCHAR[] FROM used UNION ALL {_STEP.format(room="len(list_filter(colls, lambda x: x = o.collection)) < 2", st="st", o="o")}),
    fin AS (SELECT query_id, arg_max(ids, i) AS ids, arg_max(colls, i) AS colls FROM st GROUP BY 1)
    SELECT query_id, unnest(ids) AS chunk_id, unnest(colls) AS collection, unnest(range(1, len(ids) + 1)) AS position FROM fin""",
)
def expansion(spark, d):
    p = scratch.written(_pool(spark, d), "pool")
    return R.expand(p.filter("rank <= 6"), p.filter("rank > 6"), 2).select("query_id", "chunk_id", "collection", "position")


@query(
    "u10_evidence",
    f"""WITH {HITS}, {POOL}, g AS (SELECT query_id, count(chunk_id) AS n, count(DISTINCT collection) AS n_collections FROM q LEFT JOIN (SELECT * FROM pool WHERE distance <= 0.78 AND (query_id % 60 > 0 OR collection = '3')) USING (query_id) GROUP BY 1)
    SELECT query_id, n, n_collections, CASE WHEN n = 0 THEN 'clarify' WHEN n >= 4 AND n_collections >= 2 THEN 'answer' WHEN n BETWEEN 2 AND 4 THEN 'judge' ELSE 'expand' END AS action,
    CASE WHEN n = 0 THEN 0 WHEN n >= 4 AND n_collections >= 2 THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence,
    CASE WHEN n = 0 THEN 'no_results' WHEN n >= 4 AND n_collections >= 2 THEN '' WHEN n BETWEEN 2 AND 4 THEN NULL ELSE 'insufficient_chunks' END AS missing FROM g""",
)
def evidence(spark, d):
    found = _pool(spark, d).filter("distance <= 0.78 and (query_id % 60 > 0 or collection = '3')")
    return R.evidence(found, _queries(spark, d)).withColumn("missing", F.array_join("missing_aspects", ",")).drop("missing_aspects")


_SAID = """CASE turn % 7 WHEN 0 THEN 'So: {"sufficient": true, "confidence": 0.' || conv_id % 10 || ', "action": "answer", "missing_aspects": []} end' WHEN 1 THEN '{"sufficient": false, "confidence": 0.5, "action": "clarify", "missing_aspects": ["' || role || '"]}'
WHEN 2 THEN '{"sufficient": false, "confidence": 0.5}' WHEN 3 THEN '{"confidence": 0.5, "action": "wait"}' WHEN 4 THEN 'no object here' WHEN 5 THEN '{"action": "answer", broken}' ELSE '{"confidence": "high", "action": "answer"}' END"""


@query(
    "u11_judgement",
    """SELECT conv_id, turn, k = 0 AS sufficient, CASE k WHEN 0 THEN conv_id % 10 / 10.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.4 END::DOUBLE AS confidence, CASE k WHEN 0 THEN 'answer' WHEN 1 THEN 'clarify' ELSE 'expand' END AS action,
    CASE WHEN k IN (0, 2) THEN '' WHEN k = 1 THEN role ELSE 'insufficient_chunks' END AS missing, CASE WHEN k < 3 THEN 'llm' ELSE 'heuristic' END AS judge_type FROM (SELECT *, turn % 7 AS k FROM conversations)""",
)
def judgement(spark, d):
    """A judge's words in every shape, from usable to broken, which falls back to expanding."""
    c = table(spark, d, "conversations")
    j = c.select("conv_id", "turn", R.judgement(F.expr(_SAID)).alias("j"))
    return j.select("conv_id", "turn", "j.sufficient", F.round("j.confidence", 6).alias("confidence"), "j.action", F.array_join("j.missing_aspects", ",").alias("missing"), "j.judge_type")


_BY_LABEL = f"""b AS (SELECT query_id, chunk_id, label, distance, row_number() OVER (PARTITION BY query_id, label ORDER BY round(distance, 9), chunk_id) AS rank FROM
  (SELECT query_id, vec_id AS chunk_id, label, {DIST.format(a="q.v", b="e.embedding::DOUBLE[]")} AS distance FROM (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings e ON e.vec_id <> query_id))"""


@query(
    "u2_fan_out",
    f"""WITH {_BY_LABEL}, s AS (SELECT *, list_position([3, 1, 4, 5], label) AS source_ord FROM b WHERE label IN (3, 1, 4, 5) AND rank <= 20), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min((source_ord, rank)) AS seen, arg_max(distance, source_ord) AS distance FROM s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, chunk_id) AS rank FROM f) SELECT query_id, chunk_id, round(rrf, 6) AS rrf, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""",
)
def fan_out(spark, d):
    """Twenty from each of four collections, which the order of sources fuses."""
    got = R.fan_out(_queries(spark, d), _chunks(spark, d), [3, 1, 4, 5], "label", skip="query_id")
    return got.select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), F.round("distance", 6).alias("distance"), "rank")


@query(
    "u1_rrf_compat",
    f"""WITH v AS ({_VIEW_SQL}), i AS (SELECT *, 'd' || chunk_id % 9 || '_c' || CASE WHEN chunk_id % 4 > 0 THEN chunk_id // 9 ELSE rank END AS uid FROM v), f AS (SELECT query_id, uid, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min((source_ord, rank)) AS seen, arg_max(distance, (source_ord, -rank)) AS distance FROM i GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, uid) AS rank FROM f) SELECT query_id, uid AS chunk_id, round(rrf, 6) AS rrf, rank FROM r WHERE rank <= 10""",
)
def rrf_compat(spark, d):
    """Chunks known by document and index; those without an index meet by their rank."""
    c = F.col("chunk_id")
    v = _ranked_views(spark, d).withColumn("document_id", F.concat(F.lit("d"), (c % 9).cast("string"))).withColumn("chunk_index", F.when(c % 4 > 0, F.floor(c / 9).cast("int")))
    return R.rrf_sources(v, 10, compat=True).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), "rank")


@query(
    "o4_orchestrated",
    f"""WITH RECURSIVE {HITS}, {POOL}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(distance, 9), chunk_id) AS r FROM pool WHERE distance <= 0.9),
    mine AS (SELECT * FROM near WHERE (query_id // 20 + label) % 3 > 0 AND query_id % 140 > 0 AND r <= 3),
    o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label, r) AS i FROM mine WHERE r <= 1),
    a(query_id, i, docs, ids, colls) AS (SELECT query_id, 0::BIGINT, []::VARCHAR[], []::BIGINT[], []::VARCHAR[] FROM q UNION ALL {_STEP.format(room="len(ids) < 6", st="a", o="o1")}),
    t AS (SELECT query_id, arg_max(docs, i) AS docs, arg_max(ids, i) AS ids, arg_max(colls, i) AS colls FROM a GROUP BY 1),
    w AS (SELECT *, len(ids) > 0 AND NOT (len(ids) >= 4 AND len(list_distinct(colls)) >= 2) AS more FROM t),
    o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label, r) AS i FROM mine WHERE r > 1 AND query_id IN (SELECT query_id FROM w WHERE more)),
    z(query_id, i, docs, ids, colls) AS (SELECT query_id, 0::BIGINT, docs, ids, colls FROM w UNION ALL {_STEP.format(room="true", st="z", o="o2")}),
    u AS (SELECT query_id, arg_max(ids, i) AS ids, arg_max(colls, i) AS colls FROM z GROUP BY 1)
    SELECT query_id, CASE WHEN query_id % 140 = 0 THEN 'refuse' WHEN len(u.ids) = 0 THEN 'clarify' WHEN len(u.ids) >= 4 AND len(list_distinct(u.colls)) >= 2 THEN 'answer' ELSE 'expand' END AS action,
    len(w.ids) AS n_primary, len(u.ids) AS n, len(u.ids) > len(w.ids) AS expanded, array_to_string(u.ids, ',') AS chunk_ids FROM u JOIN w USING (query_id)""",
)
def orchestrated(spark, d):
    """Plans of one primary and two reserve rows in each allowed collection, through assembly, evidence and expansion."""
    near = _pool(spark, d).drop("rank", "priority").filter("distance <= 0.9")
    ranked = first_rows(near, ["query_id", "collection"], [F.round("distance", 9), F.col("chunk_id")], 20).select("query_id", "collection", "document_id", "chunk_id", "rank")
    q = _queries(spark, d)
    label = F.explode(F.sequence(F.lit(2), F.lit(7)))
    plans = q.filter("query_id % 140 > 0").select("query_id", label.alias("priority")).filter("(query_id div 20 + priority) % 3 > 0")
    plans = plans.select("query_id", F.col("priority").cast("string").alias("collection"), "priority", F.lit(1).alias("retrieval_budget"), F.lit(2).alias("reserve_budget"))
    return R.orchestrate(q, ranked, plans, per_document=1, total=6).withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ","))


@query("u13_merge_results", f"WITH {HITS} SELECT query_id, chunk_id FROM hits WHERE rank <= 5 UNION ALL SELECT DISTINCT query_id, chunk_id FROM hits WHERE rank > 5")
def merge_results(spark, d):
    h = scratch.written(_hits(spark, d).select("query_id", "chunk_id", "rank"), "hits")
    return R.merge_results(h.filter("rank <= 5"), h.unionByName(h)).select("query_id", "chunk_id")


@query(
    "u14_context",
    f"""WITH {HITS}, h AS (SELECT query_id, rank, text, concat_ws(' | ', CASE WHEN source <> 'src1' THEN source END, CASE WHEN doc_id % 4 > 0 THEN lang END, CASE WHEN doc_id % 5 > 0 THEN 'Dönem ' || doc_id % 5 END, CASE WHEN doc_id % 3 = 0 THEN 'Ali Kaya' ELSE NULL END) AS head
      FROM hits JOIN documents ON doc_id = chunk_id WHERE distance <= 1.0),
    b AS (SELECT query_id, rank, substring(CASE WHEN head <> '' THEN '[' || head || ']' || chr(10) ELSE '' END || text, 1, 400) AS block FROM h),
    r AS (SELECT *, row_number() OVER w AS n, sum(length(block)) OVER w AS size FROM b WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
    o AS (SELECT *, max((n > 1 AND size > 2000)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS over_ FROM r)
    SELECT query_id, count(*) AS n_chunks, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM o WHERE over_ = 0 GROUP BY 1""",
)
def context(spark, d):
    """No more of a text than a block can show goes through the join."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(
        k.alias("chunk_id"), F.substring("text", 1, 400).alias("text"), F.when(F.col("source") != "src1", F.col("source")).alias("source"), F.when(k % 4 > 0, F.col("lang")).otherwise("").alias("date"),
        (k % 5).cast("int").alias("period"), F.when(k % 3 == 0, "Ali Kaya").alias("author"),
    )
    return R.context(_hits(spark, d).join(docs, "chunk_id"), 400, 1.0, 2000)


# The words asked for: numbers stand in no text here, the other words in many.
_ASKED = "CASE WHEN vec_id % 60 = 0 THEN ['the', 'sur'] WHEN vec_id % 60 = 20 THEN ['und'] ELSE ['que', 'ing'] END"


@query(
    "v9_retrieve",
    rf"""WITH RECURSIVE e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, 1990 + vec_id % 5 AS year, regexp_replace(text, '[0-9]', '#', 'g') AS text, source FROM embeddings JOIN documents ON doc_id = vec_id),
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, CASE WHEN vec_id % 60 = 0 THEN [1990, 1992] WHEN vec_id % 60 = 20 THEN [1993] ELSE [1990, 1991, 1992, 1993, 1994] END AS y, {_ASKED} AS ws FROM embeddings WHERE vec_id % 20 = 0),
    p AS (SELECT query_id, chunk_id, text, source, year, {DIST.format(a="a", b="v")} AS distance FROM q JOIN e ON list_contains(y, e.year) AND chunk_id <> query_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS r FROM p) WHERE r <= 20),
    scored AS (SELECT *, -(chunk_id % 3) - distance AS score FROM near), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
    top AS (SELECT *, query_id * 1000000000 + chunk_id AS doc_id FROM k WHERE rank <= 5),
    d AS (SELECT doc_id, text, {NORMAL.format(c="text")} AS flat, ws FROM top JOIN q USING (query_id)), {WINDOWS}
    SELECT query_id, chunk_id, rank, round(1 - 1 / (1 + exp(-score)), 6) AS distance, md5('Kaynak: ' || source || ' | Yıl: ' || year || chr(10) || coalesce(shown, text[1:3000])) AS shown FROM top LEFT JOIN shown USING (doc_id)""",
)
def retrieve(spark, d):
    """Years from a date and from bare years, rank, rerank, crop to the words asked for and head."""
    k = F.col("query_id")
    q = _queries(spark, d).withColumn("query", F.when(k % 60 == 0, "3.4.1992 & 1990 The, SUR").when(k % 60 == 20, "und 1993").otherwise("que ing"))
    year = (F.lit(1990) + F.col("chunk_id") % 5).cast("int")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source").withColumn("year", year)
    c = _chunks(spark, d).join(docs.select("chunk_id"), "chunk_id").withColumn("year", year)
    score, shown = -(F.col("chunk_id") % 3) - F.col("distance"), F.regexp_replace("text", "[0-9]", "#")
    got = R.retrieve(q, c, 5, 20, [("Kaynak", "source"), ("Yıl", "year")], score, skip="query_id", texts=docs, text=shown)
    return got.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"), F.md5("shown").alias("shown"))


@query(
    "v9_retrieve_with_year_filter",
    """WITH d AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, 1990 + vec_id % 30 AS year FROM embeddings), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, 1990 + vec_id % 7 AS y FROM embeddings WHERE vec_id % 20 = 0),
    p AS (SELECT query_id, chunk_id, """ + DIST.format(a="a", b="v") + """ AS distance FROM q JOIN d ON d.year = q.y AND chunk_id <> query_id)
    SELECT query_id, chunk_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS r FROM p) WHERE r <= 5""",
)
def retrieve_with_year(spark, d):
    """The year is read from each query's words and becomes an equality of the join."""
    said = _queries(spark, d).withColumn("said", F.format_string("%d yılında ne oldu", F.lit(1990) + F.col("query_id") % 7))
    q = said.withColumn("years", T.bare_years(F.col("said"))).drop("said")
    c = _chunks(spark, d).withColumn("year", (F.lit(1990) + F.col("chunk_id") % 30).cast("int"))
    got = R.top_k(q, c, 5, skip="query_id", among=("years", "year"))
    return got.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


@query(
    "e15_page_metrics",
    f"""WITH {HITS}, rp AS (SELECT DISTINCT query_id, unnest([query_id % 7, (query_id + 1) % 7]) AS page FROM q), h AS (SELECT query_id, rank, unnest([chunk_id % 7, chunk_id % 5]) AS page FROM hits WHERE rank <= 10),
    f AS (SELECT h.query_id, count(DISTINCT rank) AS a, count(DISTINCT page) AS b, min(rank) AS c FROM h JOIN rp USING (query_id, page) GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM rp GROUP BY 1),
    g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS g FROM (SELECT DISTINCT query_id, rank FROM h JOIN rp USING (query_id, page)) GROUP BY 1)
    SELECT query_id, round(coalesce(a, 0) / 10.0::DOUBLE, 6) AS precision, round(coalesce(b, 0) / n::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / c, 0), 6) AS mrr, (coalesce(a, 0) > 0)::INT AS hit_rate,
    round(coalesce(g, 0) / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN f USING (query_id) LEFT JOIN g USING (query_id)""",
)
def page_metrics(spark, d):
    page = lambda c, m: (F.col(c) % m).cast("long")
    hits = _hits(spark, d).select("query_id", "rank", F.lit("d").alias("document_id"), F.array(page("chunk_id", 7), page("chunk_id", 5)).alias("pages"))
    rel = _queries(spark, d).select("query_id", F.lit("d").alias("document_id"), F.array(page("query_id", 7), ((F.col("query_id") + 1) % 7).cast("long")).alias("pages"))
    return M.page_metrics(hits, rel, 10).select("query_id", "hit_rate", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query("f12_f13_vectors", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9), 6) AS cos,
    round(a.v[1] / sqrt(list_dot_product(a.v, a.v)), 6) AS first FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", T.doubles(F.col("embedding")).alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(T.cosine(F.col("v"), F.col("w")), 6).alias("cos"), F.round(T.l2_normalize(F.col("v"))[0], 6).alias("first"))


@query("u3_per_collection", f"WITH {HITS}, {POOL} SELECT query_id, collection, chunk_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(distance, 9), chunk_id) AS r FROM pool) WHERE r <= 2")
def per_collection(spark, d):
    return first_rows(_pool(spark, d).drop("rank"), ["query_id", "collection"], [F.round("distance", 9), F.col("chunk_id")], 2).select("query_id", "collection", "chunk_id", "rank")


def _index(spark, d):
    """Built on the rows of even ids, to which the others are added."""
    chunks = _chunks(spark, d)
    made = X.build(chunks.filter("chunk_id % 2 = 0"), scratch.place(spark, "index"))
    return X.add(made, chunks.filter("chunk_id % 2 = 1"))


@query("v6_index_topk", f"WITH {HITS} SELECT query_id, chunk_id, label, round(distance, 6) AS distance, rank FROM hits")
def index_topk(spark, d):
    """The exact nearest rows under a metadata filter, from an index that leaves cells out."""
    queries = _queries(spark, d).withColumn("own", F.col("query_id"))
    near = X.search(_index(spark, d), queries, 20, predicate(RANGE, columns={"year": "label"}), skip="own", also=("label",))
    return near.select("query_id", "chunk_id", "label", F.round("distance", 6).alias("distance"), "rank")


def _reported(spark, hits, seconds):
    """The reranked five of each query, or the nearest five if time is up."""

    def full():
        return _reranked(hits).select("query_id", "chunk_id", "rank")

    got, cut = timing.within(spark, seconds, full, lambda: hits.filter("rank <= 5").select("query_id", "chunk_id", "rank"))
    return got.select(F.lit(cut).alias("truncated"), "query_id", "chunk_id", "rank")


@query(
    "o7_within_budget",
    f"""WITH {HITS}, s AS (SELECT query_id, chunk_id, -abs(label - query_label) - distance AS score FROM hits),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
    SELECT false AS truncated, query_id, chunk_id, rank FROM r WHERE rank <= 5 UNION ALL SELECT true, query_id, chunk_id, rank FROM hits WHERE rank <= 5""",
)
def within_budget(spark, d):
    """A report with a budget that suffices and one with none, told apart; both read the same hits."""
    hits = scratch.written(_hits(spark, d), "hits")
    return _reported(spark, hits, 3_600).unionByName(_reported(spark, hits, 0))


@query(
    "e27_timed_stages",
    f"""WITH {HITS}, t AS (SELECT 'embed' AS label, count(*) AS n FROM embeddings UNION ALL SELECT 'retrieve', count(*) FROM hits UNION ALL SELECT 'head', count(*) FROM hits WHERE rank <= 3)
    SELECT label, n, 1::BIGINT AS calls, true AS timed FROM t""",
)
def timed_stages(spark, d):
    """Rows counted by observation while the stages run, and their times as latencies."""
    seen = timing.Timings(spark)
    seen.stage("embed", _chunks(spark, d))
    hits = seen.stage("retrieve", _hits(spark, d))
    seen.stage("head", hits.filter("rank <= 3"))
    taken = M.latency(seen.rows(), "label", "ms").select("label", F.col("n").alias("calls"), (F.col("p99") > 0).alias("timed"))
    return seen.rows().select("label", "n").join(taken, "label")


def _session(spark, d):
    """Vectors as two collections with their documents' texts, and a third that the session may not see."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    rows = rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"), "embedding", "label")
    at = session.Session(spark, ["minutes", "press", "absent"])
    at.register("minutes", rows.filter("label < 3"), "tutanak")
    at.register("hidden", rows.filter("label = 3"))
    at.register("press", rows.filter("label > 3"), "press_clip", 0.5)
    return at


_SESSION_SQL = f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT vec_id, CASE WHEN label < 3 THEN 'minutes' ELSE 'press' END AS collection, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 3),
p AS (SELECT query_id, collection, vec_id, {DIST.format(a="q.v", b="c.v")} AS distance FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), collection, vec_id::VARCHAR) AS rank FROM p)"""


@query(
    "o1_session_sql",
    f"WITH {_SESSION_SQL} SELECT query_id, CASE collection WHEN 'press' THEN 'press_clip' ELSE 'tutanak' END AS document_type, vec_id::VARCHAR AS chunk_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 4",
)
def session_sql(spark, d):
    """Collections, their list and the answers to a table of questions, joined by SQL."""
    _session(spark, d).answer(_queries(spark, d), 4)
    return spark.sql(
        """SELECT r.query_id, c.document_type, r.chunk_id, round(r.distance, 6) AS distance, r.rank
        FROM session_answers AS r JOIN session_collections AS c ON c.name = r.collection"""
    )


@query(
    "o1_session_orchestrate",
    f"""WITH {_SESSION_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(distance, 9), vec_id) AS place FROM p)
    SELECT query_id, CASE WHEN query_id % 40 = 0 THEN 'refuse' ELSE 'answer' END AS action, CASE WHEN query_id % 40 = 0 THEN 0 ELSE 6 END::BIGINT AS n,
    CASE WHEN query_id % 40 = 0 THEN '' ELSE string_agg(vec_id, ',' ORDER BY collection, place) FILTER (place <= 3) END AS chunk_ids FROM h GROUP BY query_id""",
)
def session_orchestrate(spark, d):
    """Plans of a session: half the queries ask for what it may not see and are refused."""
    at, queries = _session(spark, d), _queries(spark, d)
    row = lambda name, priority: F.struct(F.lit(name).alias("collection"), F.lit(priority).alias("priority"), F.lit(3).alias("retrieval_budget"), F.lit(2).alias("reserve_budget"))
    asked = F.when(F.col("query_id") % 40 == 0, F.array(row("hidden", 1))).otherwise(F.array(row("minutes", 1), row("press", 2), row("hidden", 3)))
    plans = queries.select("query_id", F.explode(asked).alias("p")).select("query_id", "p.*")
    got = at.orchestrate(queries, plans, per_document=99)
    return got.select("query_id", "action", "n", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"))


@query(
    "v11_deep_report",
    f"""WITH e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM embeddings JOIN documents ON doc_id = vec_id),
    q AS (SELECT q.vec_id AS query_id, coalesce(n.embedding, q.embedding)::DOUBLE[] AS a, q.vec_id % 40 > 0 AS more FROM embeddings q LEFT JOIN embeddings n ON n.vec_id = q.vec_id + 1 AND q.vec_id % 40 > 0 WHERE q.vec_id % 20 = 0),
    p AS (SELECT query_id, chunk_id, text, more, {DIST.format(a="a", b="v")} AS distance FROM q, e),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS r FROM p) WHERE r <= 150),
    scored AS (SELECT *, -(chunk_id % 7) - distance AS score FROM near), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT query_id, CASE WHEN more THEN 'zqxv zqxw' ELSE 'zqxv' END AS combined, CASE WHEN more THEN 'zqxw' END AS expanded, chunk_id, rank, md5('No: ' || chunk_id || chr(10) || text[1:3000]) AS shown FROM k WHERE rank <= 40""",
)
def deep_report(spark, d):
    """Forty chunks of a hundred and fifty for queries of which half are expanded, and embedded with their expansion."""
    k = F.col("query_id")
    asked = _queries(spark, d).select("query_id", F.lit("zqxv").alias("query"), F.when(k % 40 > 0, "zqxw").otherwise("zqxv").alias("expansion"))
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("qvec"))

    def embed(df):
        # An expanded query has the vector of the next row, where there is one.
        own = df.withColumn("_v", F.when(F.col("expanded").isNotNull(), k + 1).otherwise(k))
        two = own.join(vectors.withColumnsRenamed({"vec_id": "_v", "qvec": "_next"}), "_v", "left").join(vectors, F.col("query_id") == F.col("vec_id"))
        return two.withColumn("qvec", F.coalesce("_next", "qvec")).drop("_v", "_next", "vec_id")

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.regexp_replace("text", "[0-9]", "#").alias("text"))
    c = _chunks(spark, d).join(docs, "chunk_id").withColumn("year", F.lit(1990)).withColumn("no", F.col("chunk_id").cast("string"))
    got = G.deep_retrieve(asked, c, embed, [("No", "no")], -(F.col("chunk_id") % 7) - F.col("distance"))
    return got.select("query_id", "combined", "expanded", "chunk_id", "rank", F.md5("shown").alias("shown"))


@query(
    "v2_pooled_batches",
    """WITH t AS (SELECT vec_id // 5 AS text_id, vec_id // 40 AS batch, vec_id % 5 AS pos, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 <= (vec_id // 5) % 5 AND vec_id % 5 < 4),
    l AS (SELECT batch, max(pos) + 1 AS n FROM t GROUP BY batch), x AS (SELECT text_id, batch, unnest(v[1:6]) AS x, unnest(range(6)) AS i FROM t),
    m AS (SELECT text_id, i, sum(x) / any_value(n) AS m FROM x JOIN l USING (batch) GROUP BY text_id, i)
    SELECT text_id, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY text_id)), 6) AS x FROM m""",
)
def pooled_batches(spark, d):
    """Texts of up to five tokens in batches of eight: four tokens are read, six components kept, means go over the padded length."""
    k = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(F.expr("vec_id div 5").alias("text_id"), F.expr("vec_id div 40").alias("batch"), (k % 5).alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("pos") <= F.col("text_id") % 5)
    got = providers.pooled(rows, "batch", 6, 4)
    return got.select("text_id", F.posexplode("embedding").alias("i", "x")).select("text_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
