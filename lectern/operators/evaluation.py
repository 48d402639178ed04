"""Choice of matcher, fixture statistics, report averages and comparison of context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.functions import text as T
from lectern.operators import agents as G
from lectern.operators import metrics as M
from lectern.operators import nearest
from lectern.operators.filters import first_rows
from lectern.operators.retrieval import QUERY_BLOCK

# What a judge scores.
DIMENSIONS = ("faithfulness", "groundedness", "relevance", "citation_quality")


def matcher(pages: Column, spans: Column, excerpts: Column, records: Column, chunk_ids: Column) -> Column:
    """Which truth a query is scored by: pages, else spans, else excerpts and ids together, else none.

    Empty pages, spans and excerpts count as absent; record numbers win over
    chunk ids, and an empty list of ids counts as given.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    ids = F.when(records.isNotNull(), "kayit_no").when(chunk_ids.isNotNull(), "chunk_id")
    both = F.concat_ws("+", F.when(some(excerpts), "token_overlap"), ids)
    return F.when(some(pages), "page_overlap").when(some(spans), "span_overlap").when(both != "", both).otherwise("none")


def record_numbers(chunk_id: Column) -> Column:
    """What stands before the first underscore of a chunk id; numbers without leading zeros."""
    head = F.substring_index(chunk_id, "_", 1)
    return F.coalesce(head.try_cast("bigint").cast("string"), head)


def by_matcher(retrieved: DataFrame, golden: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(query_id, matcher, metric, value): each query's metrics by the truth it has.

    ``retrieved`` has query_id, rank, chunk_id, document_id, char_start,
    char_end, pages and text; ``golden`` one row for each query with
    relevant_pages (document_id and page), spans, excerpts,
    relevant_kayit_nos and relevant_chunk_ids. Each kind of metric sees only the
    rows of its own queries. Spans have an NDCG of zero, since none is defined.
    """
    named = golden.withColumn("matcher", matcher(*[F.col(c) for c in ("relevant_pages", "gold_evidence_spans", "excerpts", "relevant_kayit_nos", "relevant_chunk_ids")]))
    hits = retrieved.join(named.select("query_id", "matcher"), "query_id")
    all_queries = named.select("query_id", "matcher")

    def part(kind: str) -> tuple[DataFrame, DataFrame]:
        return hits.filter(F.col("matcher").contains(kind)).drop("matcher"), named.filter(F.col("matcher").contains(kind)).drop("matcher")

    def long(df: DataFrame, names: list[str]) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
        return df.select("query_id", pairs.alias("m")).select("query_id", "m.metric", "m.value")

    rank_names = ["precision", "recall", "hit_rate", "mrr", "ndcg"]
    got, gold = part("page_overlap")
    truth = gold.select("query_id", F.explode("relevant_pages").alias("p")).select("query_id", "p.document_id", F.array("p.page").alias("pages"))
    out = [long(M.page_metrics(got.select("query_id", "rank", "document_id", "pages"), truth, k), rank_names)]

    got, gold = part("span_overlap")
    truth = gold.select("query_id", F.posexplode("gold_evidence_spans").alias("golden_id", "s")).select("query_id", "golden_id", "s.*")
    found = got.filter("char_start is not null").select("query_id", "document_id", "rank", "char_start", "char_end")
    span = M.span_metrics(found, truth, k, threshold).withColumn("hit_rate", (F.col("precision") > 0).cast("double")).withColumn("ndcg", F.lit(0.0))
    covered = M.evidence_coverage(found, truth, k).select("query_id", F.col("coverage").alias("evidence_coverage"))
    out += [long(span, rank_names), long(covered, ["evidence_coverage"])]

    got, gold = part("token_overlap")
    tokens = M.token_overlap(got.filter(F.col("rank") <= k).select("query_id", "text"), gold.select("query_id", F.explode("excerpts").alias("text")))
    out.append(long(tokens, ["token_recall", "token_precision", "token_iou"]))

    for kind, ids, key in (("kayit_no", "relevant_kayit_nos", record_numbers(F.col("chunk_id"))), ("chunk_id", "relevant_chunk_ids", F.col("chunk_id"))):
        got, gold = part(kind)
        truth = gold.select("query_id", F.array_distinct(F.col(ids).cast("array<string>")).alias("ids"))
        hit = F.array_contains("ids", key.cast("string")).cast("int")
        marked = got.join(truth, "query_id").select("query_id", "rank", hit.alias("hit"))
        out.append(long(M.rank_metrics(marked, truth.select("query_id", F.size("ids").alias("n_rel")), k), rank_names))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return all_queries.join(rows, "query_id", "left")


def judged(first: Column, second: Column, most: float = 1.0) -> Column:
    """The mean of two runs of a judge in each dimension, and whether any differs by more than ``most``.

    Runs are JSON texts, fenced or not; an absent dimension, or all of a broken
    run's, count as 0. The rationale is the first run's.
    """
    runs = [A.extract_json(c) for c in (first, second)]
    value = lambda r, k: F.coalesce(F.get_json_object(r, f"$.{k}").try_cast("double"), F.lit(0.0))
    pairs = {k: [value(r, k) for r in runs] for k in DIMENSIONS}
    noisy = F.greatest(*[F.abs(a - b) for a, b in pairs.values()]) > most
    means = [F.bround((a + b) / 2, 2).alias(k) for k, (a, b) in pairs.items()]
    return F.struct(*means, F.coalesce(F.get_json_object(runs[0], "$.rationale"), F.lit("")).alias("rationale"), noisy.alias("noisy"))


def layers(retrieved: DataFrame, golden: DataFrame, k: int, most_distance: float = 1.8) -> DataFrame:
    """One row for each query: rank metrics, routing and date accuracy, and what reached the context.

    ``retrieved`` has query_id, rank, document_id and distance; ``golden``
    query_id, query, relevant_ids, is_minutes, expected_source, expected_year.
    An unknown distance reaches the context.
    """
    marked = retrieved.join(golden.select("query_id", "relevant_ids"), "query_id")
    hit = F.coalesce(F.array_contains("relevant_ids", F.col("document_id")), F.lit(False))
    ranks = M.rank_metrics(marked.select("query_id", "rank", hit.cast("int").alias("hit")), golden.select("query_id", F.coalesce(F.size(F.array_distinct("relevant_ids")), F.lit(0)).alias("n_rel")), k)
    near = F.when(F.col("distance").isNull() | (F.col("distance") <= most_distance), F.col("document_id"))
    # Only relevant documents can count, so no more than those are gathered.
    included = marked.filter(hit).groupBy("query_id").agg(F.collect_set(near).alias("included"))
    rows = golden.join(ranks, "query_id").join(included, "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *ranks.columns, G.routing_accuracy(F.col("is_minutes"), F.col("expected_source")).alias("routing_acc"), G.date_accuracy(F.col("query"), F.col("expected_year")).alias("date_acc"),
        G.context_share(F.coalesce("relevant_ids", none), F.coalesce("included", none)).alias("context_coverage"),
    )


def fixture_counts(golden: DataFrame) -> DataFrame:
    """One row: how many queries there are, and how many have spans and chunk ids."""
    return golden.agg(
        F.count("*").alias("n_queries"), F.count("gold_evidence_spans").alias("n_spans"), F.count("relevant_chunk_ids").alias("n_chunk_ids")
    )


def browse(golden: DataFrame, search: str) -> DataFrame:
    """Queries whose text or one of whose tags holds what is searched for; an empty search holds all."""
    s = F.lit(search.lower())
    tagged = F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), s)), F.lit(False))
    return golden.filter(F.contains(F.lower("query"), s) | tagged) if search else golden


def report_averages(results: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each column's mean without nulls, and its text for a report, a dash if nothing is known."""
    means = results.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    shown = {f"{c}_shown": F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).otherwise("—") for c in columns}
    return means.withColumns(shown)


def regression_mark(regressed: Column) -> Column:
    """A cross for a regression, a tick for none, a dash where it was not tested."""
    return F.when(regressed, "✗").when(~regressed, "✓").otherwise("—")


def window_bench(queries: DataFrame, chunks: DataFrame, relevant: DataFrame, k: int = 10, near: int = 5) -> DataFrame:
    """(max_tokens, mrr, ndcg, precision, avg_cos): the mean scores of each context window.

    ``queries`` (query_id, qvec) and ``chunks`` (max_tokens, chunk, vec), each
    window's vectors, meet in cells (:func:`nearest.pairs`). ``relevant``
    (query_id, chunk) may lack a query, whose nearest chunk then counts as
    relevant. Relevant chunks are found by their key first, and the best of each
    goes along with its query, so a cell leaves a query's best rows and a count
    of the chunks before its first relevant one, and no other pair.
    """
    keys = ["max_tokens", "query_id"]
    asked = queries.select("query_id", T.doubles(F.col("qvec")).alias("qvec"))
    truth = relevant.groupBy("query_id").agg(F.collect_set("chunk").alias("truth"))
    cos = F.round(T.cosine(F.col("qvec"), T.doubles(F.col("vec"))), 12)
    met = relevant.distinct().join(asked, "query_id").join(chunks, "chunk").select(*keys, "chunk", cos.alias("cos"))
    best = met.groupBy(*keys).agg(F.max(F.struct("cos", (-F.col("chunk")).alias("c"))).alias("best"))
    best = best.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("max_tokens", "best"))).alias("bests"))
    side = asked.join(best, "query_id", "left")
    vectors = chunks.select("max_tokens", F.col("chunk").alias("chunk_id"), F.col("vec").alias("embedding"))
    pairs = nearest.pairs(side, vectors, max(k, near), QUERY_BLOCK, ("max_tokens",), counted="bests")
    pairs = pairs.withColumn("cos", F.round("similarity", 12)).withColumnRenamed("chunk_id", "chunk")
    every = Window.partitionBy(*keys)
    ranked = pairs.withColumn("rank", F.row_number().over(every.orderBy(F.desc("cos"), "chunk"))).withColumn("n_before", F.sum("n_before").over(every))
    top = ranked.filter(F.col("rank") <= max(k, near)).join(truth, "query_id", "left")
    hit = F.when(F.col("truth").isNull(), F.col("rank") == 1).otherwise(F.array_contains("truth", F.col("chunk")))
    gain = F.when(hit & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.size(F.coalesce("truth", F.array(F.lit(0).cast("long"))))))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    per = top.groupBy(*keys).agg(
        F.sum(gain).alias("dcg"), F.first(ideal).alias("ideal"), F.sum((hit & (F.col("rank") <= near)).cast("int")).alias("hits"),
        F.avg(F.when(F.col("rank") <= near, F.col("cos"))).alias("near_cos"), F.first("n_before").alias("n_before"), F.max(F.col("truth").isNull()).alias("own"),
    )
    # Without a relevant chunk among all there is no place before which to count.
    mrr = F.when(F.col("own"), 1.0).otherwise(F.coalesce(1 / (F.col("n_before") + 1), F.lit(0.0)))
    scored = per.withColumn("mrr", mrr)
    return scored.groupBy("max_tokens").agg(
        F.avg("mrr").alias("mrr"), F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"), F.avg(F.col("hits") / near).alias("precision"), F.avg("near_cos").alias("avg_cos")
    )
