"""Retrieval metrics over ranks, spans, tokens and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.intervals import overlapping


def rank_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, hit rate, MRR and NDCG at ``k`` of each query in ``relevant``.

    ``hits`` (query_id, rank, hit 0/1); ``relevant`` (query_id, n_rel).
    Duplicates count each time, so recall can pass one, and precision divides by
    ``k`` however few were returned.
    """
    top = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum("hit").alias("hits"),
        F.min(F.when(F.col("hit") > 0, F.col("rank"))).alias("first"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.col("n_rel") > 0
    joined = relevant.join(top, "query_id", "left")
    hits_ = F.coalesce("hits", F.lit(0))
    return joined.select(
        "query_id",
        (hits_ / k).alias("precision"),
        F.when(some, hits_ / F.col("n_rel")).otherwise(0.0).alias("recall"),
        (hits_ > 0).cast("int").alias("hit_rate"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(some, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, n) over the queries that have each metric."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    long = per_query.select(F.explode(pairs).alias("m")).select("m.metric", "m.value").filter("value is not null")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def grade(precision: Column, mrr: Column) -> Column:
    s = F.greatest(precision, mrr)
    return F.when(s.isNull(), "skip").when(s >= 0.5, "PASS").when(s >= 0.3, "WARN").otherwise("FAIL")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Characters that two half-open spans share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = overlap(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def span_pairs(retrieved: DataFrame, golden: DataFrame) -> DataFrame:
    """Retrieved spans with the golden spans of their query and document that they overlap, and by how much.

    Spans meet under shared dyadic blocks, so a document with many spans costs
    its spans and the pairs that overlap, not all pairs.
    """
    g = golden.select("query_id", "document_id", "golden_id", F.col("char_start").alias("g0"), F.col("char_end").alias("g1"))
    joined = overlapping(retrieved, g, ["query_id", "document_id"], ("char_start", "char_end"), ("g0", "g1"))
    s = (F.col("char_start"), F.col("char_end"), F.col("g0"), F.col("g1"))
    return joined.withColumn("shared", overlap(*s)).withColumn("iou", iou(*s))


def span_metrics(retrieved: DataFrame, golden: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Precision and MRR over retrieved spans, recall over golden spans found."""
    top = retrieved.filter(F.col("rank") <= k)
    pairs = span_pairs(top, golden).filter(F.col("iou") > threshold)
    got = pairs.groupBy("query_id").agg(F.countDistinct("rank").alias("n_hit"), F.countDistinct("golden_id").alias("n_found"), F.min("rank").alias("first"))
    want = golden.groupBy("query_id").agg(F.count("*").alias("n_golden"))
    joined = want.join(got, "query_id", "left")
    zero = F.lit(0)
    return joined.select(
        "query_id",
        (F.coalesce("n_hit", zero) / k).alias("precision"),
        (F.coalesce("n_found", zero) / F.col("n_golden")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def evidence_coverage(retrieved: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """The part of each query's golden characters that the union of its top ``k`` spans covers."""
    clipped = span_pairs(retrieved.filter(F.col("rank") <= k), golden).filter("shared > 0")
    clipped = clipped.select("query_id", "golden_id", F.greatest("char_start", "g0").alias("lo"), F.least("char_end", "g1").alias("hi"))
    before = Window.partitionBy("query_id", "golden_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hi").over(before), F.col("lo"))
    fresh = clipped.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", reach)))
    covered = fresh.groupBy("query_id").agg(F.sum("new").alias("covered"))
    total = golden.groupBy("query_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("total"))
    return total.join(covered, "query_id", "left").select("query_id", F.when(F.col("total") > 0, F.coalesce("covered", F.lit(0)) / F.col("total")).otherwise(1.0).alias("coverage"))


def token_overlap(retrieved: DataFrame, golden: DataFrame) -> DataFrame:
    """Multiset token recall, precision and IoU of each query's retrieved and golden texts.

    Words are counted on each side before the two sides meet.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        ws = df.select("query_id", F.explode(T.tokens(F.col("text"))).alias("w"))
        return ws.groupBy("query_id", "w").agg(F.count("*").alias(name))

    both = counted(golden, "g").join(counted(retrieved, "r"), ["query_id", "w"], "full").na.fill(0, ["g", "r"])
    s = both.groupBy("query_id").agg(F.sum(F.least("g", "r")).alias("i"), F.sum("g").alias("g"), F.sum("r").alias("r"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    i, g, r = F.col("i"), F.col("g"), F.col("r")
    return s.select("query_id", ratio(i, g).alias("token_recall"), ratio(i, r).alias("token_precision"), ratio(i, g + r - i).alias("token_iou"))


def page_metrics(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Page matching: a hit shares a page key with the query's, recall is over distinct keys, NDCG's ideal has one hit for each key."""
    rel = relevant.select("query_id", "document_id", F.explode("pages").alias("page")).distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    keys = retrieved.filter(F.col("rank") <= k).select("query_id", "rank", "document_id", F.explode("pages").alias("page"))
    found = keys.join(rel, ["query_id", "document_id", "page"], "left_semi")
    ranks = found.groupBy("query_id", "rank").agg(F.lit(1).alias("hit"))
    keyed = found.groupBy("query_id").agg(F.countDistinct("document_id", "page").alias("n_found"))
    scored = rank_metrics(ranks, n_rel, k).drop("recall")
    recall = F.coalesce("n_found", F.lit(0)) / F.col("n_rel")
    return scored.join(n_rel, "query_id").join(keyed, "query_id", "left").select("query_id", "precision", recall.alias("recall"), "hit_rate", "mrr", "ndcg")


def regressions(now: DataFrame, golden: DataFrame, columns: list[str], most: float = 1.0) -> DataFrame:
    """Queries whose score fell by more than ``most`` in any column."""
    j = now.alias("n").join(golden.alias("g"), "query_id")
    worst = F.greatest(*[F.col(f"g.{c}") - F.col(f"n.{c}") for c in columns])
    return j.select("query_id", worst.alias("drop"), (worst > most).alias("regressed"))


#: Places of the quantile sketch that bounds a percentile: the slice between its bounds holds three of them.
SKETCH = 10_000


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and exact nearest-rank percentiles of each label.

    A quantile sketch gives values a little below and above each percentile.
    What lies below is only counted, and of the slice between them (some three
    ten-thousandths of a label) each distinct value with its count, so a hot
    label or value is neither sorted nor gathered.
    """
    wanted = (50, 95, 99)
    known = df.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("v"))
    at = [x for p in wanted for x in (p / 100 - 1.5 / SKETCH, min(1.0, p / 100 + 1.5 / SKETCH))]
    size = known.groupBy(by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile_approx("v", at, SKETCH).alias("_at"))
    dealt = known.join(size.select(F.col(by).alias("_by"), "_at"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    inside = lambda k: F.col("v").between(F.get("_at", F.lit(2 * k)), F.get("_at", F.lit(2 * k + 1)))
    below = dealt.groupBy(by).agg(*[F.count_if(F.col("v") < F.get("_at", F.lit(2 * k))).alias(f"_b{p}") for k, p in enumerate(wanted)])
    slots = F.filter(F.array(*[F.when(inside(k), F.lit(p)) for k, p in enumerate(wanted)]), lambda p: p.isNotNull())
    held = dealt.select(by, "v", F.explode(slots).alias("p")).groupBy(by, "p", "v").agg(F.count("*").alias("here"))
    facts = size.drop("_at").join(below.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    up_to = F.sum("here").over(Window.partitionBy(by, "p").orderBy("v"))
    ranked = held.withColumn("_to", up_to).join(facts.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    lower = F.coalesce(*[F.when(F.col("p") == p, F.col(f"_b{p}")) for p in wanted])
    place = F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1)
    hit = (place >= lower + F.col("_to") - F.col("here")) & (place < lower + F.col("_to"))
    return ranked.filter(hit).groupBy(by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in wanted])
