"""Trace records, parity checks and tolerant reading of plans that a model wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.operators import retrieval as R

# What a plan's fields may hold; the first is what others become.
INTENTS = ["unknown", "factual", "comparative", "analytical", "temporal"]
QUERY_TYPES = ["fact", "summary", "comparison", "reasoning", "policy"]
MODES = ["parallel", "sequential"]
TOP_K, PRIORITY = 5, 1


def trace(events: DataFrame, places: int | None = None) -> DataFrame:
    """(trace_id, n_phases, total_ms): the latency of each trace, its phases rounded first if ``places`` is given."""
    ms = F.col("latency_ms") if places is None else F.round("latency_ms", places)
    return events.groupBy("trace_id").agg(F.count("*").alias("n_phases"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total_ms"))


def manifest_row(manifest: DataFrame, document_id: str, collection: str) -> DataFrame:
    """The row of one composite key; both parts reach the scan as filters."""
    return manifest.filter((F.col("document_id") == document_id) & (F.col("collection") == collection))


def clear(rows: DataFrame, collection: str) -> DataFrame:
    """Chunks or manifest rows without those of a collection; a null collection stays."""
    return rows.filter(~F.coalesce(F.col("collection") == collection, F.lit(False)))


def count_parity(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """(check, ok, total, orphans): whether two tables have equally many rows."""
    n = left.agg(F.count("*").alias("total")).join(F.broadcast(right.agg(F.count("*").alias("_other"))))  # one row each
    return n.select(F.lit(name).alias("check"), (F.col("total") == F.col("_other")).alias("ok"), "total", F.abs(F.col("total") - F.col("_other")).alias("orphans"))


def parent_parity(name: str, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(check, ok, total, orphans): chunks whose number before the first underscore no parent has, or that have none."""
    number = F.substring_index("chunk_id", "_", 1).try_cast("bigint")
    known = parents.select(F.col("document_id").cast("bigint").alias("_p")).distinct().withColumn("_known", F.lit(1))
    # Chunks of one parent are counted before the join, so a hot parent is one row in it.
    counted = chunks.groupBy(number.alias("_p")).agg(F.count("*").alias("n"))
    joined = counted.join(known, "_p", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("orphans")
    )
    return joined.select(F.lit(name).alias("check"), (F.col("orphans") == 0).alias("ok"), "total", "orphans")


def roll_up(checks: list[DataFrame]) -> DataFrame:
    """All checks as one table, with whether every one holds."""
    rows = reduce(DataFrame.unionByName, checks)
    return rows.withColumn("all_ok", F.min("ok").over(Window.partitionBy()))  # a row for each check


def plan(text: Column) -> Column:
    """A search plan from a model's JSON that keeps what is usable.

    Unknown intents and kinds of query become the first of their list. Resources
    without a collection, drafts without a text and resources without drafts go.
    Numbers and modes that do not fit take their defaults. Filters are not read.
    """
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    get = F.get_json_object
    named = lambda c, path: F.when(~_quoted(c, path), F.lit(None)).otherwise(F.trim(get(c, path)))
    whole = lambda c, path: F.when(get(c, path).rlike("^-?[0-9]+$") & ~_quoted(c, path), get(c, path).try_cast("int"))
    one_of = lambda c, xs: F.when(c.isin(xs), c).otherwise(xs[0])

    def draft(d: Column) -> Column:
        k = whole(d, "$.top_k")
        return F.struct(named(d, "$.text").alias("text"), F.when(k > 0, k).otherwise(TOP_K).alias("top_k"))

    def resource(r: Column) -> Column:
        drafts = F.filter(F.transform(listed(get(r, "$.query_drafts")), draft), lambda d: d["text"].isNotNull() & (d["text"] != ""))
        return F.struct(
            named(r, "$.collection").alias("collection"), one_of(get(r, "$.mode"), MODES).alias("mode"),
            F.coalesce(whole(r, "$.priority"), F.lit(PRIORITY)).alias("priority"), drafts.alias("query_drafts"),
        )

    usable = lambda r: r["collection"].isNotNull() & (r["collection"] != "") & (F.size(r["query_drafts"]) > 0)
    return F.struct(
        one_of(get(text, "$.intent"), INTENTS).alias("intent"), one_of(get(text, "$.query_type"), QUERY_TYPES).alias("query_type"),
        F.filter(F.transform(listed(get(text, "$.resources")), resource), usable).alias("resources"), F.coalesce(get(text, "$.reasoning"), F.lit("")).alias("reasoning"),
    )


def _quoted(c: Column, path: str) -> Column:
    """Whether a field of an object is a JSON string."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def verdict(output: Column, answer: Column) -> Column:
    """A validator's output as (passes, ran, issues, corrected_answer); a broken one passes and says it did not run.

    A correction counts only for an answer that fails, and only if it differs.
    """
    found = A.extract_json(output)
    kind = F.schema_of_variant(F.try_parse_json(found))
    ran = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    passes = ~ran | F.coalesce(F.get_json_object(found, "$.passes") != "false", F.lit(True))
    fixed = F.get_json_object(found, "$.corrected_answer")
    issues = F.when(ran, F.from_json(F.get_json_object(found, "$.issues"), "array<string>")).otherwise(F.array(F.lit("Validation skipped")))
    return F.struct(
        passes.alias("passes"), ran.alias("ran"), F.coalesce(issues, F.array().cast("array<string>")).alias("issues"),
        F.when(~passes & (F.trim(fixed) != F.trim(answer)), fixed).alias("corrected_answer"),
    )


def merged_context(results: list[DataFrame], max_chars: int, most_distance: float, total: int) -> DataFrame:
    """One context for each query from several result lists, in the order of the lists.

    A row needs a distance within the limit here; an unknown one goes.
    """
    known = [r.filter(F.col("distance") <= most_distance).withColumn("_list", F.lit(k)) for k, r in enumerate(results)]
    w = Window.partitionBy("query_id").orderBy("_list", "rank")
    rows = reduce(DataFrame.unionByName, known).withColumn("rank", F.row_number().over(w)).drop("_list")
    return R.context(rows, max_chars, most_distance, total)


def cited_context(chunks: DataFrame) -> DataFrame:
    """(query_id, context): assembled chunks in order, each under its number and place."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    head = F.concat(F.lit("["), F.col("_n"), F.lit("] ("), F.concat_ws("/", "collection", "document_id", "chunk_id"), F.lit(")\n"))
    blocks = chunks.withColumn("_n", n).select("query_id", F.struct("_n", F.concat(head, F.col("text")).alias("b")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n")
    return blocks.groupBy("query_id").agg(joined.alias("context"))
