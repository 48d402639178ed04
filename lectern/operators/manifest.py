"""Keyed upsert, difference, counts and statistics of the ingest manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

KEY = ["document_id", "collection"]
#: Columns that keep the old value where the new one is null.
SOFT = ("quality_json", "perf_json")
#: Columns that keep the old value always.
HELD = ("ingest_time",)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows over old ones by key."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    out = []
    for c in old.columns:
        if c in KEY:
            out.append(F.col(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in HELD:
            out.append(F.when(F.col("_o"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c in SOFT:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, KEY, "full").select(*out)


def diff(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each incoming document as new, changed or unchanged by its content hash."""
    m = manifest.select(*KEY, F.col("content_hash").alias("_was"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "new").when(F.col("content_hash").eqNullSafe(F.col("_was")), "unchanged").otherwise("changed")
    return incoming.join(m, KEY, "left").withColumn("state", state).drop("_was", "_there")


def delete(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    return manifest.join(keys, KEY, "left_anti")


def counts(manifest: DataFrame, by: list[str]) -> DataFrame:
    return manifest.groupBy(*by).agg(F.count("*").alias("n"))


def status_table(manifest: DataFrame, by: list[str], statuses: list[str]) -> DataFrame:
    return manifest.groupBy(*by).pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


def run_summary(results: DataFrame) -> DataFrame:
    status = F.col("status")
    return results.agg(
        F.count_if(status == "done").alias("done"), F.count_if(status == "skipped").alias("skipped"), F.count_if(status == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(status == "done", F.col("chunk_count"))), F.lit(0)).alias("chunks"),
    )


def perf_trends(manifest: DataFrame) -> DataFrame:
    """Mean times of done documents of each collection; zero counts as missing, spans default to 100 %."""
    perf = F.from_json("perf_json", "total_ms double, parse_ms double, embed_ms double, span_coverage_pct double")
    quality = F.from_json("quality_json", "ocr_flagged boolean")
    done = manifest.filter("status = 'done' and perf_json is not null").select("collection", perf.alias("p"), quality.alias("q"))
    mean = lambda c: F.round(F.avg(F.nullif(F.col(f"p.{c}"), F.lit(0.0))), 6).alias(c)
    return done.groupBy("collection").agg(
        F.count("*").alias("n"), mean("total_ms"), mean("parse_ms"), mean("embed_ms"),
        F.round(F.avg(F.coalesce("p.span_coverage_pct", F.lit(100.0))), 6).alias("span_coverage_pct"),
        F.round(100 * F.avg(F.coalesce(F.col("q.ocr_flagged"), F.lit(False)).cast("int")), 6).alias("flagged_pct"),
    )


def chunk_stats(chunks: DataFrame, by: list[str], target: int) -> DataFrame:
    """Sizes of each group's chunks, the short and long ones, and its health."""
    n = F.length("text")
    g = chunks.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(n).alias("min_chars"), F.percentile(n, 0.5).alias("median_chars"), F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"),
        F.count_if(n < 100).alias("too_short"), F.count_if(n > 1.2 * target).alias("too_long"),
    )
    bad = (F.col("too_short") + F.col("too_long")) / F.col("n")
    return g.withColumn("health", F.when(bad < 0.1, "good").when(bad < 0.3, "fair").otherwise("poor"))


def histogram(chunks: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins; the greatest value falls into the last."""
    ends = chunks.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return chunks.crossJoin(F.broadcast(ends)).groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children whose parent id is missing or no number."""
    pid = F.split("chunk_id", "_")[0].try_cast("bigint")
    return children.withColumn("_p", pid).join(parents.select(F.col("document_id").alias("_p")), "_p", "left_anti").drop("_p")


def validate(rows: DataFrame, collections: list[str], types: list[str], files: DataFrame | None = None) -> DataFrame:
    """(position, document_id, error) for each rule a row breaks; of equal ids the second on.

    With ``files`` (path), a source that is neither a URL nor one of them is
    missing. The first place of each id is aggregated, so rows without an id
    meet nowhere.
    """
    known = F.coalesce("document_id", F.lit("")) != ""
    first = rows.filter(known).groupBy("document_id").agg(F.min("position").alias("_first"))
    marked = rows.join(first, "document_id", "left")
    rules = [
        (~known, "missing id"),
        (known & (F.col("position") > F.col("_first")), "duplicate id"),
        (F.col("document_type").isNull(), "missing type"),
        (F.col("document_type").isNotNull() & ~F.col("document_type").isin(types), "unknown type"),
        (~F.coalesce("collection", F.lit("")).isin(collections), "unknown collection"),
    ]
    if files is not None:
        there = files.select(F.col("path").alias("_path")).distinct()
        marked = marked.join(there, marked["document_source"] == there["_path"], "left")
        local = (F.coalesce("document_source", F.lit("")) != "") & ~T.is_url(F.col("document_source"))
        rules.append((local & F.col("_path").isNull(), "missing source"))
    errors = F.filter(F.array(*[F.when(c, F.lit(e)) for c, e in rules]), lambda e: e.isNotNull())
    return marked.select("position", "document_id", F.explode(errors).alias("error"))


def request_errors(requests: DataFrame, collections: list[str]) -> DataFrame:
    """(collection, error) of whole requests (collection, documents): an unknown collection, no documents."""
    rules = [(~F.coalesce("collection", F.lit("")).isin(collections), "unknown collection"), (F.coalesce(F.size("documents"), F.lit(0)) < 1, "no documents")]
    errors = F.filter(F.array(*[F.when(c, F.lit(e)) for c, e in rules]), lambda e: e.isNotNull())
    return requests.select("collection", F.explode(errors).alias("error"))
