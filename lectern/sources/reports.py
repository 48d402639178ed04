"""Sinks for reports, artifacts and golden entries, and a cache of computed rows by content."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def write_document_reports(reports: DataFrame, root: str) -> None:
    """A JSON row for each document, in a folder for each collection; a collection's later rows are added.

    ``reports`` has document_id, collection, status, timings, chunk and warnings.
    One file for each document would swamp a file system, so rows share files.
    """
    stamped = reports.withColumn("ingest_time", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    stamped.write.mode("append").partitionBy("collection").json(root)


def write_named(report: DataFrame, root: str, prefix: str = "eval_report", at: datetime | None = None) -> str:
    """Write JSON rows under a name with the time in it; an existing one is an error."""
    path = f"{root}/{prefix}_{(at or datetime.now()):%Y%m%d_%H%M%S}"
    report.write.mode("errorifexists").json(path)
    return path


def artifact_name(source: Column, content_hash: Column) -> Column:
    """A file's name without folder and ending, and the start of its content's hash."""
    stem = F.regexp_replace(F.substring_index(source, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("__"), F.substring(content_hash, 1, 8))


def append_golden(entries: DataFrame, path: str) -> None:
    """Add entries of new ids to a golden set of JSON rows; ids that it has stay as they are."""
    spark = entries.sparkSession
    old = _read(spark, path, "json")
    fresh = entries if old is None else entries.join(old.select("id"), "id", "left_anti")
    fresh.dropDuplicates(["id"]).write.mode("append").json(path)


#: What a report says without a text, and over its sources.
NO_ANSWER = "_(boş yanıt)_"
SOURCES = "## Kaynaklar"


def quoted(c: Column) -> Column:
    """A string as a quoted literal: single quotes, or double ones if it holds only single ones; backslashes and control signs are escaped."""
    for sign, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(sign), F.lit(shown))
    control = r"[\x00-\x1f\x7f]"
    code = lambda x: F.when(x.rlike(control), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(x)), 2, "0")))).otherwise(x)
    c = F.when(c.rlike(control), F.array_join(F.transform(F.split(c, ""), code), "")).otherwise(c)
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(single)


def research_report(markdown: Column, query: Column, at: Column, model: Column, k: Column, seconds: Column, expanded: Column, sources: Column) -> Column:
    """A report as Markdown: front matter, the text, and its numbered sources.

    ``sources`` is an array of document_type, document_id, source_name, date,
    author, title and distance; absent values show as a question mark.
    """
    field = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    head = F.concat_ws(
        "\n", F.lit("---"), field("query", quoted(query)), field("timestamp", at), field("model", model), field("k", k.cast("string")),
        field("elapsed_seconds", F.format_string("%.1f", seconds)), F.when(expanded != "", field("expanded_query", quoted(expanded))), F.lit("---"),
    )
    shown = lambda c: F.when(c.isNull() | (c == ""), "?").otherwise(c)

    def line(s: Column, i: Column) -> Column:
        title = F.when(s["title"] != "", F.concat(F.lit(" — "), s["title"]))
        place = F.concat(F.lit("**["), shown(s["document_type"]), F.lit("#"), shown(s["document_id"]), F.lit("]** "))
        names = F.concat_ws(" | ", shown(s["source_name"]), shown(s["date"]), shown(s["author"]))
        return F.concat((i + 1).cast("string"), F.lit(". "), place, names, F.coalesce(title, F.lit("")), F.lit("  _(d="), F.format_string("%.3f", s["distance"]), F.lit(")_"))

    body = F.when(F.trim(markdown) != "", F.trim(markdown)).otherwise(NO_ANSWER)
    lines = F.concat(F.array(body, F.lit(""), F.lit(SOURCES), F.lit("")), F.transform(sources, line))
    return F.concat(head, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n"))


def report_name(query: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd-HHmm"), F.lit("_"), T.slug(query), F.lit(".md"))


def with_ids(entries: DataFrame, golden: DataFrame | None, prefix: str, order: str) -> DataFrame:
    """``entries`` with an id of their ``prefix`` column and a number that goes on from the golden set's ids of that prefix."""
    number = F.row_number().over(Window.partitionBy(prefix).orderBy(order))
    if golden is not None:
        known = entries.select(F.col(prefix).alias("_p")).distinct()
        used = known.join(golden.select(F.col("id").alias("_id")), F.col("_id").startswith(F.col("_p"))).groupBy("_p").agg(F.count("*").alias("_n"))
        entries = entries.join(used, F.col(prefix) == F.col("_p"), "left")
        number = number + F.coalesce("_n", F.lit(0))
    shown = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return entries.withColumn("id", F.concat_ws("-", prefix, shown)).drop("_p", "_n")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.format(kind).load(path) if there else None
