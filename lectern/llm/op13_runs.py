"""Periodic runs of words in documents, and texts with each run brought to one period.

A document is searched by itself where it is read (:mod:`lyndon`), so nothing
is shuffled and memory follows the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lyndon, stage

_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def collapsed(words: list[bytes], found: list[lyndon.Run]) -> list[bytes]:
    """The words that are in no run after its first period."""
    keep = bytearray(b"\x01") * len(words)
    for start, end, period in found:
        keep[start + period : end] = bytes(end - start - period)
    return [w for w, k in zip(words, keep, strict=True) if k]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) for each row: its runs by start, then period, and its text without their repetitions.

    Words are what ASCII white space parts; ``edit`` may change them first.
    Null, empty and blank texts have no runs and an empty text. Each row is
    searched by itself, so null ids and repeated rows count as they are;
    further columns are not read, an empty table gives no rows.
    """

    def run(batches):
        for b in stage.slices(batches, "text"):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()
                if edit:
                    words = edit(doc_id, words)
                found = lyndon.runs(words)
                rows.append((doc_id, [{"start": s, "length": e - s, "period": p} for s, e, p in found], b" ".join(collapsed(words, found) if found else words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage.map_batches(rows, run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length over period, the first among equals; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def listed(runs: Column) -> Column:
    """One line for each run: ``start,length,period``."""
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's periodic tails: one id in ten, by its crc32, repeats a stretch from some word to the end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole ``documents`` with their planted tails: runs counted, the most repeated one, digests of runs and collapsed text."""
    found = periodic_runs(stage.table(spark, sf_dir, "documents"), edit=planted).withColumn("best", most_repeated(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
