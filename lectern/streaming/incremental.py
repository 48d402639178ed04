"""Incremental ingest on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import manifest as S
from lectern.sources import buckets


def latest(batch: DataFrame) -> DataFrame:
    """The last row of each key by ``ingest_time``, the greatest row among equals."""
    order = F.struct("ingest_time", F.struct(*[c for c in batch.columns if c not in S.KEY]))
    return batch.groupBy(*S.KEY).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")


def manifest_stream(spark: SparkSession, source: DataFrame, table_dir: str, checkpoint: str, bucket_count: int = buckets.BUCKETS) -> StreamingQuery:
    """Upsert each batch of a stream of manifest rows into the keyed store under ``table_dir``.

    A batch rewrites the buckets that its keys fall in, under the batch's
    number; one that runs again finds its version whole or writes it anew, so
    the result is the same. Within a batch the last row of a key counts.
    """
    if not buckets.exists(spark, table_dir):
        buckets.create(spark, table_dir, source.schema, S.KEY, bucket_count)

    def apply(batch: DataFrame, batch_id: int) -> None:
        buckets.merge(table_dir, latest(batch), batch_id, S.upsert)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table_dir: str) -> DataFrame:
    """The rows of the newest finished batch."""
    return buckets.read(spark, table_dir)


def running_outliers(source: DataFrame, by: str, value: str, least: int = 3, most: float = 0.3) -> DataFrame:
    """A stream's values against the mean of their key so far, with two numbers of state a key."""
    import pandas as pd

    def step(key, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            out = []
            for x in pdf[value]:
                if pd.isna(x):  # an unknown value is no outlier and leaves the mean alone
                    out.append(False)
                    continue
                mean = total / n if n else 0.0
                out.append(bool(n >= least and mean and abs(x - mean) / mean > most))
                n, total = n + 1, total + float(x)
            yield pd.DataFrame({by: [key[0]] * len(pdf), value: pdf[value], "outlier": out})
        state.update((n, total))

    kind = source.schema[by].dataType.simpleString()
    return source.select(by, F.col(value).cast("double").alias(value)).groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, {value} double, outlier boolean", "n long, total double", "append", "NoTimeout"
    )
