"""A keyed store of which a batch rewrites only the buckets that its keys fall in.

Rows lie in ``data/batch=B/key_bucket=K``, where B is the batch that last wrote
bucket K, and ``versions/version=B`` says for each bucket which batch that is.
A version counts once it is written whole, so a reader sees a batch with all its
buckets or not at all, a batch that failed leaves nothing that is read, and one
that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: Buckets of a store, as many rows as its versions have; at 100 TB some thousands.
BUCKETS = 64
BUCKET = "key_bucket"


def place(spark: SparkSession, where: str):
    """The file system of a path, and the path as it takes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, where: str) -> bool:
    fs, path = place(spark, where)
    return fs.exists(path)


def create(spark: SparkSession, root: str, schema: Y.StructType, key: list[str], buckets: int = BUCKETS) -> None:
    """An empty store; one that exists is an error."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("errorifexists").parquet(f"{root}/shape")
    spark.createDataFrame([(buckets, key)], "buckets int, key array<string>").coalesce(1).write.parquet(f"{root}/settings")


def _settings(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    row = spark.read.parquet(f"{root}/settings").first()
    return row.buckets, row.key


def bucket_of(key: list[str], buckets: int) -> Column:
    """The bucket of a key; null keys have one too."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Batches whose version is whole, ascending."""
    fs, path = place(spark, f"{root}/versions")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and exists(spark, f"{root}/versions/{n}/_SUCCESS"))


def _live(spark: SparkSession, root: str, before: int | None) -> dict[int, tuple[int, int]]:
    """The batch and the rows of each bucket, at the newest version or the newest before a batch."""
    done = [v for v in versions(spark, root) if before is None or v < before]
    if not done:
        return {}
    return {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{root}/versions/version={done[-1]}").select(BUCKET, "batch", "n").collect()}


def _schema(spark: SparkSession, root: str) -> Y.StructType:
    return spark.read.parquet(f"{root}/shape").schema


def read(spark: SparkSession, root: str, before: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The store's rows; with ``only``, those of some buckets, whose files alone are listed."""
    live = _live(spark, root, before)
    paths = [f"{root}/data/batch={b}/{BUCKET}={k}" for k, (b, n) in sorted(live.items()) if n and (only is None or k in only)]
    schema = _schema(spark, root)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(root: str, batch: DataFrame, batch_id: int, combine: Callable[[DataFrame, DataFrame], DataFrame], files: int = 1) -> set[int]:
    """Combine a batch with the rows of the buckets it meets; the buckets that were written.

    ``combine`` gets those buckets' rows and the batch and gives their new rows,
    with keys of the same buckets. ``files`` is the number of tasks and files of
    a bucket. Batch numbers ascend; one whose version is whole is passed over.
    """
    spark = batch.sparkSession
    if batch_id in versions(spark, root):
        return set()
    buckets, key = _settings(spark, root)
    met = {r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect()}
    live = _live(spark, root, batch_id)
    if met:
        out = combine(read(spark, root, batch_id, met), batch).withColumn(BUCKET, bucket_of(key, buckets))
        dealt = out.repartition(len(met) * files, BUCKET, F.pmod(F.xxhash64(F.lit(1), *key), F.lit(files)))
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/data/batch={batch_id}")
        named = Y.StructType([*_schema(spark, root).fields, Y.StructField(BUCKET, Y.IntegerType())])
        held = dict(tuple(r) for r in spark.read.schema(named).parquet(f"{root}/data/batch={batch_id}").groupBy(BUCKET).count().collect())
        if set(held) - met:
            raise ValueError("combine gave keys of buckets that the batch does not meet")
        live |= {k: (batch_id, held.get(k, 0)) for k in met}
    rows = [(k, b, n) for k, (b, n) in sorted(live.items())]
    spark.createDataFrame(rows, f"{BUCKET} int, batch long, n long").coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/version={batch_id}")
    return met


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the buckets that none of those names; how many folders went."""
    done = versions(spark, root)
    kept = done[-keep:]
    named = {(b, k) for v in kept for k, (b, _) in _live(spark, root, v + 1).items()}
    gone = [f"{root}/versions/version={v}" for v in done if v not in kept]
    fs, path = place(spark, f"{root}/data")
    for batch in fs.listStatus(path) if kept and fs.exists(path) else []:
        b = int(batch.getPath().getName().split("=")[1])
        # A batch beyond the newest version may be at work.
        folders = [s.getPath() for s in fs.listStatus(batch.getPath()) if s.getPath().getName().startswith(BUCKET)]
        old = [f for f in folders if b <= kept[-1] and (b, int(f.getName().split("=")[1])) not in named]
        gone += [f"{root}/data/batch={b}"] if old and len(old) == len(folders) else [str(f) for f in old]
    for where in gone:
        fs, path = place(spark, where)
        fs.delete(path, True)
    return len(gone)
