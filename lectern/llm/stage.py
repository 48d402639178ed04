"""Shared plumbing: reading tables, cutting lineage, running Arrow functions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no folder, as in unit tests.
FALLBACK_DIR = "/tmp/checkpoints"
#: Bytes of a scratch file where the rows of a shuffled table are known.
FILE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that still read them must be written first."""
    _delete(spark, f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str, rows: int | None = None, row_bytes: int = 32) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of any executor and carries
    file statistics; a lost task recomputes only its own share of the write.
    ``rows``, a bound on the rows that a shuffled table is made from, sizes its
    tasks at about ``FILE_BYTES``, so that a small table is not dealt over all
    partitions.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows * row_bytes // FILE_BYTES)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written`."""
    for f in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        if "/lectern/" in f:
            _delete(spark, f)


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give a worker's freed memory back to the system: idle workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema,
) -> DataFrame:
    """``fn`` over Arrow batches; a worker that is done gives its memory back."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each.

    One row longer than that is a batch of its own, so memory follows the
    longest text and not the batch size.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        size = max(1, batch.column(i).nbytes // batch.num_rows)
        if batch.column(i).nbytes <= most:
            yield batch
            continue
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(lengths):
            if held and held + int(n) > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(n) + size // 64
        yield batch.slice(start)


def sampled(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, by the hash of their whole row: the bounded sample for fitting.

    A threshold on the hash first, from a count of rows alone, keeps what is
    sorted close to ``most`` rows whatever the size of the table. Rows that
    repeat share a hash, so a threshold can leave too few; then all are sorted,
    of which each task keeps ``most`` at a time.
    """
    from pyspark.sql import functions as F

    n = df.select(id_col).count()
    key = F.xxhash64(F.lit("sample"), *[F.col(c) for c in df.columns])
    if n > 2 * most:
        some = df.filter(F.pmod(key, F.lit(1_000_000)) < int(1_500_000 * most / n) + 1)
        if some.limit(most // 2).count() >= most // 2:
            df = some
    return df.orderBy(key).limit(most)
