"""Computed rows by content: each key is computed once, also by callers at the same time.

Keys fall into buckets; a caller that lacks keys claims their buckets by an
atomic create, computes what is missing by then, writes it as a batch of its own
and gives the claims back. A bucket that another caller holds is waited for. A
second level is keyed by the first level's key and the settings used on it, so
other settings reuse the first level's work.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Seconds after which a claim counts as left behind, and between two looks at one.
LEASE = 3_600.0
LOOK = 0.2


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _local(where: str) -> Path | None:
    if where.startswith("file:"):
        return Path("/" + where.removeprefix("file:").lstrip("/"))
    return None if "://" in where else Path(where)


def claim(spark: SparkSession, where: str) -> bool:
    """Create a file that is not there; of callers at the same time one succeeds."""
    if place := _local(where):
        place.parent.mkdir(parents=True, exist_ok=True)
        try:
            os.close(os.open(place, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            return False
    fs, path = _path(spark, where)
    try:
        fs.create(path, False).close()
        return True
    except Py4JJavaError:
        return False


def release(spark: SparkSession, where: str) -> None:
    fs, path = _path(spark, where)
    fs.delete(path, False)


def _left_behind(spark: SparkSession, where: str, lease: float) -> bool:
    """Whether a claim is gone or so old that its caller must be; an old one is moved away, which one caller can do."""
    fs, path = _path(spark, where)
    try:
        age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
    except Py4JJavaError:
        return True
    if age <= lease:
        return False
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{where}-{uuid.uuid4().hex}.old")
    if fs.rename(path, aside):
        fs.delete(aside, False)
    return True


def results(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows of whole batches."""
    fs, path = _path(spark, f"{root}/results")
    if not fs.exists(path):
        return None
    names = [s.getPath().toString() for s in fs.listStatus(path)]
    done = [n for n in sorted(names) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
    return spark.read.parquet(*done) if done else None


def cached(rows: DataFrame, key: str, root: str, compute: Callable[[DataFrame], DataFrame], lease: float = LEASE) -> DataFrame:
    """``compute`` of rows, by a content key: (key, what ``compute`` gives), a row for each row with a key.

    ``compute`` gets one row for each missing key and keeps the key; it may give
    several rows or none for one. A call that fails gives its claims back and
    leaves no results.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    wanted = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    mark = lambda b: f"{root}/claims/{b}"
    while True:
        old = _known(spark, root, key)
        missing = wanted if old is None else wanted.join(old, key, "left_anti")
        lacking = sorted(r[0] for r in missing.select(bucket).distinct().collect())
        if not lacking:
            break
        held = [b for b in lacking if claim(spark, mark(b))]
        try:
            if held:
                # What another caller wrote since then is not computed again.
                old = _known(spark, root, key)
                mine = wanted.filter(bucket.isin(held))
                mine = mine if old is None else mine.join(old, key, "left_anti")
                batch = uuid.uuid4().hex
                compute(mine).write.parquet(f"{root}/results/{batch}")
                # Keys without results are known too, or they would be computed for ever.
                wanted.filter(bucket.isin(held)).select(key).write.parquet(f"{root}/keys/{batch}")
        finally:
            for b in held:
                release(spark, mark(b))
        for b in set(lacking) - set(held):
            while not _left_behind(spark, mark(b), lease):
                time.sleep(LOOK)
    got = results(spark, root)
    return rows.select(key).limit(0) if got is None else rows.select(key).join(got, key)


def _known(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    fs, path = _path(spark, f"{root}/keys")
    if not fs.exists(path):
        return None
    names = [s.getPath().toString() for s in fs.listStatus(path)]
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
    return spark.read.parquet(*done).select(key).distinct() if done else None


def second_key(first: str, settings: dict) -> str:
    """SQL of a key for what ``settings`` make of the row under ``first``; their order does not count."""
    plain = json.dumps(settings, sort_keys=True, ensure_ascii=False).replace("\\", "\\\\").replace("'", "\\'")
    return f"md5(concat(`{first}`, '_', '{plain}'))"


def two_levels(rows: DataFrame, key: str, root: str, parse: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame, dict], DataFrame], settings: dict) -> DataFrame:
    """Rows parsed, by their content's key, and cut with ``settings``, by that key and the settings.

    ``parse`` gives a row for each key; ``cut`` gets parsed rows with a further
    column ``cut_key`` to keep, and may give several rows for each.
    """
    parsed = cached(rows.dropDuplicates([key]), key, f"{root}/parsed", parse)
    keyed = parsed.withColumn("cut_key", F.expr(second_key(key, settings)))
    got = cached(keyed, "cut_key", f"{root}/cut", lambda df: cut(df, settings).drop(key))
    return rows.select(key).join(keyed.select(key, "cut_key").distinct(), key).join(got.distinct(), "cut_key")
