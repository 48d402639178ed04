"""A reader and a writer of SQLite tables: ranges of row ids are read by their own tasks, tasks write their own files.

Files must be in a folder that all executors see.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BATCH_ROWS = 2000
RANGE_ROWS = 200_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def local(path: str) -> str:
    """A path of a mounted folder, which may be a ``file:`` URI; other stores are refused."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite files lie in mounted folders, not in {path}")
    return path


def _files(path: str) -> list[str]:
    """The file at a path, or all SQLite files of a folder."""
    place = Path(local(path))
    return sorted(map(str, place.glob("*.sqlite"))) if place.is_dir() else [str(place)]


def _name(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """Options: ``path``, ``table`` and ``range_rows``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no table {self.options['table']}")
        with _open(files[0]) as con:
            columns = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1].replace('`', '``')}` {_kind(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def _kind(declared: str) -> str:
    """The Spark type of a column by SQLite's rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return "bigint"
    if any(k in d for k in ("REAL", "FLOA", "DOUB")):
        return "double"
    return "binary" if "BLOB" in d else "string"


class Rows(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[Rows]:
        step, out = int(self.options.get("range_rows", RANGE_ROWS)), []
        files = _files(self.options["path"])
        for file in files:
            with _open(file) as con:
                lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.options['table'])}").fetchone()
            if lo is not None:
                out += [Rows(file, a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)]
        return out or [Rows(files[0], 0, -1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        columns = []
        for f in self.schema.fields:
            kind = {"bigint": ("INTEGER", pa.int64()), "double": ("REAL", pa.float64()), "binary": ("BLOB", pa.binary())}.get(f.dataType.simpleString(), ("TEXT", pa.string()))
            columns.append((f.name, *kind))
        chosen = ", ".join(f"CAST({_name(n)} AS {k})" for n, k, _ in columns)
        con = _open(partition.file)
        try:
            found = con.execute(f"SELECT {chosen} FROM {_name(self.options['table'])} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while rows := found.fetchmany(BATCH_ROWS):
                parts = zip(zip(*rows, strict=True), columns, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in parts], names=[n for n, _, _ in columns])
        finally:
            con.close()


def sqlite_table(spark: SparkSession, path: str, table: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("range_rows", str(range_rows)).load()


def write_tables(rows: DataFrame, folder: str, table: str) -> int:
    """Write numbers, strings and bytes to SQLite files, one for each task, and return the number of rows.

    A task builds its file aside and moves it into place, so one that runs again
    replaces its own file and a failed one leaves none.
    """
    kinds = [{"double": "REAL", "float": "REAL", "binary": "BLOB", "string": "TEXT"}.get(f.dataType.simpleString(), "INTEGER") for f in rows.schema.fields]
    columns = ", ".join(f"{_name(c)} {k}" for c, k in zip(rows.columns, kinds, strict=True))
    where = Path(local(folder))

    def run(batches):
        from pyspark import TaskContext

        where.mkdir(parents=True, exist_ok=True)
        task = TaskContext.get()
        made = where / f"part-{task.partitionId():05d}.{task.taskAttemptId()}.making"
        con, n = sqlite3.connect(made), 0
        try:
            con.execute(f"CREATE TABLE {_name(table)} ({columns})")
            for b in batches:
                con.executemany(f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * len(kinds))})", zip(*(c.to_pylist() for c in b.columns), strict=True))
                n += b.num_rows
            con.commit()
        except BaseException:
            con.close()
            made.unlink(missing_ok=True)
            raise
        con.close()
        os.replace(made, where / f"part-{task.partitionId():05d}.sqlite")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
