"""A writer of artifacts: a file for each document, named by its content, written once.

Tasks write to a folder of their own write; only a write that succeeded as a
whole moves its files into place, each unless a file of that name is there.
Files of failed tasks, of lost attempts and of a write that was given up are
never seen under ``path``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.functions import metadata as D
from lectern.sources.reports import artifact_name

#: Files that one listing entry of the driver names; a folder holds the names that begin alike.
FOLDERS = 256
ASIDE = "_making"
#: Folders whose files the driver moves at once.
MOVERS = 16
#: Characters of contents that are read at once.
READ_CHARS = 4_000_000


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder and the folders in it."""

    attempt: str
    folders: list[str]


class ArtifactSink(DataSource):
    """Options: ``path``. Rows are (name, content): a file's name and its text."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("artifacts are written once and never overwritten")
        return ArtifactWriter(self.options["path"])


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.aside = f"{self.path}/{ASIDE}-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = f"{self.aside}/{TaskContext.get().taskAttemptId()}"
        store, root = _store(attempt)
        final = _store(self.path)[1]
        made: set[str] = set()
        for row in rows:
            if row["name"] is None or "/" in row["name"]:
                raise ValueError(f"no name for a file: {row['name']}")
            content = (row["content"] or "").encode()
            folder = folder_of(row["name"])
            at = f"{folder}/{inner_of(content)}"
            if store.get_file_info(f"{final}/{at}/{row['name']}").type == fs.FileType.File:
                continue
            made.add(folder)
            place = f"{root}/{at}"
            store.create_dir(place)
            with store.open_output_stream(f"{place}/{row['name']}") as out:
                out.write(content)
        return Written(attempt, sorted(made))

    def commit(self, messages: list[Written | None]) -> None:
        """Move what successful tasks wrote, some folders at once: the driver holds their names, never contents."""
        made: dict[str, list[str]] = {}
        for m in messages:
            for folder in m.folders if m else []:
                made.setdefault(folder, []).append(m.attempt)
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(self._move, made, made.values()):
                pass
        self._clear()

    def _move(self, folder: str, attempts: list[str]) -> None:
        """A folder's files of all tasks; what is in place is listed once."""
        store, root = _store(self.path)
        final = f"{root}/{folder}"
        store.create_dir(final)
        there = {f.path[len(final) :] for f in _files(store, final)}
        for attempt in attempts:
            made = f"{_store(attempt)[1]}/{folder}"
            for f in _files(store, made):
                at = f.path[len(made) :]
                if at not in there:
                    there.add(at)
                    store.create_dir(f"{final}{at}".rsplit("/", 1)[0])
                    store.move(f.path, f"{final}{at}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = _store(self.aside)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def _files(store, folder: str) -> list:
    from pyarrow import fs

    return [f for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File]


def inner_of(content: bytes) -> str:
    """The folder of a content within its name's: what a name does not say of the content's hash.

    Names hold 32 bits of it, so other contents can have one name.
    """
    import hashlib

    return hashlib.sha256(content).hexdigest()[8:]


def folder_of(name: str) -> str:
    """The folder of a name, by its hash, so that no folder holds all files."""
    import zlib

    return f"{zlib.crc32(name.encode()) % FOLDERS:02x}"


def write(documents: DataFrame, path: str, ending: str = ".md", source: str = "document_source", content: str = "text") -> DataFrame:
    """Write a file for each document and give (name, path) of each: ``{stem}__{hash[:8]}`` and ``ending``.

    Of documents of one name and content one is written, and a file that is
    there stays as it is. Other contents whose hashes begin alike have folders
    of their own. Null contents are written as empty ones.
    """
    spark = documents.sparkSession
    spark.dataSource.register(ArtifactSink)
    named = named_artifacts(documents, ending, source, content)
    digest = D.file_hash(F.col("content").cast("binary"))
    once = named.withColumn("digest", digest).dropDuplicates(["name", "digest"]).drop("digest")
    once.write.format("artifacts").mode("append").option("path", path).save()
    folder = F.lower(F.lpad(F.hex(F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(FOLDERS))), 2, "0"))
    return named.select("name", F.concat(F.lit(path.rstrip("/") + "/"), folder, F.lit("/"), F.substring(digest, 9, 56), F.lit("/"), "name").alias("path"))


def named_artifacts(documents: DataFrame, ending: str, source: str, content: str) -> DataFrame:
    text = F.coalesce(F.col(content), F.lit(""))
    name: Column = F.concat(artifact_name(F.col(source), D.file_hash(text.cast("binary"))), F.lit(ending))
    return documents.select(name.alias("name"), text.alias("content"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of all artifacts in place, whatever their names begin with, a folder at a time."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = _store(path.rstrip("/"))
        for b in batches:
            for k in b.column(0).to_pylist():
                folder = f"{root}/{k:02x}"
                if store.get_file_info(folder).type == fs.FileType.NotFound:
                    continue
                names, contents, size = [], [], 0
                for f in _files(store, folder):
                    with store.open_input_stream(f.path) as got:
                        names.append(f.base_name)
                        contents.append(got.read().decode())
                    size += len(contents[-1])
                    if size >= READ_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.string())], names=["name", "content"])
                        names, contents, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.string())], names=["name", "content"])

    return spark.range(FOLDERS).repartition(32).mapInArrow(run, "name string, content string")
