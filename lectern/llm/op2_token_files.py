"""Token ids in binary files with Elias-Fano document boundaries.

Documents are cut into ranges of ascending ids; each range is tokenised where
it is read, shuffled as ids and written as files of bounded size to the shared
folder. A file holds the documents' boundaries and their ids as Elias-Fano
codes, and one array of token ids in two bytes each if the vocabulary allows.
A manifest table names the files of successful tasks; files of lost attempts
are in no manifest and never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import stage
from lectern.llm.elias_fano import EliasFano
from lectern.llm.tokens import default_tokenizer, encoder

MAGIC = b"LECTOK01"
_HEAD = struct.Struct("<8sQQIB3x")  # magic, documents, ids, rows without an id, bytes of an id

#: Bytes of input for each range, and ids after which a file ends.
RANGE_BYTES = 16 << 20
FILE_IDS = 6_000_000
#: Ranges, and so reduce tasks, at most; beyond them ranges grow, files do not.
MOST_RANGES = 50_000
#: Ids that the driver samples for each range to find its ends.
SAMPLES_A_RANGE = 20
END_ID = 1


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: ``doc_ids`` ascending with nulls first, their lengths and all their ids."""
    nameless = sum(d is None for d in doc_ids)
    named = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    # Signed ids keep their order when the sign bit is turned over.
    named = named.view(np.uint64) ^ np.uint64(1 << 63)
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), nameless, ids.dtype.itemsize)
    return head + bounds.to_bytes() + _named(named) + ids.astype(ids.dtype.newbyteorder("<")).tobytes()


def _named(ids: np.ndarray) -> bytes:
    """Ascending ids as an offset and a code of their distances from it."""
    first = ids[:1].astype("<u8").tobytes() or bytes(8)
    return first + EliasFano.encode(ids - ids[:1] if len(ids) else ids).to_bytes()


class TokenFile:
    """A file as read back: documents by position, in ascending order of id."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_ids, nameless, width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.bounds, at = EliasFano.from_bytes(data, _HEAD.size)
        (first,) = struct.unpack_from("<Q", data, at)
        named, at = EliasFano.from_bytes(data, at + 8)
        keys = (named.decode().astype(np.uint64) + np.uint64(first)) ^ np.uint64(1 << 63)
        self.doc_ids = [None] * nameless + keys.view(np.int64).tolist()
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def document(self, k: int) -> np.ndarray:
        """The ids of the document at position ``k``, by two selects."""
        return self.ids[self.bounds.select(k) : self.bounds.select(k + 1)]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Upper ends of ``n`` ranges of ids with about as many rows, from a bounded sample of ids alone."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    rows, most = ids.count() if n > 1 else 0, SAMPLES_A_RANGE * n
    if not rows:
        return []
    if rows > most:
        ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(1_000_000_000 * most / rows) + 1)
    found = np.sort(np.array([r[0] for r in ids.distinct().limit(2 * most).toLocalIterator()], np.int64))
    return sorted({int(found[len(found) * k // n]) for k in range(1, n)}) if len(found) else []


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write all documents; the result is the manifest, itself in the shared folder.

    Null texts count as empty; every document ends with ``end_id``. Rows come in
    ascending order of id, those without one first, equal ids by their token
    ids. A text may be longer than a file's aim; it then makes a file of its own.
    Further columns are not read, and an empty table gives an empty manifest. A
    range is a reduce task's share; its sort spills, and its files are closed
    one by one, so memory is bounded by a file and the longest text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(1, min(MOST_RANGES, -(-size // range_bytes)))
    ends = np.array(_ranges(rows, n), dtype=np.int64)
    n = len(ends) + 1

    def tokenise(batches):
        enc = encoder(tokenizer_path)
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        last = np.array([end_id], "<u4").tobytes()
        for b in stage.slices(batches, "text"):
            ids = [np.frombuffer(x + last, "<u4") for x in enc.encode_many(b.column(1).to_pylist())]
            out = [x.astype("<u2").tobytes() if narrow else x.tobytes() for x in ids]
            keys = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            part = np.searchsorted(ends, keys, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), b.column(0), pa.array([2 if narrow else 4] * len(out), pa.int8()), pa.array(out, pa.binary())],
                names=["part", "doc_id", "width", "ids"],
            )

    def write(batches):
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        held: dict = {"part": None, "file": 0}

        def flush():
            data = pack_file(held["doc_ids"], held["lengths"], np.frombuffer(b"".join(held["ids"]), f"<u{held['width']}"))
            name = f"{root}/{held['part']:06d}-{held['file']:04d}-{uuid.uuid4().hex}.tok"
            with filesystem.open_output_stream(name) as f:
                f.write(data)
            row = (name, held["part"], held["file"], len(held["doc_ids"]), held["n"])
            held.update(file=held["file"] + 1, doc_ids=[], lengths=[], ids=[], n=0)
            return pa.RecordBatch.from_pylist([dict(zip(("name", "part", "file", "n_docs", "n_ids"), row, strict=True))], schema=made)

        made = pa.schema([("name", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for b in stage.slices(batches, "ids"):
            for part, doc_id, width, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != held["part"] or held["n"] >= FILE_IDS:
                    if held.get("doc_ids"):
                        yield flush()
                    if part != held["part"]:
                        held.update(part=part, file=0, doc_ids=[], lengths=[], ids=[], n=0, width=width)
                held["doc_ids"].append(doc_id)
                held["lengths"].append(len(ids) // width)
                held["ids"].append(ids)
                held["n"] += len(ids) // width
        if held.get("doc_ids"):
            yield flush()

    tokens = stage.map_batches(rows, tokenise, "part int, doc_id long, width byte, ids binary")
    # The range's number is the partition: a hash would put several into one task.
    dealt = tokens.repartitionById(n, "part").sortWithinPartitions("part", "doc_id", F.length("ids"), "ids")
    files = stage.map_batches(dealt, write, "name string, part int, file int, n_docs long, n_ids long")
    return stage.written(files, "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    A document's ends in its file come from ``select`` on the code; no table of
    offsets is made. Null ids and repeated rows are as they were written, and
    an empty manifest gives an empty result. The running total is over files, not documents: a row for about six million
    ids, so one task can hold it.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("name", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        filesystem, _ = _filesystem(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                with filesystem.open_input_file(name) as f:
                    tokens = TokenFile(f.read())
                wide, rows, a = memoryview(tokens.ids.astype("<u4").tobytes()), [], tokens.bounds.select(0)
                for k, doc_id in enumerate(tokens.doc_ids):
                    z = tokens.bounds.select(k + 1)
                    rows.append((doc_id, base + a, z - a, zlib.crc32(wide[4 * a : 4 * z])))
                    a = z
                    if len(rows) == 50_000 or k + 1 == tokens.n_docs:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []

    spread = files.repartition(max(1, min(2_000, manifest.count())), "name")
    return stage.map_batches(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage.scratch(spark, "token-files")
    manifest = write_token_files(stage.table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_token_files(manifest, folder)
