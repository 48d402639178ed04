"""Best-fit packing of documents into token windows by bin completion.

Documents are encoded where they are read; pieces with their digests are
written once, without their ids unless these are asked for. Which pieces share
a window depends on their lengths alone, so the search (:mod:`bin_completion`)
gets one count for each length, at most one window's, and gives fillings. A
piece then finds its place from its number among all pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import stage
from lectern.llm.bin_completion import STEPS, Filling, complete
from lectern.llm.tokens import default_tokenizer, encoder

WINDOW = 4096
END_ID = 1

COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "nth")), ("part", pa.int32()), ("ids", pa.binary())])
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part int, ids binary"


def _pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """The pieces of each document, numbered within their task among those of the same length."""

    def run(batches):
        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        last = np.array([end_id], "<u4").tobytes()
        seen = [0] * (window + 1)
        for b in stage.slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist()), strict=True):
                ids += last
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    n = len(piece) // 4
                    rows.append((doc_id, at // (4 * window), at // 4, n, zlib.crc32(piece), seen[n], part, piece if keep_ids else None))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage.map_batches(rows, run, _PIECE_SQL)


def places(filled: list[Filling]) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go: (length, first number, copies in a window, first window, first offset), ascending.

    A filling that ``times`` windows have takes the next ``times * copies``
    pieces of each of its lengths. Each use of a filling but the last uses up a
    length or what is left of it, so the rows are bounded by ``size`` times the
    distinct lengths of a window, whatever the number of pieces.
    """
    taken: Counter = Counter()
    rows, window = [], 0
    for filling, times in filled:
        at = 0
        for n, copies in sorted(Counter(filling).items(), reverse=True):
            rows.append((n, taken[n], copies, window, at))
            taken[n] += copies * times
            at += n * copies
        window += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    steps: int = STEPS,
) -> DataFrame:
    """One row for each piece of each document; with ``keep_ids`` also its ``ids`` (little-endian unsigned 32 bits).

    Documents of more than ``window`` ids are cut into pieces of ``window``,
    the last may be shorter; no other is cut. Null and empty texts hold the end
    id alone. Every row is a document of its own, so repeated rows and null ids
    are packed as they are. Further columns are not read; an empty table gives
    no pieces. The pieces are read from a written table, so a task that runs
    again finds them numbered as before.
    """
    made = stage.written(_pieces(docs, tokenizer_path, window, end_id, id_col, text_col, keep_ids), "pieces")
    of_part = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for length, n in of_part.groupBy("length").agg(F.sum("n")).collect():  # at most ``window`` rows
        counts[length] = n
    filled, _ = complete(counts, steps)
    length, first, copies, sequence, at = places(filled)
    # Pieces of one length number under 2^48, so a length and a number make one key.
    keys = (length << 48) + first

    def run(batches):
        for b in batches:
            n = b.column("length").to_numpy()
            number = b.column("base").to_numpy() + b.column("nth").to_numpy()
            k = np.searchsorted(keys, (n << 48) + number, "right") - 1
            window_no, copy = np.divmod(number - first[k], copies[k])
            kept = [b.column(c) for c in (*COLUMNS[:5], *(["ids"] if keep_ids else []))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[k] + window_no), pa.array(at[k] + copy * n)], names=[*COLUMNS[:5], *(["ids"] if keep_ids else []), *COLUMNS[5:]])

    # One row for each task and length, so a length that all pieces share is no more than its tasks here.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = of_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = made.join(base, ["length", "part"])
    kept = [*COLUMNS[:5], "nth", "base", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if keep_ids else "") + "sequence_id long, offset long"
    return stage.map_batches(numbered.select(*kept), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in windows of 4,096 tokens; null texts are the end id alone, repeated rows stay apart."""
    return pack(stage.table(spark, sf_dir, "documents"), default_tokenizer())
