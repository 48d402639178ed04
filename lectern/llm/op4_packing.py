"""Sum-of-squares online packing of documents into token windows.

Each task packs the documents it reads, in their order. A level array counts
the partly filled windows at each fill; a document goes to the level, or to a
new window, that leaves the least sum of squared counts. Full windows leave at
once. What lies in open windows when a task ends goes to a second stage, which
packs the pieces of many tasks by the same choice; only what is open at its end
is laid end to end and cut, which leaves one padded window for each group of
tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage
from lectern.llm.tokens import default_tokenizer, encoder

WINDOW = 2048
END_ID = 1
#: Windows a packer holds open at most, 64 MB of ids; beyond it the fullest is
#: completed with ids cut from the emptiest.
MOST_OPEN = 8192
#: Ids left open that a group of the second stage takes, as an aim.
GROUP_IDS = 8_000_000
#: Sequence numbers of the second stage start here.
SECOND = 1 << 62

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) into windows of ``size`` ids."""

    def __init__(self, size: int = WINDOW, first_sequence: int = 0, most_open: int = MOST_OPEN):
        self.size, self.next, self.most_open = size, first_sequence, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.cut_ids = 0  # ids in windows that were completed by cutting

    def choose(self, n: int) -> int:
        """The fill level at which ``n`` more ids leave the least sum of squares; 0 opens a window."""
        c = self.levels
        room = self.size - n
        # Leaving level h changes the sum by 1 - 2 c[h], reaching h + n by 2 c[h + n] + 1.
        change = 2 * c[n : self.size + 1] + 1
        change[room] = 0  # a full window counts no more
        change[1:] += 1 - 2 * c[1 : room + 1]
        # A level that holds no window cannot be chosen.
        change[1:][c[1 : room + 1] == 0] = np.iinfo(np.int64).max
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])  # among equals the fullest

    def add(self, doc_id, ids: bytes):
        """Place one document's ids; yields the rows of windows that are full."""
        n = len(ids) // 4
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            yield from self._close([(doc_id, at, ids[4 * at : 4 * (at + self.size)], n)])
        if n > whole:
            yield from self.place((doc_id, whole, ids[4 * whole :], n))

    def place(self, piece: tuple):
        """Place one piece of fewer ids than a window."""
        n = len(piece[2]) // 4
        h = self.choose(n)
        held = [*(self._take(h) if h else []), piece]
        if h + n == self.size:
            yield from self._close(held)
            return
        self._put(h + n, held)
        if self.n_open > self.most_open:
            fullest, emptiest = max(self.open), min(self.open)
            if self.n_open > 1:
                first, rest = self._take(fullest), self._take(emptiest)
                yield from self._cut(first + rest)

    def _put(self, fill: int, held: list[tuple]) -> None:
        self.levels[fill] += 1
        self.open.setdefault(fill, []).append(held)
        self.n_open += 1

    def _take(self, h: int) -> list[tuple]:
        self.levels[h] -= 1
        self.n_open -= 1
        held = self.open[h].pop()
        if not self.open[h]:
            del self.open[h]
        return held

    def _close(self, pieces: list[tuple]):
        at = 0
        for doc_id, start, ids, n in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at
            at += len(ids) // 4
        self.next += 1

    def _cut(self, pieces: list[tuple]):
        """Lay pieces end to end and close what is full; the rest is a window of its own."""
        held, fill = [], 0
        for doc_id, start, ids, n in pieces:
            while ids:
                take = min(len(ids) // 4, self.size - fill)
                held.append((doc_id, start, ids[: 4 * take], n))
                start, ids, fill = start + take, ids[4 * take :], fill + take
                if fill == self.size:
                    self.cut_ids += fill
                    yield from self._close(held)
                    held, fill = [], 0
        if held:
            self._put(fill, held)

    def leave(self) -> list[list[tuple]]:
        """The open windows, fullest first; the packer then holds none."""
        out = [held for h in sorted(self.open, reverse=True) for held in self.open[h]]
        self.levels[:] = 0
        self.open.clear()
        self.n_open = 0
        return out

    def finish(self):
        """Lay the open windows end to end, fullest first, and cut at the window size."""
        yield from self._cut([p for held in self.leave() for p in held])
        for held in self.leave():
            yield from self._close(held)


_MADE = pa.schema([*((c, pa.int64()) for c in COLUMNS), ("part", pa.int32()), ("ids", pa.binary())])


def _first_stage(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of full windows, and with their ids the pieces that each task leaves in open ones."""

    def run(batches):
        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        packer = Packer(window, part << 32)
        last = np.array([end_id], "<u4").tobytes()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MADE, strict=True)], schema=_MADE)

        for b in stage.slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist()), strict=True):
                rows += packer.add(doc_id, ids + last)
            if rows:
                yield batch([(*r, part, None) for r in rows])
        left = packer.leave()
        for at in range(0, len(left), 500):
            yield batch([(d, start, len(ids) // 4, None, n, None, None, part, ids) for held in left[at : at + 500] for d, start, ids, n in held])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage.map_batches(rows, run, ", ".join(f"{c} long" for c in COLUMNS) + ", part int, ids binary")


def _second_stage(left: DataFrame, window: int, group_ids: int) -> DataFrame:
    """Windows of the pieces that the first stage left; groups are runs of tasks."""
    ids, parts = left.agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("part") + 1, F.lit(0))).first()
    groups = max(1, -(-ids // group_ids))
    each = max(1, -(-parts // groups))

    def run(batches):
        packer, group = None, None

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=COLUMNS)

        for b in stage.slices(batches, "ids"):
            rows = []
            for part, doc_id, start, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part // each != group:
                    rows += packer.finish() if packer else []
                    group = part // each
                    packer = Packer(window, SECOND + (group << 32))
                rows += packer.place((doc_id, start, ids, n))
            if rows:
                yield batch(rows)
        if packer and (rows := list(packer.finish())):
            yield batch(rows)

    rows = left.select("part", "doc_id", "start", "doc_tokens", "ids")
    dealt = rows.repartition(groups, F.floor(F.col("part") / each)).sortWithinPartitions("part", "doc_id", "start", "ids")
    return stage.map_batches(dealt, run, ", ".join(f"{c} long" for c in COLUMNS))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_ids: int = GROUP_IDS) -> DataFrame:
    """One row for each piece of each document.

    Null and empty texts hold the end id alone. Every row is a document of its
    own, so repeated rows and null ids are packed as they are. Further columns
    are not read; an empty table gives no pieces. ``sequence_id`` holds the
    task's number above 32 bits, so a task that runs again gives the same rows.
    """
    made = stage.written(_first_stage(docs, tokenizer_path, window, end_id, id_col, text_col), "packed")
    full = made.filter("ids is null").select(*COLUMNS)
    return full.unionByName(_second_stage(made.filter("ids is not null"), window, group_ids))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stage.table(spark, sf_dir, "documents"), default_tokenizer())
