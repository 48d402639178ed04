"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is the query set. It is broadcast in blocks of bounded size, so
one scan of the documents for each block finds every run of ``SEED_WORDS``
words that a test item also has, and aligns the passage around it word by word
with the item; edited and paraphrased copies keep a high score.

A seed that few items hold is rare and names its items itself. A seed that many
items share (a stock phrase) names only those of them that have one of their
rarest words beside it. That loses nothing: an alignment at the threshold needs
``need`` words of the item, all but ``need - 1`` of its words are its rarest,
so one of those is among them. Rarity is judged within the benchmark, so no
copy in the corpus, however frequent, hides itself.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage

SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, 1
#: Part of an item's best possible score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Words' worth of score that is enough for an item of any length.
LONG_WORDS = 50
#: Items from which a seed is frequent, so that a rare word must stand beside it.
FREQUENT = 32
#: Bytes of test items that one scan takes as its query set; in a worker a block takes about twenty times as much.
BLOCK_BYTES = 4_000_000

_WORD = re.compile(r"\w+")
_MIX = np.random.default_rng(7).integers(1, 1 << 63, SEED_WORDS, dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def seed_codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for each run of ``n`` word numbers."""
    m = len(ids) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    v = ids.astype(np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out += v[k : k + m] * _MIX[k]
    return out ^ (out >> np.uint64(29))


class Block:
    """Test items as numbered words in flat arrays, with their seeds and rarest words."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        kept = [(i, w) for i, t in items if (w := words(t))]
        self.threshold = threshold
        self.item_ids = [i for i, _ in kept]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.sizes = np.array([len(w) for _, w in kept], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.flat = np.array([number(w, len(self.vocabulary) + 1) for _, ws in kept for w in ws], np.int32)
        self.reach = int(self.sizes.max(initial=0)) * 5 // 4 + 3
        need = np.minimum(np.ceil(threshold * self.sizes - 1e-9).astype(np.int64), LONG_WORDS)
        self._seeds()
        self._rare(np.maximum(need, 1))

    def ids(self, item: int) -> np.ndarray:
        return self.flat[self.starts[item] : self.starts[item + 1]]

    def _seeds(self) -> None:
        #: For each seed length its sorted codes, where their places start, and the items and offsets there.
        self.seeds: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(np.minimum(self.sizes, SEED_WORDS)).tolist():
            here = np.flatnonzero(np.minimum(self.sizes, SEED_WORDS) == n)
            code = [seed_codes(self.ids(k), n) for k in here.tolist()]
            items = np.repeat(here, [len(c) for c in code]).astype(np.int32)
            offsets = np.concatenate([np.arange(len(c)) for c in code]).astype(np.int32)
            code = np.concatenate(code).astype(np.int64)
            order = np.argsort(code, kind="stable")
            codes, at = np.unique(code[order], return_index=True)
            self.seeds[n] = (codes, np.append(at, len(code)), items[order], offsets[order])

    def _rare(self, need: np.ndarray) -> None:
        """For each word the items of which it is one of the rarest: all but ``need - 1`` of an item's words."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        pair = np.unique(np.stack([self.flat, owner]), axis=1) if len(self.flat) else np.zeros((2, 0), np.int64)
        holders = np.bincount(pair[0], minlength=len(self.vocabulary) + 1)
        order = np.lexsort((self.flat, holders[self.flat], owner))
        rank = np.arange(len(order)) - self.starts[owner[order]]
        first = order[rank < (self.sizes - need + 1)[owner[order]]]
        pair = np.unique(np.stack([self.flat[first], owner[first]]), axis=1) if len(first) else pair
        self.rare_at = np.searchsorted(pair[0], np.arange(len(self.vocabulary) + 2))
        self.rare_items = pair[1].astype(np.int32)

    def _beside(self, ids: np.ndarray) -> np.ndarray:
        """The items that have one of their rarest words among ``ids``, ascending."""
        parts = [self.rare_items[self.rare_at[w] : self.rare_at[w + 1]] for w in np.unique(ids[ids > 0]).tolist()]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)

    def _hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, where its first word would stand, where the seed stands) of each shared seed."""
        items, bases, spots = [], [], []
        for n, (codes, at, held, offsets) in self.seeds.items():
            if len(ids) < n:
                continue
            full = np.flatnonzero(np.convolve(ids == 0, np.ones(n, np.int64))[n - 1 : len(ids)] == 0)
            here = seed_codes(ids, n).astype(np.int64)[full]
            k = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
            hit = codes[k] == here
            k, full = k[hit], full[hit]
            count = at[k + 1] - at[k]
            for rare in (True, False):
                pick = (count <= FREQUENT) == rare
                if not pick.any():
                    continue
                spot = np.repeat(full[pick], count[pick])
                place = np.repeat(at[k[pick]], count[pick]) + np.arange(len(spot)) - np.repeat(np.cumsum(count[pick]) - count[pick], count[pick])
                item, base = held[place], spot - offsets[place]
                if not rare:
                    keep = self._near_rare(ids, full[pick], spot, item)
                    spot, item, base = spot[keep], item[keep], base[keep]
                items.append(item)
                bases.append(base)
                spots.append(spot)
        if not items:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(items), np.concatenate(bases), np.concatenate(spots)

    def _near_rare(self, ids: np.ndarray, spots: np.ndarray, spot: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which of the frequent hits have one of their item's rarest words within reach."""
        keep = np.zeros(len(spot), bool)
        spots = np.unique(spots)
        for run in np.split(spots, np.flatnonzero(np.diff(spots) > self.reach) + 1):
            found = self._beside(ids[max(0, run[0] - self.reach) : run[-1] + self.reach])
            if len(found):
                mine = (spot >= run[0]) & (spot <= run[-1])
                keep |= mine & (found[np.minimum(np.searchsorted(found, item), len(found) - 1)] == item)
        return keep

    def passages(self, text: str | None):
        """(item, first word, passage's word numbers) for each place that shares a seed and enough words."""
        ws = words(text)
        if not ws:
            return
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int64, len(ws))
        item, base, spot = self._hits(ids)
        if not len(item):
            return
        order = np.lexsort((spot, base, item))
        item, base = item[order], base[order]
        slack = 2 + self.sizes[item] // 4
        cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(base) > slack[1:])) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)], strict=True):
            k, room = int(item[a]), int(slack[a])
            size = int(self.sizes[k])
            first = max(0, int(base[a]) - room)
            there = ids[first : min(len(ids), int(base[z - 1]) + size + room)]
            most = MATCH * self._shared(k, there)
            if most >= min(self.threshold * MATCH * size, MATCH * LONG_WORDS):
                yield k, first, there

    def _shared(self, item: int, there: np.ndarray) -> int:
        """Words that the item and a passage share in any order: no alignment has more."""
        own, count = np.unique(self.ids(item), return_counts=True)
        at = np.searchsorted(own, there)
        at[at == len(own)] = 0
        seen = np.bincount(at[own[at] == there], minlength=len(own))
        return int(np.minimum(seen, count).sum())

    def alignments(self, text: str | None, known: dict):
        """(item id, score, first word, last word) of each passage that reaches the threshold."""
        for item, first, there in self.passages(text):
            key = (item, there.tobytes())
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                own, other = self.ids(item).tolist(), there.tolist()
                score, end = smith_waterman(own, other)
                back, size = smith_waterman(own[::-1], other[:end][::-1]) if score else (0, 0)
                known[key] = (score, end - size, end)
            score, begin, end = known[key]
            best = MATCH * int(self.sizes[item])
            if score >= self.threshold * best or score >= MATCH * LONG_WORDS:
                yield self.item_ids[item], score / best, first + begin, first + end


def smith_waterman(a: list, b: list) -> tuple[int, int]:
    """The best local alignment score of two word lists, and where it ends in ``b``."""
    number = {w: k for k, w in enumerate(dict.fromkeys(b))}
    right = np.array([number[w] for w in b], np.int64)
    ramp = GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best, end = 0, 0
    for w in a:
        step = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(right == number.get(w, -1), MATCH, MISMATCH), row[1:] - GAP, out=step[1:])
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + ramp) - ramp  # gaps along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _blocks(benchmark: DataFrame, threshold: float):
    """Blocks of items, each of about ``BLOCK_BYTES`` at most, as broadcast variables."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield sc.broadcast(Block(sorted({(r[0], r[1]) for r in part.collect()}, key=str), threshold))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of each document and item that align.

    ``score`` is the alignment's part of the item's best possible score: at
    least ``threshold``, or less if it is worth ``LONG_WORDS`` words. The words
    are counted in the document from 0, the last one exclusive. Rows with one
    id and one item are brought to the best. Null, empty and unlike texts give
    no row, null or blank items match nothing, an empty table gives an empty
    result, and a null id is kept as it is. Further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _blocks(benchmark, threshold):

        def find(batches, shared=shared):
            known: dict = {}
            for batch in stage.slices(batches, "text"):
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                made = [(doc_id, *hit) for doc_id, text in pairs for hit in shared.value.alignments(text, known)]
                if made:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                    names = ["doc_id", "item_id", "score", "first_word", "last_word"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        found = stage.map_batches(rows, find, "doc_id long, item_id long, score double, first_word int, last_word int")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("near"), "last_word")).alias("r")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("r.score").alias("score"), (-F.col("r.near")).alias("first_word"), "r.last_word")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(stage.table(spark, sf_dir, "documents"), stage.table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text aligns with no test item.

    Each row is judged by its own text in the pass that reads it, so null and
    repeated ids lose no other row. Null and empty texts stay, columns pass
    through under any name, and an empty table gives an empty result.
    """
    at = docs.columns.index("text")
    for shared in _blocks(benchmark, THRESHOLD):

        def clean(batches, shared=shared):
            known: dict = {}
            for b in stage.slices(batches, "text"):
                yield b.filter(pa.array([next(shared.value.alignments(t, known), None) is None for t in b.column(at).to_pylist()], pa.bool_()))

        docs = stage.map_batches(docs, clean, docs.schema)
    return docs
