"""Token counts by byte-pair merging on a heap and a linked list.

A word starts as one symbol for each UTF-8 byte. A heap holds its adjacent
pairs by merge rank; the lowest pair is popped, merged in a doubly linked list
of symbols, and its two new neighbour pairs are pushed. The count of tokens is
the number of initial symbols less the number of merges; no ids are made.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import filterfalse

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import stage
from lectern.llm.tokens import byte_symbols, default_tokenizer

#: White space as Unicode defines it, and the byte-level split
#: pattern that belongs to the vocabulary.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

#: Entries of a worker's caches for words and for chunks, and characters of the
#: longest one that stays; a full one becomes the older of two generations, so
#: memory is bounded and frequent words stay.
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64
TOKEN_LIMIT = 512


class MergeCounter:
    """Counts the tokens of a text for a byte-level BPE file of ``tokenizers``."""

    def __init__(self, path: str):
        with open(path) as f:
            config = json.load(f)
        model = config["model"]
        if model["type"] != "BPE" or config.get("normalizer") or config["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        if config["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a prefix space is not supported")
        number = byte_symbols()
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = number.setdefault(left + right, len(number))
            pairs.setdefault((number.setdefault(left, len(number)), number.setdefault(right, len(number))), (rank, made))
        self.pairs = pairs
        self.special = [t["content"] for t in config.get("added_tokens", []) if t["content"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(SPLIT)
        self.by_word: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}
        self.old_words: dict[str, int] = {}
        self.old_chunks: dict[str, int] = {}
        self.beside = re.compile(r"\s\s|\A\s|\s\Z")
        self.mark = re.compile(r"(?<=[A-Za-z])[.,](?=[ \n])")

    def merges(self, word: str) -> int:
        """Tokens of one word: initial symbols less merges."""
        symbols: list[int] = list(word.encode())
        n = len(symbols)
        if n < 2:
            return n
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            hit = pairs.get((symbols[i], symbols[i + 1]))
            if hit:
                heap.append((hit[0], i, hit[1], symbols[i], symbols[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merged = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else n
            if j >= n or symbols[j] != right:
                continue  # one side has been merged since
            merged += 1
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = pairs.get((made, symbols[k]))
                if hit:
                    heapq.heappush(heap, (hit[0], i, hit[1], made, symbols[k]))
            h = before[i]
            if h >= 0:
                hit = pairs.get((symbols[h], made))
                if hit:
                    heapq.heappush(heap, (hit[0], h, hit[1], symbols[h], made))
        return n - merged

    def _split(self, text: str) -> int:
        total, by_word = 0, self.by_word
        for w in self.words.findall(text):
            c = by_word.get(w)
            if c is None:
                c = self.old_words.get(w)
                if c is None:
                    c = self.merges(w)
                if len(w) <= CACHED_CHARS:
                    by_word[w] = c
            total += c
        return total

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if self.beside.search(text):
            return self._split(text)  # white space beside a space: words start elsewhere
        # A mark between a letter and single white space is one word of one
        # byte, and so is a line feed between other characters.
        text, total = self.mark.subn("", text)
        by_chunk, lines = self.by_chunk, text.split("\n")
        total += len(lines) - 1
        for line in lines:
            first, *chunks = line.split(" ")
            long = []
            for c in set(filterfalse(by_chunk.__contains__, chunks)):
                n = self.old_chunks.get(c)
                by_chunk[c] = self._split(" " + c) if n is None else n
                if len(c) > CACHED_CHARS:
                    long.append(c)
            total += self._split(first) + sum(map(by_chunk.__getitem__, chunks))
            for c in long:
                del by_chunk[c]
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.by_word) > CACHE_ENTRIES:
            self.old_words, self.by_word = self.by_word, {}
        if len(self.by_chunk) > CACHE_ENTRIES:
            self.old_chunks, self.by_chunk = self.by_chunk, {}
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its bytes, its tokens, and whether they pass ``limit``.

    Null and empty texts have 0 bytes and 0 tokens. Null ids, repeated rows and
    further columns pass through as they are (further columns are not read). An
    empty table gives an empty result. A very long word takes n log n steps.
    """

    def run(batches):
        c = counter(tokenizer_path)
        for b in stage.slices(batches, "text"):
            texts = b.column(1).to_pylist()
            seen: dict[str | None, int] = {}
            n = []
            for t in texts:
                if t not in seen:
                    seen[t] = c.count(t)
                n.append(seen[t])
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return stage.map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(stage.table(spark, sf_dir, "documents"), default_tokenizer("byte_bpe_50k.json"))
