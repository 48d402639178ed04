"""Recursive splitting with offsets, merging of small chunks, and windows around query words."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking as C

SEPARATORS = ("\n\n", "\n", " ", "")
FLUSH_CHARS = 4_000_000


def _pieces(text: str, separator: str) -> list[str]:
    """The non-empty parts of a text, each with the separator that stood before it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _merged(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces joined up to ``size``, the next chunk starting with up to ``overlap`` of the last."""
    held: deque[str] = deque()
    n = 0
    for p in pieces:
        if held and n + len(p) > size:
            yield "".join(held).strip()
            while n > overlap or (n > 0 and n + len(p) > size):
                n -= len(held.popleft())
        held.append(p)
        n += len(p)
    yield "".join(held).strip()


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about ``size`` characters, cut at the first separator that a text holds and finer ones inside."""
    k = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[k + 1 :]
    out: list[str] = []
    small: list[str] = []

    def flush() -> None:
        out.extend(c for c in _merged(small, size, overlap) if c)
        small.clear()

    for p in _pieces(text, separators[k]):
        if len(p) < size:
            small.append(p)
            continue
        flush()
        out.extend(recursive_split(p, size, overlap, finer) if finer else [p])
    flush()
    return out


def located(text: str, chunks: Iterable[str]) -> Iterator[tuple[str, int, int]]:
    """Chunks with their half-open spans, each searched for after the start before it, else from 0; unfound ones go."""
    after = 0
    for c in chunks:
        at = text.find(c, after)
        if at < 0:
            at = text.find(c)
        if at >= 0:
            yield c, at, at + len(c)
            after = at + 1


def split_with_offsets(docs: DataFrame, size: int = 1500, overlap: int = 150) -> DataFrame:
    """(doc_id, chunk, text, char_start, char_end) of every text; null and blank texts have no chunk.

    Splitting is a recursion that Catalyst cannot express, so it runs over Arrow
    batches; no row meets another, and what a batch has yielded is passed on
    every few million characters.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "chunk", "text", "char_start", "char_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.schema.field(0).type
            types = [ids, pa.int32(), pa.string(), pa.int32(), pa.int32()]
            rows: list[tuple] = []
            n = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (c, x, y) in enumerate(located(text or "", recursive_split(text or "", size, overlap))):
                    rows.append((doc, k, c, x, y))
                    n += len(c)
                if n > FLUSH_CHARS:
                    yield _batch(rows, types, names)
                    rows, n = [], 0
            if rows:
                yield _batch(rows, types, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk int, text string, char_start int, char_end int")


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def min_token_merge(chunks: DataFrame, least: int) -> DataFrame:
    """(doc_id, chunk, text, char_start, char_end, n_merged): a chunk of under ``least`` tokens takes in those after it.

    A document's chunks are brought together once; they were one text before,
    and are sliced where they stand.
    """
    n = F.size(T.tokens(F.col("text"))).alias("n")
    atoms = F.array_sort(F.collect_list(F.struct("chunk", "text", "char_start", "char_end", n)))
    docs = chunks.groupBy("doc_id").agg(atoms.alias("atoms"))
    # With no upper size a chunk closes as soon as it has enough.
    merged = C.cut(docs, C.chunk_starts(F.col("atoms"), least, -1, 0, lambda a: a["n"]))
    return merged.select(
        "doc_id", "chunk", F.array_join(F.transform("atoms", lambda a: a["text"]), "\n\n").alias("text"),
        F.array_min(F.transform("atoms", lambda a: a["char_start"])).alias("char_start"), F.array_max(F.transform("atoms", lambda a: a["char_end"])).alias("char_end"),
        F.size("atoms").cast("long").alias("n_merged"),
    )


def relevant_windows(text: Column, query: Column, size: int = 800, most: int = 3000, least_rest: int = 200) -> Column:
    """Merged windows around every occurrence of a query's words, up to ``most`` characters in all.

    Occurrences, overlapping ones too, are where a split before any of the words
    cuts the normalised text; their windows are cut from the text as it is.
    Without an occurrence it is the first ``most`` characters; null counts as empty.
    """
    text, query = F.coalesce(text, F.lit("")), F.coalesce(query, F.lit(""))
    words = F.filter(F.split(T.normalize_tr(query), r"(?U)\s+"), lambda w: F.length(w) > 2)
    flat = T.normalize_tr(text)
    any_word = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    cut = F.split(flat, F.concat(F.lit("(?="), any_word, F.lit(")")))
    at_start = F.regexp_like(flat, F.concat(F.lit("^(?:"), any_word, F.lit(")")))
    pieces = F.transform(cut, lambda p, k: F.struct(F.length(p).alias("n"), ((k > 0) | at_start).alias("hit")))
    span = "struct<a:int,b:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def mark(s: Column, p: Column) -> Column:
        # Ends are cut to the text's length once the windows are merged; measuring it here would read the text at each hit.
        a, b = F.greatest(F.lit(0), s["at"] - size), s["at"] + size
        last = F.get(s["spans"], F.size(s["spans"]) - 1)
        joins = last.isNotNull() & (a <= last["b"])
        longer = F.concat(F.slice(s["spans"], 1, F.greatest(F.size(s["spans"]) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))
        spans = F.when(~p["hit"], s["spans"]).when(joins, longer).otherwise(F.concat(s["spans"], F.array(F.struct(a.alias("a"), b.alias("b")))))
        return F.struct((s["at"] + p["n"]).alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("parts"))

    def take(s: Column, w: Column) -> Column:
        n, left = w["b"] - w["a"], F.lit(most) - s["n"]
        over = n > left
        part = F.when(~over, text.substr(w["a"] + 1, n)).when(left > least_rest, text.substr(w["a"] + 1, left))
        parts = F.when(s["full"] | part.isNull(), s["parts"]).otherwise(F.concat(s["parts"], F.array(part)))
        return F.struct(F.when(s["full"] | over, s["n"]).otherwise(s["n"] + n).alias("n"), (s["full"] | over).alias("full"), parts.alias("parts"))

    marked = F.aggregate(pieces, start, mark, lambda s: s["spans"])
    spans = F.transform(marked, lambda w: F.struct(w["a"].alias("a"), F.least(w["b"], F.length(text)).alias("b")))
    shown = F.array_join(F.aggregate(spans, empty, take, lambda s: s["parts"]), "\n[...]\n")
    hit = (F.size(words) > 0) & F.regexp_like(flat, any_word)
    return F.when(hit, shown).otherwise(F.substring(text, 1, most))
