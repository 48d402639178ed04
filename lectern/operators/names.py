"""Known names found in questions: typed criteria and what is left of the text.

An Aho-Corasick automaton over the folded vocabulary finds all names of a text
in one pass, however many names there are. It is built once in each worker from
a broadcast of checked size. A greater vocabulary is joined with the phrases of
each text that have as many words as a name, so work is linear in both.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from lectern.functions.text import fold, folded
from lectern.sources import scratch

#: Bytes of names in an automaton, which takes about a hundred times that in a worker.
BLOCK_BYTES = 4_000_000
#: Phrases of texts that a worker passes on at once.
PHRASES = 200_000
_NAME = "struct<kind:string,name:string,start:int,end:int>"
_WORD = re.compile(r"\w+")
_built: dict[str, object] = {}


def _vocabulary(names: DataFrame) -> DataFrame:
    """(key, kind, name): names by their folded words; of those of one key and kind the least."""
    key = F.array_join(F.regexp_extract_all(fold(F.col("name")), F.lit(r"(?U)\w+"), F.lit(0)), " ")
    return names.select(key.alias("key"), "kind", "name").filter("key <> ''").groupBy("key", "kind").agg(F.min("name").alias("name"))


def _automaton(block: str, held: list[tuple[str, list[tuple[str, str]]]]):
    if block not in _built:
        import ahocorasick

        _built.clear()  # one vocabulary at a time
        made = ahocorasick.Automaton()
        for key, named in held:
            made.add_word(f" {key} ", (len(key), named))
        made.make_automaton()
        _built[block] = made
    return _built[block]


def _matches(automaton, text: str) -> list[dict]:
    """All names that stand as whole words in a text, with their places in it."""
    plain = folded(text)
    words = [(m.start(), m.end()) for m in _WORD.finditer(plain)]
    joined, starts, at = [], {}, 1
    for k, (s, e) in enumerate(words):
        starts[at] = k
        joined.append(plain[s:e])
        at += e - s + 1
    ends = {p - 1: k for p, k in starts.items()} | {at - 1: len(words)}
    out = []
    for last, (n, named) in automaton.iter(f" {' '.join(joined)} ") if words else ():
        first, behind = starts[last - n], ends[last]
        out += [{"kind": kind, "name": name, "start": words[first][0], "end": words[behind - 1][1]} for kind, name in named]
    return out


@lru_cache(maxsize=100_000)
def _size(name: str) -> int:
    return len(" ".join(_WORD.findall(folded(name))))


def longest_first(found: list[dict]) -> list[dict]:
    """Names that do not overlap, the longest first, then the earliest; of one place one of each kind."""
    taken: list[dict] = []
    for m in sorted(found, key=lambda m: (-_size(m["name"]), m["start"], m["kind"], m["name"])):
        clash = any(m["start"] < t["end"] and t["start"] < m["end"] and ((m["start"], m["end"]) != (t["start"], t["end"]) or m["kind"] == t["kind"]) for t in taken)
        if not clash:
            taken.append(m)
    return taken


def _rest(text: str, found: list[dict]) -> str:
    for start, end in sorted({(m["start"], m["end"]) for m in found}, reverse=True):
        text = text[:start] + " " + text[end:]
    return " ".join(text.split())


def find_names(texts: DataFrame, names: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts`` with ``names``, what of the vocabulary (name, kind) they hold, longest first, and the ``rest`` of the text.

    Names and texts meet folded, by whole words; places are those in the text.
    Null texts have no names and no rest. Columns of these names are replaced.
    """
    held = scratch.written(_vocabulary(names), "vocabulary")
    size = held.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("name")), F.lit(0))).first()[0]
    kept = texts.select(*[c for c in texts.columns if c not in ("names", "rest", "_found", "_row")])
    grouped = held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "name"))).alias("named"))
    if size > block_bytes:
        return _joined(kept, grouped, text_col)
    # No more than ``block_bytes`` of names.
    rows = [(r.key, [(x.kind, x.name) for x in r.named]) for r in grouped.collect()]
    shared = texts.sparkSession.sparkContext.broadcast(rows)
    block = str(shared._jbroadcast.id())

    def find(text: str, _) -> list[dict]:
        return _matches(_automaton(block, shared.value), text) if shared.value else []

    return _named(kept.withColumn("_found", F.lit(None).cast("int")), text_col, find)


def _joined(texts: DataFrame, grouped: DataFrame, text_col: str) -> DataFrame:
    """The names of texts by a join of their phrases with the vocabulary; rows are numbered, and the numbers written."""
    numbered = scratch.written(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    lengths = sorted(r.n for r in grouped.select(F.size(F.split("key", " ")).alias("n")).distinct().collect())

    def phrases(batches):
        for b in batches:
            rows, keys = [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _WORD.findall(folded(text))
                said = {" ".join(words[k : k + n]) for n in lengths for k in range(len(words) - n + 1)}
                rows += [row] * len(said)
                keys += said
                if len(keys) >= PHRASES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.string())], names=["_row", "key"])
                    rows, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.string())], names=["_row", "key"])

    said = numbered.select("_row", text_col).filter(F.col(text_col).isNotNull()).mapInArrow(phrases, "_row long, key string")
    found = scratch.written(said.join(grouped, "key").groupBy("_row").agg(F.collect_list(F.struct("key", "named")).alias("_found")), "found")
    return _named(numbered.join(found, "_row", "left").drop("_row"), text_col, _places)


def _places(text: str, found: list[dict] | None) -> list[dict]:
    """All names of those that a text is known to hold, with their places in it."""
    held = {f["key"]: f["named"] for f in found or ()}
    plain = folded(text) if held else ""
    words = [(m.start(), m.end()) for m in _WORD.finditer(plain)]
    shown = [plain[s:e] for s, e in words]
    out = []
    for n in {key.count(" ") + 1 for key in held}:
        for k in range(len(words) - n + 1):
            for m in held.get(" ".join(shown[k : k + n]), ()):
                out.append({"kind": m["kind"], "name": m["name"], "start": words[k][0], "end": words[k + n - 1][1]})
    return out


def _named(texts: DataFrame, text_col: str, find: Callable[[str, list | None], list[dict]]) -> DataFrame:
    """``texts`` with ``names`` and ``rest`` instead of ``_found``, by a function of a text and that."""
    at, found_at = texts.columns.index(text_col), texts.columns.index("_found")
    fields = [f for f in texts.schema.fields if f.name != "_found"]
    schema = Y.StructType([*fields, Y.StructField("names", Y._parse_datatype_string(f"array<{_NAME}>")), Y.StructField("rest", Y.StringType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            said = b.column(at).to_pylist()
            found = [longest_first(find(t, f)) if t else [] for t, f in zip(said, b.column(found_at).to_pylist(), strict=True)]
            rest = [None if t is None else _rest(t, f) for t, f in zip(said, found, strict=True)]
            others = [c for k, c in enumerate(b.columns) if k != found_at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, arrow), pa.array(rest, pa.string())], names=schema.names)

    return texts.mapInArrow(run, schema)


def criterion(kind: str, names: str = "names") -> Column:
    """The longest name of a kind that was found, or null."""
    return F.get(F.filter(names, lambda m: m["kind"] == kind), F.lit(0))["name"]
