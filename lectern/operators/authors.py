"""Author detection by document type, and packing of atoms that keeps authors and pages together.

A detection is a struct (author, role, extra). Packing folds one document's
atom sizes into chunk starts; chunks are then slices of its atoms, so no
shuffle follows the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import chunking as C

# Patterns of names, bylines, proposers and signature lists, and
# the newspapers that a byline can name.
NAME = C.FULL_NAME
NEWSPAPERS = "Hürriyet|Milliyet|Sabah|Cumhuriyet|Tercüman|Türkiye"
COLUMNIST = rf"(?iU)^\s*Yazan\s*[:\-—]\s*({NAME})"
REPORTER = rf"(?U)^\s*({NAME})\s*[—\-]\s*(?:{NEWSPAPERS})"
PROPOSER = rf"(?U)([A-ZÇĞİÖŞÜ][a-zçğıöşü]+)\s+Milletvekili\s+({NAME})(?:\s+ve\s+(\d+)\s+arkadaşı)?"
SIGNATURES = r"(?U)\(\s*İmza\s*[:\-—]\s*([^)]+)\)"

MINUTES, PRESS, BILLS = ("tutanak",), ("gazete", "press_clip"), ("onerge", "kanun_teklifi")

FOUND = "struct<author:string,role:string,extra:map<string,string>>"


def _found(author: Column, role: str, *extra: Column) -> Column:
    more = F.map_filter(F.create_map(*extra), lambda k, v: v.isNotNull() & (v != "")) if extra else F.create_map()
    return F.struct(F.trim(author).alias("author"), F.lit(role).alias("role"), more.cast("map<string,string>").alias("extra"))


def byline(text: Column) -> Column:
    """The columnist or reporter that opens a newspaper text, else null."""
    head = F.substring(text, 1, 200)
    return F.when(head.rlike(COLUMNIST), _found(F.regexp_extract(head, COLUMNIST, 1), "köşe yazarı")).when(
        head.rlike(REPORTER), _found(F.regexp_extract(head, REPORTER, 1), "muhabir")
    )


def proposer(text: Column) -> Column:
    """The deputy that proposes a bill, with place and number of co-signers, or the first of a signature list."""
    head = F.substring(text, 1, 500)
    part = lambda k: F.regexp_extract(head, PROPOSER, k)
    names = F.filter(F.transform(F.split(F.regexp_extract(head, SIGNATURES, 1), "[,;]"), lambda s: F.trim(s)), lambda s: s != "")
    listed = _found(F.get(names, F.lit(0)), "imzacı", F.lit("signatories"), F.array_join(names, ", "))
    proposed = _found(part(2), "milletvekili", F.lit("constituency"), part(1), F.lit("co_signers_count"), part(3))
    return F.when(head.rlike(PROPOSER), proposed).when(F.size(names) > 0, listed)


def speaker(text: Column) -> Column:
    s = C.speaker(text)
    return F.when(s.isNotNull(), _found(s["author"], "", F.lit("constituency"), s["constituency"]).withField("role", s["role"]))


def detect(document_type: Column, text: Column) -> Column:
    """The author that opens a text by the rules of its document type; other types have none."""
    return (
        F.when(document_type.isin(*MINUTES), speaker(text))
        .when(document_type.isin(*PRESS), byline(text))
        .when(document_type.isin(*BILLS), proposer(text))
        .otherwise(F.lit(None).cast(FOUND))
    )


def _chunks(docs: DataFrame, least: int, most: int, join: str, soft=lambda a: F.lit(False)) -> DataFrame:
    """(doc_id, chunk, atoms) of documents with an array ``atoms`` in order."""
    sizes = F.transform("atoms", lambda a: a.withField("n", F.length(a["text"])))
    return C.cut(docs, C.chunk_starts(sizes, least, most, len(join), lambda a: a["n"], soft))


def _text(atoms: Column, join: str) -> Column:
    return F.array_join(F.transform(atoms, lambda a: a["text"]), join)


def _pages(atoms: Column) -> Column:
    """Sorted distinct pages of a chunk's atoms."""
    every = F.flatten(F.transform(atoms, lambda a: F.coalesce(a["pages"], F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(every))


def gathered(rows: DataFrame, columns: list[str], order: str = "pos") -> DataFrame:
    """(doc_id, atoms): the rows of each document in order, as one array."""
    atoms = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return rows.groupBy("doc_id").agg(F.transform(atoms, lambda a: F.struct(*[a[c].alias(c) for c in columns])).alias("atoms"))


def pack_pages(docs: DataFrame, least: int, most: int, join: str = "\n\n") -> DataFrame:
    """(doc_id, chunk, text, page, pages) of documents whose ``atoms`` have text and pages.

    A chunk closes once it has ``least`` characters and the next atom would take
    it past ``most``. Its pages are those of its atoms, its page the first. A
    document without atoms has no chunk.
    """
    packed = _chunks(docs, least, most, join).withColumn("pages", _pages(F.col("atoms")))
    return packed.select("doc_id", "chunk", _text(F.col("atoms"), join).alias("text"), F.get("pages", F.lit(0)).alias("page"), "pages")


def _authors(atoms: Column) -> dict[str, Column]:
    """Authors of a chunk's atoms: the one of most characters (the first seen on ties), all, and segments."""
    named = F.filter(atoms, lambda a: a["author"].isNotNull() & (a["author"] != ""))
    seen = F.array_distinct(F.transform(named, lambda a: a["author"]))

    def weight(x: Column, k: Column) -> Column:
        own = F.filter(named, lambda a: a["author"] == x)
        n = F.aggregate(own, F.lit(0), lambda s, a: s + F.length(a["text"]))
        return F.struct(n.alias("n"), (-k).alias("k"), x.alias("author"), F.get(own, F.lit(0))["role"].alias("role"))

    top = F.array_max(F.transform(seen, weight))
    return {
        "author": top["author"],
        "author_role": top["role"],
        "authors_in_chunk": seen,
        "segment_indices": F.array_distinct(F.transform(atoms, lambda a: a["segment"])),
    }


def pack_authors(docs: DataFrame, least: int, most: int, join: str = "\n\n", prefixed: bool = True) -> DataFrame:
    """Chunks of tagged atoms that close at a change of author too, with their authors and pages.

    ``atoms`` have text, author, role, segment, is_continuation and pages. A
    chunk of ``least`` characters closes before an atom that opens a segment, or
    that would take it past ``most``. A chunk that starts inside a named
    author's segment says so in a line before its text, if ``prefixed``.
    """
    packed = _chunks(docs, least, most, join, lambda a: ~a["is_continuation"])
    first = F.get("atoms", F.lit(0))
    role = F.when(first["role"] != "", F.concat(F.lit(" ("), first["role"], F.lit(")"))).otherwise("")
    mid = F.coalesce(first["is_continuation"] & first["author"].isNotNull(), F.lit(False))
    line = F.when(mid, F.concat(F.lit("["), first["author"], F.coalesce(role, F.lit("")), F.lit(" devam ediyor]"))) if prefixed else F.lit(None).cast("string")
    text = _text(F.col("atoms"), join)
    out = packed.withColumns({"pages": _pages(F.col("atoms")), **_authors(F.col("atoms"))}).withColumns({"starts_mid_segment": mid, "continuation_prefix": line})
    return out.withColumns({"page": F.get("pages", F.lit(0)), "text": F.concat(F.coalesce(F.concat("continuation_prefix", F.lit("\n")), F.lit("")), text)}).drop("atoms")


def tag_chunks(chunks: DataFrame, who, initial: Column | None = None, separator: str = "\n\n") -> DataFrame:
    """Authors of chunks that were cut elsewhere: (doc_id, chunk, text) and their author columns.

    Chunks are split into paragraphs; ``who`` (a function of a text Column)
    marks transitions, whose author lasts through later chunks of the document;
    ``initial`` (a detection) holds before the first. A chunk starts in mid
    segment if its first paragraph is no transition and its last has an author.
    Only paragraphs' lengths and authors are gathered, one chunk's at a time.
    """
    keys = ["doc_id", "chunk"]
    paragraphs = chunks.select(*keys, F.posexplode(F.split("text", separator)).alias("pos", "text"))
    w = Window.partitionBy("doc_id").orderBy("chunk", "pos")
    marked = paragraphs.withColumn("t", who(F.col("text"))).withColumn("is_continuation", F.col("t").isNull())
    last = F.last("t", ignorenulls=True).over(w)
    state = marked.select(
        *keys, "pos", "text", "is_continuation", F.sum(F.when(F.col("is_continuation"), 0).otherwise(1)).over(w).cast("int").alias("segment"),
        (F.coalesce(last, initial.cast(FOUND)) if initial is not None else last).alias("t"),
    )
    part = state.select(*keys, F.struct("pos", "text", F.col("t.author").alias("author"), F.col("t.role").alias("role"), "segment", "is_continuation", F.to_json("t.extra").alias("extra")).alias("a"))
    held = part.groupBy(*keys).agg(F.array_sort(F.collect_list("a")).alias("atoms"))
    first, end = F.get("atoms", F.lit(0)), F.element_at("atoms", -1)
    out = held.withColumns(_authors(F.col("atoms"))).withColumns({"starts_mid_segment": first["is_continuation"] & end["author"].isNotNull(), "extra": F.from_json(end["extra"], "map<string,string>")})
    return out.withColumn("text", _text(F.col("atoms"), separator)).drop("atoms")


def press_header(source: Column, date: Column, author: Column, title: Column) -> Column:
    """The line that stands before each chunk of a press text; absent values have stand-ins."""
    given = lambda c, other: F.when(c.isNull() | (c == ""), other).otherwise(c)
    return F.concat(
        F.lit("Gazete: "), given(source, "Bilinmiyor"), F.lit(" | Tarih: "), given(date, "?"),
        F.lit(" | Yazar: "), given(author, "Bilinmiyor"), F.lit(" | Başlık: "), given(title, ""), F.lit("\n"),
    )


def press_chunks(chunks: DataFrame, header: Column) -> DataFrame:
    """Chunks with a header before their text and spans shifted to the headed document."""
    moved = {c: F.col(c) + F.length(header) for c in ("char_start", "char_end")}
    return chunks.withColumns({"text": F.concat(header, F.col("text")), **moved})
