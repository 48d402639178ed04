"""Packing of ordered atoms into chunks, speaker tagging and span assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def atoms(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, pos, text): the non-blank pieces of each text in order."""
    parts = F.filter(F.split("text", separator), lambda s: F.trim(s) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "text"))


def chunk_starts(atoms: Column, least: int, most: int, join: int = 2, size=lambda a: a, soft=lambda a: F.lit(False)) -> Column:
    """The positions of the atoms that open a chunk, folded over their sizes in order.

    A chunk closes only if it has ``least`` and the next atom would take it past
    ``most``, or is one that ``soft`` closes at; so ``most`` is soft. A position
    is written only where a chunk opens, so the fold copies no array at every atom.
    """
    state = F.struct(F.lit(-1).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, a: Column) -> Column:
        new = (s["size"] < 0) | ((s["size"] >= least) & (soft(a) | (s["size"] + join + size(a) > most)))
        now = F.when(new, size(a)).otherwise(s["size"] + join + size(a))
        return F.struct(now.alias("size"), (s["at"] + 1).alias("at"), F.when(new, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"))

    return F.aggregate(atoms, state, step, lambda s: s["starts"])


def cut(docs: DataFrame, starts: Column) -> DataFrame:
    """(doc_id, chunk, atoms): the slices of each document's array ``atoms`` from one start to the next.

    The slices are made before the explode, which then copies no document once
    for each chunk; nothing is shuffled.
    """
    held = docs.select("doc_id", "atoms", starts.alias("starts"))
    ends = F.transform("starts", lambda s, k: F.struct((s + 1).alias("first"), (F.coalesce(F.get("starts", k + 1), F.size("atoms")) - s).alias("count")))
    held = held.select("doc_id", "atoms", ends.alias("cuts"))
    parts = F.transform("cuts", lambda c: F.slice("atoms", c["first"], c["count"]))
    return held.select("doc_id", F.posexplode(parts).alias("chunk", "atoms"))


def greedy_pack(docs: DataFrame, least: int = 400, most: int = 1500) -> DataFrame:
    """(doc_id, chunk, text, n_atoms): greedy packing of a document's lines."""
    lines = docs.select("doc_id", F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "").alias("atoms"))
    packed = cut(lines, chunk_starts(F.transform("atoms", lambda a: F.length(a)), least, most))
    return packed.select("doc_id", "chunk", F.array_join("atoms", "\n\n").alias("text"), F.size("atoms").cast("long").alias("n_atoms"))


def fixed_windows(docs: DataFrame, size: int = 1500, keep: tuple[str, ...] = ()) -> DataFrame:
    """Non-overlapping windows of ``size`` characters, with the columns in ``keep`` of their document."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))
    windows = F.transform(starts, lambda a: F.struct(a.alias("char_start"), F.col("text").substr(a + 1, F.lit(size)).alias("text")))
    rows = docs.filter(F.length("text") > 0).select("doc_id", *keep, F.explode(windows).alias("w"))
    return rows.select("doc_id", *keep, "w.char_start", "w.text")


#: Found places that the fold of :func:`spans` appends to at a time; it copies no more of them at a chunk.
SPAN_BLOCK = 256


def spans(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """0-based half-open spans of chunks found in order, each behind the last one's start, else from the beginning; unfound ones go."""
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("cs"))
    ints = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), ints.alias("block"), F.array().cast("array<array<int>>").alias("blocks"))
    joined = docs.join(held, "doc_id")

    def step(s: Column, c: Column) -> Column:
        later = F.call_function("locate", c["piece"], F.col("text"), s["at"] + 1)
        # Each search stands in an array of one, so that it is made once however often its result is read.
        found = F.transform(F.array(later), lambda n: F.when(n > 0, n).otherwise(F.call_function("locate", c["piece"], F.col("text"), F.lit(1))))
        full = F.size(s["block"]) >= SPAN_BLOCK

        def put(n: Column) -> Column:
            block = F.when(full, F.array(n)).otherwise(F.concat(s["block"], F.array(n)))
            return F.struct(F.when(n > 0, n).otherwise(s["at"]).alias("at"), block.alias("block"), F.when(full, F.concat(s["blocks"], F.array(s["block"]))).otherwise(s["blocks"]).alias("blocks"))

        return F.transform(found, put)[0]

    places = F.aggregate("cs", start, step, lambda s: F.flatten(F.concat(s["blocks"], F.array(s["block"]))))
    placed = joined.select("doc_id", "cs", places.alias("places")).select("doc_id", F.explode(F.arrays_zip("cs", "places")).alias("c"))
    begin = F.col("c.places") - 1
    return placed.filter("c.places > 0").select("doc_id", "c.cs.chunk", begin.alias("char_start"), (begin + F.length("c.cs.piece")).alias("char_end"))


# How the head of a turn of minutes names its speaker, and what in
# a name says that a title has slipped into it.
NAME_PART = "[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜa-zçğıöşü]+"
FULL_NAME = rf"{NAME_PART}(?:\s+{NAME_PART})+"
TITLE = r"(?:[A-ZÇĞİÖŞÜ]+\s+)*(?:BAKANI?|BAŞBAKAN(?:\s+YARDIMCISI)?|BAKANLIĞI|DEVLET\s+BAKANI)"
MINISTER = rf"^\s*({TITLE}(?:\s+VE\s+{TITLE})*)\s+({FULL_NAME})\s*[—\-–]"
DEPUTY = rf"^\s*({FULL_NAME})\s*\(([^)]+)\)\s*[—\-–]"
CHAIR = r"^\s*(BAŞKAN|BAŞKANVEKİLİ)\s*[—\-–]"
DOUBTFUL = r"BAKANI|YARDIMCISI|BAŞBAKAN| VE |(?<![\p{L}\p{N}_])[A-ZÇĞİÖŞÜ](?![\p{L}\p{N}_])"
LONG_NAME = 35


def speaker(text: Column) -> Column:
    """The speaker that opens a turn of minutes: minister, deputy with constituency, or chair.

    A struct of author, role, constituency and confidence; a name that looks
    like more than one has half the confidence.
    """
    head = F.trim(F.regexp_replace(F.substring(text, 1, 200), r"(?U)\s+", " "))
    part = lambda p, k: F.trim(F.regexp_extract(head, p, k))
    none = F.lit(None).cast("string")

    def row(author: Column, role: Column, place: Column) -> Column:
        doubt = (F.length(author) > LONG_NAME) | author.rlike(DOUBTFUL)
        return F.struct(author.alias("author"), role.alias("role"), place.alias("constituency"), F.when(doubt, 0.5).otherwise(1.0).alias("confidence"))

    chair = part(CHAIR, 1)
    return (
        F.when(head.rlike(MINISTER), row(part(MINISTER, 2), F.lower(part(MINISTER, 1)), none))
        .when(head.rlike(DEPUTY), row(part(DEPUTY, 1), F.lit("milletvekili"), part(DEPUTY, 2)))
        .when(head.rlike(CHAIR), row(chair, F.lower(chair), none).withField("confidence", F.lit(1.0)))
    )


def tag(turns: DataFrame, by: list[str], order: str, who: Column) -> DataFrame:
    """Carry each transition's author to the turns after it, as one struct, with a segment number."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = turns.withColumn("_t", who)
    return (
        marked.withColumn("tagged", F.last("_t", ignorenulls=True).over(w))
        .withColumn("segment", F.sum(F.col("_t").isNotNull().cast("int")).over(w))
        .withColumn("is_continuation", F.col("_t").isNull() & F.col("tagged").isNotNull())
        .drop("_t")
    )


def chunk_authors(tagged: DataFrame, by: list[str], order: str) -> DataFrame:
    """The primary author of each chunk: most characters, first seen on ties."""
    per = tagged.groupBy(*by, "author").agg(F.sum(F.length("text")).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    authors = F.transform(F.array_sort(F.collect_list(F.struct("first", "author"))), lambda a: a["author"])
    names = per.groupBy(*by).agg(F.array_join(authors, ",").alias("authors"), F.count("*").alias("n_authors"))
    top = per.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, F.col("author").alias("primary"), F.col("n").alias("primary_chars"))
    return top.join(names, by)


def turn_runs(tagged: DataFrame, by: list[str], order: str) -> DataFrame:
    """Neighbouring turns of one author as one segment."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.coalesce((F.col("author") != F.lag("author").over(w)).cast("int"), F.lit(1))
    runs = tagged.withColumn("_c", change).withColumn("segment", F.sum("_c").over(w)).drop("_c")
    return runs.groupBy(*by, "segment").agg(F.min("author").alias("author"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


def pages_text(parts: DataFrame) -> DataFrame:
    """The text of each page, its atoms in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return parts.groupBy("doc_id", "page").agg(joined.alias("text"))
