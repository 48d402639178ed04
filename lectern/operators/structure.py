"""Chunks along a document's headings: the greatest sections that fit, and what does not fit packed in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.sources.html import marked, under_headings


def structural_chunks(atoms: DataFrame, most: int, id_col: str = "page_id", size: Column | None = None, deepest: int = 6) -> DataFrame:
    """(id, pos, path, text, size, n_atoms): chunks of about ``most`` tokens (or ``size``, by atom), in order by ``pos``.

    ``atoms`` has id, pos, label, level and text. A section with all that is
    below it is one chunk if it fits and the one around it does not; neighbours
    in a section that does not fit are packed in order, an atom of more than
    ``most`` by itself. Headings count as atoms of their own section and open
    its text, marked by level. Sections are sums over windows of one document,
    so its rows are shuffled once for all levels.
    """
    held = under_headings(atoms.withColumn("_n", F.size(T.tokens(F.col("text"))) if size is None else size), id_col, deepest)
    fits, depth = [], F.size("places")
    for d in range(deepest + 1):
        held = held.withColumn(f"_t{d}", F.sum("_n").over(Window.partitionBy(id_col, F.slice("places", 1, d) if d else F.array().cast("array<int>"))))
        fits.append(F.when((F.lit(d) <= depth) & (F.col(f"_t{d}") <= most), F.lit(d)))
    whole = F.coalesce(*fits)
    # An atom of no section that fits stands with those of its own section alone.
    held = held.withColumn("_fits", whole.isNotNull()).withColumn("_unit", F.slice("places", F.lit(1), F.coalesce(whole, depth)))
    atom = F.struct("pos", marked(F.col("label"), F.col("text")).alias("text"), F.col("_n").alias("n"), "path")
    units = held.groupBy(id_col, "_unit", "_fits").agg(F.array_sort(F.collect_list(atom)).alias("atoms"))
    keyed = units.select(F.struct(id_col, "_unit", "_fits").alias("doc_id"), "atoms")
    cut = C.cut(keyed, F.when(F.col("doc_id._fits"), F.array(F.lit(0))).otherwise(C.chunk_starts(F.col("atoms"), 0, most, 0, lambda a: a["n"])))
    return cut.select(
        F.col(f"doc_id.{id_col}").alias(id_col), F.col("atoms")[0]["pos"].alias("pos"), F.slice(F.col("atoms")[0]["path"], F.lit(1), F.size("doc_id._unit")).alias("path"),
        F.array_join(F.transform("atoms", lambda a: a["text"]), "\n\n").alias("text"), F.aggregate("atoms", F.lit(0), lambda s, a: s + a["n"]).alias("size"), F.size("atoms").cast("long").alias("n_atoms"),
    )
