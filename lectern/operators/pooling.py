"""Range joins by blocks, and chunk vectors pooled from token vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def _blocks(a: Column, b: Column, block: int) -> Column:
    return F.sequence(F.floor(a / block), F.floor(F.greatest(b - 1, a) / block))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], block: int) -> DataFrame:
    """Pairs of equal keys whose half-open ranges overlap, each once.

    Both sides go to the blocks that they touch, so a long document's rows meet
    only near ones; a pair counts in the block of the later start.
    """
    x = left.withColumn("_block", F.explode(_blocks(F.col(a[0]), F.col(a[1]), block)))
    y = right.withColumn("_block", F.explode(_blocks(F.col(b[0]), F.col(b[1]), block)))
    j = x.join(y, [*keys, "_block"])
    later = F.greatest(F.col(a[0]), F.col(b[0]))
    return j.filter((later < F.least(F.col(a[1]), F.col(b[1]))) & (F.floor(later / block) == F.col("_block"))).drop("_block")


def _mean(dim: int) -> Column:
    """The mean of ``vec`` by component, which partial aggregation combines before the exchange."""
    return F.array(*[F.avg(F.col("vec")[k].cast("double")) for k in range(dim)])


def late_pool(tokens: DataFrame, spans: DataFrame, dim: int, keys: tuple[str, ...] = ("doc_id",), block: int = 2048) -> DataFrame:
    """(keys, chunk, vec): the unit mean of the token vectors that a span overlaps, of all its text's if none.

    ``tokens`` has the keys, t_start, t_end and vec; (0, 0) marks a special token, which
    overlaps nothing. ``spans`` has the keys, chunk, char_start and char_end. A span whose
    text has no token at all is absent.
    """
    k = list(keys)
    own = overlapping(tokens.filter(F.col("t_end") > F.col("t_start")), spans.filter(F.col("char_end") > F.col("char_start")), k, ("t_start", "t_end"), ("char_start", "char_end"), block)
    pooled = own.groupBy(*k, "chunk").agg(_mean(dim).alias("vec"))
    bare = spans.select(*k, "chunk").join(pooled.select(*k, "chunk"), [*k, "chunk"], "left_anti")
    whole = tokens.join(bare.select(*k).distinct(), k, "left_semi").groupBy(*k).agg(_mean(dim).alias("vec"))
    return pooled.unionByName(bare.join(whole, k).select(*k, "chunk", "vec")).withColumn("vec", T.l2_normalize(F.col("vec")))


def late_pool_windowed(tokens: DataFrame, spans: DataFrame, dim: int, most: int, overlap: int, margin: int = 10) -> DataFrame:
    """(doc_id, chunk, vec) of texts longer than a model's ``most`` tokens: the mean over windows of their unit means.

    ``tokens`` also has pos, from 0. Windows have ``most - margin`` tokens and step by that
    less ``overlap``; the last is the first to reach the end. Means over windows
    are not brought to unit length again; a span outside every window is all zero.
    """
    size = most - margin
    stride = size - overlap
    counts = tokens.groupBy("doc_id").agg(F.count("*").alias("_n"))
    last = F.when(F.col("_n") > size, F.ceil((F.col("_n") - size) / stride)).otherwise(0)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / stride))
    to = F.least(last, F.floor(F.col("pos") / stride))
    seen = tokens.join(counts, "doc_id").filter(first <= to).withColumn("window", F.explode(F.sequence(first, to))).drop("_n")
    edges = seen.groupBy("doc_id", "window").agg(F.min_by("t_start", "pos").alias("_w0"), F.max_by("t_end", "pos").alias("_w1"))
    cut = overlapping(spans, edges, ["doc_id"], ("char_start", "char_end"), ("_w0", "_w1"), 4096)
    held = cut.select("doc_id", "window", "chunk", F.greatest("char_start", "_w0").alias("char_start"), F.least("char_end", "_w1").alias("char_end"))
    per = late_pool(seen, held, dim, ("doc_id", "window"))
    mean = per.groupBy("doc_id", "chunk").agg(_mean(dim).alias("vec"))
    zero = F.array(*[F.lit(0.0)] * dim)
    return spans.select("doc_id", "chunk").join(mean, ["doc_id", "chunk"], "left").withColumn("vec", F.coalesce("vec", zero))


def embed_mode(chunks: DataFrame) -> DataFrame:
    """(doc_id, mode): ``late`` if all of a document's chunks have a span, else ``standard``."""
    return chunks.groupBy("doc_id").agg(F.when(F.count("char_start") == F.count("*"), "late").otherwise("standard").alias("mode"))


def provenance(spans: DataFrame) -> DataFrame:
    """Spans with the gap that each leaves after the one before it."""
    w = Window.partitionBy("doc_id").orderBy("chunk")
    return spans.withColumn("gap", F.col("char_start") - F.lag("char_end").over(w))
