"""Joins of half-open intervals as equi-joins on dyadic blocks.

An interval is the disjoint union of at most two blocks of each power of two; a
point lies in one block of each power. So "point in interval" is one equality,
met exactly once, and two intervals overlap if one's start lies in the other:
work follows intervals, points and true pairs, never all pairs of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two that blocks have; intervals are cut at the greatest.
LEVELS = 62


def levels(longest: Column) -> Column:
    """The greatest power of two that a block of an interval of at most this length has."""
    return F.greatest(F.length(F.bin(longest)) - 1, F.lit(0))


def blocks(start: Column, end: Column) -> Column:
    """The dyadic blocks (level, at) of ``[start, end)``, from ``at * 2^level``; null for an empty interval.

    Going up, the lower end gives a block where it is odd and the upper end
    where it is odd, as both then leave their parent.
    """
    top = F.greatest(levels(end - start), F.lit(0))

    def step(k: Column) -> Column:
        lo = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)  # rounded up
        hi = F.call_function("shiftright", end, k)
        # Below this level everything between lo and hi is whole; one block at either end is not in a greater one.
        return F.filter(
            F.array(
                F.when((lo < hi) & (lo.bitwiseAND(F.lit(1)) == 1), F.struct(k.alias("level"), lo.alias("at"))),
                F.when((lo < hi) & (hi.bitwiseAND(F.lit(1)) == 1) & ((lo.bitwiseAND(F.lit(1)) == 0) | (hi - 1 > lo)), F.struct(k.alias("level"), (hi - 1).alias("at"))),
            ),
            lambda b: b.isNotNull(),
        )

    return F.when(start < end, F.flatten(F.transform(F.sequence(F.lit(0), top), step)))


def ancestors(point: Column, top: Column) -> Column:
    """The block of each level up to ``top`` that a point lies in."""
    return F.transform(F.sequence(F.lit(0), top), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", point, k).alias("at")))


def covering(points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """Pairs of a point and an interval that holds it, of equal ``by``; columns of both, names must differ else.

    Rows with a null key or bound meet nothing. The greatest length of a
    group's intervals bounds the levels that its points are given.
    """
    known = intervals.filter(F.col(start) < F.col(end))
    tops = known.groupBy(*by).agg(levels(F.max(F.col(end) - F.col(start)).cast("long")).alias("_top"))
    side = known.withColumn("_b", F.explode(blocks(F.col(start).cast("long"), F.col(end).cast("long"))))
    keyed = points.filter(F.col(point).isNotNull()).join(tops, by).withColumn("_b", F.explode(ancestors(F.col(point).cast("long"), F.col("_top")))).drop("_top")
    return keyed.join(side, [*by, "_b"]).drop("_b")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], bounds: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of equal ``by`` that share a position, each pair once.

    ``bounds`` are the columns of ``left``'s starts and ends, ``other`` those of
    ``right``. Of two intervals that overlap the later start lies in the other;
    equal starts count on one side alone. Empty intervals overlap nothing.
    """
    a = left.filter(F.col(bounds[0]) < F.col(bounds[1]))
    b = right.filter(F.col(other[0]) < F.col(other[1]))
    names = [*by, *[c for c in left.columns if c not in by], *[c for c in right.columns if c not in by]]
    first = covering(a, bounds[0], b, *other, by).select(*names)
    second = covering(b.withColumn("_at", F.col(other[0])), "_at", a.withColumn("_s", F.col(bounds[0]) + 1), "_s", bounds[1], by).select(*names)
    return first.unionByName(second)
