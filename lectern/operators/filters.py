"""Predicates from typed criteria, masking, relaxation, resolution and routing."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, fields, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Criteria:
    """Nullable predicates over chunk metadata."""

    year: int | None = None
    year_lte: int | None = None
    year_gte: int | None = None
    author: str | None = None
    author_role: str | None = None
    source_name: str | None = None
    period: int | None = None
    session: int | None = None
    document_type: str | None = None


def predicate(c: Criteria, author_in: list[str] | None = None, columns: dict[str, str] | None = None) -> Column | None:
    """One Column for all criteria that are set, or None; Spark pushes it to the scan."""
    name = lambda k: F.col((columns or {}).get(k, k))
    parts = [name(k) == getattr(c, k) for k in ("year", "author_role", "source_name", "period", "session", "document_type") if getattr(c, k) is not None]
    if c.year_lte is not None:
        parts.append(name("year") <= c.year_lte)
    if c.year_gte is not None:
        parts.append(name("year") >= c.year_gte)
    if author_in:
        parts.append(name("author").isin(author_in))
    elif c.author is not None:
        parts.append((name("author") == c.author) | (name("author") == T.upper_tr(F.lit(c.author))))
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply(df: DataFrame, c: Criteria, **kw) -> DataFrame:
    p = predicate(c, **kw)
    return df if p is None else df.filter(p)


def mask(c: Criteria, indexed: set[str] | None) -> Criteria:
    """Criteria without the fields that a document type does not index; None masks nothing."""
    if indexed is None:
        return c
    keep = indexed | {"year_lte", "year_gte"} if "year" in indexed else indexed
    return replace(c, **{f.name: None for f in fields(c) if f.name not in keep})


def relaxations(c: Criteria) -> list[tuple[str, Criteria]]:
    """The criteria in full, without their author, and empty, as far as they differ."""
    out = [("full", c)]
    bare = replace(c, author=None, author_role=None)
    if bare != c and bare != Criteria():
        out.append(("no_author", bare))
    out.append(("semantic_only", Criteria()))
    return out


def relaxed(df: DataFrame, c: Criteria, columns: dict[str, str] | None = None) -> DataFrame:
    """The rows of the first relaxation that has any, with its ``level``, in one scan.

    The predicates nest, so a row's own level is the first it meets; the least
    level of all rows is a scalar that a broadcast row brings back.
    """
    tiers = relaxations(c)
    level = F.lit(len(tiers) - 1)
    for k in range(len(tiers) - 2, -1, -1):
        p = predicate(tiers[k][1], columns=columns)
        level = F.when(F.coalesce(p, F.lit(False)), k).otherwise(level) if p is not None else F.lit(k)
    tagged = df.withColumn("_tier", level)
    least = tagged.agg(F.min("_tier").alias("_least"))
    names = F.array(*[F.lit(n) for n, _ in tiers])
    return tagged.join(F.broadcast(least), F.col("_tier") <= F.col("_least")).withColumn("level", F.element_at(names, F.col("_least") + 1)).drop("_tier", "_least")


def resolve_names(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(wanted, label): labels that hold all words of a wanted name.

    Names meet labels under their rarest word alone, and the other words are
    then looked for in the label, so a common word joins nothing.
    """
    w = wanted.select("wanted", T.name_tokens(F.col("wanted")).alias("ws")).distinct().filter(F.size("ws") > 0)
    labels = vocabulary.select("label").distinct().select("label", T.name_tokens(F.col("label")).alias("held"))
    words = labels.select("label", "held", F.explode("held").alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("n"))
    each = w.select("wanted", "ws", F.explode("ws").alias("word")).join(known, "word", "left")
    rarest = each.groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"), F.first("ws").alias("ws"))
    met = rarest.filter("r.n > 0").select("wanted", "ws", F.col("r.word").alias("word")).join(words, "word")
    return met.filter(F.size(F.array_except("ws", "held")) == 0).select("wanted", "label")


def has_hints(c: Column, keywords: list[str]) -> Column:
    """A year, a keyword, or a capitalised word after the first that is not all capitals."""
    words = F.split(F.trim(c), r"\s+")
    later = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(0)))
    name = F.exists(later, lambda w: w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}"))
    return c.rlike(r"\b(?:19|20)\d{2}\b") | T.any_keyword(c, keywords) | name


def route(c: Column, first: list[str], second: list[str], names: tuple[str, str] = ("minutes", "gazette")) -> Column:
    """One source if only its keywords occur, else both."""
    a, b = T.any_keyword(c, first), T.any_keyword(c, second)
    return F.when(a & ~b, names[0]).when(b & ~a, names[1]).otherwise("both")


def within(df: DataFrame, most: float, column: str = "distance") -> DataFrame:
    """Rows up to a distance; an unknown distance stays."""
    return df.filter(F.col(column).isNull() | (F.col(column) <= most))


def usable_patterns(patterns: list[str]) -> list[str]:
    """Folded patterns, for folded text in any case; one that is no pattern is passed over with a warning."""
    out = []
    for raw in patterns:
        if not raw:
            continue
        try:
            re.compile(T.folded(raw))
            SparkSession.active()._jvm.java.util.regex.Pattern.compile(T.folded(raw))
            out.append("(?iU)" + T.folded(raw))
        except (re.error, Py4JJavaError) as e:
            log.warning("passing over the pattern %r: %s", raw, str(e).split("\n", 1)[0])
    return out


def banned_words(c: Column, words: list[str], patterns: list[str] | None = None, on: bool = True, repeats: bool = False) -> Column:
    """Distinct banned words among the folded tokens of a text, in order of appearance; with ``repeats`` every one of them.

    The first match of each of ``patterns`` in the folded text comes after
    them, pattern by pattern; patterns are folded as texts are. Switched off, or
    in a null or empty text, nothing is found.
    """
    none = F.array().cast("array<string>")
    folded = T.fold(c)
    parts = []
    if any(words):
        tokens = F.regexp_extract_all(folded, F.lit(r"(?U)\w+"), F.lit(0))
        parts.append(F.filter(tokens, lambda t: t.isin([T.folded(w) for w in words if w])))
    for p in usable_patterns(patterns or []):
        parts.append(F.when(folded.rlike(p), F.array(F.regexp_extract(folded, p, 0))).otherwise(none))
    if not on or not parts:
        return none
    return F.when(F.coalesce(c, F.lit("")) == "", none).otherwise(F.concat(*parts) if repeats else F.array_distinct(F.concat(*parts)))


def enforce(plan: DataFrame, allowed: DataFrame) -> DataFrame:
    """Suggested collections with whether a session allows them, in the suggested order."""
    ok = allowed.select(F.col("collection").alias("_ok")).distinct()
    joined = plan.join(ok, plan["collection"] == ok["_ok"], "left")
    return joined.withColumn("granted", F.col("_ok").isNotNull()).withColumn("reason", F.when(F.col("_ok").isNull(), "not in session")).drop("_ok")


def year_filter(years: list[int], column: str = "year") -> Column:
    return F.col(column).isin(years)


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
