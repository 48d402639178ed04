"""Boundaries to models outside the engine, with deterministic defaults that claim no model's results."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.filters import Criteria


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class Scorer(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class FilterExtractor(Protocol):
    def extract(self, query: str) -> tuple[str, Criteria]: ...


class HashedEmbedder:
    """Hashed word counts at unit length: a stand-in for tests, inside the JVM."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        slots = F.transform(T.tokens(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(self.dim)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
        return df.withColumn(out, T.l2_normalize(counts).cast("array<float>"))


class OverlapScorer:
    """The part of the query's words that a text holds."""

    def score(self, query: Column, text: Column) -> Column:
        return T.excerpt_overlap(query, text)


class PatternFilters:
    """Years and periods read from a query's words by pattern."""

    def extract(self, query: str) -> tuple[str, Criteria]:
        import re

        year = re.search(r"\b(?:19|20)\d{2}\b", query)
        period = re.search(r"\b(\d{1,2})\. *dönem", query.lower())
        return query, Criteria(year=int(year[0]) if year else None, period=int(period[1]) if period else None)


#: What a model family wants before a text, by task.
PREFIXES = {
    ("nomic", "query"): "search_query: ",
    ("nomic", "passage"): "search_document: ",
    ("qwen", "query"): "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ",
}


def prefixed(text: Column, model: str, task: str = "retrieval.passage") -> Column:
    """A text as a model wants it: families without a prefix for the task take it as it is."""
    kind = "query" if "query" in task else "passage"
    lead = next((p for (family, k), p in PREFIXES.items() if family in model.lower() and k == kind), "")
    return F.concat(F.lit(lead), text) if lead else text


def pooled(tokens: DataFrame, batch: str, dim: int | None = None, most: int | None = None) -> DataFrame:
    """(text_id, embedding): the mean of each text's token vectors over its batch's padded length, cut and brought to length one.

    ``tokens`` has text_id, the column ``batch``, pos and vec, with a row for
    each token that the model read. A model's batch is as long as its longest
    text, and its plain mean counts what fills the others up: vectors that it
    gave for filling are in ``tokens``, places without a row count as zeros.
    ``most`` is the number of tokens that it reads of a text, ``dim`` keeps the
    first components. Sums are taken by component in partial aggregation; a
    vector of zeros stays one.
    """
    tokens = tokens if most is None else tokens.filter(F.col("pos") < most)
    longest = tokens.groupBy(batch).agg((F.max("pos") + 1).alias("_long"))
    parts = tokens.select("text_id", batch, F.posexplode("vec").alias("i", "x")).groupBy("text_id", batch, "i").agg(F.sum("x").alias("s"))
    parts = parts if dim is None else parts.filter(F.col("i") < dim)
    held = parts.join(longest, batch).groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("_long")).alias("m")))).alias("ms"))
    mean = F.transform("ms", lambda m: m["m"])
    return held.select("text_id", T.l2_normalize(mean).alias("embedding"))
