"""A session's collections under one roof: registered at run time, asked by DataFrame or by SQL.

Registered collections are temporary views, a further view lists them, and
``retrieve(vector, k)`` is a table function over those that the session may
see, so SQL alone finds, joins and filters what the operators find. The function
ranks all chunks for each vector; a table of questions is answered at once by
:meth:`Session.answer`, whose view SQL reads like the function's rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import filters as P
from lectern.operators import retrieval as R
from lectern.sources import ingest

#: What every collection has; further columns may follow and need not be the same.
COLUMNS = ("chunk_id", "document_id", "text", "embedding")
ALL, LISTED, FUNCTION, ANSWERS = "session_chunks", "session_collections", "retrieve", "session_answers"

_DISTANCE = (
    "1 - aggregate(zip_with(v, {f}.q, (a, b) -> a * b), 0D, (s, x) -> s + x) / "
    "(sqrt(aggregate(v, 0D, (s, x) -> s + x * x)) * sqrt(aggregate({f}.q, 0D, (s, x) -> s + x * x)) + 1e-9)"
)


class Session:
    """Collections by name, and those of them that this session is granted (all, unless told)."""

    def __init__(self, spark: SparkSession, granted: list[str] | None = None):
        self.spark = spark
        self.granted = granted
        self.specs: dict[str, dict] = {}
        self._refresh()

    def register(self, name: str, chunks: DataFrame, document_type: str = "custom", weight: float = 1.0) -> None:
        """Add a collection or put another in its place; its view has its name."""
        if not re.fullmatch(r"[A-Za-z_]\w*", name) or name in (ALL, LISTED, ANSWERS):
            raise ValueError(f"no name for a collection: {name}")
        lacking = [c for c in COLUMNS if c not in chunks.columns]
        if lacking:
            raise ValueError(f"collection {name} lacks {', '.join(lacking)}")
        chunks.createOrReplaceTempView(name)
        self.specs[name] = {"document_type": document_type, "weight": weight, "chunks": chunks}
        self._refresh()

    def names(self) -> list[str]:
        """Registered collections that the session may see."""
        return [n for n in self.specs if self.granted is None or n in self.granted]

    def collection(self, name: str) -> DataFrame:
        if name not in self.specs:
            raise KeyError(f"no collection {name}; there are {', '.join(self.specs) or 'none'}")
        if name not in self.names():
            raise PermissionError(f"the session is not granted {name}")
        return self.specs[name]["chunks"]

    def chunks(self, names: list[str] | None = None) -> DataFrame:
        """The chunks of some collections, or of all granted ones, with their collection."""
        parts = [self.collection(n).withColumn("collection", F.lit(n)) for n in (self.names() if names is None else names)]
        if not parts:
            empty = "chunk_id string, document_id string, text string, embedding array<double>, collection string"
            return self.spark.createDataFrame([], empty)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _refresh(self) -> None:
        vector = F.transform("embedding", lambda x: x.cast("double")).alias("v")
        base = self.chunks().select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), "text", vector, "collection")
        base.createOrReplaceTempView(ALL)
        rows = [(n, self.specs[n]["document_type"], float(self.specs[n]["weight"])) for n in self.names()]
        self.spark.createDataFrame(rows, "name string, document_type string, weight double").createOrReplaceTempView(LISTED)
        self.spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION {FUNCTION}(q ARRAY<DOUBLE>, k INT)
            RETURNS TABLE(collection STRING, chunk_id STRING, document_id STRING, text STRING, distance DOUBLE, rank INT)
            RETURN SELECT collection, chunk_id, document_id, text, distance, rank FROM (
              SELECT *, row_number() OVER (ORDER BY round(distance, 9), collection, chunk_id) AS rank
              FROM (SELECT *, {_DISTANCE.format(f=FUNCTION)} AS distance FROM {ALL} WHERE v IS NOT NULL)) WHERE rank <= {FUNCTION}.k"""
        )

    def retrieve(self, queries: DataFrame, k: int, names: list[str] | None = None, criteria: P.Criteria | None = None) -> DataFrame:
        """The nearest chunks of each query (query_id, qvec) over some collections.

        ``criteria`` that no chunk meets are relaxed: without the author, then
        none. Columns of the chunks stand beside distance and rank.
        """
        chunks = self.chunks(names)
        if criteria is not None:
            chunks = P.relaxed(chunks, criteria)
        return R.top_k(queries, chunks.filter("embedding is not null"), k)

    def answer(self, questions: DataFrame, k: int, view: str = ANSWERS) -> DataFrame:
        """(query_id, collection, chunk_id, document_id, distance, rank): the rows of the table function for each question (query_id, qvec), also as a view.

        Texts stand in the view of all chunks, to be joined by collection and id.
        """
        chunks = self.spark.table(ALL).filter("v is not null")
        # Of equal distances the first collection comes first, then the first id in it.
        place = F.concat("collection", F.lit("\0"), "chunk_id")
        slim = chunks.select(place.alias("chunk_id"), F.col("chunk_id").alias("_own"), "document_id", "collection", F.col("v").alias("embedding"))
        near = R.top_k(questions.select("query_id", "qvec"), slim, k)
        got = near.select("query_id", "collection", F.col("_own").alias("chunk_id"), "document_id", "distance", "rank")
        got.createOrReplaceTempView(view)
        return got

    def context(self, queries: DataFrame, k: int, names: list[str] | None = None, max_chars: int = 2_000, most_distance: float = 1.0, total: int = 12_000, criteria: P.Criteria | None = None) -> DataFrame:
        """One context text for each query, from what :meth:`retrieve` finds."""
        ranked = self.retrieve(queries, k, names, criteria).withColumn("source", F.col("collection"))
        return R.context(ranked, max_chars, most_distance, total)

    def lookup(self, ids: list[str], names: list[str] | None = None) -> DataFrame:
        return ingest.lookup(self.chunks(names), ids)

    def plans(self, asked: DataFrame) -> DataFrame:
        """Plans (query_id, collection, priority, budgets) with whether the session allows each."""
        allowed = self.spark.createDataFrame([(n,) for n in self.names()], "collection string")
        return P.enforce(asked, allowed)

    def orchestrate(self, queries: DataFrame, plans: DataFrame, fetch: int = 20, **limits) -> DataFrame:
        """Assembly, evidence and expansion over what a session's plans allow; a query without an allowed plan is refused."""
        mine = self.plans(plans).filter("granted").drop("granted", "reason")
        slim = self.chunks().filter("embedding is not null").select("chunk_id", "document_id", "embedding", "collection")
        hits = R.top_k(queries, slim, fetch, by=("collection",)).select("query_id", "collection", "rank", "chunk_id", "document_id")
        return R.orchestrate(queries, hits, mine, **limits)
