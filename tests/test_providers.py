"""What models want before a text, and means as a padded batch takes them."""

import math

import pytest
from pyspark.sql import functions as F

from lectern import providers
from lectern.operators import agents as G


@pytest.mark.parametrize(
    "model, task, lead",
    [
        ("nomic-embed-v1", "retrieval.passage", "search_document: "),
        ("Nomic", "retrieval.query", "search_query: "),
        ("Qwen3-Embedding", "retrieval.passage", ""),
        ("qwen", "query", "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "),
        ("jina-v3", "retrieval.query", ""),
    ],
)
def test_prefixes(spark, model, task, lead):
    got = spark.createDataFrame([("x",), (None,)], "t string").select(providers.prefixed(F.col("t"), model, task).alias("p")).collect()
    assert [r.p for r in got] == [lead + "x", None]


def test_means_go_over_the_padded_length(spark):
    rows = [("a", 1, 0, [3.0, 4.0, 9.0]), ("b", 1, 0, [1.0, 0.0, 9.0]), ("b", 1, 1, [0.0, 1.0, 9.0]), ("b", 1, 2, [5.0, 5.0, 9.0]), ("z", 2, 0, [0.0, 0.0, 1.0]), ("p", 3, 0, [2.0, 0.0, 0.0]), ("p", 3, 1, [0.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "text_id string, batch int, pos int, vec array<double>")
    got = {r.text_id: r.embedding for r in providers.pooled(df, "batch", dim=2, most=2).collect()}
    half = math.sqrt(0.5)
    assert got == {"a": pytest.approx([0.6, 0.8]), "b": pytest.approx([half, half]), "z": [0.0, 0.0], "p": pytest.approx([half, half])}


def test_deep_queries_are_embedded_with_what_is_new(spark):
    asked = spark.createDataFrame([(1, "neden", "sebep"), (2, "neden", "neden"), (3, "neden", None)], "query_id int, query string, expansion string")
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.lit(1990).alias("year"), F.concat(F.lit("sebep "), "id").alias("text"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    seen = []

    def embed(df):
        seen.extend(r.query for r in df.orderBy("query_id").collect())
        return df.withColumn("qvec", F.array(F.lit(1.0), F.lit(0.0)))

    got = G.deep_retrieve(asked, chunks, embed, []).collect()
    assert seen == ["neden sebep", "neden", "neden"]
    assert {(r.query_id, r.combined, r.expanded) for r in got} == {(1, "neden sebep", "sebep"), (2, "neden", None), (3, "neden", None)}
    assert len(got) == 3 * G.REPORT_DEPTH[0] and {r.rank for r in got} == set(range(1, 41))
