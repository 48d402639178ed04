"""Hits that several steps read are ranked once; cells are laid out by what they deal and leave."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import nearest
from lectern.operators import retrieval as R
from lectern.plans import search as S

SMALL = "/root/testdata/sf0.001"


def _cells(df):
    """How often the plan brings blocks of queries and chunks together."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups")


def test_both_reports_read_the_same_hits(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(S, "_hits", lambda *a, f=S._hits: calls.append(1) or f(*a))
    got = S.within_budget(spark, SMALL)
    assert len(calls) == 1 and _cells(got) == 0
    assert {(r.truncated, r.n) for r in got.groupBy("truncated").agg(F.count("*").alias("n")).collect()} == {(False, 125), (True, 125)}


def test_orchestration_ranks_once(spark):
    assert _cells(S.orchestrated(spark, SMALL)) == 0
    assert _cells(S.session_orchestrate(spark, SMALL)) == 0


def test_expansion_and_merging_rank_once(spark):
    assert _cells(S.expansion(spark, SMALL)) == 0
    assert _cells(S.merge_results(spark, SMALL)) == 0


def test_retrieval_ranks_without_texts_and_joins_them_to_what_it_found(spark, monkeypatch):
    """Texts are joined and changed for the rows found alone, which are written before."""
    sides = []
    monkeypatch.setattr(nearest, "pairs", lambda q, c, *a, f=nearest.pairs: sides.append(c) or f(q, c, *a))
    got = S.retrieve(spark, SMALL)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert _cells(got) == 0 and len(sides) == 1
    assert "text" not in sides[0].columns and "[0-9]" not in sides[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.index("[0-9]") < plan.index("Join Inner") and "embedding" not in plan


def test_retrieval_of_texts_apart_equals_texts_beside_vectors(spark):
    chunks = spark.range(30).select(F.col("id").alias("chunk_id"), (F.lit(1990) + F.col("id") % 3).cast("int").alias("year"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    texts = spark.range(60).select(F.col("id").alias("chunk_id"), F.concat(F.lit("çay 7 "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "a").alias("source"))
    asked = spark.createDataFrame([(1, "çay 1991", [1.0, 0.0]), (2, "çay", [0.0, 1.0])], "query_id int, query string, qvec array<double>")
    masked = F.regexp_replace("text", "7", "#")
    rows = lambda *a, **b: sorted(tuple(r) for r in R.retrieve(asked, *a, 4, 9, [("Kaynak", "source")], -F.col("distance"), **b).collect())
    apart = rows(chunks, texts=texts, text=masked)
    assert apart == rows(chunks.join(texts.withColumn("text", masked), "chunk_id")) and len(apart) == 8
    assert all("çay # " in r[4] for r in apart) and {r[1] % 3 for r in apart if r[0] == 1} == {1}


def test_layout_counts_the_rows_that_cells_leave():
    """Many neighbours: more blocks of queries instead of many blocks of chunks that each leave them all."""
    across, down = nearest.layout(5_129, 102_564, 150, R.QUERY_BLOCK, 16)
    assert across * down >= 16 and across * 102_564 + down * 5_129 * 150 < 2_500_000
    for n_queries, n, k in ((0, 0, 5), (1, 10, 5), (100, 2_000, 20), (30_770, 615_384, 150), (5, 10**6, 20), (10**6, 5, 20)):
        across, down = nearest.layout(n_queries, n, k, R.QUERY_BLOCK, 16)
        assert across * R.QUERY_BLOCK >= n_queries and down * nearest.CHUNK_BLOCK >= n and across >= 1 <= down


def test_turkish_case_makes_no_string_of_each_character(spark):
    text = "İIiı ŞĞ ÇÖÜ I'İ! 日本 É"
    df = spark.createDataFrame([(text,), ("",), (None,)], "x string")
    lower, upper = T.lower_tr(F.col("x")), T.upper_tr(F.col("x"))
    assert "translate" not in df.select(lower, upper)._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.select(lower, upper).collect()] == [("iıiı şğ çöü ı'i! 日本 é", "İIİI ŞĞ ÇÖÜ I'İ! 日本 É"), ("", ""), (None, None)]
