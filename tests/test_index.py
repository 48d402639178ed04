"""The inverted-file index against a comparison with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import index as X
from lectern.sources import scratch

SCHEMA = "chunk_id string, embedding array<float>, label int"


def _brute(rows, queries, k, keep=lambda r: True):
    out = {}
    for q, v in queries:
        scored = []
        for i, x, label in rows:
            if x is not None and keep((i, label)):
                x, w = np.array(x, float), np.array(v, float)
                scored.append((round(1 - x @ w / (np.linalg.norm(x) * np.linalg.norm(w) + 1e-9), 9), i))
        out[q] = [(i, d) for d, i in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    made = [(f"c{i:04d}", (centres[i % 12] + 0.15 * rng.normal(size=16)).astype("f4").tolist(), i % 5) for i in range(900)]
    # A third of all rows is one vector; some have no direction, some hardly a length.
    made += [(f"h{i:04d}", made[0][1], i % 5) for i in range(450)]
    made += [("z0", [0.0] * 16, 1), ("z1", [0.0] * 16, 2), ("n0", None, 1), ("s0", [1e-6] * 16, 3)]
    return made


@pytest.fixture(scope="module")
def index(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    made = X.build(df.filter("label < 3"), scratch.place(spark, "index"), cells=20)
    return X.add(made, df.filter("label >= 3"))


def _got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.distance, 9)))
    return out


def test_search_is_that_over_all_rows(spark, rows, index):
    queries = [(k, rows[i][1]) for k, i in enumerate([0, 3, 77, 450, 901])] + [(9, [1.0] * 16), (10, [-x for x in rows[5][1]])]
    qdf = spark.createDataFrame(queries, "query_id int, qvec array<float>")
    for k in (1, 7, 500):
        work = []
        got = _got(X.search(index, qdf, k, work=work))
        want = _brute(rows, queries, k)
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
        assert all(abs(a[1] - b[1]) < 1e-8 for q in want for a, b in zip(got[q], want[q], strict=True))
        compared, all_pairs = work[0]
        assert all_pairs == len(rows) * len(queries)
        if k == 7:
            assert compared < 0.6 * all_pairs  # one cell alone holds a third


def test_conditions_skips_and_queries_without_a_direction(spark, rows, index):
    queries = [(k, rows[i][1], rows[i][0]) for k, i in enumerate([0, 3, 901])] + [(7, None, None), (8, [0.0] * 16, None)]
    qdf = spark.createDataFrame(queries, "query_id int, qvec array<float>, own string")
    got = _got(X.search(index, qdf, 9, F.col("label") == 2, skip="own"))
    for q, v, own in queries:
        if v is None:
            assert q not in got
        else:
            assert [i for i, _ in got[q]] == [i for i, _ in _brute(rows, [(q, v)], 9, lambda r, own=own: r[1] == 2 and r[0] != own)[q]]
    labelled = X.search(index, qdf, 3, also=("label",)).filter("query_id = 1").collect()
    assert {r.label for r in labelled} <= set(range(5)) and len(labelled) == 3


def test_looking_at_few_cells_keeps_most(spark, rows, index):
    queries = [(k, rows[k * 30][1]) for k in range(30)]
    qdf = spark.createDataFrame(queries, "query_id int, qvec array<float>")
    want, work = _brute(rows, queries, 10), []
    got = _got(X.search(index, qdf, 10, exact=False, probe=3, work=work))
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9 and work[0][0] < 0.5 * work[0][1]


def test_queries_come_in_blocks_and_an_empty_index_gives_none(spark, rows, index, monkeypatch):
    queries = [(k, rows[k * 11][1]) for k in range(20)]
    qdf = spark.createDataFrame(queries, "query_id int, qvec array<float>")
    whole = _got(X.search(index, qdf, 4))
    monkeypatch.setattr(X, "QUERY_BLOCK", 6)
    work = []
    assert _got(X.search(index, qdf, 4, work=work)) == whole and len(work) > 1
    nothing = X.build(spark.createDataFrame([], SCHEMA), scratch.place(spark, "index"))
    assert X.search(nothing, qdf, 4).count() == 0
    assert X.search(index, qdf.limit(0), 4).count() == 0


def test_centroids_come_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(X, "SAMPLE", 50)
    df = spark.range(2000).select(F.col("id").cast("string").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.lit(1).alias("label"))
    assert len(X.fit(df, 40)) <= 40
    assert (X.fit(df, 8) == X.fit(df.repartition(3), 8)).all()


def test_equal_rows_do_not_share_a_task(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"))
    root = scratch.place(spark, "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        X.build(df, root)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spread = [r[0] for r in spark.read.parquet(f"{root}/rows").groupBy(F.input_file_name()).count().select("count").collect()]
    assert max(spread) < 2500
