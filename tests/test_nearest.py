"""The nearest rows of blocks against a plain ranking of all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluation as E
from lectern.operators import nearest
from lectern.operators import retrieval as R

NAN = float("nan")


def _distance(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
    return 1 - dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)) + 1e-9)


def _key(d, chunk):
    return (d is None, d is not None and math.isnan(d), 0 if d is None or math.isnan(d) else round(d, 9), chunk)


def _plain(queries, chunks, k, grouped):
    out = []
    for q, qvec, own, years in queries:
        groups = {}
        for c, vec, label, year in chunks:
            if c != own and (not years or year in years):
                groups.setdefault(label if grouped else 0, []).append((_key(_distance(qvec, vec), c), label))
        for rows in groups.values():
            out += [(q, key[3], label, n + 1) for n, (key, label) in enumerate(sorted(rows, key=lambda r: r[0])[:k])]
    return sorted(out, key=str)


def _rows(seed):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(7)]
    odd = [None, [], [1.0, None, 2.0, 3.0], [0.0] * 4, [1e-7, 0.0, 2e-7, 0.0], [1e200, 1e200, 0.0, 1.0], [NAN, 1.0, 1.0, 1.0], [1.0, 2.0], [3.0, 1.0]]
    vec = lambda: rnd.choice(base) if rnd.random() < 0.5 else rnd.choice(odd) if rnd.random() < 0.3 else [rnd.gauss(0, 1) for _ in range(4)]
    chunks = [(c, vec(), rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None])) for c in range(150)]
    queries = [(q, vec(), rnd.choice([q, q + 1, 999]), rnd.choice([[], [1], [2, 3], [7]])) for q in range(40)]
    return queries, chunks


@pytest.mark.parametrize(("grouped", "k", "tile"), [(False, 5, (1024, 4096)), (True, 3, (7, 11)), (False, 200, (16, 64)), (True, 1, (16, 9))])
def test_top_k_equals_all_pairs(spark, monkeypatch, grouped, k, tile):
    """Copies, ties, vectors that are null, of other lengths, of zeros, tiny, huge or without a number; blocks of every size."""
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "LEAST_BLOCK", 40)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    monkeypatch.setattr(R, "QUERY_BLOCK", 15)
    queries, chunks = _rows(k)
    q = spark.createDataFrame(queries, "query_id long, qvec array<double>, own long, years array<int>")
    c = spark.createDataFrame(chunks, "chunk_id long, embedding array<double>, label string, year int")
    got = R.top_k(q, c, k, by=("label",) if grouped else (), skip="own", among=("years", "year"))
    assert sorted(((r.query_id, r.chunk_id, r.label, r["rank"]) for r in got.collect()), key=str) == _plain(queries, chunks, k, grouped)


def test_no_pair_beyond_the_nearest_is_shuffled(spark):
    """What the cells leave is bounded by the number of neighbours, also if all vectors are equal."""
    q = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("qvec"))
    c = spark.range(6_000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    left = nearest.pairs(q, c, 3, 8_192, skip="query_id")
    cells = -(-6_000 // nearest.LEAST_BLOCK)
    assert left.count() <= 50 * 3 * cells
    got = R.top_k(q, c, 3, skip="query_id").filter("query_id = 1").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 2, 3]


def test_empty_sides(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, qvec array<double>")
    c = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    assert R.top_k(q, c, 3).count() == 0 and R.top_k(q.limit(0), c, 3).count() == 0


def test_counts_before_the_first_relevant(spark, monkeypatch):
    """Copies of the relevant chunk stand before it by their ids alone; blocks do not matter."""
    rows = [(m, k, [1.0, float(k // 4)]) for m in (1, 2) for k in range(12)]
    chunks = spark.createDataFrame(rows, "max_tokens int, chunk long, vec array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, qvec array<double>")
    relevant = spark.createDataFrame([(7, 6)], "query_id long, chunk long")
    monkeypatch.setattr(nearest, "LEAST_BLOCK", 5)
    monkeypatch.setattr(nearest, "TILE", (4, 3))
    got = E.window_bench(queries, chunks, relevant).orderBy("max_tokens").collect()
    assert [r.mrr for r in got] == [pytest.approx(1 / 3)] * 2


@pytest.mark.parametrize(("alike", "tile"), [(1, (16, 64)), (5, (7, 11)), (12, (1024, 4096)), (1000, (16, 9))])
def test_queries_that_see_the_same_values_share_tiles(spark, monkeypatch, alike, tile):
    """Tiles of queries that see the same, tiles that hide what each may not see, and both beside each other."""
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "ALIKE", alike)
    queries, chunks = _rows(11)
    queries += [(q, v, own, years) for q, (_, v, own, years) in enumerate(queries, 1000) if years in ([], [1])]
    q = spark.createDataFrame(queries, "query_id long, qvec array<double>, own long, years array<int>")
    c = spark.createDataFrame(chunks, "chunk_id long, embedding array<double>, label string, year int")
    got = R.top_k(q, c, 6, skip="own", among=("years", "year"))
    assert sorted(((r.query_id, r.chunk_id, r.label, r["rank"]) for r in got.collect()), key=str) == _plain(queries, chunks, 6, False)


def test_pairs_that_no_query_may_see_are_not_multiplied(monkeypatch):
    """Of ten years each query sees one: a tenth of all pairs is compared."""
    n, compared = 2_000, []
    monkeypatch.setattr(nearest, "_where", lambda found, f=nearest._where: compared.append(found.size) or f(found))
    vectors = pa.array(np.random.default_rng(3).normal(size=(n, 4)).tolist(), pa.list_(pa.float64()))
    chunks = pa.table({"chunk_id": range(n), "year": [k % 10 for k in range(n)], "embedding": vectors})
    queries = pa.table({"query_id": range(n), "years": [[k // 7 % 10] for k in range(n)], "qvec": vectors})
    got = nearest._cell(queries, chunks, 3, [], "query_id", ("years", "year"), None)
    assert sum(compared) <= n * n // 10
    assert got.num_rows == 3 * n and all(q // 7 % 10 == y for q, y in zip(got["query_id"].to_pylist(), got["year"].to_pylist(), strict=True))


def test_true_places_of_a_table():
    rnd = np.random.default_rng(5)
    for shape in ((0, 3), (1, 1), (3, 5), (4, 16), (7, 33)):
        for share in (0, 0.1, 1):
            found = rnd.random(shape) < share
            for table in (found, found[:, ::2]):
                assert [x.tolist() for x in nearest._where(table)] == [x.tolist() for x in np.nonzero(table)]
