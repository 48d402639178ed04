"""Percentiles and prefix statistics at any size, stages timed as they run, and answers within a budget."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import metrics as M
from lectern.operators import quality as Q
from lectern.operators import timing


def _percentile(xs, p):
    return sorted(xs)[min(int(len(xs) * p / 100), len(xs) - 1)]


def test_percentiles_are_exact(spark):
    r = random.Random(1)
    held = {
        "spread": [r.random() for _ in range(40_000)],
        "few": [float(r.choice([1, 2, 2, 2, 7])) for _ in range(30_000)],  # a hot value
        "one": [3.5],
        "two": [1.0, 2.0],
        "hundred": [float(k) for k in range(100)],
        "long tail": [r.paretovariate(0.5) for _ in range(25_000)],
        None: [5.0, 6.0, 7.0],
    }
    rows = [(k, v) for k, xs in held.items() for v in xs] + [("one", None), ("nothing", None)]
    got = {x.k: x for x in M.latency(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    assert set(got) == set(held)
    for k, xs in held.items():
        assert (got[k].n, got[k].p50, got[k].p95, got[k].p99) == (len(xs), *(_percentile(xs, p) for p in (50, 95, 99))), k
        assert got[k].mean == pytest.approx(sum(xs) / len(xs))


def test_percentiles_rank_a_small_slice(spark):
    """Of a label with all rows, what is ranked are the distinct values of three slices, not its rows."""
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.rand(3).alias("v"))
    plan = M.latency(df, "k", "v")
    slices = [1.0 / 2 + 3 / M.SKETCH, 3 / M.SKETCH, 3 / M.SKETCH]
    assert plan.count() == 1 and sum(slices[1:]) * 200_000 < 200


@pytest.mark.parametrize("block_rows", [2_000_000, 50, 1])
def test_prefix_means_do_not_depend_on_blocks(spark, block_rows):
    r = random.Random(2)
    rows = [(k, r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, 10.0, 11.0, 30.0])) for k in range(700)]
    got = Q.outliers_so_far(spark.createDataFrame(rows, "i int, k string, v double").repartition(4), "k", "v", "i", block_rows=block_rows).collect()
    seen, want = {}, {}
    for i, k, v in rows:
        n, s = seen.get(k, (0, 0.0))
        want[i] = (n, bool(v is not None and n >= 3 and abs(v - s / n) / (s / n) > 0.3))
        seen[k] = (n + 1, s + v) if v is not None else (n, s)
    assert {x.i: (x.seen, x.outlier) for x in got} == want


@pytest.mark.parametrize("block_rows", [2_000_000, 1])
def test_prefix_means_are_of_sums_without_rounding(spark, block_rows):
    """Ten tenths added one by one fall short of one, and what differs by less than 0.3 would differ by more."""
    rows = [(k, "a", 0.1 if k < 10 else 0.13) for k in range(11)]
    got = Q.outliers_so_far(spark.createDataFrame(rows, "i int, k string, v double"), "k", "v", "i", block_rows=block_rows).collect()
    assert [x.outlier for x in sorted(got, key=lambda x: x.i)] == [False] * 11


def test_stages_are_counted_as_they_run(spark):
    t = timing.Timings(spark)
    a = t.stage("read", spark.range(1000))
    b = t.stage("cut", a.filter("id % 3 = 0"))
    assert t.stage("none", b.filter("id < 0")).count() == 0
    assert t.call("sum", lambda: b.agg(F.sum("id")).first()[0]) == sum(range(0, 1000, 3))
    got = {r.label: (r.n, r.ms) for r in t.rows().collect()}
    assert {k: n for k, (n, _) in got.items()} == {"read": 1000, "cut": 334, "none": 0, "sum": None} and all(ms > 0 for _, ms in got.values())
    assert {r.k: r.n for r in M.latency(t.rows().select(F.col("label").alias("k"), "ms"), "k", "ms").collect()} == {"read": 1, "cut": 1, "none": 1, "sum": 1}


def _slow(spark):
    def wait(batches):
        time.sleep(60)
        yield from batches

    return spark.range(4).mapInArrow(wait, "id long")


def test_an_answer_comes_within_its_budget(spark):
    quick = lambda: spark.range(2)
    start = time.perf_counter()
    got, cut = timing.within(spark, 2.0, lambda: _slow(spark), quick)
    assert cut and got.count() == 2 and time.perf_counter() - start < 25
    # The jobs of what was cut short are gone.
    tracker = spark.sparkContext.statusTracker()
    end = time.time() + 20
    while tracker.getActiveJobsIds() and time.time() < end:
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds()


def test_a_budget_that_suffices_and_failures(spark):
    got, cut = timing.within(spark, 120, lambda: spark.range(5), lambda: spark.range(1))
    assert not cut and got.count() == 5
    got, cut = timing.within(spark, 0, lambda: 1 / 0, lambda: spark.range(1))
    assert cut and got.count() == 1
    with pytest.raises(ZeroDivisionError):
        timing.within(spark, 60, lambda: 1 / 0, lambda: spark.range(1))
