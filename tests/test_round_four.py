"""Findings of the fourth round."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from lectern.operators import quality as Q
from tests import oracle


def _in_nodes(values, fan):
    """The sum of all values, in whole nodes from the highest level down, then rows."""
    levels = [values]
    while len(levels[-1]) >= fan:
        below, sums = levels[-1], []
        for k in range(0, len(below) - fan + 1, fan):
            s = 0.0
            for x in below[k : k + fan]:
                s += x or 0.0
            sums.append(s)
        levels.append(sums)
    total = 0.0
    for k in reversed(range(len(levels))):
        end = len(values) // fan**k
        for x in levels[k][end // fan * fan : end]:
            total += x or 0.0
    return total


def test_prefix_sums_are_added_in_nodes(spark):
    """To the last bit, whatever the blocks, with null keys and values; none of 3 rows is like one by one throughout."""
    r = random.Random(4)
    rows = [(k, r.choice(["hot", "hot", "a", None]), r.choice([None, round(r.random() * 90, 2), 0.1])) for k in range(400)] + [(400, "b", None)]
    kept = [(*row, sum(k == row[1] for _, k, _ in rows[: row[0]])) for row in rows]
    got = Q._in_nodes(spark.createDataFrame(kept, "i int, k string, v double, _at long").repartition(5), "k", "v", 3)
    assert got.columns == ["i", "k", "v", "_at", "_sum"]
    assert {x.i: x._sum for x in got.collect()} == {i: _in_nodes([v for j, k2, v in rows[:i] if k2 == k], 3) for i, k, _ in rows}
    plain = {i: sum((v or 0.0) for _, k2, v in rows[:i] if k2 == k) for i, k, _ in rows}
    assert plain != {x.i: x._sum for x in got.collect()}


def test_outliers_so_far_at_exactly_the_limit(spark, tmp_path):
    """Where rounding decides between 0.3 and more, and where the mean is 0, rows equal the SQL's."""
    r = random.Random(5)
    rows = [(k, 1, 0.1 if k < 10 else 0.13) for k in range(11)] + [(20 + k, 2, v) for k, v in enumerate([0.0, 0.0, 0.0, 0.0, 2.0, None])]
    for user in range(3, 200):
        held = [r.randint(1, 60) / 10 for _ in range(10)]
        rows += [(user * 100 + k, user, x) for k, x in enumerate([*held, round(sum(held) / 10 * r.choice([0.7, 1.3]), 3)])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    name = "m12_outliers_so_far"
    assert oracle.compare(spark, con, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], str(tmp_path)) == ""
    exact = Q.outliers_so_far(df.filter("user_id > 2"), "user_id", "value", "event_id")
    assert exact.filter(F.col("outlier")).count() != __spark_entry__.queries()[name](spark, str(tmp_path)).filter("outlier and event_id >= 300").count()


def test_names_of_a_large_vocabulary_read_texts_once(spark, monkeypatch):
    """However many times a vocabulary exceeds one automaton, texts are not passed on block by block."""
    from lectern.operators import names as N
    from lectern.sources import scratch

    placed = []
    place = scratch.place
    monkeypatch.setattr(scratch, "place", lambda s, tag: placed.append(tag) or place(s, tag))
    words = [f"n{k}" for k in range(60)]
    texts = spark.createDataFrame([(k, " ".join(words[k:] + ["zz"])) for k in range(30)] + [(30, None), (31, "")], "i int, text string")
    got = {}
    for size in (60, 1_000_000):
        placed.clear()
        got[size] = sorted(N.find_names(texts, spark.createDataFrame([(" ".join(words[k : k + 1 + k % 2]), "author") for k in range(59)], "name string, kind string"), block_bytes=size).collect(), key=lambda r: r.i)
        assert len(placed) <= 3
    assert got[60] == got[1_000_000] and len(got[60][0].names) > 29


def test_metadata_maps_are_computed_once(spark):
    """Naming a map in several places of an expression must not multiply what is computed for a row."""
    name = "f9_f11_metadata"
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_concat(") <= 6 and plan.count("o_orderpriority") < 10


def test_commit_lists_what_is_in_place_once(tmp_path, monkeypatch):
    """Not once for each task, which grew as the square of the files; of two tasks' files of one name the first stays."""
    from pathlib import Path

    from lectern.sources import artifacts

    sink = artifacts.ArtifactWriter(f"{tmp_path}/a")
    for task in range(5):
        for folder in ("00", "01"):
            for name in (f"f{task}.md", "same.md"):
                at = Path(f"{sink.aside}/{task}/{folder}/inner{name[1]}/{name}")
                at.parent.mkdir(parents=True)
                at.write_text(str(task))
    listed = []
    files = artifacts._files
    monkeypatch.setattr(artifacts, "_files", lambda store, folder: listed.append(folder) or files(store, folder))
    sink.commit([artifacts.Written(f"{sink.aside}/{task}", ["00", "01"]) for task in range(5)] + [None])
    assert sorted(f for f in listed if artifacts.ASIDE not in f) == [f"{tmp_path}/a/00", f"{tmp_path}/a/01"]
    assert sorted(p.name for p in Path(f"{tmp_path}/a/01").rglob("*.md")) == [*(f"f{k}.md" for k in range(5)), "same.md"]
    assert Path(f"{tmp_path}/a/00/innera/same.md").read_text() == "0" and not Path(sink.aside).exists()
