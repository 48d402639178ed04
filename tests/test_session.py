"""A session's collections by DataFrame and by SQL."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.filters import Criteria
from lectern.session import Session

VECTORS = {"a1": [1.0, 0.0], "a2": [0.8, 0.6], "b1": [0.0, 1.0], "c1": [0.6, 0.8]}


def _chunks(spark, *ids):
    rows = [(i, f"d{i[0]}", f"text of {i}", VECTORS.get(i), 1990 + int(i[1])) for i in ids]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, text string, embedding array<double>, year int")


@pytest.fixture
def at(spark):
    s = Session(spark, ["first", "second"])
    s.register("first", _chunks(spark, "a1", "a2", "x9"), "tutanak")
    s.register("second", _chunks(spark, "b1").drop("year"))
    s.register("third", _chunks(spark, "c1"))
    return s


def test_sql_sees_what_is_granted(spark, at):
    assert at.names() == ["first", "second"]
    assert sorted(tuple(r) for r in spark.table("session_collections").collect()) == [("first", "tutanak", 1.0), ("second", "custom", 1.0)]
    got = spark.sql("SELECT chunk_id, collection, rank FROM retrieve(array(0.6D, 0.8D), 5) ORDER BY rank").collect()
    assert [tuple(r) for r in got] == [("a2", "first", 1), ("b1", "second", 2), ("a1", "first", 3)]
    # Another collection under the name, and one more, are seen at once.
    at.register("first", _chunks(spark, "c1"))
    at.granted.append("third")
    at.register("third", _chunks(spark, "a1"))
    got = spark.sql("SELECT collection, chunk_id FROM retrieve(array(0.6D, 0.8D), 9) ORDER BY rank").collect()
    assert [tuple(r) for r in got] == [("first", "c1"), ("second", "b1"), ("third", "a1")]


def test_names_are_checked(spark, at):
    with pytest.raises(KeyError, match="no collection none"):
        at.chunks(["none"])
    with pytest.raises(PermissionError, match="third"):
        at.collection("third")
    with pytest.raises(ValueError, match="lacks embedding"):
        at.register("bad", spark.createDataFrame([("a", "b", "c")], "chunk_id string, document_id string, text string"))
    for name in ("a b", "session_chunks", "x; drop"):
        with pytest.raises(ValueError, match="no name"):
            at.register(name, _chunks(spark, "a1"))
    nothing = Session(spark, [])
    assert nothing.chunks().count() == 0 and spark.sql("SELECT * FROM retrieve(array(1D), 3)").count() == 0


def test_retrieval_relaxes_what_no_chunk_meets(spark, at):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<double>")
    ids = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert ids(at.retrieve(q, 5)) == ["a1", "a2", "b1"]
    assert ids(at.retrieve(q, 5, ["second"])) == ["b1"]
    assert ids(at.retrieve(q, 5, criteria=Criteria(year=1992), names=["first"])) == ["a2"]
    assert ids(at.retrieve(q, 5, criteria=Criteria(year=1066), names=["first"])) == ["a1", "a2"]
    assert [r.chunk_id for r in at.lookup(["a2", "c1"]).collect()] == ["a2"]
    context = at.context(q, 2).first()
    assert context.n_chunks == 2 and context.context == "[first]\ntext of a1\n\n---\n\n[first]\ntext of a2"


def test_plans_of_other_collections_are_refused(spark, at):
    q = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 0.0])], "query_id string, qvec array<double>")
    plans = spark.createDataFrame([("p", "first", 1, 2, 0), ("q", "third", 1, 2, 0)], "query_id string, collection string, priority int, retrieval_budget int, reserve_budget int")
    assert {r.query_id: r.granted for r in at.plans(plans).collect()} == {"p": True, "q": False}
    numbered = Session(spark)
    numbered.register("first", _chunks(spark, "a1", "a2").withColumn("chunk_id", F.monotonically_increasing_id()))
    numbered.granted = ["first"]
    got = {r.query_id: r.action for r in numbered.orchestrate(q, plans).collect()}
    assert got["q"] == "refuse" and got["p"] != "refuse"


def test_answers_are_the_functions_rows(spark):
    """A table of questions gets the rows that the function gives each; equal vectors go by collection, then by id."""
    at = Session(spark, ["alpha", "beta"])
    rows = [(k, str(k), f"t{k}", [1.0, float(k // 3)]) for k in range(12)]
    df = spark.createDataFrame(rows, "chunk_id long, document_id string, text string, embedding array<double>")
    at.register("beta", df)
    at.register("alpha", df.filter("chunk_id > 4"))
    at.register("gamma", df)
    questions = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(4)], "query_id long, qvec array<double>")
    questions.createOrReplaceTempView("asked")
    at.answer(questions, 5)
    columns = "query_id, r.collection, r.chunk_id, r.document_id, round(r.distance, 9), r.rank"
    want = spark.sql(f"SELECT {columns} FROM asked, LATERAL retrieve(asked.qvec, 5) AS r").collect()
    got = spark.sql(f"SELECT {columns} FROM session_answers AS r").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 20
    plan = spark.table("session_answers")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
