"""Names in questions against looking for each name in each text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import folded
from lectern.operators import names as N


def _plain(text, vocabulary):
    """All whole-word places of each name, longest first, by trying every name at every word."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", folded(text))]
    shown = [folded(text)[s:e] for s, e in words]
    found = []
    least = {}
    for name, kind in vocabulary:
        key = tuple(re.findall(r"\w+", folded(name)))
        if key:
            least[key, kind] = min(name, least.get((key, kind), name))
    for (key, kind), name in least.items():
        for k in range(len(words) - len(key) + 1):
            if tuple(shown[k : k + len(key)]) == key:
                found.append({"kind": kind, "name": name, "start": words[k][0], "end": words[k + len(key) - 1][1]})
    return N.longest_first(found)


@pytest.mark.parametrize("block_bytes", [N.BLOCK_BYTES, 120])
def test_names_are_those_of_trying_each(spark, block_bytes):
    r = random.Random(1)
    pool = ["Deniz", "BAYKAL", "Işık", "ışık", "can", "Can", "İnönü", "a", "b", "c1"]
    vocabulary = [(" ".join(r.choice(pool) for _ in range(r.randint(1, 3))), r.choice(["author", "source"])) for _ in range(40)] + [("--", "author"), ("", "source")]
    texts = [r.choice(["", " "]) + r.choice([" ", ", ", "-", "  "]).join(r.choice([*pool, "x", "ne", "İNÖNÜ'nün"]) for _ in range(r.randint(0, 12))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "i int, text string, rest string").repartition(3)
    got = N.find_names(df, spark.createDataFrame(vocabulary, "name string, kind string"), block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for row in got:
        want = _plain(texts[row.i] or "", vocabulary)
        assert [m.asDict() for m in row.names] == want, texts[row.i]
        if row.text is None:
            assert row.rest is None
        else:
            chars = list(row.text)
            for m in want:
                chars[m["start"] : m["end"]] = " " * (m["end"] - m["start"])
            assert row.rest == " ".join("".join(chars).split())


def test_criteria_of_a_question(spark):
    vocabulary = [("Deniz Baykal", "author"), ("Baykal", "author"), ("Cumhuriyet", "source"), ("Milliyet", "source")]
    df = spark.createDataFrame([("1996'da DENİZ BAYKAL Milliyet'te ne dedi?",), ("Baykalcı olmak",)], "text string")
    got = N.find_names(df, spark.createDataFrame(vocabulary, "name string, kind string")).select("rest", N.criterion("author").alias("a"), N.criterion("source").alias("s")).collect()
    assert [tuple(r) for r in got] == [("1996'da 'te ne dedi?", "Deniz Baykal", "Milliyet"), ("Baykalcı olmak", None, None)]
    none = N.find_names(df, spark.createDataFrame([], "name string, kind string"))
    assert none.filter(F.size("names") > 0).count() == 0


def test_a_worker_holds_one_block_at_a_time(spark):
    """Whatever the number of blocks, one function over Arrow batches is left in the plan, and all names are found."""
    words = [f"name{k}" for k in range(40)]
    texts = spark.createDataFrame([(" ".join(words),), (None,)], "text string")
    got = N.find_names(texts, spark.createDataFrame([(w, "author") for w in words], "name string, kind string"), block_bytes=100)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(len(r.names or ()) for r in got.collect()) == [0, 40]
