"""Artifacts written once, results computed once, SQLite tables by tasks, and what reports and filters say."""

import hashlib
import re
import threading
import time
import unicodedata
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import filters as P
from lectern.sources import artifacts, cache, reports, sqlite


def _files(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file()}


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "document_source string, text string")


def test_artifacts_are_written_once(spark, tmp_path):
    root = f"{tmp_path}/a"
    named = artifacts.write(_docs(spark, ("x/Rapor 1.pdf", "bir"), ("y/Rapor 1.pdf", "bir"), ("y/çığ.v2.md", "iki"), (".gizli", None)), root)
    got = {r.name: r.content for r in artifacts.read(spark, root).collect()}
    assert sorted(n.split("__")[0] for n in got) == [".gizli", "Rapor 1", "çığ.v2"] and set(got.values()) == {"bir", "iki", ""}
    assert all(re.fullmatch(r".+__[0-9a-f]{8}\.md", n) for n in got)
    assert {Path(r.path).read_text() for r in named.collect()} == {"bir", "iki", ""}
    # A file that is there stays, whatever a later write would put there.
    place = next(p for p in Path(root).rglob("Rapor*"))
    place.write_text("kept")
    artifacts.write(_docs(spark, ("z/Rapor 1.pdf", "bir"), ("z/new.pdf", "üç")), root)
    assert place.read_text() == "kept" and artifacts.read(spark, root).count() == 4
    assert not [p for p in Path(root).iterdir() if p.name.startswith(artifacts.ASIDE)]


def test_contents_whose_hashes_begin_alike_are_all_written(spark, tmp_path):
    root, seen, two = f"{tmp_path}/a", {}, None
    for k in range(1_000_000):
        start = hashlib.sha256(str(k).encode()).hexdigest()[:8]
        if start in seen:
            two = (str(seen[start]), str(k))
            break
        seen[start] = k
    named = artifacts.write(_docs(spark, ("x/a.pdf", two[0]), ("x/a.pdf", two[1]), ("y/a.pdf", two[1])), root)
    artifacts.write(_docs(spark, ("x/a.pdf", two[1]), ("x/b.pdf", "else")), root)
    got = artifacts.read(spark, root).collect()
    assert sorted(r.content for r in got) == sorted([*two, "else"]) and len({r.name for r in got}) == 2
    assert {Path(r.path).read_text() for r in named.collect()} == set(two)


def test_a_failed_write_leaves_no_artifact(spark, tmp_path):
    root = f"{tmp_path}/a"
    artifacts.write(_docs(spark, ("old", "1")), root)
    before = _files(root)
    broken = spark.range(0, 40, numPartitions=4).select(F.concat(F.lit("d"), "id").alias("document_source"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken")).cast("string")).otherwise("t").alias("text"))
    with pytest.raises(Exception, match="broken"):
        artifacts.write(broken, root)
    assert _files(root) == before
    with pytest.raises(Exception, match="never overwritten"):
        spark.createDataFrame([("n", "c")], "name string, content string").write.format("artifacts").mode("overwrite").option("path", root).save()
    assert artifacts.write(_docs(spark).limit(0), root).count() == 0 and _files(root) == before


def test_what_a_lost_attempt_wrote_is_not_moved(tmp_path):
    sink = artifacts.ArtifactWriter(f"{tmp_path}/a")
    for attempt in ("1", "2"):
        folder = Path(sink.aside) / attempt / "00"
        folder.mkdir(parents=True)
        (folder / f"from{attempt}").write_text(attempt)
    sink.commit([artifacts.Written(f"{sink.aside}/2", ["00"]), None])
    assert _files(f"{tmp_path}/a") == {"00/from2": "2"}


def test_two_callers_compute_each_key_once(spark, tmp_path):
    root, both = f"{tmp_path}/c", threading.Barrier(2)

    def compute(df):
        time.sleep(0.3)
        return df.select("k", (F.col("k") * 2).alias("v"))

    def call(lo, hi, out):
        rows = spark.range(lo, hi).select(F.col("id").alias("k"))
        both.wait()
        out += [(r.k, r.v) for r in cache.cached(rows, "k", root, compute).collect()]

    one, two = [], []
    threads = [threading.Thread(target=call, args=a) for a in ((0, 300, one), (100, 400, two))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(one) == [(k, 2 * k) for k in range(300)] and sorted(two) == [(k, 2 * k) for k in range(100, 400)]
    stored = cache.results(spark, root).groupBy("k").count()
    assert stored.count() == 400 and stored.filter("count > 1").count() == 0
    assert not list((Path(root) / "claims").glob("*"))


def test_claims_are_given_back_and_old_ones_taken_over(spark, tmp_path):
    root = f"{tmp_path}/c"
    assert cache.claim(spark, f"{root}/claims/x") and not cache.claim(spark, f"{root}/claims/x")
    rows = spark.range(3).select(F.col("id").alias("k"))
    with pytest.raises(Exception, match="broken"):
        cache.cached(rows, "k", root, lambda df: df.withColumn("v", F.raise_error(F.lit("broken"))))
    assert [p.name for p in (Path(root) / "claims").iterdir()] == ["x"] and cache.results(spark, root) is None
    # A caller that died holds every bucket: its claims are waited for, then taken.
    for b in range(cache.BUCKETS):
        cache.claim(spark, f"{root}/claims/{b}")
    got = cache.cached(rows, "k", root, lambda df: df.withColumn("v", F.lit(1)), lease=0.5).collect()
    assert sorted(r.k for r in got) == [0, 1, 2]


def test_keys_without_results_are_not_asked_for_again(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.filter("k > 0").withColumn("v", F.lit(1))

    rows = spark.createDataFrame([(0,), (1,), (None,)], "k long")
    for _ in range(2):
        assert [r.k for r in cache.cached(rows, "k", f"{tmp_path}/c", compute).collect()] == [1]
    assert calls == [2]
    assert cache.cached(rows.limit(0), "k", f"{tmp_path}/d", compute).count() == 0


def test_other_settings_parse_nothing_again(spark, tmp_path):
    parsed, root = [], f"{tmp_path}/c"
    rows = spark.createDataFrame([("a", "x y z"), ("b", "p q"), ("a", "x y z")], "key string, text string")

    def parse(df):
        parsed.append(df.count())
        return df

    def cut(df, s):
        return df.select("key", "cut_key", F.explode(F.split("text", s["at"])).alias("piece"))

    first = cache.two_levels(rows, "key", root, parse, cut, {"at": " ", "n": 1})
    assert sorted((r.key, r.piece) for r in first.collect()) == sorted([("a", c) for c in "xyz"] * 2 + [("b", c) for c in "pq"])
    again = cache.two_levels(rows, "key", root, parse, cut, {"n": 1, "at": " "})
    other = cache.two_levels(rows, "key", root, parse, cut, {"n": 1, "at": "'\\\\[|]"})
    assert again.count() == 8 and {r.piece for r in other.collect()} == {"x y z", "p q"} and parsed == [2]
    assert cache.results(spark, f"{root}/cut").select("cut_key").distinct().count() == 4


def test_sqlite_tables_by_tasks(spark, tmp_path):
    rows = spark.range(0, 1000, numPartitions=3).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n'é"), "id")).alias("name of"), (F.col("id") / 4).alias("x"))
    assert sqlite.write_tables(rows, f"file://{tmp_path}/db", 'my "t"') == 1000
    assert sqlite.write_tables(rows, f"{tmp_path}/db", 'my "t"') == 1000  # the same files anew
    got = sqlite.sqlite_table(spark, f"file:{tmp_path}/db", 'my "t"', 90)
    assert got.count() == 1000 and got.exceptAll(rows).count() == 0 and len(list(Path(f"{tmp_path}/db").iterdir())) == 3
    with pytest.raises(ValueError, match="mounted"):
        sqlite.local("s3://b/x")
    assert sqlite.write_tables(rows.limit(0), f"{tmp_path}/none", "t") == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii") | st.sampled_from("ığüşÇß€"), max_size=12), min_size=1, max_size=40))
def test_queries_are_quoted_as_literals(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(reports.quoted(F.col("t")).alias("q"))
    assert [r.q for r in df.collect()] == [repr(t) for t in texts]


def _found(spark, text, words=(), patterns=(), on=True):
    return spark.createDataFrame([(text,)], "t string").select(P.banned_words(F.col("t"), list(words), list(patterns), on).alias("f")).first().f


@pytest.mark.parametrize(
    "text, words, patterns, want",
    [
        ("APTAL bir aptal, aptallık", ["aptal"], [], ["aptal"]),
        ("PİÇ herif", ["piç"], [], ["pic"]),
        ("en ağır küfürler, en ağır küfür", [], ["en ağır küfür(ler)?"], ["en agir kufurler"]),
        ("b2 a1 b3", ["b3"], ["b[0-9]", "(broken", "", "a."], ["b3", "b2", "a1"]),
        ("x", [], ["x", "x"], ["x"]),
        ("abc", [], ["z*"], [""]),
        ("", ["a"], ["z*"], []),
        (None, ["a"], ["z*"], []),
        ("a", [""], [], []),
    ],
)
def test_banned_words(spark, text, words, patterns, want, caplog):
    assert _found(spark, text, words, patterns) == want
    assert ("broken" in caplog.text) == ("(broken" in patterns)
    assert _found(spark, text, words, patterns, on=False) == []


def test_ascii_slugs(spark):
    texts = ["Özal döneminde GAZETE manşetleri neler?", "ılık ΣΩ ﬁne ½ x", "--", "", "İstanbul'da", "日本 a b", "Ǆ x y z w"]

    def plain(q):
        s = unicodedata.normalize("NFKD", q).encode("ascii", "ignore").decode()
        return "-".join(re.sub("[^a-zA-Z0-9]+", "-", s).strip("-").lower().split("-")[:3])

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.ascii_slug(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_ids_go_on_from_the_golden_set(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "prefix string, k int")
    old = spark.createDataFrame([("a-001",), ("a-007",), ("ax-1",), ("c-1",)], "id string")
    ids = lambda golden: sorted(r.id for r in reports.with_ids(new, golden, "prefix", "k").collect())
    assert ids(old) == ["a-004", "a-005", "b-001"] and ids(None) == ["a-001", "a-002", "b-001"]


def test_banned_words_with_repeats(spark):
    """Every banned token in order, where the last need not be new."""
    found = lambda **kw: spark.createDataFrame([("Und sur, und. Thing und",)], "t string").select(P.banned_words(F.col("t"), ["und", "SUR"], ["th[a-z]+g"], **kw).alias("f")).first().f
    assert found() == ["und", "sur", "thing"] and found(repeats=True) == ["und", "sur", "und", "und", "thing"]
