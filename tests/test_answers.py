"""Splitting, windows, JSON repair, pooling and agent steps against plain versions."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.operators import agents as G
from lectern.operators import pooling as V
from lectern.operators import splitting as S


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("aaaa bbbb cccc dddd", 10, 4, ["aaaa bbbb", "cccc dddd"]),
        ("aaaa bbbb cccc dddd", 10, 5, ["aaaa bbbb", "bbbb cccc", "cccc dddd"]),
        ("one\n\ntwo three four five", 9, 0, ["one", "two", "three", "four", "five"]),
        ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
        ("", 5, 0, []),
        (" \n ", 5, 0, []),
    ],
)
def test_recursive_split(text, size, overlap, want):
    assert S.recursive_split(text, size, overlap) == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=120), st.integers(3, 20), st.integers(0, 2))
def test_chunks_are_bounded_and_cover_the_words(text, size, overlap):
    chunks = S.recursive_split(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert all(text[a:b] == c for c, a, b in S.located(text, chunks))
    if not overlap:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_split_with_offsets(spark):
    rows = [(1, "ab cd ef ab cd", "x"), (None, "zz", "y"), (3, None, "z"), (4, "", "z"), (1, "ab cd ef ab cd", "x")]
    got = S.split_with_offsets(spark.createDataFrame(rows, "doc_id long, text string, chunk string"), 5, 0).collect()
    assert sorted((r.doc_id or 0, r.chunk, r.text, r.char_start, r.char_end) for r in got) == [
        (0, 0, "zz", 0, 2), (1, 0, "ab cd", 0, 5), (1, 0, "ab cd", 0, 5), (1, 1, "ef", 6, 8), (1, 1, "ef", 6, 8), (1, 2, "ab", 9, 11), (1, 2, "ab", 9, 11),
        (1, 3, "cd", 12, 14), (1, 3, "cd", 12, 14),
    ]


def _plain_windows(text, query, size, most):
    words = [w for w in query.lower().split() if len(w) > 2]
    hits = sorted(k for k in range(len(text)) for w in words if text.lower().startswith(w, k))
    if not hits:
        return text[:most]
    merged = []
    for k in sorted(set(hits)):
        a, b = max(0, k - size), min(len(text), k + size)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    parts, n = [], 0
    for a, b in merged:
        if n + b - a > most:
            if most - n > 3:
                parts.append(text[a : a + most - n])
            break
        parts.append(text[a:b])
        n += b - a
    return "\n[...]\n".join(parts)


def test_relevant_windows(spark):
    filler = " lorem ipsum dolor sit amet" * 3
    cases = [
        ("aaaa" + filler + " kale " + filler + filler + " kale kule", "kale kule"), ("aaaaa b", "aaa"), (filler, "absent words"), ("abc", "a b"), ("kale", "kale"), ("", "kale"),
        (filler + " kule" + filler + " kale" + filler, "kule ve kale"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, q string")
    for size, most in ((5, 40), (8, 27), (20, 30)):
        got = {r.k: r.w for r in df.select("k", S.relevant_windows(F.col("t"), F.col("q"), size, most, 3).alias("w")).collect()}
        assert got == {k: _plain_windows(t, q, size, most) for k, (t, q) in enumerate(cases)}
    empty = spark.createDataFrame([(None, None)], "t string, q string")
    assert empty.select(S.relevant_windows(F.col("t"), F.col("q")).alias("w")).first().w == ""


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('so: ```json\n{"a": [1, 2}\n``` end', {"a": [1, 2]}), ('text {"a": {"b": "}]"}} tail', {"a": {"b": "}]"}}), ('[{"x": 1]', [{"x": 1}]), ('{"k": "\\"]"}', {"k": '"]'}), ("[1, [2, 3]", [1, [2, 3]]),
    ],
)
def test_json_text(answer, want):
    assert json.loads(A.json_text(answer)) == want


def test_json_without_brackets_and_null(spark):
    got = spark.createDataFrame([("plain",), (None,), ("",)], "t string").select(A.extract_json("t").alias("j")).collect()
    assert [r.j for r in got] == ["plain", None, ""]


def test_commands(spark):
    want = {
        "/Rapor 1997 davası": ("rapor", "1997 davası", None, False), "/müfettiş": ("mufettis", None, None, True), "/kaynak 3": ("show_source", None, 2, False), "/kaynak": ("show_source", None, None, True),
        "": ("empty", None, None, False), "soru": ("normal_query", "soru", None, False),
    }
    rows = spark.createDataFrame([(k,) for k in want], "raw string").select("raw", A.command(F.col("raw")).alias("c")).collect()
    assert {r.raw: tuple(r.c) for r in rows} == want


def test_late_pool_falls_back_to_the_whole_text(spark):
    tokens = spark.createDataFrame([(1, 0, 0, [9.0, 0.0]), (1, 0, 4, [1.0, 0.0]), (1, 5, 9, [0.0, 1.0])], "doc_id long, t_start int, t_end int, vec array<double>")
    spans = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 2, 6), (1, 2, 4, 5), (2, 0, 0, 5)], "doc_id long, chunk int, char_start int, char_end int")
    got = {(r.doc_id, r.chunk): [round(x, 6) for x in r.vec] for r in V.late_pool(tokens, spans, 2, block=3).collect()}
    assert got == {(1, 0): [1.0, 0.0], (1, 1): [0.707107, 0.707107], (1, 2): [round(10 / 101**0.5, 6), round(1 / 101**0.5, 6)]}


def test_windowed_pool_gives_zeros_outside_all_windows(spark):
    tokens = spark.createDataFrame([(1, k, 2 * k, 2 * k + 2, [1.0, float(k)]) for k in range(6)], "doc_id long, pos int, t_start int, t_end int, vec array<double>")
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 90, 95)], "doc_id long, chunk int, char_start int, char_end int")
    got = {r.chunk: r.vec for r in V.late_pool_windowed(tokens, spans, 2, 14, 1).collect()}
    assert got == {0: [1.0, 0.0], 1: [0.0, 0.0]}


def test_allocation_and_drafts(spark):
    p = spark.createDataFrame([("q", "comparison", 1, "b"), ("q", "comparison", 0, "a"), ("r", None, 0, "a")], "query_id string, query_type string, position int, collection string")
    assert sorted(tuple(r) for r in G.allocate(p).collect()) == [("q", "a", 1, 3, 2, 12), ("q", "b", 2, 3, 2, 12), ("r", "a", 1, 2, 2, 10)]
    d = spark.createDataFrame([([" x", "", None, "y", "x "],)], "d array<string>")
    assert d.select(G.draft_texts(F.col("d")).alias("d")).first().d == ["x", "y"]


def test_resolved_errors(spark):
    w = spark.createDataFrame([("a_0",), ("a_9",), ("b_0",), ("c_0",), ("odd",), ("a_1",)], "chunk_id string")
    m = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "")], "document_id string, document_source string")
    c = spark.createDataFrame([("a", 0, 0, 5), ("a", 1, None, None)], "document_id string, chunk int, char_start int, char_end int")
    got = {r.chunk_id: (r.error, r.char_end) for r in G.resolve_spans(w, m, c).collect()}
    assert got == {"a_0": (None, 5), "a_9": ("index", None), "b_0": ("cache", None), "c_0": ("manifest", None), "odd": ("format", None), "a_1": ("span", None)}
