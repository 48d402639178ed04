"""Interval joins against all pairs, and their size where all pairs would be too many."""

import random

from pyspark.sql import functions as F

from lectern.operators import chunking as C
from lectern.operators import intervals as I
from lectern.operators import metrics as M


def _overlap(spark, left, right):
    a = spark.createDataFrame(left, "doc string, i int, a0 int, a1 int")
    b = spark.createDataFrame(right, "doc string, j int, b0 int, b1 int")
    return I.overlapping(a, b, ["doc"], ("a0", "a1"), ("b0", "b1"))


def test_blocks_are_a_disjoint_cover(spark):
    pairs = [(s, e) for s in range(-9, 20) for e in range(s - 1, 40)] + [(5, 5 + 2**40), (2**40 - 1, 2**40 + 1)]
    got = spark.createDataFrame(pairs, "s long, e long").select("s", "e", I.blocks(F.col("s"), F.col("e")).alias("b")).collect()
    for r in got:
        if r.s >= r.e:
            assert r.b is None
            continue
        parts = sorted((b["at"] << b["level"], (b["at"] + 1) << b["level"]) for b in r.b)
        assert parts[0][0] == r.s and parts[-1][1] == r.e and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (r.e - r.s).bit_length()


def test_pairs_are_those_of_comparing_all(spark):
    r = random.Random(3)

    def spans(n):
        out = []
        for k in range(n):
            s = r.randrange(60)
            out.append((r.choice("xyz"), k, s, s + r.choice([0, -2, 1, 1, 3, 8, 40])))
        return [*out, (None, n, 1, 9), ("x", n + 1, None, 4), ("x", n + 2, 4, None), ("only" + str(n), n + 3, 0, 5)]

    left, right = spans(90), spans(80)
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in a + b and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])
    got = sorted((x.i, x.j) for x in _overlap(spark, left, right).collect())
    assert got == want and len(want) > 200


def test_a_document_with_many_spans_stays_linear(spark):
    """10^5 spans on either side of one document, short ones between long ones: 10^10 pairs, of which few overlap."""
    n = 100_000
    left = spark.range(n).select(F.lit("q").alias("query_id"), F.lit("d").alias("document_id"), (F.col("id") + 1).alias("rank"), (F.col("id") * 10).alias("char_start"), (F.col("id") * 10 + 4).alias("char_end"))
    right = spark.range(n).select(F.lit("q").alias("query_id"), F.lit("d").alias("document_id"), F.col("id").alias("golden_id"), (F.col("id") * 10 + 3 + F.col("id") % 2).alias("char_start"), (F.col("id") * 10 + 9).alias("char_end"))
    # One span of each side holds half the document.
    far = right.limit(1).withColumn("golden_id", F.lit(-1).cast("long")).withColumn("char_start", F.lit(0).cast("long")).withColumn("char_end", F.lit(5 * n).cast("long"))
    pairs = M.span_pairs(left, right.unionByName(far))
    assert pairs.count() == n // 2 + n // 2
    assert M.evidence_coverage(left, right, n).first().coverage == (n // 2) / (n // 2 * 6 + n // 2 * 5)


def test_spans_of_many_chunks_are_those_found_in_order(spark):
    r = random.Random(9)
    text = " ".join(r.choice(["ab", "abc", "b", "c c", "ß"]) for _ in range(3000))
    pieces, at = [], 0
    while at < len(text):
        n = r.randint(1, 9)
        pieces.append(r.choice([text[at : at + n], text[at : at + n], "zz", text[at : at + 1]]))
        at += n
    want, last = [], 0
    for k, piece in enumerate(pieces):
        found = text.find(piece, last)
        found = found if found >= 0 else text.find(piece)
        if found >= 0:
            want.append((k, found, found + len(piece)))
            last = found + 1
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    chunks = spark.createDataFrame([(1, k, p) for k, p in enumerate(pieces)] + [(2, 0, "x")], "doc_id int, chunk int, piece string")
    assert len(want) > 2 * C.SPAN_BLOCK
    assert [tuple(x)[1:] for x in C.spans(docs, chunks).orderBy("chunk").collect()] == want
