"""SimHash near-duplicate classes with pigeonring filtering.

Fingerprints are 64-bit majorities of shingle hashes. Two fingerprints link at
``DISTANCE`` or fewer differing bits. The bits lie on a ring of ``SEGMENTS``
segments. If a pair is within the distance, then some segment starts a chain
whose every prefix of k segments differs in at most k * DISTANCE / SEGMENTS
bits: with three segments and two bits, one segment is equal and, with its
successor, differs in at most one bit. So a pair meets under a key of two
consecutive segments, with the second varied in at most one bit. Only pairs
that pass this chain reach the full Hamming check. Each distinct fingerprint
gives a fixed number of keys whatever the size of its group, and copies are
brought to one fingerprint before any of this.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 3

#: For each byte, its bits spread over eight byte lanes, most significant first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_digests(text: str | None, shingle: int, seed: int = SEED) -> bytes:
    """The 8-byte hashes of a whole text's shingles, end to end; a text of fewer words is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return b""
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(line, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    cuts = map(slice, starts, [e - 1 for e in ends[shingle - 1 :]])
    return b"".join(map(xxhash.xxh64_digest, map(line.__getitem__, cuts), repeat(seed)))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text as an unsigned integer."""
    return majority(shingle_digests(text, shingle, seed))


def majority(raw: bytes) -> int:
    """The bits that are set in over half of the 8-byte hashes of ``raw``; zero of none."""
    if len(raw) <= 8:
        return int.from_bytes(raw, "big")
    lanes = _LANES[np.frombuffer(raw, np.uint8)].reshape(-1, 8)
    n = len(lanes)
    # A lane holds up to 255 ones before it would run into the next.
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    counts = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with ``fp`` the fingerprint's bits as a signed long."""

    def run(batches):
        for b in stage.slices(batches, "text"):
            known: dict[str | None, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                if t not in known:
                    f = fingerprint(t)
                    known[t] = f - (1 << 64) if f >> 63 else f
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return stage.map_batches(rows, run, "doc_id long, fp long")


def _segments() -> list[list[int]]:
    """The bit positions of each segment."""
    cuts = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within ``DISTANCE`` bits.

    A pair may come up under more than one chain. Null fingerprints link to
    none, repeated ones add repeated pairs, and an empty table gives none.
    """
    parts = _segments()
    held, varied = [], []
    fp = F.col("fp")
    for k, first in enumerate(parts):
        second = parts[(k + 1) % SEGMENTS]
        mask = _signed(sum(1 << b for b in first + second))
        base = fp.bitwiseAND(F.lit(mask))
        held.append(F.struct(F.lit(k).cast("byte").alias("chain"), base.alias("key")))
        # The chain's budgets: none in the first segment, one in the first two.
        for flip in [0, *(_signed(1 << b) for b in second)]:
            varied.append(F.struct(F.lit(k).cast("byte").alias("chain"), base.bitwiseXOR(F.lit(flip)).alias("key")))
    left = fps.select(fp.alias("a"), F.explode(F.array(*varied)).alias("k")).select("a", "k.chain", "k.key")
    right = fps.select(fp.alias("b"), F.explode(F.array(*held)).alias("k")).select("b", "k.chain", "k.key")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return left.join(right, (left["chain"] == right["chain"]) & (left["key"] == right["key"]) & near).select("a", "b")


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(fp, label): the smallest fingerprint reachable from each linked one.

    Alternating stars: each round first joins every larger neighbour of a
    fingerprint to the least of its neighbourhood, then every smaller one. The
    number of edges never grows, a path shrinks by a constant factor a round,
    and the rounds end when only stars are left. Minima are taken by partial
    aggregation, each round is a table in the shared folder, and only
    counts reach the driver (``rounds`` gets the edges left after each).
    """
    spark = edges.sparkSession
    now = stage.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n = now.count()
    while n and not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = joined.distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        joined = joined.select("u", F.col("m").alias("v")).union(joined.filter("v > m").select("v", "m"))
        after = stage.written(joined.distinct(), "small-stars", n, 16)
        stage.drop_table(spark, now)
        now, n = after, after.count()
        if rounds is not None:
            rounds.append(n)
    roots = now.select(F.col("v").alias("fp"), F.col("v").alias("label")).distinct()
    return stage.written(now.select(F.col("u").alias("fp"), F.col("v").alias("label")).union(roots), "labels", 2 * n, 16)


def _all_stars(edges: DataFrame) -> bool:
    """Whether each upper end has one lower end, which is no upper end itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up > 1 or (up = 1 and down = 1)").limit(1).count()


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a (doc_id, fp) table.

    The component's id is the least of its rows' ids; null where it has none.
    Repeated rows count once, and an empty table gives an empty result.
    """
    n = fps.count()
    nodes = stage.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "nodes", n, 16)
    found = components(links(nodes.select("fp")))
    linked = stage.written(nodes.join(found, "fp"), "linked", n, 24)
    roots = stage.written(linked.groupBy("label").agg(F.min("least_doc").alias("component_id")), "roots", n, 16)
    mapped = stage.written(linked.join(roots, "label").select("fp", "component_id"), "mapped", n, 16)
    kinds = nodes.join(mapped, "fp", "left").select("fp", F.coalesce("component_id", "least_doc").alias("component_id"))
    out = stage.written(kinds, "classes", n, 16)
    stage.drop_table(fps.sparkSession, nodes, found, linked, roots, mapped)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id.

    Null, empty and blank texts have fingerprint zero and form one class. Rows
    with equal ids or equal texts keep a row each. Null ids take part in links
    but are never a ``component_id``; a class of null ids alone has a null one.
    Further columns are not read. An empty table gives an empty result.
    """
    fps = stage.written(fingerprints(docs, id_col, text_col), "fingerprints")
    out = fps.join(classes(fps), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(stage.table(spark, sf_dir, "documents"))
