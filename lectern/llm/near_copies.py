"""Near copies by the Jaccard similarity of five-word shingles, for the pipeline.

Two texts are near copies if their sets of shingles have a similarity of 0.8 or
more; classes are the connected components. Candidates meet in buckets of two
kinds: a class of SimHash fingerprints of the sets, linked by the pigeonring of
:mod:`op1_simhash`, and a key of ``ROWS`` MinHash values, of which a text has
``BANDS``, as few of the pairs at 0.8 are within the fingerprints' distance.
Every link is checked on the whole sets. In each bucket all texts are first compared with the least one, then, in
buckets that are not yet of one class, with the greatest one. In a bucket still
of several classes after that, the texts outside its greatest class meet its
members, in blocks that are dealt over tasks, so a bucket's texts link exactly
as if all its pairs had been compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import op1_simhash, stage

SHINGLE = 5
#: Similarity from which texts are near copies, as a fraction of whole numbers.
PART, WHOLE = 4, 5
#: A pair at the similarity of 0.8 meets under no key with a probability of (1 - 0.8 ** ROWS) ** BANDS, 5e-5.
BANDS, ROWS = 25, 5
#: Texts outside their bucket's greatest class that meet its members in one group of a join.
BLOCK = 256
_NODE, _ID = "__node", "__kept_id"

_RANDOM = np.random.default_rng(11).integers(1, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
_FLIP, _TIMES, _JOIN = _RANDOM[0][:, None], _RANDOM[1][:, None] * np.uint64(2) + np.uint64(1), (_RANDOM[2] | np.uint64(1)).reshape(BANDS, ROWS)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text, as sorted 64-bit hashes; a text of fewer words is one shingle."""
    return np.unique(np.frombuffer(op1_simhash.shingle_digests(text, SHINGLE), ">u8").astype(np.uint64))


def keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, one for each band; of an empty set, one."""
    if not len(found):
        return np.zeros(1, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 2048):
        np.minimum(least, ((found[k : k + 2048] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    out = (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (out ^ (out >> np.uint64(31))).astype(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles, each counted once, as a signed 64-bit integer."""
    f = op1_simhash.majority(found.astype(">u8").tobytes())
    return f - (1 << 64) if f >> 63 else f


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, fp, keys) of each row; a node stands for all rows of one text."""

    def run(batches):
        for b in stage.slices(batches, "text"):
            known: dict[int, tuple[int, int, np.ndarray]] = {}
            out = []
            for node, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if node not in known:
                    found = shingles(t)
                    known[node] = (len(found), fingerprint(found), keys(found))
                out.append(known[node])
            sizes, fps, held = zip(*out, strict=True)
            cols = [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(held, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "size", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text")
    return stage.map_batches(rows, run, "doc_id long, node long, size int, fp long, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, found): the shingles of each of ``nodes`` (node, doc_id), once for each row of that text and id."""

    def run(batches):
        for b in stage.slices(batches, "text"):
            found = [shingles(t).astype(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    return stage.map_batches(_rows_of(docs.select("doc_id", "text"), nodes).select(F.xxhash64("text").alias("node"), "text"), run, "node long, found array<long>")


def _rows_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the text and id of one of ``nodes`` (node, doc_id)."""
    wanted = nodes.select(F.col("node").alias(_NODE), F.col("doc_id").cast("long").alias(_ID))
    same = (F.xxhash64(docs["text"]) == F.col(_NODE)) & docs["doc_id"].cast("long").eqNullSafe(F.col(_ID))
    # The wanted rows grow with the corpus, so the join is a merge at every size.
    return docs.join(wanted.hint("merge"), same, "left_semi")


def _similar(a: str, b: str):
    """Whether two sets are similar enough, without a rounded quotient."""
    both = F.size(F.array_intersect(a, b))
    return (PART + WHOLE) * both >= PART * (F.size(a) + F.size(b))


def _sizes_allow(a: str, b: str):
    return WHOLE * F.least(a, b) >= PART * F.greatest(a, b)


def _shingles_in(sizes: DataFrame, *columns: str) -> int:
    """The sum of columns that hold sizes of sets: what a join that carries those sets has to read."""
    return sizes.agg(F.sum(sum((F.col(c).cast("long") for c in columns), F.lit(0)))).first()[0] or 0


def _stars(members: DataFrame, leader: str, sets: DataFrame, most: int, before: DataFrame | None = None) -> DataFrame:
    """(a, b) of the members that are similar to their bucket's leader, written, with those of ``before``.

    The pairs are written first: tasks are sized by the sets that the pairs
    bring along, not by the few bytes of a pair that is left.
    """
    pairs = members.filter((F.col("node") != F.col(leader)) & _sizes_allow("size", f"{leader}_size"))
    pairs = pairs.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col(leader).alias("b"), F.col(f"{leader}_size").alias("b_size")).distinct()
    pairs = stage.written(pairs, "pairs", most, 24)
    carried = _shingles_in(pairs, "a_size", "b_size")
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("found").alias("left")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("found").alias("right")), "b")
    found = both.filter(_similar("left", "right")).select("a", "b")
    edges = stage.written(found if before is None else found.union(before), "stars", carried, 8)
    stage.drop_table(members.sparkSession, pairs)
    return edges


def _open(members: DataFrame, edges: DataFrame, most: int) -> DataFrame | None:
    """The members, with labels, of buckets that ``edges`` do not make one class; None if there are none."""
    spark = members.sparkSession
    labels = op1_simhash.components(edges).withColumnRenamed("fp", "node")
    marked = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = stage.written(marked, "marked", most, 60)
    several = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    several = stage.written(several, "open-buckets", most, 24)
    found = stage.written(marked.join(several, "key", "left_semi"), "open", most, 60) if several.limit(1).count() else None
    stage.drop_table(spark, labels, marked, several)
    return found


def _across(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the similar texts of different classes in one bucket.

    One of such two is outside the bucket's greatest class, so the work is that
    class's rest times the bucket and not its square. Blocks spread it, and
    nothing but links leaves the join.
    """
    classes = rest.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("held"))
    classes = classes.select("key", F.col("most.label").alias("greatest"), F.ceil((F.col("held") - F.col("most.count")) / BLOCK).cast("int").alias("blocks"))
    sides = rest.select("key", "node", "size", "label").join(classes, "key").join(sets, "node")
    every = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = sides.filter("label != greatest").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    left, right = (df.select("key", "block", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "label", "greatest", "found")]) for df, s in ((every, "a"), (others, "b")))
    once = (F.col("label_a") == F.col("greatest_a")) | (F.col("node_a") < F.col("node_b"))
    pairs = left.join(right, ["key", "block"]).filter((F.col("label_a") != F.col("label_b")) & once & _sizes_allow("size_a", "size_b") & _similar("found_a", "found_b"))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _held(nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(node, size, key) of the buckets that each node is in, and the table of SimHash classes that this reads.

    Fingerprints that the pigeonring links have their class's label as a key,
    others themselves: texts of one fingerprint meet too.
    """
    fps = stage.written(nodes.select("fp").distinct(), "fingerprints", n, 16)
    classes = op1_simhash.components(op1_simhash.links(fps))
    stage.drop_table(nodes.sparkSession, fps)
    near = nodes.select("node", "size", "fp").join(classes, "fp", "left")
    near = near.select("node", "size", F.xxhash64(F.lit("simhash"), F.coalesce("label", "fp")).alias("key"))
    return nodes.select("node", "size", F.explode("keys").alias("key")).union(near), classes


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that are near copies, enough of them to connect each class.

    ``nodes`` has (node, size, fp, keys, row) with ``row.doc_id`` an id whose
    row holds the text. Empty tables give no pairs.
    """
    spark, n = docs.sparkSession, nodes.count()
    total = _shingles_in(nodes, "size")
    held, classes = _held(nodes, n)
    ends = held.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lo"), F.max(F.struct("node", "size")).alias("hi"))
    ends = ends.filter("lo.node < hi.node").select("key", F.col("lo.node").alias("lo"), F.col("lo.size").alias("lo_size"), F.col("hi.node").alias("hi"), F.col("hi.size").alias("hi_size"))
    buckets = stage.written(ends, "buckets", (BANDS + 1) * n // 2, 40)
    members = stage.written(held.join(buckets, "key"), "members", (BANDS + 1) * n, 60)
    most = members.count()
    linked = members.select("node").distinct().join(nodes.select("node", "row.doc_id"), "node")
    sets = stage.written(_sets(docs, linked), "shingles", total, 8)
    edges = _stars(members, "lo", sets, most)
    rest = _open(members, edges, most)
    if rest is not None:
        edges = _stars(rest, "hi", sets, most, edges)
        rest = _open(rest, edges, most)
    if rest is not None:
        edges = stage.written(edges.union(_across(rest, sets)), "near", 2 * _shingles_in(rest, "size"), 8)
    stage.drop_table(spark, classes, buckets, members, sets)
    return edges


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies: the one with the least id.

    Each row is judged by its own text, whatever other rows have its id. Rows
    without an id stay only if their class has no row with one. Null, empty
    and blank texts form one class. Of rows with one id and one text the least
    by the other columns stays; a map column counts for nothing there. Other
    columns pass through under any name but ``__node`` and ``__kept_id``. An
    empty table gives an empty result.
    """
    rows, n = _sketches(docs), docs.count()
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id")
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(first).alias("row"))
    nodes = stage.written(nodes, "nodes", n, 240)
    labels = op1_simhash.components(links(docs, nodes)).withColumnRenamed("fp", "node")
    labelled = nodes.select("node", "row").join(labels, "node", "left")
    best = labelled.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(F.struct("row", "node")).alias("r"))
    kept = stage.written(best.select(F.col("r.node").alias("node"), "r.row.doc_id"), "kept", n, 60)
    stage.drop_table(docs.sparkSession, nodes, labels)
    stays = _rows_of(docs, kept)
    text = F.xxhash64("text")
    if docs.groupBy("doc_id", text).count().filter("count > 1").limit(1).count():
        kinds = dict(docs.dtypes)
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        order = F.struct(*[F.col(c) for c in ("text", *others) if "map<" not in kinds[c]])
        least = F.min_by(F.struct("text", *others), order).alias("r")
        stays = stays.groupBy("doc_id", text.alias(_NODE)).agg(least)
        stays = stays.select(*[F.col("doc_id") if c == "doc_id" else F.col("r")[c].alias(c) for c in docs.columns])
    return stays
