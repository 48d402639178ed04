"""A Merkle manifest of a dataset: parents keep their children's hashes, rows prove that they belong.

Each parent is stored as its preimage, the concatenated hashes of its children.
A leaf joins the preimages of its ancestors; taking its own 64 characters out of
each gives the siblings that prove it, putting another hash in their place folds
that hash up to the root. Everything is built-in functions: rows are numbered
after one sort by range, and levels are made in blocks of ``arity ** LEVELS``
nodes, so a job makes several levels and no tree is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import stage

ARITY = 2
#: Levels that one block of nodes is folded by.
LEVELS = 6
DIGEST = 64
#: Groups whose paths are broadcast, about 2 KB each; more are joined by salted keys.
FEW_GROUPS = 10_000
SALTS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value: no two rows have one encoding."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


_STEP = "array<struct<preimage:string,slot:int>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in their ``group``, and ``size``, the group's rows.

    One sort by range over all rows, whatever the groups' sizes; a partition's
    rows are numbered as they lie, and what earlier partitions hold of a group
    comes from a table of one row for each partition and group. Nulls come
    first, strings go bytewise. Rows equal in ``order`` are told apart by a
    number, so that many of them do not end in one partition.
    """
    keys = ["group", *order, "_tie"]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = stage.written(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    held = spread.groupBy(F.col("group").alias("_group"), part.alias("_held")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_held").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_group", "_held", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    met = spread.join(held, F.col("group").eqNullSafe(F.col("_group")) & (part == F.col("_held")))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_held", "_group", "_shift")


def _depth(size: Column, arity: int) -> Column:
    """Levels over ``size`` nodes, exactly: the powers of ``arity`` below it."""
    powers = [1]
    while powers[-1] * arity < 1 << 62:
        powers.append(powers[-1] * arity)
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < size))


def _parents(hashes: Column, arity: int) -> Column:
    """Preimages of the parents of an array of nodes: ``arity`` hashes in turn, the last may have fewer."""
    last = F.floor((F.size(hashes) - 1) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(hashes, i * arity + 1, F.lit(arity)), ""))


def _blocks(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (group, pos, hash, left) by blocks: the preimages of each level within it, and the hash that it comes to.

    ``left`` is the number of levels from a node to its group's root, where a
    block stops. ``p0`` has the preimages over the nodes, ``p1`` those above, and so on.
    """
    out = nodes.groupBy("group", F.expr(f"pos div {arity**LEVELS}").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("hashes"),
        F.first("left").alias("left"),
    )
    for k in range(LEVELS):
        inside = F.col("left") > k
        out = out.withColumn(f"p{k}", F.when(inside, _parents(F.col("hashes"), arity)))
        out = out.withColumn("hashes", F.when(inside, F.transform(f"p{k}", lambda x: F.sha2(x, 256))).otherwise(F.col("hashes")))
    return out.withColumn("hash", F.element_at("hashes", 1)).drop("hashes")


def _ancestors(nodes: DataFrame, arity: int, top: int) -> DataFrame:
    """(group, block, p0 and on, root, above): what nodes join to reach their group's root.

    ``top`` is the most levels that a group has. What blocks come to are the
    nodes of a table ``arity ** LEVELS`` times smaller, whose paths are made
    first and kept in ``above``, so rows meet all their ancestors in one join.
    """
    blocks = stage.written(_blocks(nodes, arity), "preimages")
    inside = ["group", "block", *[f"p{k}" for k in range(LEVELS)]]
    if top <= LEVELS:
        return blocks.select(*inside, F.col("hash").alias("root"), F.array().cast(_STEP).alias("above"))
    upper = blocks.select("group", F.col("block").alias("pos"), "hash", F.greatest(F.col("left") - LEVELS, F.lit(0)).alias("left"))
    above = joined(upper.select("group", "pos"), _ancestors(upper, arity, top - LEVELS), arity)
    above = above.select(F.col("group").alias("_g"), F.col("pos").alias("_b"), "root", F.col("path").alias("above"))
    return blocks.join(above, F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).select(*inside, "root", "above")


def joined(rows: DataFrame, ancestors: DataFrame, arity: int, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (with group, pos) with ``also`` of ``ancestors``, ``root`` and ``path``: the preimage of each ancestor and the slot that leads to it."""
    wide = arity**LEVELS

    def step(k: int) -> Column:
        parent = F.expr(f"cast(pos % {wide} div {arity ** (k + 1)} as int)")
        slot = F.expr(f"cast(pos div {arity**k} % {arity} as int)")
        return F.when(F.col(f"p{k}").isNotNull(), F.struct(F.element_at(f"p{k}", parent + 1).alias("preimage"), slot.alias("slot")))

    side = ancestors.withColumnsRenamed({"group": "_g", "block": "_b"})
    met = rows.join(side, F.col("group").eqNullSafe(F.col("_g")) & (F.expr(f"pos div {wide}") == F.col("_b")))
    inner = F.filter(F.array(*[step(k) for k in range(LEVELS)]), lambda s: s.isNotNull())
    return met.select(*rows.columns, *also, "root", F.concat(inner, "above").alias("path"))


def excised(path: Column) -> Column:
    """The siblings along a path, one after the other: each preimage without the slot that was come from."""
    return F.array_join(F.transform(path, lambda s: F.overlay(s["preimage"], F.lit(""), s["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to when it is put in its slot of each preimage in turn."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


def proofs(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` (group, doc_id, leaf and others) with ``subroot``, ``root`` and the ``path`` from a leaf to the root.

    Within a group leaves ascend by ``doc_id``, null first, equal ones by their
    hash; rows that repeat are leaves of their own. Groups ascend bytewise,
    null first. No leaves give no rows.
    """
    kept = [c for c in leaves.columns if c != "group"]
    rows = numbered(stage.written(leaves, "leaves"), ["doc_id", "leaf"]).withColumn("left", _depth(F.col("size"), arity)).drop("size")
    rows = stage.written(rows, "numbered")
    top = rows.agg(F.coalesce(F.max("left"), F.lit(0))).first()[0]
    low = stage.written(_ancestors(rows.select("group", "pos", F.col("leaf").alias("hash"), "left"), arity, top).withColumnRenamed("root", "subroot"), "ancestors")

    groups = low.filter("block = 0").select(F.lit(0).alias("group"), F.col("group").alias("of"), F.col("subroot").alias("hash"))
    groups = stage.written(numbered(groups, ["of"]).withColumn("left", _depth(F.col("size"), arity)), "subroots")
    n, top = groups.agg(F.count("*"), F.coalesce(F.max("left"), F.lit(0))).first()
    high = joined(groups.select("of", "group", "pos"), _ancestors(groups.select("group", "pos", "hash", "left"), arity, top), arity)
    high = high.select("of", "root", F.col("path").alias("high"))
    same = F.col("group").eqNullSafe(F.col("of"))
    if n <= FEW_GROUPS:
        low = low.join(F.broadcast(high), same)
    else:
        high = high.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        low = low.join(high, same & (F.pmod("block", F.lit(SALTS)) == F.col("_salt"))).drop("_salt")
    low = low.withColumn("above", F.concat("above", "high")).drop("of", "high")
    return joined(rows, low, arity, ("subroot",)).select(*kept, "subroot", "root", "path")


def leaves(docs: DataFrame, edited: dict[str, Column] | None = None) -> DataFrame:
    """(group, doc_id, leaf, again) of each row, by ``FIELDS``; further columns are not read.

    ``again`` is the leaf that the row has with the values in ``edited``. Rows
    of null and empty values differ; repeated rows have equal leaves.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = [(edited or {}).get(c, F.col(c)) for c in FIELDS]
    return docs.select(F.col("lang").alias("group"), "doc_id", digest(*map(field, fields)).alias("leaf"), digest(*map(field, changed)).alias("again"))


def manifest(docs: DataFrame, edited: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """A leaf for each row, its path to its language's subroot and the root, and the root that the edited row leads to."""
    out = proofs(leaves(docs, edited), arity)
    return out.withColumn("folded_root", folded(F.col("again"), F.col("path")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; one more is added to ``n_chars`` where 7 divides the crc32 of the id. A null id changes nothing."""
    docs = stage.table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = manifest(docs, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(excised(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(changed: dict[str, str] | None = None) -> str:
    values = [(changed or {}).get(c, f"d.{c}") for c in FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')" for v in values) + "))"


#: Levels are made one after the other, for all languages and then for their
#: subroots; each leaf then climbs past its siblings. crc32 goes bit by bit.
SQL = f"""
WITH RECURSIVE
crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
hit AS (SELECT doc_id, 1 AS more FROM crc WHERE xor(c, 4294967295::UBIGINT) % 7 = 0),
made AS (
  SELECT d.doc_id, d.lang, {_sql_leaf()} AS leaf, {_sql_leaf({"n_chars": "d.n_chars + coalesce(h.more, 0)"})} AS again
  FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM made),
low(lang, level, pos, n, hash) AS (
  SELECT lang, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n),
tops AS (
  SELECT lang, level AS height, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, hash) AS (
  SELECT 0, place, n, subroot FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
inside(lang, first, level, pos, h, siblings) AS (
  SELECT lang, pos, 0, pos, again, '' FROM placed
  UNION ALL
  SELECT c.lang, first, c.level + 1, c.pos // 2,
    sha256(CASE WHEN c.pos % 2 = 0 THEN h || coalesce(s.hash, '') ELSE s.hash || h END), siblings || coalesce(s.hash, '')
  FROM inside c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.level < t.height),
above(lang, first, subroot, level, pos, h, siblings) AS (
  SELECT i.lang, first, subroot, 0, place, h, siblings FROM inside i JOIN tops t ON t.lang IS NOT DISTINCT FROM i.lang AND i.level = t.height
  UNION ALL
  SELECT c.lang, first, subroot, c.level + 1, c.pos // 2,
    sha256(CASE WHEN c.pos % 2 = 0 THEN h || coalesce(s.hash, '') ELSE s.hash || h END), siblings || coalesce(s.hash, '')
  FROM above c LEFT JOIN high s ON s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.level < (SELECT max(level) FROM high))
SELECT p.doc_id, p.leaf, a.subroot, r.hash AS root, sha256(a.siblings) AS proof_sha256, a.h AS folded_root, a.h = r.hash AS verified
FROM placed p JOIN above a ON a.lang IS NOT DISTINCT FROM p.lang AND a.first = p.pos
JOIN high r ON r.n = 1 AND a.level = r.level
"""
