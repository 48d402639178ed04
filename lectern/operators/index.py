"""Inverted-file index over vectors: rows stored by the cell they fall in, exact search that leaves cells out.

Centroids are fitted on a bounded sample; every row goes to its nearest
centroid's cell and is stored with its angle to it. On unit vectors the triangle
inequality bounds how near any row of a cell can be to a query, so after the
cells nearest to a query gave it ``k`` rows, cells that cannot hold a nearer one
are left out, and the result is that of comparing with all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from lectern.operators.filters import first_rows
from lectern.sources import scratch

#: Vectors that centroids are fitted on, and centroids, at most.
SAMPLE = 20_000
MOST_CELLS = 2_048
ROUNDS = 10
#: Queries whose vectors one pass over the index holds.
QUERY_BLOCK = 2_000
#: Cells that a query looks at before it leaves any out.
PROBE = 4
#: Rows without a direction: no vector, or one of zeros.
NO_CELL = -1
CELL, ANGLE = "ivf_cell", "ivf_angle"
#: Distances are ordered at nine digits; bounds give way by a little more.
SLACK = 1e-7


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which rows have one; the others are zero. All have one length."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.drop_null().flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    n = int(known.sum())
    if n and len(flat) % n:
        raise ValueError("vectors of an index have one length")
    out = np.zeros((len(column), len(flat) // n if n else 0))
    if n:
        out[known] = flat.reshape(n, -1)
    return out, known


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm > 0, norm, 1.0)[:, None], norm


def fit(vectors: DataFrame, cells: int | None = None, id_col: str = "chunk_id", vec_col: str = "embedding", seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on at most ``SAMPLE`` vectors, chosen by the hash of their id."""
    known = vectors.filter(F.col(vec_col).isNotNull())
    n = known.count()
    if n > SAMPLE:
        known = known.filter(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(1_200_000 * SAMPLE / n) + 1)
    held = known.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(SAMPLE).select(vec_col).toArrow()
    points, norm = _unit(_matrix(held.column(0).combine_chunks())[0])
    points = points[norm > 0]
    if not len(points):
        return np.zeros((0, points.shape[1]))
    k = min(cells or max(1, round(n**0.5)), MOST_CELLS, len(np.unique(points, axis=0)))
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]]
    for _ in range(ROUNDS):
        near = points @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = points[np.argsort(near.max(1), kind="stable")[: len(empty)]]  # the worst served points
        centres = _unit(sums)[0]
    return centres


@dataclass
class Index:
    """An index under ``root``: its centroids, and the number of rows and the angles of each cell."""

    spark: SparkSession
    root: str
    centres: np.ndarray
    id_col: str
    vec_col: str
    cells: dict[int, tuple[int, float, float]]

    def read(self) -> DataFrame:
        """All rows with their cell; the shape is stored, as an index without rows has no files."""
        return _rows(self.spark, self.root)

    @property
    def rows(self) -> int:
        return sum(n for n, _, _ in self.cells.values())


def _rows(spark: SparkSession, root: str) -> DataFrame:
    shape = spark.read.parquet(f"{root}/shape").schema
    return spark.read.schema(Y.StructType([*shape.fields, Y.StructField(ANGLE, Y.DoubleType()), Y.StructField(CELL, Y.IntegerType())])).parquet(f"{root}/rows")


def _assigned(vectors: DataFrame, centres: np.ndarray, vec_col: str) -> DataFrame:
    place = vectors.columns.index(vec_col)

    def run(batches):
        for b in batches:
            m, _ = _matrix(b.column(place))
            unit, norm = _unit(m)
            cell = np.full(len(m), NO_CELL, np.int32)
            angle = np.zeros(len(m))
            some = norm > 0
            if some.any() and len(centres):
                near = unit[some] @ centres.T
                cell[some] = near.argmax(1)
                angle[some] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, CELL, ANGLE])

    return vectors.mapInArrow(run, Y.StructType([*vectors.schema.fields, Y.StructField(CELL, Y.IntegerType()), Y.StructField(ANGLE, Y.DoubleType())]))


def _stored(vectors: DataFrame, root: str, centres: np.ndarray, id_col: str, vec_col: str) -> None:
    """Rows by cell, dealt by cell, angle and id, so that neither a full cell nor equal vectors are one task's rows."""
    by = [CELL, ANGLE, id_col]
    _assigned(vectors, centres, vec_col).repartitionByRange(*by).sortWithinPartitions(*by).write.mode("append").partitionBy(CELL).parquet(f"{root}/rows")


def build(vectors: DataFrame, root: str, cells: int | None = None, id_col: str = "chunk_id", vec_col: str = "embedding") -> Index:
    """Index all rows of ``vectors`` under ``root``, with all their columns; null and zero vectors are kept apart."""
    spark = vectors.sparkSession
    centres = fit(vectors, cells, id_col, vec_col)
    named = [(k, [float(x) for x in c]) for k, c in enumerate(centres)]
    spark.createDataFrame(named, f"{CELL} int, centre array<double>").coalesce(1).write.parquet(f"{root}/centres")
    vectors.limit(0).coalesce(1).write.parquet(f"{root}/shape")
    _stored(vectors, root, centres, id_col, vec_col)
    return load(spark, root, id_col, vec_col)


def load(spark: SparkSession, root: str, id_col: str = "chunk_id", vec_col: str = "embedding") -> Index:
    """An index that was built before; at most ``MOST_CELLS`` rows reach the driver."""
    centres = [r.centre for r in spark.read.parquet(f"{root}/centres").orderBy(CELL).collect()]
    held = _rows(spark, root).groupBy(CELL).agg(F.count("*"), F.min(ANGLE), F.max(ANGLE)).collect()
    return Index(spark, root, np.array(centres, float).reshape(len(centres), len(centres[0]) if centres else 0), id_col, vec_col, {r[0]: (r[1], r[2], r[3]) for r in held})


def add(index: Index, vectors: DataFrame) -> Index:
    """Further rows, by the centroids that the index has; their ids are new."""
    _stored(vectors, index.root, index.centres, index.id_col, index.vec_col)
    return load(index.spark, index.root, index.id_col, index.vec_col)


def _near(index: Index, qs: np.ndarray, norms: np.ndarray, skip: list, wanted: dict[int, np.ndarray], k: int, where: Column | None, also: list[str]) -> DataFrame:
    """(_q, id, distance, also): for each query the ``k`` nearest that each task sees in the cells wanted for it.

    A task compares one cell's rows with that cell's queries as one product of
    matrices and passes on no more than ``k`` rows for each query and batch.
    """
    rows = index.read().filter(F.col(CELL).isin([int(c) for c in wanted]))
    rows = rows if where is None else rows.filter(where)
    rows = rows.select(index.id_col, CELL, index.vec_col, *also)
    id_col = index.id_col

    def run(batches):
        worst = np.full(len(qs), np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column(1).to_numpy()
            by_id = np.empty(b.num_rows, np.int64)
            by_id[pc.sort_indices(b.column(0)).to_numpy()] = np.arange(b.num_rows)
            m, known = _matrix(b.column(2))
            norm = np.sqrt(np.einsum("ij,ij->i", m, m))
            ids = b.column(0).to_pylist() if any(s is not None for s in skip) else None
            at = {x: i for i, x in enumerate(ids)} if ids else {}
            found_q, found_row, found_d = [], [], []
            for cell in np.unique(cells):
                mine = np.flatnonzero((cells == cell) & known)
                who = wanted[int(cell)]
                if not len(mine) or not len(who):
                    continue
                d = 1 - (m[mine] @ qs[who].T) / (norm[mine][:, None] * norms[who][None, :] + 1e-9)
                place = {int(r): i for i, r in enumerate(mine)} if ids else {}
                for j, q in enumerate(who):
                    own = d[:, j]
                    if skip[q] in at and at[skip[q]] in place:
                        own = own.copy()
                        own[place[at[skip[q]]]] = np.inf
                    # Ordered as the result is, at nine digits and by id.
                    shown = np.round(own, 9)
                    most = min(worst[q], np.partition(shown, k - 1)[k - 1] if len(shown) > k else np.inf)
                    some = np.flatnonzero((shown <= most) & np.isfinite(own))
                    best = some[np.lexsort((by_id[mine[some]], shown[some]))][:k]
                    if len(best) == k:
                        worst[q] = min(worst[q], shown[best[-1]])
                    found_q.append(np.full(len(best), q))
                    found_row.append(mine[best])
                    found_d.append(own[best])
            if found_q:
                row = np.concatenate(found_row)
                kept = b.select([id_col, *also]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_q).astype(np.int32)), pa.array(np.concatenate(found_d)), *kept.columns], names=["_q", "distance", id_col, *also])

    kinds = {f.name: f for f in rows.schema.fields}
    schema = Y.StructType([Y.StructField("_q", Y.IntegerType()), Y.StructField("distance", Y.DoubleType()), kinds[id_col], *[kinds[c] for c in also]])
    return first_rows(rows.mapInArrow(run, schema), ["_q"], [F.round("distance", 9), F.col(id_col)], k)


def _bounds(index: Index, unit: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Cells that hold rows, and for each query the least distance that one of a cell's rows can have."""
    cells = sorted(c for c in index.cells if c != NO_CELL)
    angle = np.arccos(np.clip(unit @ index.centres[cells].T, -1, 1)) if cells else np.zeros((len(unit), 0))
    low = np.array([index.cells[c][1] for c in cells])
    high = np.array([index.cells[c][2] for c in cells])
    least = np.clip(np.maximum(angle - high, low - angle), 0, np.pi)
    # Short vectors draw a distance towards one, so no bound beyond a right angle holds.
    return cells, np.where(least < np.pi / 2, 1 - np.cos(least), 1.0) - SLACK


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None, skip: str | None = None, also: tuple[str, ...] = (), probe: int = PROBE, exact: bool = True, work: list | None = None) -> DataFrame:
    """(query_id, id, distance, rank, also): the ``k`` rows nearest to each query by cosine distance.

    ``queries`` (query_id, qvec) are a stated set, taken in blocks of
    ``QUERY_BLOCK``; ``where`` is a condition on the rows' own columns that the
    scan takes; ``skip`` names a column of ``queries`` with the id of a row that
    is left out. With ``exact`` the result is that over all rows; without it
    only the ``probe`` nearest cells are looked at. ``work`` gets for each block
    the pairs compared and those there are. A query without a vector gets no
    rows, one of zeros has distance one to all.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = part.filter("qvec is not null").select("query_id", "qvec", (F.col(skip) if skip else F.lit(None)).alias("_skip")).toArrow()
        qs, _ = _matrix(held.column(1).combine_chunks()) if held.num_rows else (np.zeros((0, 0)), None)
        skips = held.column(2).to_pylist()
        unit, norms = _unit(qs)
        cells, least = _bounds(index, unit) if held.num_rows else ([], np.zeros((0, 0)))
        first = np.zeros(least.shape, bool)
        np.put_along_axis(first, np.argsort(least, axis=1, kind="stable")[:, :probe], True, axis=1)
        everyone = np.arange(len(qs))

        def wanted(mask: np.ndarray, cells=cells) -> dict[int, np.ndarray]:
            return {c: np.flatnonzero(mask[:, i]) for i, c in enumerate(cells) if mask[:, i].any()}

        now = wanted(first) | ({NO_CELL: everyone} if NO_CELL in index.cells else {})
        path = scratch.place(index.spark, "near")
        _near(index, qs, norms, skips, now, k, where, list(also)).drop("rank").write.parquet(path)
        got = index.spark.read.parquet(path)
        mask = first
        if exact:
            # The k-th distance so far, of those queries that have k rows.
            worst = np.full(len(qs), np.inf)
            for q, d in got.groupBy("_q").agg(F.count("*").alias("n"), F.max("distance").alias("d")).filter(f"n >= {k}").select("_q", "d").collect():
                worst[q] = d
            more = ~first & (least <= worst[:, None])
            mask = first | more
            got = got.unionByName(_near(index, qs, norms, skips, wanted(more), k, where, list(also)).drop("rank"))
        if work is not None:
            sizes = np.array([index.cells[c][0] for c in cells])
            alone = index.cells.get(NO_CELL, (0,))[0]
            work.append((int((mask @ sizes).sum()) + alone * len(qs), index.rows * len(qs)))
        names = index.spark.createDataFrame([(i, x) for i, x in enumerate(held.column(0).to_pylist())], Y.StructType([Y.StructField("_q", Y.IntegerType()), part.schema["query_id"]]))
        ranked = first_rows(got, ["_q"], [F.round("distance", 9), F.col(index.id_col)], k)
        ranked = ranked.join(F.broadcast(names), "_q").select("query_id", index.id_col, "distance", "rank", *also)
        out = ranked if out is None else out.unionByName(ranked)
    return out
