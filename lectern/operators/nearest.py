"""Nearest vectors of blocks: queries and chunks meet in cells, each a group of one task.

Spark deals both sides into blocks and brings each pair of blocks together. In a
cell single-precision products only rule pairs out, by a bound on their error;
what is left is computed in double precision, component by component in order.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of chunks that meet a block of queries in one task, and the least worth a task; the least queries worth one.
CHUNK_BLOCK, LEAST_BLOCK, LEAST_QUERIES = 65_536, 2_048, 256
#: Queries and chunks whose products are held at once; pairs computed at once.
TILE, PAIRS = (256, 16_384), 65_536
#: The least queries that see the same values and get tiles of their own.
ALIKE = 64
#: Similarities so close may be equal at nine places.
CLOSE = 1.1e-9
EPSILON = 1e-9


class _Side:
    """The vectors of a block by their lengths: a null vector, or one that holds a null, has length -1."""

    def __init__(self, column: pa.ChunkedArray):
        a = pa.concat_arrays([c.cast(pa.list_(pa.float64())) for c in column.chunks]) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
        self.length = pc.fill_null(pc.list_value_length(a), -1).to_numpy().astype(np.int64)
        if a.flatten().null_count:
            self.length[np.unique(pc.list_parent_indices(a).to_numpy()[pc.is_null(a.flatten()).to_numpy(zero_copy_only=False)])] = -1
        self.rows: dict[int, np.ndarray] = {}
        self.at = np.zeros(len(a), np.int64)
        for n in np.unique(self.length[self.length >= 0]):
            own = np.flatnonzero(self.length == n)
            self.at[own] = np.arange(len(own))
            self.rows[int(n)] = a.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), int(n))
        with np.errstate(all="ignore"):
            self.norms = {n: np.sqrt(_in_order(v, v)) for n, v in self.rows.items()}
            self.units = {n: _units(v, self.norms[n]) for n, v in self.rows.items()}
        #: Vectors whose products single precision says nothing about.
        self.odd = {n: ~np.isfinite(x) for n, x in self.norms.items()}


def _units(v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    out = np.zeros(v.shape, np.float32)
    some = (norms > 0) & np.isfinite(norms)
    out[some] = v[some] / norms[some, None]
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def _similarities(q: _Side, c: _Side, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The similarity of each pair of rows of ``n`` components."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            out[k : k + PAIRS] = _in_order(q.rows[n][a], c.rows[n][b]) / (q.norms[n][a] * c.norms[n][b] + EPSILON)
    return out


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """A number for each distinct row of some columns; nulls are a value."""
    out = np.zeros(table.num_rows, np.int64)
    for name in names:
        d = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        _, out = np.unique(out * (len(d.dictionary) + 1) + d.indices.to_numpy(), return_inverse=True)
    return out


def _allowed(queries: pa.Table, chunks: pa.Table, among: tuple[str, str] | None):
    """Codes of the chunks' values, and for a tile of queries what each may see; None if all see all."""
    if among is None:
        return None, None
    asked, column = queries[among[0]].combine_chunks(), chunks[among[1]].combine_chunks()
    asked, column = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (asked, column))
    values = pc.unique(pc.drop_null(column))
    place = {v: k for k, v in enumerate(values.to_pylist())}
    codes = np.array([place.get(v, len(place)) for v in column.to_pylist()], np.int64)

    def seen(rows: range) -> np.ndarray:
        out = np.zeros((len(rows), len(place) + 1), bool)
        for k, wanted in enumerate(asked.slice(rows.start, len(rows)).to_pylist()):
            if wanted is not None and not len(wanted):
                out[k] = True
            out[k, [place[v] for v in wanted or () if v in place]] = True
        return out

    return codes, seen


def _tiles(queries: pa.Table, among: tuple[str, str] | None) -> tuple[pa.Table, list[tuple[range, int]]]:
    """The queries in tiles: many that see the same values stand together under a number, the others under -1."""

    def cut(a: int, b: int, run: int) -> list[tuple[range, int]]:
        return [(range(x, min(x + TILE[0], b)), run) for x in range(a, b, TILE[0])]

    if among is None or not queries.num_rows:
        return queries, cut(0, queries.num_rows, -1)
    numbers: dict = {}
    run = np.array([numbers.setdefault(None if v is None else frozenset(v), len(numbers)) for v in queries[among[0]].to_pylist()], np.int64)
    run[np.bincount(run)[run] < ALIKE] = -1
    order = np.argsort(run, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(run[order])) + 1, len(order)]
    return queries.take(pa.array(order)), [t for a, b in zip(starts[:-1], starts[1:], strict=True) for t in cut(int(a), int(b), int(run[order[a]]))]


def _where(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true places of a table that has few, looking at eight places at once."""
    flat = np.ascontiguousarray(found).ravel()
    whole = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.r_[near[flat[near]], whole + np.flatnonzero(flat[whole:])]
    return np.divmod(at, max(1, found.shape[1]))


def _first(q: np.ndarray, s: np.ndarray, j: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs by query and falling similarity: the first ``k`` of each and those that rounding could bring among them; and the queries' ``k``-th."""
    down = np.where(np.isnan(s), np.inf, -s)
    order = np.lexsort((place[j], down, q))
    q, s, j, down = q[order], s[order], j[order], down[order]
    new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    position = np.arange(len(q)) - start
    value = new | np.r_[True, down[1:] != down[:-1]] if len(q) else new
    run = np.arange(len(q)) - np.maximum.accumulate(np.where(value, np.arange(len(q)), 0))
    last = np.minimum(start + k - 1, len(q) - 1)
    same = q[last] == q if len(q) else new
    limit = np.where(same, down[last], np.inf)
    keep = (position < k) | ((run < k) & (down <= limit + CLOSE))
    return q[keep], s[keep], j[keep], limit[keep]


def _up(x: float) -> float:
    """A number at twelve places, halves away from zero, as Spark rounds it."""
    return float(decimal.Decimal(repr(float(x))).quantize(decimal.Decimal("1e-12"), decimal.ROUND_HALF_UP)) if np.isfinite(x) else x


def _ahead(s: np.ndarray, ids: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether pairs stand before a query's first relevant one, by the similarity at twelve places and then by id."""
    out = s > first
    near = np.flatnonzero(np.abs(s - first) < 1e-11)
    values, back = np.unique(s[near], return_inverse=True)
    rounded = np.array([_up(v) for v in values])[back] if len(near) else values
    out[near] = (rounded > first[near]) | ((rounded == first[near]) & (ids[near] < own[near]))
    return out


def _cell(queries: pa.Table, chunks: pa.Table, k: int, by: list[str], skip: str | None, among, counted: str | None) -> pa.Table:
    """The best pairs of two blocks, all columns but the vectors beside ``similarity``; with ``counted`` also ``n_before``."""
    order = pc.sort_indices(chunks, sort_keys=[("chunk_id", "ascending")])
    chunks = chunks.take(order)
    queries, tiles = _tiles(queries, among)
    q, c = _Side(queries["qvec"]), _Side(chunks["embedding"])
    groups, (codes, seen) = _codes(chunks, by), _allowed(queries, chunks, among)
    ids = _codes(chunks, ["chunk_id"])
    most = int(np.bincount(ids).max()) if skip is not None and len(ids) else 1
    own = None
    if skip is not None:
        known = dict(zip(chunks["chunk_id"].to_pylist(), ids.tolist(), strict=True))
        own = np.array([known.get(v, -1) if v is not None else -1 for v in queries[skip].to_pylist()], np.int64)
    want = k + (most if skip is not None else 0)
    place = np.arange(chunks.num_rows)
    limits = queries[counted].to_pylist() if counted else None
    left, right, scores, before = [], [], [], []
    parts = {int(g): np.flatnonzero(groups == g) for g in np.unique(groups)}
    for g, members in parts.items():
        by_length = {n: members[c.length[members] == n] for n in c.rows}
        by_length = {n: m if counted else _once(c, n, m, codes, want) for n, m in by_length.items() if len(m)}
        value = chunks[by[0]][int(members[0])].as_py() if counted else None
        held = None
        for tile, run in tiles:
            may = seen(tile) if seen else None
            if run != held:
                # What all of a run may see is left to them beforehand; the others' tiles hide what each may not.
                held, mine = run, by_length if run < 0 else {n: m[may[0][codes[m]]] for n, m in by_length.items()}
                units = {n: c.units[n][c.at[m]] for n, m in mine.items()}
            at, sim, row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            limit = np.full(len(tile), -np.finfo(np.float32).max, np.float64)
            if counted:
                firsts = [(limits[t] or {}) for t in tile]
                firsts = [dict(f).get(value) for f in firsts]
                f_cos = np.array([np.inf if f is None else f["cos"] for f in firsts])
                f_own = np.array([-1 if f is None else -f["c"] for f in firsts], np.int64)
                n_before = np.zeros(len(tile), np.int64)
                chunk_ids = chunks["chunk_id"].to_numpy()
            for n, m in mine.items():
                here = np.flatnonzero(q.length[tile.start : tile.stop] == n)
                if not len(here):
                    continue
                qi = q.at[tile.start + here]
                margin = (n + 24) * 1.2e-7
                for b in range(0, len(m), TILE[1]):
                    rows = m[b : b + TILE[1]]
                    ci = c.at[rows]
                    s = q.units[n][qi] @ units[n][b : b + TILE[1]].T
                    norms, lengths = q.norms[n][qi], c.norms[n][ci]
                    with np.errstate(all="ignore"):
                        if min(np.min(norms, where=norms > 0, initial=np.inf), 1e9) * min(np.min(lengths, where=lengths > 0, initial=np.inf), 1e9) < 1e-2:
                            both = norms[:, None] * lengths
                            s *= (both / (both + EPSILON)).astype(np.float32)
                    hidden = None if may is None or run >= 0 else ~may[here][:, codes[rows]]
                    if hidden is not None:
                        s[hidden] = -np.inf
                    odd_q, odd_c = q.odd[n][qi], c.odd[n][ci]
                    strange = odd_q.any() or odd_c.any()
                    if counted:
                        sure = s > (f_cos[here, None] + margin).astype(np.float32)
                        near = s >= (f_cos[here, None] - margin).astype(np.float32)
                        n_before[here] += np.count_nonzero(sure, axis=1)
                        near ^= sure
                        if strange:
                            # Of these nothing is sure: all are compared.
                            unsafe = odd_q[:, None] | odd_c[None, :]
                            n_before[here] -= np.count_nonzero(sure & unsafe, axis=1)
                            near |= unsafe
                        i, j = _where(near)
                        exact = _similarities(q, c, n, qi[i], ci[j])
                        np.add.at(n_before, here[i], _ahead(exact, chunk_ids[rows[j]], f_cos[here[i]], f_own[here[i]]))
                    if strange:
                        s[odd_q] = -np.inf
                        s[:, odd_c] = -np.inf
                    if (limit[here] < -2).any() and len(rows) > want:
                        t = np.partition(s, len(rows) - want, axis=1)[:, len(rows) - want]
                        limit[here] = np.maximum(limit[here], t - 2 * margin - CLOSE)
                    found = s >= (limit[here, None] - 2e-7).astype(np.float32)
                    if strange:
                        found |= odd_q[:, None] | odd_c[None, :]
                        if hidden is not None:
                            found &= ~hidden
                    i, j = _where(found)
                    if own is not None:
                        other = ids[rows[j]] != own[tile.start + here[i]]
                        i, j = i[other], j[other]
                    if not len(i):
                        continue
                    exact = _similarities(q, c, n, qi[i], ci[j])
                    at, sim, row, last = _first(np.r_[at, here[i]], np.r_[sim, exact], np.r_[row, rows[j]], place, k)
                    limit[at] = np.maximum(limit[at], np.where(np.isfinite(last), -last - margin - CLOSE, limit[at]))
            unknown = _without(q, c, members, tile, np.bincount(at, minlength=len(tile)), k, ids, own, codes, may)
            left.append(np.r_[at, unknown[0]] + tile.start)
            right.append(np.r_[row, unknown[1]])
            scores.append(np.r_[sim, np.full(len(unknown[0]), np.inf)])
            if counted:
                rows = np.r_[at, unknown[0]]
                once = np.zeros(len(rows), bool)
                once[np.unique(rows, return_index=True)[1]] = True
                before.append(np.where(np.isinf(f_cos[rows]), -1, np.where(once, n_before[rows], 0)))
    l, r, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, scores))
    unknown = ~np.isfinite(s) & (s > 0) if len(s) else np.zeros(0, bool)
    unknown &= (q.length[l] != c.length[r]) | (q.length[l] < 0)
    out = queries.drop_columns(["qvec", counted] if counted else ["qvec"]).take(pa.array(l, pa.int64()))
    for name in chunks.column_names:
        if name != "embedding":
            out = out.append_column(name, chunks[name].take(pa.array(r, pa.int64())))
    out = out.append_column("similarity", pa.array(s, pa.float64(), mask=unknown))
    if counted:
        ahead = np.concatenate(before)
        out = out.append_column("n_before", pa.array(ahead, pa.int64(), mask=ahead < 0))
    return out


def _once(c: _Side, n: int, rows: np.ndarray, codes: np.ndarray | None, want: int) -> np.ndarray:
    """``rows`` without those that have more than ``want`` equal ones before them."""
    if len(rows) <= want or not n:
        return rows
    key = np.ascontiguousarray(c.rows[n][c.at[rows]]).view(np.dtype((np.void, 8 * n))).ravel()
    _, same = np.unique(key, return_inverse=True)
    if codes is not None:
        _, same = np.unique(same * (codes.max() + 1) + codes[rows], return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(same[order])) + 1]
    nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return np.sort(rows[order[nth < want]])


def _without(q, c, members, tile, counts, k, ids, own, codes, may):
    """Pairs without a similarity, the first by id, for queries that have fewer than ``k`` others."""
    left, right = [], []
    lengths = c.length[members]
    for t in np.flatnonzero(counts < k):
        n = q.length[tile.start + t]
        rows = members if n < 0 else members[lengths != n]
        if may is not None:
            rows = rows[may[t][codes[rows]]]
        if own is not None:
            rows = rows[ids[rows] != own[tile.start + t]]
        rows = rows[: k - counts[t]]
        left.append(np.full(len(rows), t, np.int64))
        right.append(rows)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def layout(n_queries: int, n: int, k: int, query_block: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of chunks: cells for as many tasks as the rows are worth, and of these layouts the one that deals and leaves the fewest rows.

    Each block of queries meets a copy of all chunks, each block of chunks leaves
    ``k`` rows for every query.
    """
    across, down = max(1, -(-n_queries // query_block)), max(1, -(-n // CHUNK_BLOCK))
    widest = max(across, -(-n_queries // LEAST_QUERIES))

    def shape(d: int) -> tuple[int, int]:
        return min(widest, max(across, -(-tasks // d))), d

    def cost(s: tuple[int, int]) -> tuple[int, int]:
        return max(0, tasks - s[0] * s[1]), s[0] * n + s[1] * n_queries * k

    return min((shape(d) for d in range(down, max(down, min(tasks, -(-n // LEAST_BLOCK))) + 1)), key=cost)


def pairs(queries: DataFrame, chunks: DataFrame, k: int, query_block: int, by: tuple[str, ...] = (), skip: str | None = None, among: tuple[str, str] | None = None, counted: str | None = None) -> DataFrame:
    """The columns of both sides but the vectors, and ``similarity``: of each pair of blocks the ``k`` nearest rows of each query, and those that may tie with them.

    ``skip`` is the queries' column of the chunk id that a query does not see,
    ``among`` a column of the queries with the values of a column of the chunks
    that they see; an empty array sees all. ``counted`` is a map of the queries,
    by the chunks' column ``by``, to the place (cos, c) before which all rows
    are counted in ``n_before``, at the first of a block's rows for a query (null where the map has none). Vectors of other lengths and null ones have no similarity.
    """
    n_queries, n = queries.count(), chunks.count()
    across, down = layout(n_queries, n, k, query_block, 2 * queries.sparkSession.sparkContext.defaultParallelism)
    own_q, own_c = F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int"), F.pmod(F.xxhash64("chunk_id"), F.lit(down)).cast("int")
    q = queries.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda b: own_q * down + b)))
    c = chunks.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda b: b * down + own_c)))
    tasks = min(3 * across * down, max(200, across * down))
    q, c = q.repartition(tasks, "_cell"), c.repartition(tasks, "_cell")
    fields = [f for f in queries.schema.fields if f.name not in ("qvec", counted)] + [f for f in chunks.schema.fields if f.name != "embedding"]
    fields = [Y.StructField(f.name, f.dataType) for f in fields] + [Y.StructField("similarity", Y.DoubleType())] + ([Y.StructField("n_before", Y.LongType())] if counted else [])

    empty = to_arrow_schema(Y.StructType(fields)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return _cell(left.drop_columns(["_cell"]), right.drop_columns(["_cell"]), k, list(by), skip, among, counted)

    return q.groupBy("_cell").cogroup(c.groupBy("_cell")).applyInArrow(run, Y.StructType(fields))
