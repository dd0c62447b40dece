"""Exact k-nearest-neighbour join (J1) and mutual-pair join.

Plan, for query rows ``L`` and reference rows ``R`` (vectors as ``array<double>``):

1. **Pivots.** ``P`` reference rows with the smallest keyed hash (a bounded
   ``limit`` of about the square root of the rows) are collected; every reference row goes to its nearest pivot's
   cell.  Per cell we keep count and radius (max distance to the pivot) — a
   table of at most ``groups × P`` rows.
2. **Pruning.** For a query ``q`` with pivot distances ``D``, cells sorted by
   ``D + radius`` give an upper bound ``ub`` on its k-th neighbour distance
   (enough points lie within it).  A cell can hold a neighbour only if
   ``D - radius <= ub`` (triangle inequality), so only those cells are
   candidates.  Cells that lie close together are merged into regions of about
   ``block`` rows (:func:`merged_cells`) and a query goes once to each region that
   holds a candidate, so its copies don't grow with the number of cells.  The result stays exact.
   With few dimensions (``FLAT_DIMS``) and several regions there is a round before this: each query is searched in the
   cell of its nearest pivot alone, and the k-th distance found there is a far smaller bound.  Blocks then take leaf by leaf
   and only the queries whose bound reaches the leaf's box (:func:`_rows_within`).
3. **Bounded blocks.** A region's reference rows are split by hash into blocks of
   about ``block`` rows and its candidate queries into chunks of about
   ``block`` rows; each (region, block, chunk) group is one cogroup task.  Inside it both sides are
   halved into leaves (:func:`_leaves`); a tile of queries looks into the leaves by distance, each bounded by
   the k-th distance so far, and the task emits only its top-k per query.
   Equal rows and equal queries of a block are searched once.  Vectors are shuffled as bytes, in single precision
   where that loses nothing.  No pair rows are written.  Where pruning finds little (high
   dimension) the search stays quadratic: a vector is copied once per block of
   the other side, so larger blocks copy less and take more memory.
4. **Merge.** Per query, the top-k over its candidate blocks (``row_number``
   over ``(dist, id)``): a window over at most ``k × blocks`` rows.

Ties are broken by the reference id.  Self-pairs are excluded on request
(same id), duplicates with different ids are kept at distance 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.functions.hashing import hash32
from tabula.operators.ranking import join_small
from tabula.session import cut_lineage

# Rows of the table of cells by group that are shipped with a task (four numbers each).
STATS_ROWS = 200_000
# Numbers in one temporary array of a task (32 MB of doubles).
TILE = 1 << 22
# Rows of a block between these bounds: as many blocks as give each core a few tasks, so that large tables have few copies
# and small ones several tasks.  Numbers of a block's vectors.
BLOCK_ROWS, BLOCK_NUMBERS = (2048, 131_072), 1 << 23
# Rows of a leaf, and queries of a tile (more where leaves can't be told apart by distance; products of such tiles stay
# in a core's cache).
LEAF, TILE_QUERIES, FLAT_DIMS, FLAT_TILE = 256, (256, 1024), 16, 1 << 20
# Rows for each combination of categories in a block from which on combinations have leaves of their own.
COMBINED = 64
# Copies of an id up to which equal queries of a block are searched as one.
ID_COPIES = 8


def packed(m: np.ndarray) -> list[bytes]:
    """Each row as bytes: single precision where that loses nothing, else double."""
    with np.errstate(over="ignore"):
        single = m.astype(np.float32)
    short, width = (single == m).all(axis=1), 4 * m.shape[1]
    a, b = single.tobytes(), np.ascontiguousarray(m).tobytes()
    return [a[i * width:(i + 1) * width] if s else b[2 * i * width:2 * (i + 1) * width] for i, s in enumerate(short)]


def unpacked(rows: np.ndarray, dims: int) -> np.ndarray:
    """The matrix of rows made by :func:`packed`."""
    out = np.empty((len(rows), dims))
    double = np.fromiter(map(len, rows), np.int64, len(rows)) > 4 * dims
    for part, kind in ((~double, np.float32), (double, np.float64)):
        if part.any():
            out[part] = np.frombuffer(b"".join(rows[part]), kind).reshape(-1, dims)
    return out


def _numbers(m: np.ndarray, n_cat: int) -> np.ndarray:
    return m[:, :m.shape[1] - n_cat - 1] if n_cat else m


def _mismatches(a: np.ndarray, b: np.ndarray, n_cat: int) -> np.ndarray:
    """Number of differing category codes, rows of ``a`` × rows of ``b``."""
    out = np.zeros((len(a), len(b)))
    for c in range(-n_cat - 1, -1):
        out += a[:, c, None] != b[None, :, c]
    return out


def _slices(n: int, pivots: np.ndarray):
    """Slices of ``n`` rows so that rows × pivots of one stay below ``TILE`` numbers."""
    step = max(1, TILE // max(1, len(pivots)))
    return (slice(s, s + step) for s in range(0, n, step))


def _squares(m: np.ndarray, pivots: np.ndarray, n_cat: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances rows × pivots by one matrix product, a bound on the rounding error of each row's)."""
    x, p = _numbers(m, n_cat), _numbers(pivots, n_cat)
    with np.errstate(over="ignore", invalid="ignore"):
        x2, p2 = (x * x).sum(1), (p * p).sum(1)
        d2 = x2[:, None] + p2[None, :] - 2.0 * (x @ p.T)
        if n_cat:
            d2 += m[:, -1, None] * _mismatches(m, pivots, n_cat)
    return d2, 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (x2 + p2.max(initial=0.0))


def _nearest(m: np.ndarray, pivots: np.ndarray, n_cat: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a nearest pivot, exact distance to it) of each row; near ties may go either way, radii are measured."""
    at, d = np.zeros(len(m), np.int64), np.empty(len(m))
    for part in _slices(len(m), pivots):
        at[part] = np.nan_to_num(_squares(m[part], pivots, n_cat)[0], nan=np.inf).argmin(1)
        own = pivots[at[part]]
        with np.errstate(over="ignore"):
            diff = _numbers(m[part], n_cat) - _numbers(own, n_cat)
            d2 = (diff * diff).sum(1)
            for c in range(-n_cat - 1, -1):
                d2 = d2 + m[part][:, -1] * (m[part][:, c] != own[:, c])
        d[part] = np.sqrt(d2)
    return at, d


def block_rows(n: int, dims: int, cores: int = 22) -> int:
    """Rows of a block for ``n`` reference rows of ``dims`` numbers: blocks by chunks make about three tasks a core."""
    low, high = BLOCK_ROWS
    parts = min(8, math.ceil(math.sqrt(3 * cores)))
    return max(1, min(max(low, min(-(-n // parts), high)), BLOCK_NUMBERS // max(1, dims)))


def _leaves(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of ``x`` in leaves of at most ``rows`` rows: halved at the median of the widest column."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        part = x[at]
        with np.errstate(over="ignore"):
            v = part[:, int(np.argmax(part.max(0) - part.min(0)))] if x.shape[1] else np.zeros(len(at))
        half = np.argpartition(v, len(at) // 2)
        todo += [at[half[len(at) // 2:]], at[half[:len(at) // 2]]]
    return out


def _alike_leaves(x: np.ndarray, alike: np.ndarray, rows: int) -> list[np.ndarray]:
    """Leaves (:func:`_leaves`) of rows that have one number in ``alike``."""
    order = np.argsort(alike, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(alike[order])) + 1)
    return [part[at] for part in parts for at in _leaves(x[part], rows)]


def _balls(x: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(centre, radius) of each leaf."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre = np.stack([x[at].mean(0) for at in leaves])
        radius = np.array([np.sqrt(((x[at] - c) ** 2).sum(1).max()) for at, c in zip(leaves, centre)])
    return centre, radius


def merged_cells(points: np.ndarray, cells: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """A region number for each of ``cells`` (numbers of ``points``): neighbouring cells together, up to ``block`` rows."""
    place = np.empty(len(points), np.int64)
    place[np.concatenate(_leaves(points, 1))] = np.arange(len(points))  # halving puts near points side by side
    region, held, at = np.empty(len(cells), np.int32), 0, 0
    for i in np.argsort(place[cells], kind="stable"):
        if held and held + sizes[i] > block:
            at, held = at + 1, 0
        region[i], held = at, held + sizes[i]
    return region


def finite_vector(v: Column) -> Column:
    """True if every element of the vector is a finite number (the sum of ``x - x`` is zero only then)."""
    return F.coalesce(F.forall(v, lambda x: F.coalesce((x - x) == F.lit(0.0), F.lit(False))), F.lit(False))


def knn(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, vec: str = "vec",
        group: str | None = None, exclude_self: bool = False, n_pivots: int | None = None,
        block: int | None = None, seed: int = 42, n_cat: int = 0) -> DataFrame:
    """``(qid, rank, nid, dist)`` — the ``k`` nearest reference rows of every query row.

    ``group`` restricts neighbours to rows with the same group value (e.g. the
    same class).  ``dist`` is the Euclidean distance.  Ids must be unique on
    each side.  A vector with a NULL, NaN or infinite element has no distance:
    such a row has no neighbours and is nobody's.

    Mixed data: with ``n_cat`` the vectors end in that many category codes and a weight (one per group); each code that
    differs adds the weight to the squared distance.  Codes are compared, not expanded, whatever their number.
    """
    spark = left.sparkSession
    gcol = [group] if group else []
    L = left.select(F.col(left_id).alias("qid"), *gcol, F.col(vec).cast("array<double>").alias("v"))
    R = right.select(F.col(right_id).alias("rid"), *gcol, F.col(vec).cast("array<double>").alias("v"))
    if group:
        L, R = L.withColumnRenamed(group, "g"), R.withColumnRenamed(group, "g")
    else:
        L, R = L.withColumn("g", F.lit(0)), R.withColumn("g", F.lit(0))
    L, R = L.where(finite_vector(F.col("v"))), R.where(finite_vector(F.col("v")))
    need = k + (1 if exclude_self else 0)

    n_r = R.count()
    if n_r == 0:
        return spark.createDataFrame([], f"qid {L.schema['qid'].dataType.simpleString()}, rank int, "
                                         f"nid {R.schema['rid'].dataType.simpleString()}, dist double")
    p = n_pivots or max(1, round(math.sqrt(n_r / 8.0)))
    piv_rows = R.orderBy(hash32(seed, "rid", "pivot"), "rid").limit(p).select("v").collect()
    pivots = np.array([r["v"] for r in piv_rows], dtype=np.float64)
    block = block or block_rows(n_r, pivots.shape[1], spark.sparkContext.defaultParallelism)

    cell_schema = "cell int, d double, v binary"
    dims = pivots.shape[1]

    @F.pandas_udf(cell_schema)
    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        m = np.stack(v.to_numpy()) if len(v) else np.empty((0, dims))
        at, d = _nearest(m, pivots, n_cat) if len(v) else (np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"cell": at.astype("int32"), "d": d, "v": packed(m)})

    # Vectors are packed once, in the pass that looks at them anyway; what is stored and shuffled is the packed form.
    Rc = R.withColumn("_c", nearest_pivot("v")).select("rid", "g", "_c.v", "_c.cell", "_c.d")
    Rc = cut_lineage(Rc)
    stats = cut_lineage(Rc.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("cnt"), F.max("d").alias("radius")))
    if stats.limit(STATS_ROWS + 1).count() > STATS_ROWS:
        # Very many groups: each has few rows, and all of its own are searched.
        own = stats.select(F.col("g").alias("_g")).distinct()
        Lc = cut_lineage(L.join(own, F.col("g") == F.col("_g")).select("qid", "g", F.array(F.lit(0)).alias("cells"), pack_column(F.col("v")).alias("v")))
        Lx = cell_pairs(Lc, L, L.select("qid", pack_column(F.col("v")).alias("v")))
        Rx = Rc.select("rid", "g", F.lit(0).alias("cell"), "v")
    else:
        tables = _tables(stats, pivots, block, n_cat)
        # A row per query with its regions: the copies are made when the blocks are built and are not written.
        if not n_cat and dims <= FLAT_DIMS and any(t[3].max(initial=0) for t in tables.values()) and _unique(L):
            Lc = cut_lineage(_bounded(L, Rc, tables, pivots, k, exclude_self, block))
            Lx = cell_pairs(Lc, None, None)
        else:
            Lc = cut_lineage(L.select("qid", "g", _candidates(tables, pivots, need, n_cat)("g", "v").alias("_c")).select("qid", "g", "_c.cells", "_c.v"))
            Lx = cell_pairs(Lc, Lc, Lc.select("qid", "v"))
        merged = spark.createDataFrame([(g, int(c), int(m)) for g, (cells, _, _, region) in tables.items() for c, m in zip(cells, region)],
                                       T.StructType([stats.schema["g"], T.StructField("cell", T.IntegerType()), T.StructField("region", T.IntegerType())]))
        Rx = join_small(Rc, merged, on=["g", "cell"]).select("rid", "g", F.col("region").alias("cell"), "v")
    return search_cells(None, Lx, Rx, k, exclude_self, block, seed, n_cat, dims)


def _bounded(L: DataFrame, Rc: DataFrame, tables: dict, pivots: np.ndarray, k: int, exclude_self: bool, block: int) -> DataFrame:
    """(qid, g, cells, v, b): the queries, their regions and ``b``, a squared distance that the k-th neighbour is within: that of
    the k-th row in the cell of the query's nearest pivot (infinite where the cell has fewer)."""
    dims = pivots.shape[1]
    first = cut_lineage(L.select("qid", "g", _first_cells(tables, pivots)("g", "v").alias("_c")).select("qid", "g", "_c.cell", "_c.v"))
    found = search_cells(None, first.where("qid is not null and cell is not null"), Rc.select("rid", "g", "cell", "v"), k, exclude_self, block, dims=dims)
    kth = found.groupBy("qid").agg(F.count(F.lit(1)).alias("got"), F.max("dist").alias("kth"))
    known = F.when(F.col("got") >= k, F.col("kth") * F.col("kth") * (1 + 1e-9)).otherwise(F.lit(float("inf")))
    q = first.join(kth, "qid", "left").select("qid", "g", "v", known.alias("b"))
    return q.select("qid", "g", _candidates(tables, pivots, k + bool(exclude_self), 0, dims)("g", "v", "b").alias("_c"), "b") \
        .select("qid", "g", "_c.cells", "_c.v", "b")


def _first_cells(tables: dict, pivots: np.ndarray):
    """The function from (group, vector) to the group's cell of the nearest pivot, and the packed vector."""

    @F.pandas_udf("cell int, v binary")
    def first(g: pd.Series, v: pd.Series) -> pd.DataFrame:
        gv, m = g.to_numpy(), np.stack(v.to_numpy()) if len(v) else np.empty((0, pivots.shape[1]))
        cell = pd.array([None] * len(m), dtype="Int32")
        for key in pd.unique(gv):
            if key in tables:
                rows, cells = np.flatnonzero(gv == key), tables[key][0]
                cell[rows] = cells[_nearest(m[rows], pivots[cells], 0)[0]].astype("int32")
        return pd.DataFrame({"cell": cell, "v": packed(m) if len(m) else []})

    return first


def _unique(queries: DataFrame) -> bool:
    return queries.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and qid is not null").isEmpty()


def cell_pairs(stored: DataFrame, queries: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """(qid, g, cell, v), a row per cell of each of the ``stored`` queries (qid, g, cells, v); no id, no search.  A column ``b`` goes along.

    Where an id of ``queries`` repeats, its rows share cells and ``vectors`` (qid, v) by a join on the id, so its neighbours repeat
    (None: no id repeats)."""
    pairs = stored.where(F.col("qid").isNotNull()).select("qid", "g", F.explode("cells").alias("cell"), "v", *[c for c in ("b",) if c in stored.columns])
    if queries is None or _unique(queries):
        return pairs
    return pairs.drop("v", "b").join(vectors, on="qid")


def pack_column(v: Column) -> Column:
    """A column of vectors (``array<double>``) packed by :func:`packed`."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return pd.Series(packed(np.stack(v.to_numpy())) if len(v) else [], dtype=object)

    return pack(v)


def _tables(stats: DataFrame, pivots: np.ndarray, block: int, n_cat: int) -> dict:
    """Group → its (cells, rows, radii, regions)."""
    by_group: dict = {}
    for r in stats.where(F.col("g").isNotNull()).collect():  # at most STATS_ROWS rows of four numbers
        by_group.setdefault(r["g"], []).append((r["cell"], r["cnt"], r["radius"]))
    out = {}
    for g, rows in by_group.items():
        cells, cnt = np.array([c for c, _, _ in rows]), np.array([n for _, n, _ in rows], dtype=np.int64)
        points = np.unique(cells)  # one row per cell of the group
        region = merged_cells(_numbers(pivots[points], n_cat), np.searchsorted(points, cells), cnt, block)
        out[g] = cells, cnt, np.array([rad for _, _, rad in rows]), region
    return out


def _candidates(tables: dict, pivots: np.ndarray, need: int, n_cat: int, dims: int | None = None):
    """The function from (group, vector) to the regions of the group that may hold one of the ``need`` nearest rows, and the packed vector.
    With ``dims`` the vectors are packed ones, and a third argument is a squared distance that those rows are within."""

    def prune(m: np.ndarray, most: np.ndarray | float, cells: np.ndarray, cnt: np.ndarray, rad: np.ndarray, region: np.ndarray) -> list:
        """Regions of the candidate cells for queries of one group (vectorised)."""
        d2, slack = _squares(m, pivots[cells], n_cat)
        with np.errstate(invalid="ignore"):
            low, high = np.sqrt(np.maximum(d2 - slack[:, None], 0)), np.sqrt(np.maximum(d2, 0) + slack[:, None])
        low, high = np.nan_to_num(low, nan=0.0), np.nan_to_num(high, nan=np.inf)  # numbers beyond doubles prune nothing
        upper = high + rad
        full = cnt >= need
        if full.any():  # one cell holds enough rows: no order of all cells is needed
            ub = upper[:, full].min(axis=1)
        else:
            order = np.argsort(upper, axis=1, kind="stable")
            reach = np.cumsum(cnt[order], axis=1)
            j = np.minimum((reach < need).sum(axis=1), len(cells) - 1)
            ub = np.take_along_axis(upper, order, axis=1)[np.arange(len(m)), j]
        ok = (low - rad) <= (np.minimum(ub, most) * (1 + 1e-9) + 1e-12)[:, None]
        return [np.unique(region[row]).tolist() for row in ok]

    @F.pandas_udf("cells array<int>, v binary")
    def candidate_cells(g: pd.Series, v: pd.Series, *b: pd.Series) -> pd.DataFrame:
        out = [[] for _ in range(len(v))]
        gv, vectors = g.to_numpy(), v.to_numpy() if dims is None else list(unpacked(v.to_numpy(), dims)) if len(v) else []
        most = np.sqrt(b[0].to_numpy()) if b else np.full(len(v), np.inf)
        if dims is not None:
            vectors = np.array([None, *vectors], dtype=object)[1:]  # of rows, not a matrix
        for key in pd.unique(gv):
            tab = tables.get(key)
            if tab is None:
                continue
            rows = np.flatnonzero(gv == key)
            for part in _slices(len(rows), pivots):
                for i, cand in zip(rows[part], prune(np.stack(vectors[rows[part]]), most[rows[part]], *tab)):
                    out[i] = cand
        return pd.DataFrame({"cells": pd.Series(out, dtype=object), "v": packed(np.stack(vectors)) if len(v) else []})

    return candidate_cells


def _same_rows(m: np.ndarray) -> np.ndarray:
    """A number for each row; equal rows, and only they, have the same."""
    if not m.shape[1]:
        return np.zeros(len(m), np.int64)
    whole = np.ascontiguousarray(m).view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel()
    return np.unique(whole, return_inverse=True)[1].ravel()


def _marked(passed: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` for matrices with few marks: eight at a time."""
    flat = passed.ravel()
    even = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], even + np.flatnonzero(flat[even:])])


def _block_topk(qid: np.ndarray, whole_q: np.ndarray, rid: np.ndarray, whole_x: np.ndarray, need: int, exclude_self: bool, n_cat: int,
                bound: np.ndarray | None = None) -> pd.DataFrame:
    """``(qid, nid, d2)``: the ``need`` nearest rows of each query in one block, by exact squared distances, ties by id; rows beyond
    a query's ``bound``, a squared distance, may be left out.

    Of equal reference rows those of the smallest ids count, no more than can be among the nearest, and equal queries
    are searched once, for as many rows more as have one query's id."""
    rank_of_id, _ = pd.factorize(rid, sort=True)
    kind = _same_rows(whole_x)
    if kind.max(initial=-1) + 1 < len(kind):
        order = np.lexsort((rank_of_id, kind))
        k_, r_ = kind[order], rank_of_id[order]
        fresh = np.append(True, k_[1:] != k_[:-1])
        seen = np.cumsum(fresh | np.append(True, r_[1:] != r_[:-1]))  # ids of a row met so far, over all rows
        keep = np.sort(order[seen - seen[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] < need + exclude_self])
        rid, whole_x, rank_of_id = rid[keep], whole_x[keep], rank_of_id[keep]
    self_of = pd.factorize(np.concatenate([pd.Series(qid).to_numpy(object), pd.Series(rid).to_numpy(object)]))[0] if exclude_self else None
    copies = int(np.bincount(rank_of_id + 1).max(initial=0)) if exclude_self else 0
    same = _same_rows(whole_q)
    n_same = int(same.max(initial=-1)) + 1
    if 2 * n_same > len(qid) or copies > ID_COPIES:
        own = (self_of[:len(qid)], self_of[len(qid):]) if exclude_self else None
        row, col, d2 = _nearest_rows(whole_q, whole_x, rank_of_id, need, own, n_cat, *([] if bound is None else [bound]))
    else:
        one = np.empty(n_same, np.int64)
        one[same] = np.arange(len(same))
        widest = []
        if bound is not None:
            widest = [np.zeros(n_same)]
            np.maximum.at(widest[0], same, bound)
        row, col, d2 = _nearest_rows(whole_q[one], whole_x, rank_of_id, need + copies, None, n_cat, *widest)
        first, many = np.searchsorted(row, np.arange(n_same)), np.bincount(row, minlength=n_same)[same]
        at = np.repeat(first[same] - np.cumsum(many) + many, many) + np.arange(many.sum())  # every query's share of the found rows
        row, col, d2 = np.repeat(np.arange(len(qid)), many), col[at], d2[at]
        if exclude_self:
            other = self_of[len(qid) + col] != self_of[row]
            row, col, d2 = row[other], col[other], d2[other]
        few = np.arange(len(row)) - np.searchsorted(row, row) < need
        row, col, d2 = row[few], col[few], d2[few]
    return pd.DataFrame({"qid": qid[row], "nid": rid[col], "d2": d2})


def _short(m: np.ndarray, mean: np.ndarray, times: float) -> tuple[np.ndarray, np.ndarray]:
    """(``times`` the rows around the mean and a column of ones in single precision, the squared lengths around the mean)."""
    out, squares = np.ones((len(m), m.shape[1] + 1), np.float32), np.empty(len(m))
    for at in _slices(len(m), m[:1].T):
        near = m[at] - mean
        squares[at] = (near * near).sum(axis=1)
        out[at, :-1] = times * near
    return out, squares


def _nearest_rows(whole_q: np.ndarray, whole_x: np.ndarray, rank_of_id: np.ndarray, need: int,
                  own: tuple[np.ndarray, np.ndarray] | None, n_cat: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of each query's ``need`` nearest rows, in order; ``own`` numbers the ids of both sides
    where a query's own rows don't count.  Rows beyond a query's ``bound``, a squared distance, need not be found.

    A tile of queries takes the leaves by a lower bound of their distance, in runs of growing size, until none is nearer
    than the tile's farthest ``need``-th distance so far.  A run is screened with |q|² + |x|² - 2qx (one matrix product) and a bound
    on its rounding error; only rows that may be among the nearest get their exact distance.  With many dimensions the
    product is in single precision, of vectors around their mean, with that precision's bound, as long as the
    bound is small against the distances."""
    X, Q = np.ascontiguousarray(_numbers(whole_x, n_cat)), np.ascontiguousarray(_numbers(whole_q, n_cat))
    kk, dims = min(need, len(X)), X.shape[1]
    if bound is not None and not n_cat and kk:
        with np.errstate(over="ignore"):
            top = (X * X).sum(axis=1).max(initial=0)
            reach = np.isfinite(bound) & ((Q * Q).sum(axis=1) < 1e300) & (top < 1e300)
        if reach.any():  # the others have no bound to start with
            with_it, without = np.flatnonzero(reach), np.flatnonzero(~reach)
            mine = lambda at: None if own is None else (own[0][at], own[1])
            r, c, d = _rows_within(Q[with_it], X, rank_of_id, kk, mine(with_it), bound[with_it])
            if len(without):
                r2, c2, d2 = _nearest_rows(whole_q[without], whole_x, rank_of_id, need, mine(without), n_cat)
                r, c, d = np.concatenate([with_it[r], without[r2]]), np.concatenate([c, c2]), np.concatenate([d, d2])
                by = np.argsort(r, kind="stable")
                return r[by], c[by], d[by]
            return with_it[r], c, d
    alike = np.zeros(len(X) + len(Q), np.int64)
    if n_cat:
        both = np.vstack([whole_x[:, -n_cat - 1:-1], whole_q[:, -n_cat - 1:-1]])
        alike = _same_rows(both)
        if (alike.max() + 1) * COMBINED > len(X):  # too many combinations of categories for leaves of their own
            alike[:] = 0
    leaves, tiles = _alike_leaves(X, alike[:len(X)], LEAF), _alike_leaves(Q, alike[len(X):], TILE_QUERIES[dims > FLAT_DIMS])
    by_codes = bool(alike.any())
    leaf_codes = np.stack([whole_x[at[0]] for at in leaves]) if by_codes else None
    where, size = np.concatenate(leaves), np.array([len(at) for at in leaves])
    start = np.concatenate([[0], np.cumsum(size)])
    X, codes, rank_of_id = X[where], whole_x[where] if n_cat else None, rank_of_id[where]
    centre, radius = _balls(X, [np.arange(start[i], start[i + 1]) for i in range(len(leaves))])
    with np.errstate(over="ignore", invalid="ignore"):
        x2, q2 = (X * X).sum(axis=1), (Q * Q).sum(axis=1)
        slack = 8 * (dims + 4) * np.finfo(np.float64).eps * (q2 + x2.max())
        wide = None
        short = False
        if dims > FLAT_DIMS and not n_cat:
            mean = X.mean(axis=0)
            short_x, n2 = _short(X, mean, -2.0)
            m2 = np.concatenate([((Q[at] - mean) ** 2).sum(axis=1) for at in _slices(len(Q), Q[:1].T)])
            short = bool(1e-20 < n2.max() < 1e30 and m2.max(initial=0) < 1e30)  # products stay in the range of single precision
    if short:
        short_x[:, -1] = n2
        short_slack = 8 * (dims + 8) * float(np.finfo(np.float32).eps) * (m2 + n2.max())
    found_q, found_x, found_d = [], [], []
    for tile in tiles:
        qt = Q[tile]
        (mid,), (rad,) = _balls(qt, [np.arange(len(tile))])
        with np.errstate(over="ignore", invalid="ignore"):
            apart = np.sqrt(((centre - mid) ** 2).sum(1))
            low = apart * (1 - 1e-9) - (rad + radius) * (1 + 1e-9)
        low = np.nan_to_num(low, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)  # numbers beyond doubles prune nothing
        if by_codes:  # a tile's queries and a leaf's rows have one combination each, so their categories cost the same
            differ = _mismatches(whole_q[tile[:1]], leaf_codes, n_cat)[0] * whole_q[tile, -1].min()
            low = np.where((differ > 0) & np.isfinite(low), np.sqrt(np.maximum(low, 0) ** 2 + differ) * (1 - 1e-9), low)
        order = np.argsort(low, kind="stable")
        row, col, d2 = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        more: list = []  # found, but not ranked yet
        kth, done, take, waiting = np.full(len(tile), np.inf), 0, 1, 0
        quick = short
        long = _short(qt, mean, 1.0)[0] if quick else None
        while done < len(order):
            known = bool(np.isfinite(kth).all())
            if quick and known and short_slack[tile].max() > 0.05 * np.median(kth):
                quick, long = False, None
            if not quick and long is None:
                long = np.hstack([qt, np.ones((len(tile), 1))])
                if wide is None:
                    with np.errstate(over="ignore"):
                        wide = np.hstack([-2.0 * X, x2[:, None]])  # one product gives |x|² - 2qx
            own_q2, own_slack, side = (m2[tile], short_slack[tile], short_x) if quick else (q2[tile], slack[tile], wide)
            run = order[done:done + take]
            worst = math.sqrt(kth.max()) * (1 + 1e-9)
            run = run[low[run] <= worst]
            if len(run):
                # squared distances of a run stay below TILE numbers
                done, take = done + len(run), min(take * 2, max(1, (FLAT_TILE if quick else TILE) // (LEAF * len(tile))))
                at = np.concatenate([np.arange(start[i], start[i + 1]) for i in run])
                with np.errstate(over="ignore", invalid="ignore"):
                    near = long @ side[at].T  # squares less those of the query
                if n_cat:
                    cost = whole_q[tile, -1, None] * _mismatches(whole_q[tile], codes[at], n_cat)
                    near += cost
                limit = kth
                if len(at) >= kk and not known:
                    others = near
                    if own is not None:
                        others = np.where(own[1][where[at]][None, :] == own[0][tile][:, None], np.inf, near)
                    limit = np.minimum(kth, np.partition(others, kk - 1, axis=1)[:, kk - 1] + own_q2 + own_slack)
                with np.errstate(invalid="ignore"):
                    limit = limit + own_slack - own_q2
                if quick:
                    passed = near <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
                elif np.isfinite(own_slack).all():
                    passed = near <= limit[:, None]
                else:  # squares beyond the range of doubles screen nothing
                    with np.errstate(invalid="ignore"):
                        passed = ~(near > np.where(np.isfinite(own_slack), limit, np.inf)[:, None])
                r, c = np.divmod(_marked(passed), len(at))
                if own is not None:
                    other = own[1][where[at[c]]] != own[0][tile[r]]
                    r, c = r[other], c[other]
                d = np.empty(len(r))
                part = max(1, TILE // max(1, dims))
                with np.errstate(over="ignore"):
                    for t in range(0, len(r), part):
                        diff = qt[r[t:t + part]] - X[at[c[t:t + part]]]
                        d[t:t + part] = (diff * diff).sum(axis=1)
                if n_cat:
                    d += cost[r, c]
                more.append((r, at[c], d))
                waiting += len(r)
            last_run = not len(run) or done >= len(order)
            if waiting and (not known or waiting >= len(tile) or last_run):
                row, col, d2 = (np.concatenate(x) for x in zip((row, col, d2), *more))
                more, waiting = [], 0
                best = np.lexsort((rank_of_id[col], d2, row))
                row, col, d2 = row[best], col[best], d2[best]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = (place < kk) & np.isfinite(d2)
                row, col, d2, place = row[keep], col[keep], d2[keep], place[keep]
                last = place == kk - 1
                kth[row[last]] = d2[last]
            if not len(run):
                break
        found_q.append(tile[row])
        found_x.append(where[col])
        found_d.append(d2)
    row, col, d2 = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_d)
    by = np.argsort(row, kind="stable")  # a query's rows are in order already
    return row[by], col[by], d2[by]


def _rows_within(Q: np.ndarray, X: np.ndarray, rank_of_id: np.ndarray, kk: int, own: tuple[np.ndarray, np.ndarray] | None,
                 bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of each query's ``kk`` nearest rows that are within its finite ``bound``, in order.

    A leaf's box is compared with every query, and only those whose bound reaches it are screened against the leaf's rows
    (as in :func:`_nearest_rows`); a box tells far more of a leaf than its ball where columns have few values."""
    order, kth = np.empty((3, 0), np.int64), bound.copy()
    row, col, d2 = order[0], order[1], np.empty(0)
    more, waiting = [], 0
    q2, x2, dims = (Q * Q).sum(axis=1), (X * X).sum(axis=1), X.shape[1]
    slack = 8 * (dims + 4) * np.finfo(np.float64).eps * (q2 + x2.max())
    columns = np.ascontiguousarray(Q.T)
    long = np.hstack([Q, np.ones((len(Q), 1))])

    def ranked() -> None:
        nonlocal row, col, d2, more, waiting
        row, col, d2 = (np.concatenate(x) for x in zip((row, col, d2), *more))
        more, waiting = [], 0
        best = np.lexsort((rank_of_id[col], d2, row))
        row, col, d2 = row[best], col[best], d2[best]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < kk
        row, col, d2, place = row[keep], col[keep], d2[keep], place[keep]
        kth[row[place == kk - 1]] = d2[place == kk - 1]

    for at in _leaves(X, LEAF):
        part = X[at]
        gap2 = np.zeros(len(Q))
        for c, lo, hi in zip(columns, part.min(axis=0), part.max(axis=0)):
            gap = c - np.clip(c, lo, hi)
            gap2 += gap * gap
        reached = np.flatnonzero(gap2 * (1 - 1e-9) <= kth)
        side = np.vstack([-2.0 * part.T, x2[at]])
        step = max(1, FLAT_TILE // len(at))
        for s in range(0, len(reached), step):
            some = reached[s:s + step]
            r, c = np.divmod(_marked(long[some] @ side <= (kth[some] + slack[some] - q2[some])[:, None]), len(at))
            r, c = some[r], at[c]
            if own is not None:
                other = own[1][c] != own[0][r]
                r, c = r[other], c[other]
            diff = Q[r] - X[c]
            d = (diff * diff).sum(axis=1)
            near = d <= kth[r]
            more.append((r[near], c[near], d[near]))
            waiting += int(near.sum())
            if waiting > max(FLAT_TILE, 4 * kk * len(Q)):
                ranked()
    ranked()
    return row, col, d2


def search_cells(L: DataFrame | None, Lx: DataFrame, Rc: DataFrame, k: int, exclude_self: bool = False, block: int = 16384,
                 seed: int = 42, n_cat: int = 0, dims: int = 0) -> DataFrame:
    """``(qid, rank, nid, dist)``: the ``k`` nearest rows of ``Rc`` (rid, g, cell, v) in the cells or regions that ``Lx``
    (qid, g, cell, v) names for each query; the vectors, of ``dims`` numbers, are packed.  A column ``b`` of ``Lx`` is a squared distance that they are within.  Without ``v`` in ``Lx`` they are joined from ``L`` (qid, v)."""
    need = k + (1 if exclude_self else 0)
    spark = Lx.sparkSession
    q_counts = Lx.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("nq"))
    r_counts = Rc.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("nr"))
    plan = (q_counts.join(r_counts, on=["g", "cell"])
            .select("g", "cell", F.ceil(F.col("nr") / F.lit(block)).cast("int").alias("n_sub"),
                    # of large blocks' queries twice as many meet a block: they are seen by tiles and take less memory
                    F.ceil(F.col("nq") / F.lit(2 * block if block >= BLOCK_ROWS[1] else block)).cast("int").alias("n_chunk")))
    plan = cut_lineage(plan)
    tasks = plan.agg(F.sum(F.col("n_sub").cast("long") * F.col("n_chunk"))).first()[0] or 0

    Rb = (join_small(Rc, plan, on=["g", "cell"])
          .withColumn("sub", F.pmod(F.xxhash64("rid"), F.col("n_sub")).cast("int"))
          .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunk") - 1)))
          .select("g", "cell", "sub", "chunk", "rid", "v"))
    Lv = Lx if L is None else Lx.join(L, on="qid")
    Lb = (join_small(Lv, plan, on=["g", "cell"])
          .withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("n_chunk")).cast("int"))
          .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)))
          .select("g", "cell", "sub", "chunk", "qid", "v", *[c for c in ("b",) if c in Lx.columns]))

    qtype = Lx.schema["qid"].dataType.simpleString()
    rtype = Rc.schema["rid"].dataType.simpleString()
    out_schema = f"qid {qtype}, nid {rtype}, d2 double"

    def block_topk(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"qid": q["qid"].iloc[:0], "nid": r["rid"].iloc[:0],
                                 "d2": pd.Series([], dtype="float64")})
        return _block_topk(q["qid"].to_numpy(), unpacked(q["v"].to_numpy(), dims), r["rid"].to_numpy(), unpacked(r["v"].to_numpy(), dims),
                           need, exclude_self, n_cat, *([q["b"].to_numpy()] if "b" in q else []))

    keys = ["g", "cell", "sub", "chunk"]
    # Blocks take long and move little, so they are dealt to partitions by number, not by bytes.
    most = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, min(2 * int(tasks), most))
    partial = Lb.repartition(parts, *keys).groupBy(*keys).cogroup(Rb.repartition(parts, *keys).groupBy(*keys)).applyInPandas(block_topk, out_schema)
    w = Window.partitionBy("qid").orderBy("d2", "nid")
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("qid", F.col("rank").cast("int").alias("rank"), "nid", F.sqrt("d2").alias("dist"))


def mutual_pairs(nn: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Tomek links (J6): pairs ``(a, b)`` that are each other's nearest neighbour
    and have different labels.  ``nn`` is ``knn(..., k=1)``; an equi self-join."""
    one = nn.where(F.col("rank") == 1).select("qid", "nid")
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y"))
    a = one.alias("a")
    b = one.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.nid")) & (F.col("a.nid") == F.col("b.qid"))) \
        .select(F.col("a.qid").alias("a_id"), F.col("a.nid").alias("b_id"))
    pairs = (pairs.join(lab.withColumnRenamed("id", "a_id").withColumnRenamed("y", "a_y"), on="a_id")
             .join(lab.withColumnRenamed("id", "b_id").withColumnRenamed("y", "b_y"), on="b_id"))
    return pairs.where(F.col("a_y") != F.col("b_y")).select("a_id", "b_id", "a_y", "b_y")


def knn_vote(nn: DataFrame, ref_labels: DataFrame, ref_id: str, label: str) -> DataFrame:
    """k-NN classification (T3): majority label among each query's neighbours,
    ties to the smaller label; ``confidence`` = winning votes / neighbours."""
    lab = ref_labels.select(F.col(ref_id).alias("nid"), F.col(label).alias("_lab"))
    votes = nn.join(lab, on="nid").groupBy("qid", "_lab").agg(F.count(F.lit(1)).alias("_c"))
    return votes.groupBy("qid").agg(
        F.min_by("_lab", F.struct((-F.col("_c")).alias("a"), F.col("_lab").alias("b"))).alias("y_pred"),
        (F.max("_c") / F.sum("_c")).alias("confidence"))
