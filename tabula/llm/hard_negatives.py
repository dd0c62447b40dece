"""Hard-negative mining by slot-decomposed selection.

For an anchor with positives of scores p1 >= p2 >= ..., the negatives of positive i are the
best rows of another label whose score lies in [low% of pi, high% of pi].  All these windows
are answered by one selection:

1. The distinct upper limits u1 > u2 > ... of an anchor's positives split the scores into
   disjoint slots (u2, u1], (u3, u2], ..., (least lower limit, last u].
2. Anchors meet rows in blocks.  A block keeps the top k of each (anchor, slot); Spark's
   group limit combines them per task before the shuffle and once more after it.
3. The best k scores up to ui are the first k of slots i, i+1, ... read in descending order
   (suffix merge).  Scores below the lower limit are the end of that list and are cut off.

The positives themselves come from the same block job with "same label" as its condition.

Scale: anchors x rows products are what is asked for.  Rows and anchors are dealt by row
number into blocks of bounded size, so no label, id or vector makes a block larger.  A vector
is copied once per block of the other side; a block emits positives or slots x k rows for an
anchor, whatever it reads.

Defined results: rows with a null id, label or vector, or with a null or non-finite component
take no part; components and scores outside a long saturate at its ends; vectors of different
lengths meet as if the shorter one ended in zeros; repeated rows count each (as rows, as
anchors and as one another's positives); ties go to the smaller id; an anchor without a
positive, or whose positives score below zero (their windows are empty), returns nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
LOW_PCT, HIGH_PCT = 30, 90
#: Most rows and anchors of a block (16 MB and 4 MB at 64 dimensions).
ROW_BLOCK, ANCHOR_BLOCK = 32768, 8192
#: Scores that a task holds at once (16 MB of doubles).
TILE = 1 << 21
_EXACT, _LONG = 1 << 53, 1 << 62
_FOUND = "anchor long, slot int, score long, id long"


def finite(vec: Column) -> Column:
    """False for a null vector and for one with a null, NaN or infinite component."""
    return F.coalesce(F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False))


def quantised(vec: Column, scale: int = 256) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as an int64 matrix, short ones filled up with zeros."""
    a = col.combine_chunks()
    size = np.diff(a.offsets.to_numpy())
    width = int(size.max(initial=0))
    flat = a.flatten().to_numpy()
    if len(flat) == width * len(size):
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _keys(a: np.ndarray, x: np.ndarray, step: int):
    """Per slice of ``a``: its start and ``score * n + (n - 1 - column)``, one distinct number for every
    (score, column), exact: in doubles or longs where the largest product fits, else in Python's integers."""
    n = len(x)
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, x))
    top = max(1, width) * int(max(-int(a.min(initial=0)), int(a.max(initial=0)))) * int(max(-int(x.min(initial=0)), int(x.max(initial=0))))
    kind = np.float64 if (top + 1) * n < _EXACT else np.int64 if (top + 1) * n < _LONG else object
    x, back = x.T.astype(kind), np.arange(n - 1, -1, -1).astype(kind)
    for s in range(0, len(a), step):
        score = a[s:s + step].astype(kind) @ x
        if kind is object:
            score = np.clip(score, -(1 << 63), (1 << 63) - 1)
        yield s, score * n + back, kind


def _best(key: np.ndarray, mask: np.ndarray, k: int):
    """(row, key) of the k greatest masked keys of each row."""
    if key.dtype == object:
        key = np.where(mask, key, -(1 << 200))
        least = np.sort(key, axis=1)[:, -min(k, key.shape[1])]
    else:
        key = np.where(mask, key, -np.inf if key.dtype == np.float64 else np.iinfo(np.int64).min)
        least = np.partition(key, -min(k, key.shape[1]), axis=1)[:, -min(k, key.shape[1])]
    row, col = np.nonzero(mask & (key >= least[:, None]))
    return row, key[row, col]


def _block(k: int, slots: bool):
    """The task of one block: top k per anchor of its own label (``slots`` False), or per anchor and slot of the others."""

    def select(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
            rid, label, rno = (rows[c].to_numpy() for c in ("id", "label", "row"))
            own, own_label = anchors["anchor"].to_numpy(), anchors["label"].to_numpy()
            x = _matrix(rows["vec"])
            n = len(x)
            if slots:  # limits as a matrix, short lists filled with their lower bound: those slots are empty
                low = anchors["low"].to_numpy()
                upper = np.stack([np.concatenate([u, np.full(POSITIVES + 1 - len(u), lo - 1)])
                                  for u, lo in zip(anchors["upper"].to_pylist(), low)]).astype(np.int64)
                upper = np.clip(upper, -_LONG // n, _LONG // n)  # beyond every key of this block, and times n still a long
            for s, key, kind in _keys(_matrix(anchors["vec"]), x, max(1, TILE // n)):
                part = slice(s, s + len(key))
                same = own_label[part, None] == label[None, :]
                for j in range(POSITIVES) if slots else [0]:
                    if slots:  # u(j+1) < score <= u(j), as a range of keys
                        up, lo = (upper[part, i].astype(kind)[:, None] for i in (j, j + 1))
                        mask = ~same & (key < (up + 1) * n) & (key >= (lo + 1) * n)
                    else:
                        mask = same & (rno[None, :] != own[part, None])
                    row, best = _best(key, mask, k)
                    score = best // n
                    col = n - 1 - (best - score * n)
                    out.append((own[part][row], np.full(len(row), j), score, rid[col.astype(np.int64)]))
        cols = [np.concatenate(c) if out else [] for c in (zip(*out) if out else [[]] * 4)]
        return pa.table({"anchor": pa.array(cols[0], pa.int64()), "slot": pa.array(cols[1], pa.int32()),
                         "score": pa.array([int(v) for v in cols[2]] if len(cols[2]) and cols[2].dtype == object else np.asarray(cols[2]).astype(np.int64), pa.int64()),
                         "id": pa.array(cols[3], pa.int64())})

    return select


def _selected(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int, slots: bool) -> DataFrame:
    """Top k rows of each (anchor, slot): anchor, slot, score, id."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    down, across = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(cores, -(-n_rows // ROW_BLOCK))

    def dealt(df: DataFrame, number: str, mine: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.col(number), F.lit(n)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(anchors, "anchor", "i", down, "j", across)
    right = dealt(rows.select("row", "id", "label", "vec"), "row", "j", across, "i", down)
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_block(k, slots), _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id long, label, vec array<long>): anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"),
                              F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec")), "mining_rows")
    anchors = rows.where(is_anchor).select(
        F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.col("label").alias("label"), F.col("vec").alias("vec"))
    n_rows, n_anchors = rows.count(), anchors.count()

    near = _selected(anchors.select("anchor", "label", "vec"), rows, n_anchors, n_rows, POSITIVES, False)
    big = F.col("score").cast("decimal(38,0)")  # 9 x score may pass a long
    near = near.where("score >= 0").withColumn("upper", F.floor(big * HIGH_PCT / 100).cast("long")) \
        .withColumn("low", F.ceil(big * LOW_PCT / 100).cast("long"))
    # at most POSITIVES rows for an anchor
    limits = near.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("upper"), F.min("low").alias("low"),
                                        F.collect_list(F.struct("score", "id", F.col("upper").alias("top"), F.col("low").alias("least"))).alias("pos"))
    limits = stored(limits, "mining_limits")
    asked = anchors.join(limits.select("anchor", "upper", "low"), "anchor")
    slots = _selected(asked.select("anchor", "label", "vec", "upper", "low"), rows, n_anchors, n_rows, NEGATIVES, True)
    # at most POSITIVES x NEGATIVES rows for an anchor, in descending order over all its slots
    lists = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        "slot", (-F.col("score").cast("decimal(20,0)")).alias("down"), "id", "score"))).alias("found"))
    each = limits.join(lists, "anchor").select("anchor", "upper", "found", F.explode("pos").alias("p"))
    # slot j ends at upper[j]; a suffix of slots is one slice of the list
    first = F.array_position("upper", F.col("p.top")) - 1
    suffix = F.slice(F.filter("found", lambda x: x["slot"] >= first), 1, NEGATIVES)
    hits = each.select("anchor", "p", F.posexplode(F.filter(suffix, lambda x: x["score"] >= F.col("p.least"))).alias("place", "hit"))
    return hits.join(anchors.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("hit.score").alias("negative_score"))


def report(embeddings: DataFrame, every: int = 100, shift: int = 7, labels: int = 10) -> DataFrame:
    """The contract's rows of ``embeddings`` (vec_id, embedding, label)."""
    label = F.col("label").cast("long")
    rows = embeddings.where(finite(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % shift == 0, (label + 1) % labels).otherwise(label).alias("label"),
        quantised(F.col("embedding")).alias("vec"))
    return mine(rows, F.col("id") % every == 0)


_PRODUCT = "CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT)"
ORACLE_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, {_PRODUCT} AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id,
    p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LOW_PCT} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH_PCT} * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
