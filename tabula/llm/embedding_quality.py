"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

1. **Random indexing.**  Every unit (word or run of signs; a word in capitals also gives
   a mark) has a sparse random index vector, a function of its hash alone.  Its context vector
   is the sum of the index vectors of its neighbours over all texts of the corpus.  A task adds
   up its own texts and emits one row per unit bucket; the sums over tasks are one aggregate.
   Units share ``BUCKETS`` hashed rows, so the table has a fixed size (8 MB), whatever the
   vocabulary, and may be broadcast; counts come from every document.
2. **Word vectors.**  Context vectors less what the unit's frequency alone would give, scaled to
   length one, plus the scaled index vector, so that a unit keeps its identity.
3. **Pooling.**  Mean and deviation of the vectors of a text, the shares of units equal to the
   1st to 4th before them (repetition), and the length.
4. **Network.**  Standardised features, one hidden tanh layer, one logistic output; numpy on the
   driver over a sample of at most ``FIT_ROWS`` labelled training documents of each label.  A
   fifth of the sample is left out of the descent: it picks the best epoch and then the
   temperature that the logits are divided by, so scores are calibrated probabilities.

Scoring is one pass over the texts: no shuffle, and memory is bounded by the piece size, not by
the length of a text.

Defined results: null and empty texts have no units and are scored from zero vectors; repeated
rows are scored each; a null id is in no fold and not held out; without labels of both kinds the
score is the smoothed share of label 1 (0.5 without any label); labels other than 0 and 1 are
ignored, of repeated labels of an id the greatest counts; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import stored

FOLDS, HELD_OUT = 3, 1
#: Most labelled training documents of each label that the fit reads.
FIT_ROWS = 20_000
BUCKETS, DIMS, NONZERO, WINDOW = 1 << 15, 64, 2, 2
LAGS = (1, 2, 3, 4)
FEATURES = 2 * DIMS + len(LAGS) + 1
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.005, 1e-3
#: Units whose vectors are in memory at once (2 MB: they stay in the processor's cache).
PIECE = 1 << 12
#: Units whose contexts are counted at once.
COUNTED = 1 << 20
_MAX_KNOWN = 200_000
_UNIT = re.compile(r"\w+|[^\w\s]+")
_CAPS = zlib.crc32(b"\0caps") % BUCKETS  # the mark of a word in capitals


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _index() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero elements of each bucket's index vector."""
    rng = np.random.default_rng(42)
    places = np.argsort(rng.random((BUCKETS, DIMS), dtype=np.float32), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


class _Codes(dict):
    """Bucket of a unit, plus BUCKETS if it is a word in capitals; made when first asked for, up to a bound."""

    def __missing__(self, unit: str) -> int:
        if len(self) >= _MAX_KNOWN:
            self.clear()
        low = unit.lower()
        got = self[unit] = zlib.crc32(low.encode("utf-8", "replace")) % BUCKETS + (BUCKETS if low != unit and len(unit) > 1 and unit.isupper() else 0)
        return got


class Units:
    """Hash buckets of texts' units, in order; a word in capitals is followed by the mark for that."""

    def __init__(self):
        self.code = _Codes().__getitem__

    def _codes(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self.code, _UNIT.findall(text or ""))), np.int32)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all units, number of each text)."""
        lists = [self._codes(t) for t in texts]
        codes = np.concatenate([np.empty(0, np.int32), *lists])
        caps = codes >= BUCKETS
        out = np.repeat(codes % BUCKETS, 1 + caps)
        out[np.flatnonzero(caps) + np.cumsum(caps)[caps]] = _CAPS
        end = np.cumsum([0, *map(len, lists)])
        return out, np.diff(end + np.concatenate([[0], np.cumsum(caps)])[end])

    def of(self, text: str | None) -> list[int]:
        return self.batch([text])[0].tolist()


# ── 1. Random indexing ────────────────────────────────────────────────────
def add_contexts(total: np.ndarray, ids: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray,
                 start: int = 0, stop: int | None = None) -> None:
    """Add to ``total`` (BUCKETS x DIMS) the index vectors of the neighbours of each unit within its text,
    for the pairs whose later unit is one of ``start`` to ``stop``."""
    flat = total.reshape(-1)
    for lag in range(1, WINDOW + 1):
        lo, hi = max(start, lag), min(len(ids), len(ids) if stop is None else stop)
        if lo >= hi:
            continue
        here = doc[lo:hi] == doc[lo - lag:hi - lag]
        left, right = ids[lo - lag:hi - lag][here].astype(np.int64), ids[lo:hi][here].astype(np.int64)
        for unit, near in ((left, right), (right, left)):
            for k in range(NONZERO):
                flat += np.bincount(unit * DIMS + places[near, k], weights=signs[near, k], minlength=len(flat)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that the task's texts have: bucket, n, context."""
    units, (places, signs) = Units(), _index()
    total, n = np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def flush() -> None:
        if held:
            ids, size = np.concatenate(held), np.concatenate(sizes)
            doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
            for s in range(0, len(ids), COUNTED):
                add_contexts(total, ids, doc, places, signs, s, s + COUNTED)
            n[:] += np.bincount(ids, minlength=BUCKETS)
            held.clear()
            sizes.clear()

    waiting = 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for s in range(0, len(texts), 256):
            ids, size = units.batch(texts[s:s + 256])
            held.append(ids)
            sizes.append(size)
            waiting += len(ids)
            if waiting >= COUNTED:
                flush()
                waiting = 0
    flush()
    some = np.flatnonzero(n)
    for s in range(0, len(some), 4096):
        b = some[s:s + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.astype(np.int32)), pa.array(n[b]), pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(b) * DIMS + 1, DIMS, dtype=np.int32)), pa.array(total[b].reshape(-1)))], ["bucket", "n", "context"])


def contexts(docs: DataFrame) -> DataFrame:
    """bucket, n (units), c0 ... (context vector) summed over all texts: at most BUCKETS rows."""
    parts = docs.select("text").mapInArrow(_count, "bucket int, n long, context array<long>")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("context")[i]).alias(f"c{i}") for i in range(DIMS)))


# ── 2. Word vectors ───────────────────────────────────────────────────────
def word_vectors(n: np.ndarray, context: np.ndarray) -> np.ndarray:
    """float32 BUCKETS x DIMS from the counts and context sums of all buckets."""
    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    expected = n[:, None] / max(n.sum(), 1) * context.sum(0)[None, :]
    places, signs = _index()
    own = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(own, places, signs, axis=1)
    return (unit(context - expected) + unit(own)).astype(np.float32)


def fit_vectors(docs: DataFrame) -> np.ndarray:
    t = contexts(docs).toArrow()  # at most BUCKETS rows
    n, context = np.zeros(BUCKETS), np.zeros((BUCKETS, DIMS))
    b = t["bucket"].to_numpy()
    n[b] = t["n"].to_numpy()
    context[b] = np.stack([t[f"c{i}"].to_numpy() for i in range(DIMS)], axis=1) if len(b) else 0
    return word_vectors(n, context)


# ── 3. Pooling ────────────────────────────────────────────────────────────
def pooled(units: Units, vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Features of each text (float64, len(texts) x FEATURES) from float64 vectors."""
    ids, size = units.batch(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), size)
    total, square = np.zeros((n, DIMS)), np.zeros((n, DIMS))
    end = np.cumsum(size)
    for i in np.flatnonzero(size):
        for s in range(end[i] - size[i], end[i], PIECE):
            v = vectors[ids[s:min(s + PIECE, end[i])]]
            total[i] += v.sum(0)
            square[i] += np.einsum("ij,ij->j", v, v)
    count = np.maximum(size, 1)[:, None]
    mean = total / count
    spread = np.sqrt(np.maximum(square / count - mean * mean, 0))
    again = np.zeros((n, len(LAGS)))
    for i, lag in enumerate(LAGS):
        hit = (ids[lag:] == ids[:-lag]) & (doc[lag:] == doc[:-lag])
        again[:, i] = np.bincount(doc[lag:][hit], minlength=n) / count[:, 0]
    return np.concatenate([mean, spread, again, np.log1p(size)[:, None]], axis=1)


# ── 4. Network ────────────────────────────────────────────────────────────
@dataclass(frozen=True)
class Network:
    """p = sigmoid(((tanh((x - mean) / scale @ w1 + b1)) @ w2 + b2) / temperature); a constant without weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple | None
    temperature: float = 1.0
    share: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), np.log(self.share / (1 - self.share)))
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(z) else 0.0


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that minimises the log-loss (golden section over its logarithm)."""
    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if log_loss(z / np.exp(a), y) <= log_loss(z / np.exp(b), y):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def gradient(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log-loss plus DECAY / 2 times the squared weights."""
    w1, b1, w2, b2 = weights
    h = np.tanh(x @ w1 + b1)
    e = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y) / len(y)
    back = np.outer(e, w2) * (1 - h * h)
    return [x.T @ back + DECAY * w1, back.sum(0), h.T @ e + DECAY * w2, e.sum(keepdims=True)]


def train(x: np.ndarray, y: np.ndarray, left_out: np.ndarray) -> Network:
    """Adam over the rows not left out; the epoch and the temperature with the least log-loss on the others."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(FEATURES), np.ones(FEATURES), None, share=float(share))
    if not (~left_out).any() or y[~left_out].min() == y[~left_out].max():
        left_out = np.zeros(len(y), bool)
    mean, scale = x.mean(0), np.where((sd := x.std(0)) > 1e-9, sd, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(7)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    rows, step, best = np.flatnonzero(~left_out), 0, (np.inf, w)
    judge = left_out if left_out.any() else ~left_out
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for s in range(0, len(rows), BATCH):
            step += 1
            part = rows[s:s + BATCH]
            for p, g, m, v in zip(w, gradient(w, z[part], y[part]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        loss = log_loss(np.tanh(z[judge] @ w[0] + w[1]) @ w[2] + w[3], y[judge])
        if loss < best[0]:
            best = (loss, [p.copy() for p in w])
    net = Network(mean, scale, tuple(best[1]), share=float(share))
    return Network(mean, scale, net.weights, best_temperature(net.logits(x[judge]), y[judge]), float(share))


# ── Fit and score ─────────────────────────────────────────────────────────
def fit_sample(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """text, y, doc_id: at most FIT_ROWS training documents of each label, picked by the hash of their id."""
    y = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    ids = docs.select("doc_id").distinct().join(y, "doc_id").withColumn("order", F.xxhash64("doc_id"))
    part = [ids.where(F.col("y") == v).orderBy("order", "doc_id").limit(FIT_ROWS) for v in (0, 1)]
    few = stored(part[0].union(part[1]).select("doc_id", "y"), "quality_sample")
    # two rows of an id and a flag for each label at most: bounded by FIT_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> tuple[np.ndarray, Network]:
    vectors = fit_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMS floats: 8 MB

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, v = Units(), shared.value.astype(np.float64)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                x = pooled(units, v, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.astype(np.float32).reshape(-1)))], ["y", "out", "x"])

    sample = fit_sample(docs, labels, target).select("text", "y", (F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0).alias("out"), "doc_id")
    # One point for each document id: copies of a row don't count twice, and the sample stays bounded.
    rows = sample.groupBy("doc_id").agg(F.min(F.struct("text", "y", "out")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").select("r.*")
    t = rows.mapInArrow(points, "y int, out boolean, x array<float>").toArrow()
    x = t["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
    return vectors, train(x, t["y"].to_numpy().astype(np.float64), t["out"].to_numpy().astype(bool))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """doc_id, score for every row, from its whole text and nothing else."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, (v, model) = Units(), shared.value
        v = v.astype(np.float64)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                p = model.score(pooled(units, v, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document row."""
    s = score(docs, *fit(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
