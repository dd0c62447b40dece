"""Exact substring dedup: every byte inside a ``SPAN``-byte string that also starts elsewhere goes.

One suffix array of a corpus can't be built in one place, so equal strings are
first brought together and each bounded block of them is suffix-sorted.

1. Anchors.  Each window of ``SPAN`` bytes has an anchor, its ``GRAM``-byte
   substring of least hash (leftmost of equals); equal windows have equal
   anchors at equal offsets.  Neighbouring windows with one anchor make a
   segment; a segment is one narrow row (anchor hash, segment hash).
2. An anchor that occurs once has no repeated window.  Equal segments repeat as a whole.
3. Other segments of a repeated anchor are cut, by the window's offset from the
   anchor, into cells of up to ``STEP`` windows.  A cell's windows share a core
   of ``SPAN - STEP + 1`` bytes; cells whose core occurs once are done.
4. What is left are the edges of repeated passages: strings of fewer than
   ``2 * STEP`` symbols (left bytes, one symbol for the core, right bytes).  They
   are packed into blocks, each sorted by ``suffix_sort``; equal windows are
   neighbours in the suffix array.
5. A core with more than ``BLOCK`` cells is spread over several blocks.  Each
   block then also reports a row per distinct window, and a count over these
   rows finds the windows that repeat only across blocks.

Copies and common passages collapse by partial aggregation at every step, and
no step holds more than one text or one block.

Edge cases: a null text is empty; a text shorter than ``SPAN`` bytes is kept
whole; repeated rows are copies of each other; texts with null ids take part;
very long texts are cut into overlapping parts for hashing only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import hinted, stored
from tabula.llm.suffix_sort import suffix_array

SPAN = 400
GRAM = 128
STEP = 25
BLOCK = 256          # cells of one core in a block
BLOCK_SYMBOLS = 1 << 15
PART = 1 << 22       # windows hashed at a time
_BASE = 0x9E3779B97F4A7C15  # odd
_U = np.uint64


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            made = []
            for base in (_BASE, inverse):
                steps = np.full(size, base, _U)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            cls.up, cls.down = made
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of every ``size``-byte substring."""
    up, down = _Powers.get(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up, out=total[1:])
    h = (total[size:] - total[:-size]) * down[:len(data) - size + 1]
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return h


def _least_at(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys (block-wise running minima)."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segments(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(first window, last window, anchor, anchor hash, segment hash) of every segment of ``b``."""
    firsts, lasts, anchors, hashes, names = [], [], [], [], []
    low = _U((1 << 24) - 1)
    for at in range(0, len(b) - SPAN + 1, PART):
        part = np.frombuffer(b, np.uint8)[at:at + PART + SPAN - 1]
        h = gram_hashes(part)
        least = _least_at((h & ~low) | np.arange(len(h), dtype=_U), SPAN - GRAM + 1)
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        anchor = anchor[first]
        firsts.append(first + at)
        lasts.append(last + at)
        anchors.append(anchor + at)
        hashes.append(h[anchor])
        digest = xxhash.xxh3_64_intdigest
        names.extend(digest(b[s:e]) for s, e in zip((first + at).tolist(), (last + at + SPAN).tolist()))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(firsts, np.int64), join(lasts, np.int64), join(anchors, np.int64), join(hashes, _U), names


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        yield value.as_py() or b""


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, cols = [], [[], [], [], [], []]
        for i, b in enumerate(_bytes(batch.column("text"))):
            found = segments(b)
            rows.append(np.full(len(found[0]), i))
            for col, x in zip(cols, (*found[:3], found[3].view(np.int64), np.array(found[4], _U).view(np.int64))):
                col.append(x)
        at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        s, e, a, anchor, seg = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)),
             pa.array(a.astype(np.int32)), pa.array(anchor), pa.array(seg)], ["doc_id", "h", "s", "e", "a", "anchor", "seg"])


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the unsettled segments of each text."""
    names = ["doc_id", "h", "anchor", "core", "q", "l", "r", "c"]
    for batch in batches:
        rows: list[int] = []
        anchor, core, q, left, right, times = [], [], [], [], [], []
        for i, (b, segs) in enumerate(zip(_bytes(batch.column("text")), batch.column("segs").to_pylist())):
            for x in segs:
                s, e, a = x["s"], x["e"], x["a"]
                for k in range((a - e) // STEP, (a - s) // STEP + 1):
                    near, far = max(a - e, k * STEP), min(a - s, k * STEP + STEP - 1)
                    mid = a - k * STEP
                    end = mid - STEP + 1 + SPAN
                    rows.append(i)
                    anchor.append(x["anchor"])
                    core.append(xxhash.xxh3_64_intdigest(b[mid:end]) - (1 << 63))
                    q.append(mid)
                    left.append(b[a - far:mid])
                    right.append(b[end:a - near + SPAN])
                    times.append(x["c"])
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(anchor, pa.int64()), pa.array(core, pa.int64()),
             pa.array(q, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(times, pa.int64())], names)


def equal_windows(groups: list[list[tuple[bytes, bytes]]]) -> Iterator[list[tuple[int, int, int]]]:
    """Classes of equal windows of a block, as (group, member, bytes taken from its left).

    A group's members share a core; a window is the core's symbol and ``STEP - 1`` bytes around it."""
    text: list[int] = []
    window: list[tuple[int, int, int] | None] = []
    for g, members in enumerate(groups):
        for m, (left, right) in enumerate(members):
            text.extend(x + 1 for x in left)
            text.append(257 + g)
            text.extend(x + 1 for x in right)
            text.append(0)
            # the window that takes x bytes from the left starts x symbols before the core
            window.extend((g, m, x) if STEP - 1 - x <= len(right) else None for x in range(len(left), -1, -1))
            window.extend([None] * (len(right) + 1))
    last, klass = None, []
    for i in suffix_array(text):
        if window[i] is None:
            continue
        own = text[i:i + STEP]
        if own != last:
            if klass:
                yield klass
            last, klass = own, []
        klass.append(window[i])
    if klass:
        yield klass


_FOUND = ["doc_id", "h", "p", "anchor", "core", "w", "cnt", "settled"]


def _sorted_block(rows: list[list[dict]]) -> list[tuple]:
    out = []
    members = [[(x["l"], x["r"]) for x in group] for group in rows]
    for klass in equal_windows(members):
        here = [(rows[g][m], x) for g, m, x in klass]
        total = sum(r["c"] for r, _ in here)
        if total > 1:
            out.extend((r["doc_id"], r["h"], r["q"] - x, None, None, None, None, True) for r, x in here if r["c"] == 1)
        r, x = here[0]
        if r["blocks"] > 1:
            name = xxhash.xxh3_64_intdigest(bytes([x]) + r["l"][len(r["l"]) - x:] + r["r"][:STEP - 1 - x]) - (1 << 63)
            out.append((r["doc_id"], r["h"], r["q"] - x, r["anchor"], r["core"], name, total, False))
    return out


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sort the cells of a partition that is sorted by core and block, a bounded block at a time."""
    types: list[pa.DataType] = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    packed: list[list[dict]] = []
    last, size = None, 0

    def flush() -> pa.RecordBatch:
        found = _sorted_block([g for g in packed if len(g) > 1 or g[0]["blocks"] > 1])
        packed.clear()
        cols = list(zip(*found)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _FOUND)

    for batch in batches:
        types[0] = batch.column("doc_id").type
        for row in batch.to_pylist():
            key = (row["anchor"], row["core"], row["block"])
            if key != last:
                if size > BLOCK_SYMBOLS:
                    yield flush()
                    size = 0
                packed.append([])
                last = key
            packed[-1].append(row)
            size += len(row["l"]) + len(row["r"]) + 2
    if packed:
        yield flush()


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, h, s, e): runs of windows that start at s to e and occur elsewhere; h is the text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    seg = stored(texts.where(F.octet_length("text") >= SPAN).mapInArrow(
        _segment_batches, f"doc_id {kind}, h long, s int, e int, a int, anchor long, seg long"), "segments")
    twice = stored(seg.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
                   .where("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("alike")), "anchors")
    met = stored(seg.join(hinted(twice), "anchor"), "met_segments")
    mixed = met.where(~F.col("alike"))
    kinds = stored(mixed.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("h", "doc_id", "s", "e", "a")).alias("at")),
                   "segment_kinds")
    whole = met.where("alike").select("doc_id", "h", "s", "e").unionByName(
        mixed.join(hinted(kinds.where("c > 1").select("anchor", "seg")), ["anchor", "seg"]).select("doc_id", "h", "s", "e"))

    open_ = kinds.groupBy(F.col("at.doc_id").alias("o_id"), F.col("at.h").alias("o_h")).agg(F.collect_list(
        F.struct("anchor", F.col("at.s").alias("s"), F.col("at.e").alias("e"), F.col("at.a").alias("a"), "c")).alias("segs"))
    own = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h"))
    cells = stored(texts.join(open_, own).select("doc_id", "h", "text", "segs").mapInArrow(
        _cell_batches, f"doc_id {kind}, h long, anchor long, core long, q int, l binary, r binary, c long"), "cells")
    cores = stored(cells.groupBy("anchor", "core").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1")
                   .select("anchor", "core", F.expr(f"cast((rows + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")), "cores")
    spread = cells.join(hinted(cores), ["anchor", "core"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "h", "q"), F.col("blocks")))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = stored(spread.repartition(parts, "anchor", "core", "block").sortWithinPartitions("anchor", "core", "block").mapInArrow(
        _block_batches, f"doc_id {kind}, h long, p int, anchor long, core long, w long, cnt long, settled boolean"), "sorted_blocks")
    across = found.where("not settled").groupBy("anchor", "core", "w").agg(F.sum("cnt").alias("t")).where("t > 1").select("anchor", "core", "w")
    late = found.where("not settled and cnt = 1").join(across, ["anchor", "core", "w"])
    edge = found.where("settled").select("doc_id", "h", "p").unionByName(late.select("doc_id", "h", "p"))
    return whole.unionByName(edge.select("doc_id", "h", F.col("p").alias("s"), F.col("p").alias("e")))


def cut_text(b: bytes | None, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) without the bytes that windows s to e cover."""
    b = b or b""
    if starts is None or not len(starts):
        return b, 0, 0
    edge = np.zeros(len(b) + 1, np.int64)
    np.add.at(edge, np.asarray(starts), 1)
    np.add.at(edge, np.asarray(ends) + SPAN, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(b, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def with_cuts(docs: DataFrame) -> DataFrame:
    """doc_id, text (binary) and the windows to remove (starts, ends; null for none), a row per document row."""
    found = repeated(docs).groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), F.col("runs.s").alias("starts"), F.col("runs.e").alias("ends"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left") \
        .select("doc_id", "text", "starts", "ends")


def _facts(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for b, s, e in zip(text, starts, ends):
        left, removed, runs = cut_text(b, s, e)
        rows.append((len(b or b""), removed, runs, hashlib.sha256(left).hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rest(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([cut_text(b, s, e)[0] for b, s, e in zip(text, starts, ends)])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id and ``kept``, the bytes that are left of each text."""
    cut = with_cuts(docs)
    return cut.select("doc_id", F.pandas_udf(_rest, "binary")("text", "starts", "ends").alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (whether the text lost bytes) for every document row."""
    facts = F.pandas_udf(_facts, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")("text", "starts", "ends")
    x = with_cuts(docs).select("doc_id", facts.alias("x")).select("doc_id", "x.*")
    return x.withColumn("removed", F.col("n_removed") > 0)
