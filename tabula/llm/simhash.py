"""SimHash near-duplicate groups through deletion-variant signatures.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles.  Two fingerprints within three bits, cut into two segments, differ by
at most one bit in one segment.  So each distinct fingerprint is filed under
every one-wildcard variant of each segment; rows that share a variant are
candidates and are verified by their bit distance.

A bucket of two is verified in place.  A bucket of up to ``BLOCK`` fingerprints
is linked inside one bounded task, which returns a spanning forest and not all
pairs.  A larger bucket is filed again by variants of the bits that its members
don't share, 32 then 16 of them; at the third level a bucket can't hold more
than 2^11 fingerprints.  So no group is ever collected unbounded and no link is
lost.  Exact copies share one fingerprint and meet as one row.

Edge cases: a null or empty text has fingerprint zero; fewer words than a
shingle make one shingle; repeated rows belong to one group; null ids take part
but are never a group's id unless the group has no other (then it is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import fresh, hinted, stored

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 2048
_CHUNK = 1 << 15


def fingerprint_text(b: bytes | None, size: int = SHINGLE) -> int:
    ws = (b or b"").lower().split()  # A-Z and ASCII white space only
    if not ws:
        return 0
    size = min(size, len(ws))
    text = b" ".join(ws)
    lens = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:len(ws) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    votes, total, digest = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        part = [digest(text[a:z], SEED) for a, z in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_text(b) for b in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text.cast("binary"))


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """(key, fp, rest): the one-wildcard variants of both halves of ``rest``'s ``width`` bits."""
    half = width // 2
    mask = (1 << half) - 1
    low, high = F.col("rest").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("rest", half).bitwiseAND(F.lit(mask))
    kinds = [F.struct(F.xxhash64("key", F.lit(s * half + p), seg.bitwiseAND(F.lit(mask & ~(1 << p)))).alias("key"), other.alias("rest"))
             for s, (seg, other) in enumerate(((low, high), (high, low))) for p in range(half)]
    return rows.select("fp", F.explode(F.array(*kinds)).alias("v")).select("v.key", "fp", "v.rest")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a spanning forest of each bounded bucket."""
    for pdf in batches:
        a, b = [], []
        for fps in pdf["fps"]:
            left = np.unique(np.asarray(fps, np.int64)).view(np.uint64)
            todo: list[np.uint64] = []
            while len(left) or todo:
                if not todo:
                    todo, left = [left[0]], left[1:]
                u = todo.pop()
                near = np.bitwise_count(left ^ u) <= MAX_BITS
                found = left[near]
                left = left[~near]
                todo.extend(found)
                a.extend([u] * len(found))
                b.extend(found)
        yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints whose components are those of all links."""
    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest"))
    found: list[DataFrame] = []
    for width in (64, 32, 16):
        index = _variants(rows, width)
        buckets = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                         .where("n > 1"), "simhash_buckets")
        found.append(buckets.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b").distinct())
        size = buckets.agg(F.max("n")).first()[0] or 0
        if size <= 2:
            break
        many = buckets.where("n > 2").select("key", "n")
        members = index.join(hinted(many), "key")
        last = width == 16
        blocks = (members if last else members.where(F.col("n") <= BLOCK)).groupBy("key").agg(F.collect_list("fp").alias("fps"))
        found.append(blocks.select("fps").distinct().mapInPandas(_forest, "a long, b long"))
        if last or size <= BLOCK:
            break
        rows = stored(members.where(F.col("n") > BLOCK).select("key", "fp", "rest"), "simhash_hot")
    return reduce(DataFrame.union, found).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars, root the least node."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
        e = stored(small.select("s.u", "s.v").where("u <> v").distinct(), "small_star")
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = sign


def groups(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, h (text hash), fp, first (is_null, doc_id, h of the group's least document)."""
    d = stored(docs.select("doc_id", F.xxhash64("text").alias("h"), fingerprint(F.col("text")).alias("fp")), "fingerprints")
    nodes = stored(d.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")), "nodes")
    roots = components(links(nodes.select("fp")))
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    grouped = stored(linked.join(heads, "root").select("fp", F.col("head").alias("first")), "groups")
    return d.join(grouped, "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group (the least doc_id), columns unchanged."""
    h, did, n = fresh(docs, "text_hash", "first_id", "copy_no")
    g = groups(docs)
    keep = stored(g.where(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h")))
                  .groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("doc_id").alias(did), F.col("h").alias(h), F.col("n").alias(n)), "kept_documents")
    out = docs.join(keep, docs["doc_id"].eqNullSafe(F.col(did)) & (F.xxhash64(docs["text"]) == F.col(h)))
    single = out.where(F.col(n) == 1).select(*docs.columns)
    if keep.where(F.col(n) > 1).limit(1).count() == 0:
        return single
    again = out.where(F.col(n) > 1).dropDuplicates([did, h]).select(*docs.columns)  # repeated rows of one document
    return single.unionByName(again)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                               F.col("first.doc_id").alias("component_id"))
