"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Texts are A-Z lower-cased and cut into words (ASCII letters, ASCII digits and
every non-ASCII character).  A benchmark item gives all its windows of
``WIDTH`` consecutive words; an item of fewer words, but not none, is one
window.  Each window is filed under a hash of all its words, made of the words'
own hashes.  Documents are scanned position by position: for each length that
windows have (``WIDTH`` at most) the hash of the next words probes the broadcast
window table, and a hit is verified word by word.  So windows that only begin
alike never meet: a position has one candidate a length, but for equal hashes.  Nothing but
verified hits and one marker row per document is shuffled, so a passage that a
third of all documents share costs each task only its own documents' hits.

Edge cases: a null text has no words (0 words, nothing hit, not contaminated);
a null item id is reported as the empty string; repeated items count once per
id, repeated documents give one result row each; an empty benchmark leaves all
documents clean; very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import ascii_lower, fresh, hinted, let, stored

WIDTH = 13
#: What stands between words.  ``split`` and dropping empty ends costs a tenth of ``regexp_extract_all``,
#: which builds a match object for every word.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows are broadcast in slices of at most this many bytes of words and ids.
SLICE_BYTES = 32 << 20
_MARK = 0


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAPS, -1), ""), F.array().cast("array<string>"))


def _key(size: int | Column, hashes: list[Column]) -> Column:
    """Hash of a window of so many words, given the hashes of its words (a null, past the end, adds nothing)."""
    return F.xxhash64(F.lit(size).cast("int") if isinstance(size, int) else size, *hashes)


def benchmark_windows(bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """(win, items, n, key): each distinct window with the ids of its items."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = let(F.col("w"), lambda w: F.when(F.size(w) < width, F.array(w)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))),
                    lambda i: F.slice(w, i, width))))
    wins = items.select("item", F.explode(cut).alias("win")).groupBy("win").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    hashes = [F.when(F.size("win") > k, F.xxhash64(F.get("win", F.lit(k)))) for k in range(width)]
    return wins.select("win", "items", F.size("win").alias("n"), _key(F.size("win"), hashes).alias("key"))


def hits(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per (doc_id, text hash): copies, n_words, spans (array of word position and length), items."""
    spark = docs.sparkSession
    wins = stored(benchmark_windows(bench, width), "bench_windows")
    size = wins.agg(F.sum(F.length(F.array_join("win", " ")) * 4 + F.length(F.array_join("items", " ")) * 4 + 64)).first()[0] or 0
    slices = -(-size // SLICE_BYTES) or 1
    lens = sorted(r.n for r in wins.select("n").distinct().collect())  # at most WIDTH values
    mark = spark.range(1).select(
        F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"),
        F.lit(0).alias("n"), F.lit(_MARK).cast("long").alias("key"))
    base = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))

    def probes(w: Column, marked: bool) -> Column:
        def of(h: Column, n: int) -> Column:
            return F.transform(h, lambda x, i: F.struct(
                i.alias("pos"), _key(n, [x, *[F.get(h, i + k) for k in range(1, n)]]).alias("key")))

        mark_row = [F.array(F.struct(F.lit(-1).alias("pos"), F.lit(_MARK).cast("long").alias("key")))] if marked else []
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*mark_row, *[of(h, n) for n in lens]))

    out = None
    for k in range(slices):
        if k and not lens:
            break
        part = wins.where(F.pmod(F.xxhash64("win"), F.lit(slices)) == k) if slices > 1 else wins
        part = part.unionByName(mark) if k == 0 else part
        first = k == 0
        # As a column of their own the probes leave explode in generated code, where w is not copied for every word.
        # The outer form keeps the optimizer from computing them twice more for a filter on empty arrays.
        at = base.select("doc_id", "h", "w", let(F.col("w"), lambda w: probes(w, first)).alias("probes")) \
            .select("doc_id", "h", "w", F.explode_outer("probes").alias("e"))
        found = at.join(F.broadcast(part), F.col("e.key") == F.col("key")).where(
            F.when(F.col("n") == 0, F.col("e.pos") < 0).otherwise(
                (F.col("e.pos") >= 0) & (F.slice(F.col("w"), F.greatest(F.col("e.pos") + 1, F.lit(1)), F.greatest(F.col("n"), F.lit(1))) == F.col("win"))))
        found = found.select("doc_id", "h", F.size("w").alias("n_words"), F.col("e.pos").alias("pos"), "n", "items")
        out = found if out is None else out.unionByName(found)
    real = F.col("pos") >= 0
    return out.groupBy("doc_id", "h").agg(
        F.sum(F.when(~real, 1)).alias("copies"), F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(real, F.struct("pos", "n"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(real, F.col("items"))))).alias("items"))


def covered(spans: Column) -> Column:
    """Number of positions inside any (pos, n) span."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, lambda acc, s: F.struct(
        (acc["total"] + F.greatest(F.lit(0), s["pos"] + s["n"] - F.greatest(acc["end"], s["pos"]))).alias("total"),
        F.greatest(acc["end"], s["pos"] + s["n"]).alias("end")), lambda acc: acc["total"]).cast("long")


def judge(found: DataFrame) -> DataFrame:
    """One row per document: doc_id, h, n_words, n_hit, items, contaminated, spans."""
    return found.select("doc_id", "h", "copies", "n_words", covered(F.col("spans")).alias("n_hit"),
                        F.sort_array("items").alias("items"), "spans").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with the hit words of
    contaminated documents cut out and the rest of each text kept as it is (``remove="spans"``)."""
    bad = judge(hits(docs, bench, width)).where("contaminated")
    h, did, spans = fresh(docs, "text_hash", "bad_id", "hit_spans")
    bad = bad.select(F.col("doc_id").alias(did), F.col("h").alias(h), *([F.col("spans").alias(spans)] if remove == "spans" else []))
    bad = stored(bad, "contaminated")
    match = docs["doc_id"].eqNullSafe(F.col(did)) & (F.xxhash64(docs["text"]) == F.col(h))
    if remove == "documents":
        return docs.join(hinted(bad), match, "left_anti")
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    joined = docs.join(bad, match, "left")
    sep, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    kept = let(F.col(spans), lambda sp: F.array_join(F.filter(
        F.regexp_extract_all(F.col("text"), F.lit(sep + word), F.lit(0)),
        lambda _, i: ~F.exists(sp, lambda s: (i >= s["pos"]) & (i < s["pos"] + s["n"]))), ""))
    tail = F.regexp_extract(F.col("text"), f"({sep})$", 1)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(kept, tail))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document row."""
    r = judge(hits(docs, bench))
    return r.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
