"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source).  At each node the
children share it in proportion to their weights; a child whose subtree can't
supply its share (tokens times the allowed epochs) gives all it has, and its
shortage goes to its siblings first.  Only what no sibling can take had already
gone to the siblings of an ancestor, because every subtree's supply bounds its
allotment from the top.  Each leaf then takes whole epochs and, of the last
one, the token-prefix in the seeded order of that epoch.

The prefix is found without ordering a leaf in one place: tokens per leaf and
hash range, running totals over 256 ranges, then the same inside the one range
that the cut falls into, ``DEPTH`` times; only the rows of the last range (a
16-millionth of the leaf) are put in order.  All arithmetic is on integers and decimals, so
results do not depend on the order of addition.

Edge cases: null levels become ``(none)``; a null or empty text has no tokens
and rides along for free; documents with one id share a hash and are taken or
left together, as are those with null ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.llm.common import fresh, hinted, stored

#: Fixed production parameters.
LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 5, "d1": 3, "d2": 2},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 3},
}
BUDGET = (3, 5)  # part of all tokens of the input
MAX_EPOCHS = 2
SEED = 17
NONE = "(none)"
DEPTH = 3  # rounds of 256 hash ranges
_DEC = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Token estimate: a token for every four UTF-8 bytes begun."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source in these tables: by the first hex digit of the name's MD5."""
    first = F.substring(F.md5(F.coalesce(source, F.lit(NONE))), 1, 1)
    return F.when(first < "6", F.lit("d0")).when(first < "b", F.lit("d1")).otherwise(F.lit("d2"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Children of nodes with ``budget``: adds ``alloc``, the weighted share cut at the supply ``cap``."""
    order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy((F.col("cap") / F.col("w")).asc(), F.col(level).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(parent or [F.lit(0)]))
    c = children.withColumn("given", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    c = c.withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    full = F.col("cap").cast(_DEC) * F.col("left_w").cast(_DEC) <= F.col("w").cast(_DEC) * (F.col("budget") - F.col("given")).cast(_DEC)
    c = c.withColumn("full", full)
    c = c.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
    c = c.withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole))
    alloc = F.when(F.col("full"), F.col("cap")).otherwise(
        F.expr(f"cast(w as {_DEC}) * cast(rest as {_DEC}) div greatest(open_w, 1)"))
    return c.withColumn("alloc", alloc.cast("long")).drop("given", "left_w", "full", "rest", "open_w", "budget")


def allocate(leaves: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Leaves (levels, total) with ``alloc`` tokens each.  The tree has a row per leaf: small next to the documents."""
    levels = list(LEVELS)
    leaf = leaves.withColumn("cap", F.col("total") * max_epochs)
    total = leaf.agg(F.sum("total")).first()[0] or 0
    node, root = None, min(total * budget[0] // budget[1], total * max_epochs)
    for depth, level in enumerate(levels):
        parent, own = levels[:depth], levels[:depth + 1]
        kids = leaf.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        kids = kids.join(node, parent) if parent else kids.withColumn("budget", F.lit(root).cast("long"))
        node = _share(kids, parent, level).select(*own, F.col("alloc").alias("budget"))
    return leaf.join(node.withColumnRenamed("budget", "alloc"), levels).select(*levels, "total", "alloc")


def _hash(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(narrow: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """(levels, whole, cut) per leaf: whole epochs, and the last hash taken in the next (null: none).

    ``narrow``: stored rows of doc_id, tokens and the levels."""
    levels = list(LEVELS)
    leaves = stored(narrow.groupBy(*levels).agg(F.sum("tokens").alias("total")), "mix_leaves")
    alloc = stored(allocate(leaves, **how).select(
        *levels, F.expr("if(total > 0, alloc div greatest(total, 1), 0)").alias("whole"),
        F.expr("if(total > 0, alloc % greatest(total, 1), 0)").alias("part")), "mix_alloc")
    rows = narrow.join(hinted(alloc.where("part > 0")), levels).withColumn("hash", _hash(F.col("whole"), F.col("doc_id"), seed))
    by_leaf = Window.partitionBy(*levels)

    def upto(parts: DataFrame, by: str) -> DataFrame:
        return parts.withColumn("upto", F.sum("t").over(by_leaf.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))

    cut = alloc.where("part > 0").select(*levels, F.lit("").alias("range"), F.col("part").alias("room"))
    for depth in range(1, DEPTH + 1):
        above = F.substring("hash", 1, 2 * depth - 2)
        inside = rows.withColumn("range", above).join(hinted(cut), [*levels, "range"])
        ranges = inside.withColumn("range", F.substring("hash", 1, 2 * depth)).groupBy(*levels, "room", "range").agg(F.sum("tokens").alias("t"))
        cut = stored(upto(ranges, "range").where("upto > room").groupBy(*levels).agg(
            F.min("range").alias("range"), F.min_by(F.col("room") - F.col("upto") + F.col("t"), "range").alias("room")), "mix_cut")
    inside = rows.withColumn("range", F.substring("hash", 1, 2 * DEPTH)).join(hinted(cut), [*levels, "range"])
    hashes = inside.groupBy(*levels, "room", "hash").agg(F.sum("tokens").alias("t"))
    taken = upto(hashes, "hash").where("upto <= room").groupBy(*levels).agg(F.max("hash").alias("hash"))
    last = cut.join(taken, levels, "left").select(*levels, F.coalesce("hash", "range").alias("cut"))
    return alloc.select(*levels, "whole").join(last, levels, "left")


def with_levels(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", domain_of(F.col("source"))).withColumn("lang", F.coalesce("lang", F.lit(NONE))) \
        .withColumn("source", F.coalesce("source", F.lit(NONE)))


def narrowed(docs: DataFrame) -> DataFrame:
    return stored(with_levels(docs.select("doc_id", "lang", "source", tokens(F.col("text")).alias("tokens"))), "mix_tokens")


def _epochs(rows: DataFrame, epoch: str, whole: str, cut: str, doc_id: str, seed: int) -> DataFrame:
    """A row per epoch in which the document is taken."""
    out = rows.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(whole))))
    return out.where((F.col(epoch) < F.col(whole)) | (_hash(F.col(epoch), F.col(doc_id), seed) <= F.col(cut)))


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch: a row for every time a document is used."""
    narrow = narrowed(docs)
    p = stored(plan(narrow, seed), "mix_plan")
    return _epochs(narrow.join(hinted(p), list(LEVELS)), "epoch", "whole", "cut", "doc_id", seed).select(
        "doc_id", "domain", "lang", "source", "tokens", "epoch")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs``, each row repeated for every epoch that uses it, plus the column ``epoch``."""
    p = plan(narrowed(docs), seed)
    d, l, s, w, c, e = fresh(docs, "mix_domain", "mix_lang", "mix_source", "mix_whole", "mix_cut", "epoch")
    p = stored(p.toDF(d, l, s, w, c), "mix_plan")
    on = (domain_of(docs["source"]) == F.col(d)) & (F.coalesce(docs["lang"], F.lit(NONE)) == F.col(l)) & (
        F.coalesce(docs["source"], F.lit(NONE)) == F.col(s))
    return _epochs(docs.join(hinted(p), on), e, w, c, "doc_id", seed).select(*docs.columns, e)


def _case(level: str) -> str:
    whens = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    return f"CASE{whens} ELSE 1 END" if whens else "1"


def _level_sql(depth: int) -> str:
    own, parent = LEVELS[:depth + 1], LEVELS[:depth]
    level, cols, up = LEVELS[depth], ", ".join(own), ", ".join(parent)
    part = f"PARTITION BY {up}" if parent else ""
    using = f"JOIN n{depth} USING ({up})" if parent else f"CROSS JOIN n{depth}"
    return f"""
    k{depth} AS (SELECT * FROM (SELECT {cols}, sum(cap)::HUGEINT AS cap, {_case(level)} AS w FROM leaf GROUP BY {cols}) {using}),
    o{depth} AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS given, sum(w) OVER a - coalesce(sum(w) OVER b, 0) AS left_w FROM k{depth}
        WINDOW a AS ({part}), b AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f{depth} AS (SELECT *, cap * left_w <= w * (budget - given) AS is_full FROM o{depth}),
    r{depth} AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER a AS rest,
        sum(CASE WHEN is_full THEN 0 ELSE w END) OVER a AS open_w FROM f{depth} WINDOW a AS ({part})),
    n{depth + 1} AS (SELECT {cols}, CASE WHEN is_full THEN cap ELSE w * rest // greatest(open_w, 1) END AS budget FROM r{depth})"""


_MD5 = "md5('{seed}:' || {epoch}::VARCHAR || ':' || coalesce(doc_id::VARCHAR, ''))"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
        coalesce((strlen(text) + 3) // 4, 0) AS tokens, md5(coalesce(source, '{NONE}'))[1] AS digit FROM documents),
    x AS (SELECT * EXCLUDE digit, CASE WHEN digit < '6' THEN 'd0' WHEN digit < 'b' THEN 'd1' ELSE 'd2' END AS domain FROM d),
    leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS total, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS cap FROM x GROUP BY ALL),
    n0 AS (SELECT least(sum(total) * {BUDGET[0]} // {BUDGET[1]}, sum(cap)) AS budget FROM leaf),
    {", ".join(_level_sql(i) for i in range(len(LEVELS)))},
    p AS (SELECT domain, lang, source, budget // greatest(total, 1) AS whole, budget % greatest(total, 1) AS part
        FROM leaf JOIN n3 USING (domain, lang, source) WHERE total > 0),
    e AS (SELECT x.*, whole, part, unnest(range(whole::BIGINT + 1)) AS epoch FROM x JOIN p USING (domain, lang, source)),
    h AS (SELECT *, {_MD5.format(seed=SEED, epoch='epoch')} AS hash FROM e),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY hash) AS upto FROM h)
SELECT doc_id, domain, lang, source, tokens, epoch FROM s WHERE epoch < whole OR (part > 0 AND upto <= part)
"""
