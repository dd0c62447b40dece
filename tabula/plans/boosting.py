"""Second-order boosting on orders (T5), every split and leaf recomputed in SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.operators.boosting import BoostedTrees, Tree
from tabula.operators.profile import sig
from tabula.plans import sqltext as S
from tabula.plans.fixtures import ORDERS_LABELLED_SQL, orders_labelled
from tabula.plans.profiling import _sig
from tabula.plans.registry import register
from tabula.session import cut_lineage

ROUNDS, DEPTH, ETA, LAMBDA, SHIFT = 3, 3, 0.3, 1.0, 30
#: Orders of status P have no weekday: a feature with missing values.
FEATURES_SQL = f"""
    SELECT label AS y, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x0, CAST(year(o_orderdate) AS DOUBLE) AS x1,
        CAST(month(o_orderdate) AS DOUBLE) AS x2, CASE WHEN o_orderstatus <> 'P' THEN CAST(dayofmonth(o_orderdate) AS DOUBLE) END AS x3,
        CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x4
    FROM ({ORDERS_LABELLED_SQL})
"""
N = 5


def boosting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders_labelled(spark, sf_dir)
    x = [F.substring("o_orderpriority", 1, 1).try_cast("double"), F.year("o_orderdate"), F.month("o_orderdate"),
         F.when(F.col("o_orderstatus") != "P", F.dayofmonth("o_orderdate")), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)]
    full = [F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in x]
    return o.select("label", array_to_vector(F.array(*full)).alias("features"))


def _level(r: int, d: int, rows: str) -> str:
    """CTEs of one level: best split of each open node of ``rows`` (y, x..., m, g, h, node, live)."""
    t, unit = f"r{r}d{d}", f"{float(1 << SHIFT)!r}::DOUBLE"
    score = lambda g, h: f"(({g}) / {unit}) * (({g}) / {unit}) / (({h}) / {unit} + {S.dbl(LAMBDA)})"
    long = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, g, h FROM {rows} WHERE live" for i in range(N))
    side = lambda m: f"""SELECT node, f, v, {m} AS m, n, ga, ha, gl + {m} * gm AS gl, hl + {m} * hm AS hl, nl + {m} * nm AS nl
        FROM {t}c WHERE NOT last {'AND nm > 0' if m else ''}"""  # noqa: E731
    gain = f"{score('gl', 'hl')} + {score('ga - gl', 'ha - hl')} - {score('ga', 'ha')}"
    return f"""
    {t}l AS MATERIALIZED (SELECT node, f, v, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, count(*) AS n FROM ({long}) GROUP BY node, f, v),
    {t}t AS (SELECT node, sum(g)::BIGINT AS ga, sum(h)::BIGINT AS ha, sum(n) AS n FROM {t}l WHERE f = 0 GROUP BY node),
    {t}m AS (SELECT node, f, g AS gm, h AS hm, n AS nm FROM {t}l WHERE v IS NULL),
    {t}c AS (SELECT l.node, l.f, l.v, t.n, t.ga, t.ha, coalesce(gm, 0) AS gm, coalesce(hm, 0) AS hm, coalesce(nm, 0) AS nm,
        sum(l.g) OVER w AS gl, sum(l.h) OVER w AS hl, sum(l.n) OVER w AS nl, l.v = max(l.v) OVER (PARTITION BY l.node, l.f) AS last
        FROM {t}l l JOIN {t}t t USING (node) LEFT JOIN {t}m m ON m.node = l.node AND m.f = l.f WHERE l.v IS NOT NULL
        WINDOW w AS (PARTITION BY l.node, l.f ORDER BY l.v)),
    {t}s AS (SELECT *, {gain} AS gain FROM ({side(0)} UNION ALL {side(1)}) WHERE hl / {unit} >= 1 AND (ha - hl) / {unit} >= 1),
    {t}b AS MATERIALIZED (SELECT *, (SELECT min(x) FROM vals WHERE vals.f = b.f AND vals.x > b.v) AS cut FROM (SELECT * FROM {t}s WHERE gain > 1e-6
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v, m) = 1) b)"""


def trees_sql() -> str:
    unit = f"{float(1 << SHIFT)!r}::DOUBLE"
    xs = ", ".join(f"x{i}" for i in range(N))
    leaf = lambda g, h: f"-{S.dbl(ETA)} * (({g}) / {unit}) / (({h}) / {unit} + {S.dbl(LAMBDA)})"
    ctes = [f"base AS MATERIALIZED ({FEATURES_SQL})",
            "vals AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT DISTINCT {i} AS f, x{i} AS x FROM base WHERE x{i} IS NOT NULL" for i in range(N)) + ")",
            f"m0 AS (SELECT y, {xs}, 0.0::DOUBLE AS m FROM base)"]
    parts = []
    for r in range(1, ROUNDS + 1):
        ctes.append(f"""r{r}n0 AS MATERIALIZED (SELECT *, round((1 / (1 + exp(-m)) - y) * {unit})::BIGINT AS g,
            round((1 / (1 + exp(-m))) * (1 - 1 / (1 + exp(-m))) * {unit})::BIGINT AS h, 1 AS node, true AS live FROM m{r - 1})""")
        for d in range(DEPTH):
            ctes.append(_level(r, d, f"r{r}n{d}"))
            v = "CASE b.f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(N)) + " END"
            left = f"CASE WHEN ({v}) IS NULL THEN b.m = 1 ELSE ({v}) <= b.v END"
            ctes.append(f"""r{r}n{d + 1} AS MATERIALIZED (SELECT y, {xs}, n.m, n.g, n.h, b.node IS NOT NULL AS live,
                CASE WHEN b.node IS NULL THEN n.node WHEN {left} THEN 2 * n.node ELSE 2 * n.node + 1 END AS node
                FROM r{r}n{d} n LEFT JOIN r{r}d{d}b b ON b.node = n.node AND n.live)""")
            parts.append(f"SELECT {r} AS round, node, f AS feature, cut, m AS missing_left, gain FROM r{r}d{d}b")
        ctes.append(f"r{r}w AS MATERIALIZED (SELECT node, {leaf('sum(g)', 'sum(h)')} AS w, count(*) AS n FROM r{r}n{DEPTH} GROUP BY node)")
        ctes.append(f"m{r} AS MATERIALIZED (SELECT y, {xs}, n.m + w.w AS m FROM r{r}n{DEPTH} n JOIN r{r}w w USING (node))")
    leaves = " UNION ALL ".join(f"SELECT {r}, node, NULL, NULL, NULL, NULL, {_sig('w', 7)}, n FROM r{r}w" for r in range(1, ROUNDS + 1))
    splits = " UNION ALL ".join(parts)
    return f"""WITH {", ".join(ctes)}
    SELECT round, node, feature, cut, missing_left, {_sig('gain', 7)} AS gain, CAST(NULL AS DOUBLE) AS weight, CAST(NULL AS BIGINT) AS n FROM ({splits})
    UNION ALL {leaves}"""


def tree_rows(tree: Tree, number: int) -> list[tuple]:
    """(round, node, feature, cut, missing_left, gain, weight, n); node 1 is the root, 2i and 2i + 1 the children of i."""
    out, todo = [], [(0, 1)]
    while todo:
        i, name = todo.pop()
        if tree.feature[i] < 0:
            out.append((number, name, None, None, None, None, tree.weight[i], tree.n[i]))
        else:
            out.append((number, name, tree.feature[i], tree.cut[i], tree.missing[i], tree.gain[i], None, None))
            todo += [(tree.left[i], 2 * name), (tree.right[i], 2 * name + 1)]
    return out


@register("boosted_trees", trees_sql())
def q_boosted_trees(spark, sf_dir):
    """T5: splits, gains and leaf weights of the first rounds over all orders."""
    model = BoostedTrees(rounds=ROUNDS, maxDepth=DEPTH, eta=ETA, regLambda=LAMBDA).fit(cut_lineage(boosting_rows(spark, sf_dir)))
    rows = [row for k, trees in enumerate(model.rounds()) for row in tree_rows(trees[0], k + 1)]
    out = spark.createDataFrame(rows, "round int, node int, feature int, cut double, missing_left int, gain double, weight double, n bigint")
    return out.withColumn("gain", sig(F.col("gain"), 7)).withColumn("weight", sig(F.col("weight"), 7))
