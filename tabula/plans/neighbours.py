"""Neighbour queries on the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.operators.neighbors import knn
from tabula.operators.profile import sig
from tabula.plans.registry import register
from tabula.session import cut_lineage, scratch_path
from tabula.sources.readers import read_table

K = 5


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


EMB_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
D2_SQL = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"


def _sig_sql(expr: str, digits: int = 10) -> str:
    return f"CAST(printf('%.{digits - 1}e', {expr}) AS DOUBLE)"


@register("knn_self_join", f"""
    WITH e AS ({EMB_SQL}),
    p AS (SELECT a.vec_id AS qid, b.vec_id AS nid, {D2_SQL} AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, nid) AS rank FROM p)
    SELECT qid, CAST(rank AS INTEGER) AS rank, nid, {_sig_sql('sqrt(d2)')} AS dist FROM r WHERE rank <= {K}
""")
def q_knn_self_join(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    nn = knn(e, e, K, "vec_id", "vec_id", "vec", exclude_self=True)
    return nn.select("qid", "rank", "nid", sig(F.col("dist")).alias("dist"))


@register("knn_within_class", f"""
    WITH e AS ({EMB_SQL}),
    p AS (SELECT a.vec_id AS qid, b.vec_id AS nid, {D2_SQL} AS d2
          FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, nid) AS rank FROM p)
    SELECT qid, CAST(rank AS INTEGER) AS rank, nid, {_sig_sql('sqrt(d2)')} AS dist FROM r WHERE rank <= {K}
""")
def q_knn_within_class(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    nn = knn(e, e, K, "vec_id", "vec_id", "vec", group="label", exclude_self=True)
    return nn.select("qid", "rank", "nid", sig(F.col("dist")).alias("dist"))


# ── B1: SMOTE on the embeddings (every class up to the largest) ─────────────
SEED = 42


def _h(key: str, tag: str) -> str:
    from tabula.plans.sqltext import h32
    return h32(SEED, key, tag)


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}.v) + 1), lambda i: ({a}.v[i] - {b}.v[i]) * ({a}.v[i] - {b}.v[i])))"


def smote_ctes(src: str, p: str = "") -> str:
    """DuckDB CTEs of SMOTE over relation ``src(vec_id, label, v)``; result in ``{p}syn``."""
    return f"""
    {p}cnt AS (SELECT label, count(*) AS n FROM {src} GROUP BY label),
    {p}mx AS (SELECT max(n) AS nmax FROM {p}cnt),
    {p}need AS (SELECT label, n, nmax - n AS m FROM {p}cnt, {p}mx WHERE n < nmax),
    {p}mino AS (SELECT x.* FROM {src} x JOIN {p}need USING (label)),
    {p}ranked AS (SELECT mi.vec_id, mi.label, mi.v, nd.n, nd.m,
                      row_number() OVER (PARTITION BY mi.label ORDER BY {_h('mi.vec_id', 'base')}, mi.vec_id) - 1 AS r
               FROM {p}mino mi JOIN {p}need nd USING (label)),
    {p}quota AS (SELECT *, CAST(m // n AS BIGINT) + CASE WHEN r < m % n THEN 1 ELSE 0 END AS q FROM {p}ranked),
    {p}slots AS (SELECT vec_id, label, v, n, unnest(range(0, q)) AS slot FROM {p}quota WHERE q > 0),
    {p}keyed AS (SELECT *, CAST(vec_id AS VARCHAR) || ':' || CAST(slot AS VARCHAR) AS id FROM {p}slots),
    {p}pick AS (SELECT *, CAST(({_h('id', 'nn')} % least({K}, n - 1)) + 1 AS INTEGER) AS nn_rank,
                    CAST({_h('id', 'gap')} AS DOUBLE) / CAST(4294967296.0 AS DOUBLE) AS gap FROM {p}keyed),
    {p}p AS (SELECT a.vec_id AS qid, b.vec_id AS nid, {_d2('a', 'b')} AS d2
          FROM {p}mino a JOIN {p}mino b ON a.label = b.label AND a.vec_id <> b.vec_id),
    {p}nn AS (SELECT qid, nid, row_number() OVER (PARTITION BY qid ORDER BY d2, nid) AS rk FROM {p}p),
    {p}syn AS (SELECT pk.label, pk.id, pk.vec_id AS base_id, CAST(pk.slot AS INTEGER) AS slot, nn.nid AS nn_id,
                   pk.gap,
                   list_transform(range(1, len(pk.v) + 1), lambda i: pk.v[i] + pk.gap * (b.v[i] - pk.v[i])) AS nv
            FROM {p}pick pk JOIN {p}nn nn ON nn.qid = pk.vec_id AND nn.rk = pk.nn_rank JOIN {src} b ON b.vec_id = nn.nid)
"""


def tomek_ctes(src: str, p: str = "") -> str:
    """DuckDB CTEs of Tomek links over ``src(vec_id, label, v)``; links in ``{p}tl``, kept rows in ``{p}kept``."""
    return f"""
    {p}p AS (SELECT a.vec_id AS qid, b.vec_id AS nid, {_d2('a', 'b')} AS d2 FROM {src} a JOIN {src} b ON a.vec_id <> b.vec_id),
    {p}r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, nid) AS rk FROM {p}p),
    {p}nn1 AS (SELECT qid, nid FROM {p}r WHERE rk = 1),
    {p}links AS (SELECT a.qid AS a_id, a.nid AS b_id FROM {p}nn1 a JOIN {p}nn1 b ON a.qid = b.nid AND a.nid = b.qid),
    {p}tl AS (SELECT l.a_id, l.b_id, ea.label AS a_y, eb.label AS b_y
           FROM {p}links l JOIN {src} ea ON ea.vec_id = l.a_id JOIN {src} eb ON eb.vec_id = l.b_id
           WHERE ea.label <> eb.label),
    {p}cnt AS (SELECT label, count(*) AS n FROM {src} GROUP BY label),
    {p}minority AS (SELECT label FROM {p}cnt ORDER BY n, label LIMIT 1),
    {p}kept AS (SELECT * FROM {src}
               WHERE vec_id NOT IN (SELECT a_id FROM {p}tl WHERE a_y <> (SELECT label FROM {p}minority)))
"""


SMOTE_SQL = f"WITH e AS ({EMB_SQL}), " + smote_ctes("e")


@register("smote_synthetic", SMOTE_SQL + f"""
    SELECT label, id, base_id, slot, nn_id, gap, nv[1] AS v0, {_sig_sql('list_sum(nv)')} AS v_sum FROM syn
""")
def q_smote_synthetic(spark, sf_dir):
    from tabula.operators.rebalance import smote
    out = smote(embeddings(spark, sf_dir), "label", "vec_id", "vec", k=K, seed=SEED, keep_originals=False)
    return out.select("label", "id", "base_id", "slot", "nn_id", "gap", F.col("vec")[0].alias("v0"),
                      sig(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("v_sum"))


@register("smote_class_balance", SMOTE_SQL + """
    SELECT label, count(*) AS n_rows FROM (SELECT label FROM e UNION ALL SELECT label FROM syn) GROUP BY label
""")
def q_smote_balance(spark, sf_dir):
    from tabula.operators.rebalance import smote
    out = smote(embeddings(spark, sf_dir), "label", "vec_id", "vec", k=K, seed=SEED)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


# ── J6 / B3: Tomek links ────────────────────────────────────────────────────
TOMEK_SQL = f"WITH e AS ({EMB_SQL}), " + tomek_ctes("e")


@register("tomek_links", TOMEK_SQL + "SELECT a_id, b_id, a_y, b_y FROM tl")
def q_tomek_links(spark, sf_dir):
    from tabula.operators.rebalance import tomek_links
    return tomek_links(embeddings(spark, sf_dir), "label", "vec_id", "vec", seed=SEED)


@register("tomek_resample", TOMEK_SQL + "SELECT vec_id, label FROM kept")
def q_tomek_resample(spark, sf_dir):
    from tabula.operators.rebalance import tomek
    return tomek(embeddings(spark, sf_dir), "label", "vec_id", "vec", seed=SEED).select("vec_id", "label")


# ── T3: k-NN classifier on a stratified split ───────────────────────────────
def _emb_split_sql() -> str:
    from tabula.plans.fixtures import split_sql
    return split_sql(EMB_SQL, "label", "vec_id", SEED)


@register("knn_classifier", f"""
    WITH s AS ({_emb_split_sql()}),
    tr AS (SELECT * FROM s WHERE split = 'train'),
    qs AS (SELECT * FROM s WHERE split <> 'train'),
    p AS (SELECT a.vec_id AS qid, b.vec_id AS nid, b.label AS nl, {D2_SQL} AS d2 FROM qs a, tr b),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, nid) AS rk FROM p),
    votes AS (SELECT qid, nl, count(*) AS c FROM r WHERE rk <= {K} GROUP BY qid, nl),
    best AS (SELECT qid, nl AS y_pred, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY qid) AS DOUBLE) AS confidence,
                    row_number() OVER (PARTITION BY qid ORDER BY c DESC, nl) AS o FROM votes)
    SELECT qs.vec_id, qs.split, qs.label AS y_true, best.y_pred, best.confidence
    FROM qs JOIN best ON best.qid = qs.vec_id AND best.o = 1
""")
def q_knn_classifier(spark, sf_dir):
    from tabula.operators.neighbors import knn_vote
    from tabula.operators.split import stratified_split
    s = stratified_split(embeddings(spark, sf_dir), "label", "vec_id", seed=SEED)
    s = cut_lineage(s)
    tr = s.where(F.col("split") == "train")
    qs = s.where(F.col("split") != "train")
    nn = knn(qs, tr, K, "vec_id", "vec_id", "vec")
    pred = knn_vote(nn, tr, "vec_id", "label")
    return (qs.select("vec_id", "split", F.col("label").alias("y_true"))
            .join(pred.withColumnRenamed("qid", "vec_id"), on="vec_id"))


# ── J1, T3: the stored index ────────────────────────────────────────────────
def _index(spark: SparkSession, sf_dir: str):
    from tabula.operators.neighbor_index import NeighborIndex, build_index
    path = build_index(embeddings(spark, sf_dir), scratch_path(spark, "embedding-index"), "vec_id", "vec")
    return NeighborIndex(spark, path)


@register("knn_index_exact", f"""
    WITH e AS ({EMB_SQL}),
    p AS (SELECT a.vec_id AS qid, b.vec_id AS nid, {D2_SQL} AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, nid) AS rank FROM p)
    SELECT qid, CAST(rank AS INTEGER) AS rank, nid, {_sig_sql('sqrt(d2)')} AS dist FROM r WHERE rank <= {K}
""")
def q_knn_index_exact(spark, sf_dir):
    """The exact answer from the stored index."""
    nn = _index(spark, sf_dir).search(embeddings(spark, sf_dir), "vec_id", "vec", K, exclude_self=True)
    return nn.select("qid", "rank", "nid", sig(F.col("dist")).alias("dist"))


RECALL = 0.95


@register("knn_index_recall", f"""
    SELECT count(*) AS n_queries, count(*) * least({K}, count(*) - 1) AS n_found, true AS recall_reached FROM embeddings
""")
def q_knn_index_recall(spark, sf_dir):
    """The approximate mode against the exact one over all rows: every query gets its k rows, 9 of 10 of them the nearest."""
    from tabula.operators.neighbor_index import probes_for
    e, index = embeddings(spark, sf_dir), _index(spark, sf_dir)
    near = cut_lineage(index.search(e, "vec_id", "vec", K, probes=probes_for(index, K, RECALL), exclude_self=True))
    true = knn(e, e, K, "vec_id", "vec_id", "vec", exclude_self=True)
    hit = near.select("qid", "nid", F.lit(1).alias("hit"))
    both = true.select("qid", "nid").join(hit, ["qid", "nid"], "full")
    n, found = e.count(), near.count()
    missed = both.agg(F.count_if(F.col("hit").isNull()).alias("missed"))
    return missed.select(F.lit(n).alias("n_queries"), F.lit(found).alias("n_found"), (F.col("missed") <= 0.1 * found).alias("recall_reached"))
