"""Random forest whose trees grow until their leaves are pure (T2): level-wise growth as tables.

Neither the rows nor the trees are held anywhere: the state is a table of (tree, node, label, weight, values), one row per row and
tree that drew it, and the trees are a table of nodes, one folder per level.  A level costs a pass:

1. Rows are counted per (tree, node, feature, cell, class) over the features that the node drew.  A node of
   more than ``EXACT_ROWS`` rows has the cells of the feature's ``MAX_BINS`` cuts, a smaller one a cell for
   every value, so no window gets larger than that and every split can be found in the end.
2. Running counts over a node's cells give the weighted Gini impurity of each cut; the best one is the node's split.
3. Rows are joined with the splits and go to the left or right child.  Rows of nodes that are pure, or
   that no feature splits, stay behind: their node is a leaf with its class counts.  A node whose drawn features
   don't split it draws others in the next pass, until all have been tried.

So depth is bounded by the table alone and costs passes, not driver memory.  Draws are keyed hashes: of a
row's weight in a tree (a Poisson bootstrap) and of a node's features, independent of partitions.

Scoring sends a row through a tree in a numpy loop where the nodes, measured, are below ``NODE_BYTES``; larger
forests are walked by a join per level.  Probabilities are means of the leaves' class shares.

Defined results: rows without a label, or with a feature that is not finite, take no part in the fit; ties of impurity go
to the smaller feature and value; equal rows of different labels end in a leaf that holds both; one class
only is a forest of roots; a scored row with features that are not finite gets nulls.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabula.functions.hashing import hash32
from tabula.operators.boosting import cut_points
from tabula.operators.neighbors import finite_vector
from tabula.operators.sums import array_column
from tabula.session import cut_lineage, scratch_path

EXACT_ROWS, MAX_BINS = 100_000, 256
NODE_BYTES = 64 << 20
_NODES = "tree int, node long, feature int, cut double, left long, right long, counts array<double>, level int"


def poisson_weight(u: Column, most: int = 12) -> Column:
    """A Poisson(1) draw from a uniform number (the tail beyond ``most`` is 1e-10)."""
    out, total, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(most):
        total += p
        out = out + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    return out


def _bin_names(cuts: list):
    """The function from a row's values to its bins: for each feature the next cut above the value, which names the bin."""
    edges = [np.append(np.asarray(c, dtype=float), np.inf) for c in cuts]

    @F.pandas_udf("array<double>")
    def names(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.empty((0, len(edges)))
        return pd.Series(list(np.stack([e[np.searchsorted(e[:-1], m[:, i], side="right")] for i, e in enumerate(edges)], axis=1)))

    return names


class DeepForestModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    path = Param(Params._dummy(), "path", "table of nodes", typeConverter=TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "class values in order", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol="features", predictionCol="prediction", path=None, classes=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader(cls)

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_NODES).parquet(self.getOrDefault(self.path))

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, nodes = self.getOrDefault(self.classes), self.nodes(df.sparkSession)
        x = F.when(finite_vector(vector_to_array(F.col(self.getFeaturesCol()))), vector_to_array(F.col(self.getFeaturesCol())))
        size = nodes.count() * (48 + 8 * len(classes))
        out = self._local(df, x, nodes.collect(), len(classes)) if size <= NODE_BYTES else self._joined(df, x, nodes, len(classes))
        best = F.array_position("_p", F.array_max("_p")).cast("int") - 1  # ties to the smaller class
        return out.withColumn(self.getPredictionCol(), F.get(F.lit(classes), best)).withColumn("probability", F.when(F.col("_p").isNotNull(), array_to_vector("_p"))).drop("_p")

    def _local(self, df: DataFrame, x: Column, nodes: list, k: int) -> DataFrame:
        nodes.sort(key=lambda r: (r["tree"], r["node"]))
        place = {(r["tree"], r["node"]): i for i, r in enumerate(nodes)}
        feature = np.array([-1 if r["feature"] is None else r["feature"] for r in nodes])
        cut = np.array([np.nan if r["cut"] is None else r["cut"] for r in nodes])
        kids = np.array([(-1, -1) if r["left"] is None else (place[(r["tree"], r["left"])], place[(r["tree"], r["right"])]) for r in nodes])
        counts = np.array([r["counts"] for r in nodes], dtype=float).reshape(len(nodes), k)
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)
        roots = [i for (_, n), i in place.items() if n == 1]

        @F.pandas_udf("array<double>")
        def walk(v: pd.Series) -> pd.Series:
            some = v.notna().to_numpy()
            m = np.stack(v[some].to_numpy()) if some.any() else np.empty((0, 1))
            rows, total = np.arange(len(m)), np.zeros((len(m), k))
            for root in roots:
                at = np.full(len(m), root)
                while True:
                    live = feature[at] >= 0
                    if not live.any():
                        break
                    right = m[rows[live], feature[at[live]]] > cut[at[live]]
                    at[live] = kids[at[live], right.astype(int)]
                total += share[at]
            return array_column(some, total / len(roots))

        return df.withColumn("_p", walk(x))

    def _joined(self, df: DataFrame, x: Column, nodes: DataFrame, k: int) -> DataFrame:
        """The same by tables: a row per row and tree, moved down by a join with each level's nodes."""
        keyed = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        depth = nodes.agg(F.max("level")).first()[0]
        trees = nodes.select("tree").where("node = 1").distinct()
        at = keyed.select("_row", x.alias("_x")).where("_x is not null").withColumn("tree", F.explode(F.lit([r["tree"] for r in trees.collect()])))
        at = at.withColumn("node", F.lit(1).cast("long"))
        done = None
        for level in range(depth + 1):
            here = nodes.where(F.col("level") == level).select("tree", "node", "feature", "cut", "left", "right", "counts")
            met = cut_lineage(at.join(here, ["tree", "node"], "left"))  # a node that drew again comes at a later level
            leaf = met.where("counts is not null and feature is null").select("_row", "counts")
            done = leaf if done is None else done.unionByName(leaf)
            down = F.when(F.get("_x", F.col("feature")) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
            at = met.where("counts is null or feature is not null").select("_row", "_x", "tree", F.coalesce(down, "node").alias("node"))
        total = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
        per = done.groupBy("_row").agg(*[F.avg(F.col("counts")[i] / total).alias(f"_p{i}") for i in range(k)])
        per = per.select("_row", F.array(*[F.col(f"_p{i}") for i in range(k)]).alias("_p"))
        return keyed.join(per, "_row", "left").drop("_row")


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.nodes(SparkSession.getActiveSession()).write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str):
        return super().load(path)._set(path=f"{path}/nodes")


class DeepForest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """``bootstrap=False`` with one tree and all features (``drawn=0``) is a plain decision tree."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", typeConverter=TypeConverters.toInt)
    drawn = Param(Params._dummy(), "drawn", "features that a node draws (0: all, -1: the square root)", typeConverter=TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "weigh rows by Poisson draws", typeConverter=TypeConverters.toBoolean)
    idCol = Param(Params._dummy(), "idCol", "unique row key (draws are keyed by it)", typeConverter=TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "of all draws", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100, drawn=-1, bootstrap=True, idCol="row_id", seed=42):
        super().__init__()
        self._setDefault(numTrees=100, drawn=-1, bootstrap=True, idCol="row_id", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> DeepForestModel:
        get = lambda p: self.getOrDefault(getattr(self, p))
        seed, spark = get("seed"), df.sparkSession
        rows = df.select(F.col(self.getLabelCol()).cast("double").alias("y"), vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(get("idCol")).alias("id"))
        rows = cut_lineage(rows.where(F.col("y").isNotNull() & finite_vector(F.col("x"))))
        classes = sorted(r["y"] for r in rows.select("y").distinct().collect()) or [0.0]  # one row per class
        k, d = len(classes), len((rows.first() or {"x": [0.0]})["x"])
        drawn = {0: d, -1: max(1, math.isqrt(d))}.get(get("drawn"), get("drawn"))
        cuts = cut_points(rows, d, MAX_BINS) if rows.count() > EXACT_ROWS else None
        # the bins of a row are found once, not at every level
        bins = F.array().cast("array<double>") if cuts is None else _bin_names(cuts)(F.col("x"))
        weight = poisson_weight(hash32(seed, F.concat_ws(":", "tree", "id"), "weight") / F.lit(2.0 ** 32)) if get("bootstrap") else F.lit(1)
        rows = rows.withColumn("b", bins) if cuts is None else cut_lineage(rows.withColumn("b", bins))
        state = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(get("numTrees") - 1)))).select(
            "tree", F.lit(1).cast("long").alias("node"), F.lit(0).alias("tried"), F.lit(2 ** 62).cast("long").alias("size"),
            (F.array_position(F.lit(classes), F.col("y")) - 1).cast("int").alias("c"), weight.cast("double").alias("w"), "x", "b")
        path = scratch_path(spark, "forest")
        if cuts is None:
            state = state.withColumn("size", F.lit(0).cast("long"))
        state, level = self._stored(state.where("w > 0")), 0
        while not state.isEmpty():
            # children are numbered by pass and row: 2^15 passes of 2^47 splits
            kids = F.shiftleft(F.lit(level + 1).cast("long"), 48) + 2 * F.monotonically_increasing_id()
            split = self._splits(state, cuts, k, d, drawn, seed).withColumn("level", F.lit(level)).withColumn("kids", kids)
            spath = scratch_path(spark, "forest-splits")
            split.write.parquet(spath)
            split = spark.read.schema(split.schema).parquet(spath)
            # nodes that draw again keep their number and are written once they are settled
            settled = split.where("feature is not null or leaf")
            settled.select("tree", "node", "feature", "cut", F.when(F.col("feature").isNotNull(), F.col("kids")).alias("left"),
                           F.when(F.col("feature").isNotNull(), F.col("kids") + 1).alias("right"), "counts", "level") \
                .write.mode("append").partitionBy("level").parquet(path)
            moved = state.drop("size", "tried").join(split.where("not leaf").select("tree", "node", "feature", "cut", "kids", "tried", "n_left", "n"), ["tree", "node"])
            left = F.get("x", F.col("feature")) <= F.col("cut")
            again = F.col("feature").isNull()
            state = self._stored(moved.select(
                "tree", F.when(again, F.col("node")).when(left, F.col("kids")).otherwise(F.col("kids") + 1).alias("node"),
                F.when(again, F.col("tried")).otherwise(0).alias("tried"),
                F.when(again, F.col("n")).when(left, F.col("n_left")).otherwise(F.col("n") - F.col("n_left")).alias("size"), "c", "w", "x", "b"))
            level += 1
        return DeepForestModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), path=path, classes=classes)

    def _stored(self, state: DataFrame) -> DataFrame:
        path = scratch_path(state.sparkSession, "forest-rows")
        state.write.parquet(path)
        return state.sparkSession.read.schema(state.schema).parquet(path)

    def _splits(self, state: DataFrame, cuts: list | None, k: int, d: int, drawn: int, seed: int) -> DataFrame:
        """A row per node: number, counts, n, leaf, and the best split (feature, cut, n_left) of the features drawn, if any."""
        # 1. cells
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda f: F.struct(
            F.xxhash64(F.lit(seed), F.col("tree"), F.col("node"), f).alias("h"), f.alias("f"))))
        mine = F.slice(order, F.col("tried") * drawn + 1, drawn) if drawn < d else order
        own_value = value = F.get("x", F.col("f"))
        if cuts is not None:
            value = F.when(F.col("size") > EXACT_ROWS, F.get("b", F.col("f"))).otherwise(own_value)
        each = state.select("tree", "node", "size", "tried", "c", "w", "x", "b", F.explode(mine).alias("e")).withColumn("f", F.col("e.f"))
        sums = [F.sum(F.when(F.col("c") == i, F.col("w")).otherwise(0.0)).alias(f"c{i}") for i in range(k)]
        keys = ["tree", "node", "f"]
        cells = each.withColumn("u", value).groupBy(*keys, "u", "size", "tried").agg(*sums, F.count(F.lit(1)).alias("m"), F.max(own_value).alias("top"))
        # 2. the best cut of each node
        until = Window.partitionBy(*keys).orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        run = cells.select("*", *[F.sum(f"c{i}").over(until).alias(f"l{i}") for i in range(k)], *[F.sum(f"c{i}").over(whole).alias(f"t{i}") for i in range(k)],
                           F.sum("m").over(until).alias("n_left"), F.sum("m").over(whole).alias("n"), (F.max("u").over(whole) == F.col("u")).alias("last"))

        def gini(parts: list[Column]) -> Column:
            total = sum(parts[1:], parts[0])
            return total - sum((p * p for p in parts[1:]), parts[0] * parts[0]) / total

        left, right = [F.col(f"l{i}") for i in range(k)], [F.col(f"t{i}") - F.col(f"l{i}") for i in range(k)]
        impurity = F.round(gini(left) + F.when(F.col("last"), F.lit(0.0)).otherwise(gini(right)), 9)
        candidate = F.when(~F.col("last"), F.struct(impurity.alias("i"), F.col("f"), F.col("u"), F.col("top"), F.col("n_left")))
        per = run.groupBy("tree", "node", "size", "tried").agg(
            F.min(candidate).alias("best"), F.max(F.col("n")).alias("n"), *[F.max(f"t{i}").alias(f"t{i}") for i in range(k)])
        pure = sum((F.when(F.col(f"t{i}") > 0, 1).otherwise(0) for i in range(k)), F.lit(0)) <= 1
        last_try = (F.col("tried") + 1) * drawn >= d
        split = F.col("best").isNotNull() & ~pure
        exact = (F.col("size") <= EXACT_ROWS) if cuts is not None else F.lit(True)
        leaf = pure | (F.col("best").isNull() & last_try & exact)
        # a large node of which no feature has two bins is looked at again by values
        size = F.when(F.col("best").isNull() & last_try & ~exact, 0).otherwise(F.col("n"))
        return per.select("tree", "node", leaf.alias("leaf"), size.cast("long").alias("n"),
                          F.when(split, F.col("best.f")).alias("feature"), F.when(split, F.col("best.top")).alias("cut"), F.when(split, F.col("best.n_left")).alias("n_left"),
                          F.when(last_try, 0).otherwise(F.col("tried") + 1).alias("tried"), F.array(*[F.col(f"t{i}") for i in range(k)]).alias("counts"))
