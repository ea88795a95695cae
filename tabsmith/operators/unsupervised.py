"""Isolation forest (M11) and DBSCAN (M10) — models Spark ML does not ship.

Isolation forest
----------------
* each of ``n_trees`` trees gets ``psi`` = min(256, n) rows: a seeded
  Bernoulli sample of about 1.5 * n_trees * psi rows is dealt to trees by a
  hash (``pmod(xxhash64(row, seed), n_trees)``); small inputs instead give
  every tree its own hash order over all rows.  Only the sample is shuffled.
* ``groupBy(tree).applyInPandas`` grows each tree (<= ~400 rows per group)
  into node rows; the node table is n_trees * (2 psi - 1) rows at most — a
  proven bound — and is shipped to the scoring pandas UDF.
* score = 2 ** (-E[h(x)] / c(psi)); prediction -1 when score > 0.5.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.5772156649015329
SCORED = 8_192          # rows scored at a time


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left_child int, right_child int, "
               "size int, depth int")


def _grow(tree_id: int, x: np.ndarray, seed: int, max_depth: int) -> list[tuple]:
    rng = np.random.RandomState((seed * 1_000_003 + tree_id) % (2 ** 31))
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        idx, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append([tree_id, nid, -1, 0.0, -1, -1, int(len(idx)), depth])
        if parent is not None:
            nodes[parent][4 if side == "l" else 5] = nid
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            continue
        f = int(cand[rng.randint(len(cand))])
        thr = float(rng.uniform(lo[f], hi[f]))
        nodes[nid][2], nodes[nid][3] = f, thr
        go_left = sub[:, f] < thr
        stack.append((idx[~go_left], depth + 1, nid, "r"))
        stack.append((idx[go_left], depth + 1, nid, "l"))
    return [tuple(n) for n in nodes]


class IsolationForestModel:
    def __init__(self, nodes: pd.DataFrame, psi: int, features: str = "features",
                 prediction: str = "prediction", score: str = "anomaly_score"):
        self.nodes, self.psi = nodes, int(psi)
        self.features, self.prediction, self.score = features, prediction, score

    def _arrays(self):
        """Per tree its columns, thresholds, children (left, right by turns; a leaf's are the leaf itself), the
        path length of each node, and the number of steps to its deepest leaf."""
        nd = self.nodes.sort_values(["tree", "node"])
        trees = []
        for _, g in nd.groupby("tree"):
            feature, depth, here = g["feature"].to_numpy(), g["depth"].to_numpy(), np.arange(len(g))
            kids = [np.where(feature >= 0, g[c].to_numpy(), here) for c in ("left_child", "right_child")]
            trees.append((np.maximum(feature, 0).astype(np.int64), g["threshold"].to_numpy(np.float64),
                          np.stack(kids, 1).astype(np.int32).reshape(-1), depth + c_factor(g["size"].to_numpy()), int(depth.max())))
        return trees

    def transform(self, df: DataFrame) -> DataFrame:
        trees = self._arrays()
        cpsi = float(c_factor([self.psi])[0]) or 1.0

        @F.pandas_udf(T.DoubleType())
        def score_udf(col: pd.Series) -> pd.Series:
            x = np.vstack(col.to_numpy()) if len(col) else np.zeros((0, 1))
            total = np.zeros(len(x))
            for i in range(0, len(x), SCORED):
                part = np.ascontiguousarray(x[i:i + SCORED].T)
                n, flat = part.shape[1], part.reshape(-1)
                at = np.arange(n)
                for feat, thr, kids, length, steps in trees:
                    node, start = np.zeros(n, np.int32), feat * n
                    for _ in range(steps):
                        right = ~(flat.take(start.take(node) + at) < thr.take(node))
                        node = kids.take(2 * node + right)
                    total[i:i + SCORED] += length.take(node)
            return pd.Series(np.power(2.0, -(total / len(trees)) / cpsi))

        arr = vector_to_array(self.features) if self._is_vector(df) else F.col(self.features)
        out = df.withColumn(self.score, score_udf(arr))
        return out.withColumn(self.prediction, F.when(F.col(self.score) > 0.5, -1).otherwise(1))

    def _is_vector(self, df: DataFrame) -> bool:
        return not isinstance(df.schema[self.features].dataType, T.ArrayType)

    def save(self, path: str, spark) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps({"psi": self.psi, "features": self.features}),)],
                              "meta string").write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(path: str, spark) -> "IsolationForestModel":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return IsolationForestModel(nodes, meta["psi"], meta["features"])


class IsolationForest:
    """100 trees, 256 rows each, seeded; ``fit(df)`` -> IsolationForestModel."""

    def __init__(self, features: str = "features", n_trees: int = 100, max_samples: int = 256,
                 seed: int = 42):
        self.features, self.n_trees, self.max_samples = features, n_trees, max_samples
        self.seed = seed

    def fit(self, df: DataFrame) -> IsolationForestModel:
        arr = (vector_to_array(self.features)
               if not isinstance(df.schema[self.features].dataType, T.ArrayType) else F.col(self.features))
        base = df.select(arr.cast("array<double>").alias("x"))
        n = base.count()
        psi = max(1, min(self.max_samples, n))
        t, seed = self.n_trees, self.seed
        # One path at every size.  A row takes part in about 4 psi t / n trees (all of them where
        # the table is small): consecutive trees from a start drawn by the row's number, not by
        # its content, so equal rows are drawn apart.  Only these candidates reach the shuffle.
        share = min(float(t), 4.0 * psi * t / max(n, 1))
        slots = max(1, math.ceil(share))
        row = F.monotonically_increasing_id()
        ex = (base.withColumn("row", row)
              .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
              .withColumn("tree", F.pmod(F.xxhash64("row", F.lit(seed)) + F.col("slot"), F.lit(t)).cast("int"))
              .withColumn("h", F.xxhash64("row", F.lit(seed), "tree"))
              .where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(int(share / slots * (1 << 30))))
              .select("x", "tree", "h"))
        max_depth = int(math.ceil(math.log2(max(psi, 2))))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("h", kind="mergesort").head(psi)
            x = np.vstack(pdf["x"].to_numpy())
            return pd.DataFrame(_grow(int(pdf["tree"].iloc[0]), x, seed, max_depth),
                                columns=["tree", "node", "feature", "threshold", "left_child",
                                         "right_child", "size", "depth"])

        nodes = ex.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
        return IsolationForestModel(nodes, psi, self.features)


def make(name: str, features: str = "features", **params):
    if name == "isolation_forest":
        return IsolationForest(features=features, **params)
    if name == "dbscan":
        from .dbscan import DBSCAN
        return DBSCAN(features=features, **params)
    raise ValueError(f"Model {name} is not supported")
