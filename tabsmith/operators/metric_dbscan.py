"""DBSCAN (M10), exact, for points of any dimension, over a tree of metric balls (``pivot_tree``).

* Equal points are one weighted point, so copies cost one row.
* Pairs of balls that lie within eps of each other as a whole and both weigh ``min_samples`` are settled
  without looking at points: all their points are core and in one cluster.  A dense spot that holds a
  third of the rows is such a ball.
* Pairs of leaves that remain are compared point by point, only in the bands that face each other: one
  pass adds up the weights within eps, a second one returns a spanning forest of the core points and
  the core neighbours of the others (fewer than ``min_samples`` each).
* Clusters are the components of these edges; other points take the smallest cluster of a core point
  within eps, the rest is noise (-1).

Numbers follow the smallest id of each cluster, as in ``dbscan``.  Rows whose vector is NULL or holds NULL,
NaN or infinite entries are noise.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ordering import materialize, with_global_index
from .pivot_tree import SLACK, PivotTree, build, dist, in_tiles, near_pairs, packed, sqdist, tile_pairs, within

BLOCK = 256           # rows of a distance block


def point_array(df: DataFrame, features: str) -> Column:
    """The vector as an array of finite doubles, else NULL."""
    dt = df.schema[features].dataType
    x = F.col(features) if isinstance(dt, T.ArrayType) else vector_to_array(features)
    x = x.cast("array<double>")
    return F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), x)


def _weights(eps: float, kind: T.DataType):
    """Per tile: (pid, near) the weights within eps of its points, and (a, b) its pairs with points of theirs within eps."""
    def one(pairs: list, leaves: dict) -> pa.Table:
        got = {node: np.zeros(len(leaf.ids), np.int64) for node, leaf in leaves.items()}
        live = []
        for a, b in pairs:
            left, right = leaves[a], leaves[b]
            here = np.arange(len(left.ids)) if a == b else left.facing(right, eps)
            there = here if a == b else right.facing(left, eps)
            met, y, w = a == b, right.x[there], right.mark[there]
            for start in range(0, len(here) if len(there) else 0, BLOCK):
                rows = here[start:start + BLOCK]
                near = within(left.x[rows], y, eps * eps)
                if not near.any():
                    continue
                met = True
                got[a][rows] += near @ w
                if a != b:
                    got[b][there] += left.mark[rows] @ near
            if met:
                live.append((a, b))
        ids = [i for node, leaf in leaves.items() for i in leaf.ids]
        near = np.concatenate(list(got.values()))
        keep = np.flatnonzero(near)
        none = [None] * len(live)
        return pa.Table.from_pydict({"pid": [ids[i] for i in keep] + none, "near": near[keep].tolist() + none,
                                     "a": [None] * len(keep) + [a for a, _ in live], "b": [None] * len(keep) + [b for _, b in live]}, types)

    types = pa.schema([("pid", to_arrow_type(kind)), ("near", pa.int64()), ("a", pa.string()), ("b", pa.string())])
    return one, f"pid {kind.simpleString()}, near long, a string, b string"


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the rows and columns that ``near`` links."""
    found = []
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    while len(rows):
        wave, rows = rows[:1], rows[1:]
        while len(wave):                                   # rows -> new columns -> new rows
            met = near[np.ix_(wave, columns)]
            hit = met.any(0)
            new = columns[hit]
            found += zip(wave[met[:, hit].argmax(0)].tolist(), new.tolist())
            columns = columns[~hit]
            met = near[np.ix_(rows, new)]
            hit = met.any(1)
            wave = rows[hit]
            found += zip(wave.tolist(), new[met[hit].argmax(1)].tolist() if len(new) else [])
            rows = rows[~hit]
    return found


def _links(eps: float, kind: T.DataType):
    """Per tile: links of core points that join the same ones as all do, and the core points within eps of the others."""
    def one(pairs: list, leaves: dict) -> pa.Table:
        u, v, both = [], [], []
        for a, b in pairs:
            left, right = leaves[a], leaves[b]
            here = np.arange(len(left.ids)) if a == b else left.facing(right, eps)
            there = here if a == b else right.facing(left, eps)
            if not len(here) or not len(there):
                continue
            near = np.concatenate([within(left.x[here[i:i + BLOCK]], right.x[there], eps * eps) for i in range(0, len(here), BLOCK)])
            core, other = left.mark[here] > 0, right.mark[there] > 0
            mine, theirs = [left.ids[i] for i in here], [right.ids[i] for i in there]
            for i, j in forest(near & core[:, None] & other):
                if mine[i] != theirs[j]:
                    u.append(mine[i])
                    v.append(theirs[j])
                    both.append(True)
            for i, j in zip(*np.nonzero(near & ~core[:, None] & other)):
                u.append(mine[i])
                v.append(theirs[j])
                both.append(False)
            if a != b:
                for i, j in zip(*np.nonzero(near & core[:, None] & ~other)):
                    u.append(theirs[j])
                    v.append(mine[i])
                    both.append(False)
        return pa.Table.from_pydict({"u": u, "v": v, "both": both}, types)

    types = pa.schema([("u", to_arrow_type(kind)), ("v", to_arrow_type(kind)), ("both", pa.bool_())])
    return one, f"u {kind.simpleString()}, v {kind.simpleString()}, both boolean"


def _ancestors(node: str) -> Column:
    path = F.split(node, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat_ws(".", F.slice(path, F.lit(1), i)))


def cluster(points: DataFrame, eps: float, min_samples: int, cap: int = 1024) -> tuple[DataFrame, PivotTree]:
    """``points``: (pid, x, w), distinct.  Returns (pid, x, node, core, label) and the tree; label is the
    smallest pid of the cluster's core points, NULL for noise."""
    from .dbscan import DBSCAN
    tree = build(points, cap)
    kind = points.schema["pid"].dataType
    sure, open_ = near_pairs(tree, eps, min_samples)
    sure, open_ = materialize(sure, "dbscan-sure"), materialize(open_, "dbscan-open")
    tied = sure.select(F.col("a").alias("ball")).unionByName(sure.select(F.col("b").alias("ball"))).distinct()
    held = tree.points.select("pid", F.explode(_ancestors("node")).alias("ball")).join(tied, "ball")
    held = materialize(held, "dbscan-held")

    tiled = materialize(tile_pairs(tree, open_), "dbscan-tiles")
    fn, schema = _weights(eps, kind)
    near = materialize(in_tiles(tiled, packed(tree, tree.points, "w"), fn, schema), "dbscan-near")
    weight = near.where("a is null").groupBy("pid").agg(F.sum("near").alias("near"))
    sure_core = held.select("pid").distinct().withColumn("sure", F.lit(True))
    pts = tree.points.join(weight, "pid", "left").join(sure_core, "pid", "left")
    pts = materialize(pts.withColumn("core", F.coalesce("sure", F.col("near") >= min_samples, F.lit(False)))
                      .drop("near", "sure"), "dbscan-core")

    # pairs of leaves without points within eps of each other aren't met again
    fn, schema = _links(eps, kind)
    live = tiled.join(near.where("a is not null").select("a", "b"), ["a", "b"], "left_semi")
    links = materialize(in_tiles(live, packed(tree, pts, "core"), fn, schema), "dbscan-links")
    first = held.groupBy("ball").agg(F.min("pid").alias("v"))
    inside = held.join(first, "ball").select(F.col("pid").alias("a"), F.col("v").alias("b"))
    across = sure.join(first.select(F.col("ball").alias("a"), F.col("v").alias("u")), "a") \
        .join(first.select(F.col("ball").alias("b"), "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    edges = inside.unionByName(across).unionByName(
        links.where("both").select(F.col("u").alias("a"), F.col("v").alias("b"))).where("a <> b").distinct()
    cores = pts.where("core").select(F.col("pid").alias("cell"), F.col("pid").alias("label"))
    label = DBSCAN._components(cores, edges).withColumnRenamed("cell", "pid")
    border = links.where("not both").join(label.withColumnRenamed("pid", "v"), "v") \
        .groupBy(F.col("u").alias("pid")).agg(F.min("label").alias("label"))
    out = pts.join(label.unionByName(border), "pid", "left").select("pid", "x", "node", "core", "label")
    return materialize(out, "dbscan-points"), tree


def fit(rows: DataFrame, eps: float, min_samples: int, settings: dict, cap: int = 1024) -> "MetricDBSCANModel":
    """``rows``: (id, x), x an array of doubles or NULL."""
    rows = materialize(rows, "dbscan-rows")
    points = rows.where("x is not null").groupBy("x").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))
    pts, tree = cluster(materialize(points, "dbscan-distinct"), eps, min_samples, cap)
    number = with_global_index(pts.where("label is not null").select("label").distinct(), [F.col("label")], "cluster")
    pts = materialize(pts.join(number, "label", "left"), "dbscan-numbered")
    named = rows.join(pts.select("x", "cluster"), "x", "left")
    labels = materialize(named.select(F.col("id").alias(settings["id_col"]), F.coalesce("cluster", F.lit(-1)).cast("int")
                                      .alias(settings["prediction"])), "dbscan-labels")
    core = pts.where("core").select("x", "node", F.col("cluster").cast("int").alias("label"))
    low = core.select(F.explode(_ancestors("node")).alias("node"), "label").groupBy("node").agg(F.min("label").alias("low"))
    balls = tree.nodes.join(low, "node").select("node", "parent", "centre", "r", "leaf", "low")
    return MetricDBSCANModel(labels, materialize(core, "dbscan-core-model"), materialize(balls, "dbscan-balls"),
                             eps, settings)


class MetricDBSCANModel:
    """Same use as ``DBSCANModel``: ``fit_labels``, ``transform``, ``save``, ``load``."""

    def __init__(self, labels: DataFrame, core: DataFrame, balls: DataFrame, eps: float, settings: dict):
        self.labels, self.core, self.balls, self.eps, self.settings = labels, core, balls, eps, settings

    def fit_labels(self) -> DataFrame:
        return self.labels

    def transform(self, df: DataFrame) -> DataFrame:
        """The smallest cluster with a core point within eps, else -1.  Rows go down the balls within
        reach; a ball wholly within eps answers with its smallest cluster and isn't opened."""
        eps, name = self.eps, self.settings["prediction"]
        # row numbers must not change between the two uses below; the array is made from the vector when read
        rows = materialize(df.withColumn("_rid", F.monotonically_increasing_id()), "dbscan-score")
        rows = rows.withColumn("_x", point_array(rows, self.settings["features"]))
        at = self.balls.where("parent is null").withColumn("up", F.col("node"))
        kids = self.balls.withColumn("up", F.col("parent"))
        todo = rows.where("_x is not null").select("_rid", "_x", F.lit("r").alias("b"))
        found = None
        while True:
            met = todo.join(at.drop("parent"), F.col("b") == F.col("up")).withColumn("gap", dist("_x", "centre"))
            met = met.where(F.col("gap") <= (F.col("r") + eps) * (1 + SLACK))
            met = materialize(met.withColumn("whole", (F.col("gap") + F.col("r")) * (1 + SLACK) <= eps).select(
                "_rid", "_x", F.col("node").alias("b"), "leaf", "whole", "low"), "dbscan-descent")
            hit = met.where("whole").select("_rid", "low")
            last = met.where("leaf and not whole").join(self.core.select(F.col("node").alias("b"), "x", "label"), "b")
            hit = hit.unionByName(last.where(sqdist("_x", "x") <= eps * eps).select("_rid", F.col("label").alias("low")))
            found = hit if found is None else found.unionByName(hit)
            todo = met.where("not leaf and not whole").select("_rid", "_x", "b")
            if todo.isEmpty():
                break
            at = kids
        best = found.groupBy("_rid").agg(F.min("low").alias("_low"))
        return rows.join(best, "_rid", "left").withColumn(
            name, F.coalesce("_low", F.lit(-1)).cast("int")).drop("_x", "_rid", "_low")

    def save(self, path: str, spark) -> None:
        for part in ("core", "labels", "balls"):
            getattr(self, part).write.mode("overwrite").parquet(f"{path}/{part}")
        doc = {"kind": "metric", "eps": self.eps, **self.settings}
        spark.createDataFrame([(json.dumps(doc),)], "doc string").write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(path: str, spark) -> "MetricDBSCANModel":
        doc = json.loads(spark.read.text(f"{path}/settings").where("value <> ''").first()["value"])
        settings = {k: v for k, v in doc.items() if k not in ("kind", "eps")}
        return MetricDBSCANModel(*[spark.read.parquet(f"{path}/{p}") for p in ("labels", "core", "balls")],
                                 doc["eps"], settings)
