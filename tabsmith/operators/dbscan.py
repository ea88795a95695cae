"""DBSCAN (M10), exact: on a grid for up to three dimensions, as described here, and over a tree of
metric balls (``metric_dbscan``) for more.

Grid cells have side s = eps / sqrt(d) (a hair less), so every two points of
one cell are within eps of each other.  This gives:

* a cell with >= min_samples points: all its points are core — no pairs formed;
* a sparse cell (< min_samples points, so at most min_samples - 1 of them):
  its points are compared with the points of the neighbouring cells only.
  Each point of any cell meets at most (#neighbour cells) * (min_samples - 1)
  sparse points, so this step is linear in the data;
* all core points of one cell belong to one cluster, so connectivity is a
  graph over *core cells*.  Two neighbouring core cells are joined when some
  pair of their core points is within eps.  A sub-cell test (side s/4, then
  quarters of the undecided ones, ``LEVELS`` times) settles most cell pairs
  without looking at points: sub-cell pairs whose farthest corners are within
  eps connect at once, those whose nearest corners are farther than eps never
  do, and only the remaining boundary pairs of the smallest sub-cells are
  checked, between different points in the eps-band facing the other cell;
* connected components: smallest labels over the core-cell edge table with
  pointer jumping, each round written to the shared checkpoint folder;
* border points (non-core, always in sparse cells) take the smallest label of
  a core point within eps; the rest is noise (-1).

Cluster numbers follow the smallest point id of each cluster (0, 1, ...), the
order in which scikit-learn's scan meets them when ids follow input order.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import materialize, with_global_index
from . import metric_dbscan

GRID_DIMS = 3         # cells near a cell grow as 5^d
LEVELS = 4            # times that undecided sub-cells are cut before their points are compared


def _corners(pairs: DataFrame, sub: float, e2: float) -> DataFrame:
    """Pairs of sub-cells (side ``sub``) whose nearest corners are within reach; ``sure`` where the farthest are, too."""
    total = lambda gap: F.aggregate(F.zip_with("sa", "sb", gap), F.lit(0).cast("long"), lambda acc, z: acc + z).cast("double") * (sub * sub)
    near = lambda p, q: F.greatest(F.abs(p - q) - 1, F.lit(0))
    pairs = pairs.withColumn("gap", total(lambda p, q: near(p, q) * near(p, q))).withColumn("far", total(lambda p, q: (F.abs(p - q) + 1) * (F.abs(p - q) + 1)))
    return pairs.where(F.col("gap") <= e2).select("a", "b", "sa", "sb", (F.col("far") <= e2).alias("sure"))


def _offsets(d: int, s: float, eps: float) -> list[tuple]:
    r = int(math.ceil(eps / s)) + 1
    out = []
    for o in itertools.product(range(-r, r + 1), repeat=d):
        if all(v == 0 for v in o):
            continue
        gap = sum(max(abs(v) - 1, 0) ** 2 for v in o) * s * s
        if gap <= eps * eps * (1 + 1e-12):
            out.append(o)
    return out


def _lit_arrays(rows: list[tuple]):
    return F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in o]) for o in rows])


def _sqdist(a, b):
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda acc, z: acc + z)


def _box_gap(x, cell, s: float):
    """Squared distance from point x to the box of grid cell ``cell`` (side s)."""
    return F.aggregate(F.zip_with(x, cell, lambda v, c: F.greatest(
        F.lit(0.0), c.cast("double") * s - v, v - (c.cast("double") + 1.0) * s) * F.greatest(
        F.lit(0.0), c.cast("double") * s - v, v - (c.cast("double") + 1.0) * s)), F.lit(0.0),
        lambda acc, z: acc + z)


def _shift(cell, off):
    return F.zip_with(cell, off, lambda c, o: c + o)


class DBSCANModel:
    def __init__(self, labels: DataFrame, core: DataFrame, eps: float, s: float, d: int, id_col: str,
                 features: str, prediction: str = "prediction"):
        self.labels, self.core, self.eps, self.s, self.d = labels, core, eps, s, d
        self.id_col, self.features, self.prediction = id_col, features, prediction

    def fit_labels(self) -> DataFrame:
        """(id, prediction) for the fitted points."""
        return self.labels

    def transform(self, df: DataFrame) -> DataFrame:
        """Label points: in a dense cell the cell's cluster (all its points are core), elsewhere the
        smallest cluster with a core point within eps, else -1."""
        pts = df.withColumn("_x", _points(df, self.features))
        pts = pts.withColumn("_cell", F.transform("_x", lambda v: F.floor(v / self.s)))
        # row numbers must not change between the two uses below
        pts = materialize(pts.withColumn("_rid", F.monotonically_increasing_id()), "dbscan-score")
        dense = self.core.where("dense").select(F.col("cell").alias("_cell"), F.col("label").alias("_own")).distinct()
        pts = pts.join(dense, "_cell", "left")
        offs = [tuple([0] * self.d)] + _offsets(self.d, self.s, self.eps)
        ex = pts.where("_own is null").select("_rid", "_x", "_cell", F.explode(_lit_arrays(offs)).alias("_o"))
        ex = ex.withColumn("_t", _shift(F.col("_cell"), F.col("_o")))
        core = self.core.select(F.col("cell").alias("_t"), F.col("x").alias("_cx"), F.col("label").alias("_l"))
        hit = (ex.join(core, "_t").where(_sqdist(F.col("_x"), F.col("_cx")) <= self.eps * self.eps)
               .groupBy("_rid").agg(F.min("_l").alias("_lab")))
        out = pts.join(hit, "_rid", "left")
        return out.withColumn(self.prediction, F.coalesce("_own", "_lab", F.lit(-1)).cast("int")).drop(
            "_x", "_cell", "_rid", "_lab", "_own")

    def save(self, path: str, spark) -> None:
        """Core points with their clusters, labels of the fitted points, settings."""
        self.core.write.mode("overwrite").parquet(f"{path}/core")
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        doc = {"eps": self.eps, "s": self.s, "d": self.d, "id_col": self.id_col, "features": self.features,
               "prediction": self.prediction}
        spark.createDataFrame([(json.dumps(doc),)], "doc string").write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(path: str, spark) -> "DBSCANModel":
        doc = json.loads(spark.read.text(f"{path}/settings").where("value <> ''").first()["value"])
        if doc.get("kind") == "metric":
            return metric_dbscan.MetricDBSCANModel.load(path, spark)
        return DBSCANModel(spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/core"), **doc)


def _points(df: DataFrame, features: str):
    dt = df.schema[features].dataType
    arr = F.col(features) if isinstance(dt, T.ArrayType) else vector_to_array(features)
    return arr.cast("array<double>")


class DBSCAN:
    """``DBSCAN(eps=0.5, min_samples=5).fit(df)`` -> DBSCANModel (``fit_labels()`` = fit_predict)."""

    def __init__(self, features: str = "features", eps: float = 0.5, min_samples: int = 5,
                 id_col: str | None = None, prediction: str = "prediction"):
        self.features, self.eps, self.min_samples = features, float(eps), int(min_samples)
        self.id_col, self.prediction = id_col, prediction

    def fit(self, df: DataFrame) -> DBSCANModel:
        eps, mp = self.eps, self.min_samples
        id_col = self.id_col or "_id"
        if self.id_col is None:
            df = df.withColumn("_id", F.monotonically_increasing_id())
        x = metric_dbscan.point_array(df, self.features)
        d = int(df.select(F.max(F.size(x)).alias("d")).first()["d"] or 1)
        if d > GRID_DIMS:
            settings = {"id_col": id_col, "features": self.features, "prediction": self.prediction}
            return metric_dbscan.fit(df.select(F.col(id_col).alias("id"), x.alias("x")), eps, mp, settings)
        s = eps / math.sqrt(d) * (1 - 1e-9)
        offs = _offsets(d, s, eps)
        pts = df.select(F.col(id_col).alias("id"), _points(df, self.features).alias("x"))
        pts = pts.withColumn("cell", F.transform("x", lambda v: F.floor(v / s)))
        pts = materialize(pts, "dbscan-points")
        counts = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n_cell"))
        pts = pts.join(counts, "cell")

        # ---- core points: dense cells at once, sparse-cell points by neighbour count
        sparse = pts.where(F.col("n_cell") < mp)
        ex = sparse.select("id", "x", "n_cell", F.explode(_lit_arrays(offs)).alias("o"),
                           F.col("cell").alias("c0"))
        ex = ex.withColumn("cell", _shift(F.col("c0"), F.col("o")))
        other = pts.select("cell", F.col("x").alias("qx"))
        nbr = (ex.join(other, "cell").where(_sqdist(F.col("x"), F.col("qx")) <= eps * eps)
               .groupBy("id").agg(F.count(F.lit(1)).alias("n_nbr")))
        pts = pts.join(nbr, "id", "left").withColumn(
            "is_core", (F.col("n_cell") + F.coalesce(F.col("n_nbr"), F.lit(0))) >= mp).drop("n_nbr")
        pts = materialize(pts, "dbscan-core")
        core = pts.where("is_core").select("id", "x", "cell", (F.col("n_cell") >= mp).alias("dense"))

        # ---- core-cell graph
        nodes = core.groupBy("cell").agg(F.min("id").alias("label"))
        edges = self._edges(core, offs, s, eps)
        labels = self._components(nodes, edges)

        core_l = core.join(labels, "cell")   # every core point: its cell's component label
        # ---- border points (only in sparse cells) -> smallest label of a core point within eps
        noncore = pts.where(~F.col("is_core")).select("id", "x", F.col("cell").alias("c0"))
        offs0 = [tuple([0] * d)] + offs
        bx = noncore.select("id", "x", "c0", F.explode(_lit_arrays(offs0)).alias("o"))
        bx = bx.withColumn("cell", _shift(F.col("c0"), F.col("o")))
        border = (bx.join(core_l.select("cell", F.col("x").alias("cx"), "label"), "cell")
                  .where(_sqdist(F.col("x"), F.col("cx")) <= eps * eps)
                  .groupBy("id").agg(F.min("label").alias("label")))
        all_l = core_l.select("id", "label").unionByName(border)
        # cluster numbers 0.. in order of each cluster's smallest id
        comp = with_global_index(all_l.select("label").distinct(), [F.col("label")], "cluster")
        res = pts.select("id").join(all_l, "id", "left").join(comp, "label", "left")
        res = res.select(F.col("id").alias(id_col),
                         F.coalesce(F.col("cluster"), F.lit(-1)).cast("int").alias(self.prediction))
        res = materialize(res, "dbscan-labels")
        core_model = core_l.join(comp, "label").select("cell", "x", "dense", F.col("cluster").cast("int").alias("label"))
        return DBSCANModel(res, materialize(core_model, "dbscan-core-model"), eps, s, d, id_col,
                           self.features, self.prediction)

    @staticmethod
    def _edges(core: DataFrame, offs, s: float, eps: float) -> DataFrame:
        """Edges between neighbouring core cells having a core pair within eps."""
        sub = s / 4.0
        e2 = eps * eps
        points = materialize(core.select("cell", F.transform("x", lambda v: F.floor(v / sub)).alias("sc"), "x"), "dbscan-band")
        # neighbours are named for the sub-cells that hold points, not for the points
        occ = materialize(points.select("cell", "sc").distinct(), "dbscan-sub-cells")
        occ = occ.withColumn("o", F.explode(_lit_arrays(offs))).select("cell", _shift(F.col("cell"), F.col("o")).alias("tcell"), "sc")
        occ = occ.join(occ.select(F.col("cell").alias("tcell"), F.col("tcell").alias("cell")).distinct(), ["cell", "tcell"], "left_semi")
        left = occ.select(F.col("cell").alias("a"), F.col("tcell").alias("b"), F.col("sc").alias("sa"))
        right = occ.select(F.col("cell").alias("b"), F.col("tcell").alias("a"), F.col("sc").alias("sb"))
        open_ = left.join(right, ["a", "b"]).where(F.col("a") < F.col("b"))
        sure = None
        for level in range(LEVELS):
            found = materialize(_corners(open_, sub, e2), "dbscan-pairs")
            near = materialize(found.where("sure").select("a", "b").distinct(), "dbscan-sure")
            sure = near if sure is None else sure.unionByName(near)
            open_ = materialize(found.where("not sure").join(near, ["a", "b"], "left_anti").select("a", "b", "sa", "sb"), "dbscan-open")
            if level + 1 == LEVELS or open_.isEmpty():
                break
            # the undecided sub-cells in quarters: crowded ones are settled before their points meet
            sub /= 4.0
            held = open_.select(F.col("a").alias("cell"), F.col("sa").alias("sc")).unionByName(
                open_.select(F.col("b").alias("cell"), F.col("sb").alias("sc"))).distinct()
            points = points.join(held, ["cell", "sc"], "left_semi").select(
                "cell", F.col("sc").alias("up"), F.transform("x", lambda v: F.floor(v / sub)).alias("sc"), "x")
            points = materialize(points, "dbscan-band")
            fine = materialize(points.select("cell", "up", "sc").distinct(), "dbscan-sub-cells")
            points = points.drop("up")
            open_ = open_.join(fine.select(F.col("cell").alias("a"), F.col("up").alias("sa"), F.col("sc").alias("ta")), ["a", "sa"]) \
                .join(fine.select(F.col("cell").alias("b"), F.col("up").alias("sb"), F.col("sc").alias("tb")), ["b", "sb"]) \
                .select("a", "b", F.col("ta").alias("sa"), F.col("tb").alias("sb"))
        # only points of these sub-cells, facing the other cell
        lp = open_.select("a", "b", "sa").distinct().join(points.select(F.col("cell").alias("a"), F.col("sc").alias("sa"), F.col("x").alias("xa")), ["a", "sa"])
        rp = open_.select("a", "b", "sb").distinct().join(points.select(F.col("cell").alias("b"), F.col("sc").alias("sb"), F.col("x").alias("xb")), ["b", "sb"])
        lp, rp = lp.where(_box_gap(F.col("xa"), F.col("b"), s) <= e2).distinct(), rp.where(_box_gap(F.col("xb"), F.col("a"), s) <= e2).distinct()
        checked = (open_.join(lp, ["a", "b", "sa"]).join(rp, ["a", "b", "sb"])
                   .where(_sqdist(F.col("xa"), F.col("xb")) <= e2).select("a", "b").distinct())
        return sure.unionByName(checked).distinct()

    @staticmethod
    def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Smallest label of each component: every round takes the smallest label of the neighbours
        and then the label that the label's own cell has reached, so a chain of cells settles in a
        number of rounds that grows with its logarithm.  One written table per round."""
        und = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        und = materialize(und, "dbscan-edges")
        lab = materialize(nodes.withColumn("home", F.col("label")), "dbscan-cc")
        while True:
            msg = und.join(lab.select(F.col("cell").alias("v"), F.col("label").alias("l")), "v") \
                .groupBy(F.col("u").alias("cell")).agg(F.min("l").alias("m"))
            near = lab.join(msg, "cell", "left").select(
                "cell", "home", F.col("label").alias("before"), F.least("label", F.coalesce("m", "label")).alias("via"))
            near = materialize(near, "dbscan-cc-near")
            jump = near.select(F.col("home").alias("via"), F.col("via").alias("up"))
            new = near.join(jump, "via", "left").select(
                "cell", "home", F.least("via", F.coalesce("up", "via")).alias("label"), "before")
            new = materialize(new, "dbscan-cc")
            lab = new.drop("before")
            if new.where("label < before").isEmpty():
                return lab.drop("home")
