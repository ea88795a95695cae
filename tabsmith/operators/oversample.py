"""Oversampling of small classes (H5) and the union with the original rows (J-e).

Every class smaller than the largest one is filled up to its size.  A synthetic row lies on
the segment between a row of the class and one of its near neighbours in the class.

Neighbours are exact: equal rows of a class are one point, the points of each class form a tree of
metric balls (``pivot_tree``), and only balls that reach below the distance of a point's k-th neighbour
in its own leaf are searched.  A task holds the bands of two leaves, whatever the size of the class.
Copies of a row are its nearest neighbours, so a row with k or more copies is repeated as it is, as a
search among all rows would do; with fewer, its other neighbours follow by distance.

Defined cases: a smallest class of fewer than ``min_rows`` rows, one class only, or no rows at
all give no synthetic rows; rows with a NULL label or with features that are NULL or not all finite take no part; a row without
another row in its class is repeated as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import hash_unit
from ..functions.ordering import materialize
from .metric_dbscan import point_array
from .pivot_tree import build, nearest
from .split import class_positions


def _neighbours(pts: DataFrame, k: int, cap: int) -> DataFrame:
    """(label, x, near): vectors of the k nearest other rows of each distinct row of a class."""
    points = pts.groupBy("label", "x").agg(F.count(F.lit(1)).alias("w"), F.min("pos").alias("first"))
    root = F.hex(F.encode(F.col("label").cast("string"), "utf-8"))
    points = points.withColumn("root", root).withColumn("pid", F.concat_ws(".", "root", F.lpad(F.col("first").cast("string"), 20, "0")))
    points = materialize(points.select("pid", "x", "w", "label", "root"), "oversample-points")
    tree = build(points, cap, root=F.concat(F.lit("c"), F.col("root")))
    at = points.select("pid", "label", "x", "w")
    found = nearest(tree, k).select("pid", F.posexplode("near").alias("i", "n"))
    # a neighbour counts once for each row that it stands for
    found = found.join(points.select(F.col("pid").alias("other"), F.col("w").alias("times")),
                       F.col("n.pid") == F.col("other"))
    filled = found.withColumn("v", F.explode(F.array_repeat("n.x", F.least("times", F.lit(k)).cast("int"))))
    listed = filled.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs"))
    own = F.array_repeat(F.col("x"), F.least(F.col("w") - 1, F.lit(k)).cast("int"))
    rest = F.coalesce(F.transform("vs", lambda e: e["v"]), F.array().cast("array<array<double>>"))
    return at.join(listed, "pid", "left").select("label", "x", F.slice(F.concat(own, rest), 1, k).alias("near"))


def synthetic_rows(df: DataFrame, label: str, features: str, keys: list[str], k: int = 5, min_rows: int = 6,
                   cap: int = 1024, seed: int = 42) -> DataFrame:
    """H5: (label, x, a, b, u) with x = a + u * (b - a); ``features`` is an array of doubles."""
    rows = df.where(F.col(label).isNotNull()).withColumn(features, point_array(df, features)).where(
        F.col(features).isNotNull())
    empty = rows.select(F.col(label).alias("label"), *[F.col(features).alias(c) for c in ("x", "a", "b")],
                        F.lit(0.0).alias("u")).limit(0)
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.agg(F.max("_n").alias("top"), F.min("_n").alias("low")).first()
    if sizes["top"] is None or sizes["low"] < min_rows or sizes["low"] == sizes["top"]:
        return empty
    small = rows.join(counts.where(F.col("_n") < sizes["top"]).select(label), label, "left_semi")
    placed = class_positions(small, label, keys, seed)
    pts = materialize(placed.select(F.col(label).alias("label"), F.col("_cpos").alias("pos"), F.col("_nc").alias("n"),
                                    F.col(features).alias("x")), "oversample-rows")
    near = _neighbours(pts, min(k, sizes["low"] - 1), cap)
    missing = F.lit(sizes["top"]) - F.col("n")
    share = F.floor(missing / F.col("n")) + F.when(F.col("pos") < missing % F.col("n"), 1).otherwise(0)
    made = (pts.join(near, ["label", "x"], "left").withColumn("share", share.cast("int")).where("share > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("share")))))
    pick = F.pmod(F.xxhash64(F.lit(seed), "label", "pos", "copy"), F.size("near")).cast("int")
    made = made.select("label", F.col("x").alias("a"),
                       F.when(F.size("near") > 0, F.get("near", pick)).otherwise(F.col("x")).alias("b"),
                       hash_unit("label", "pos", "copy", seed=seed + 1).alias("u"))
    return made.select("label", F.zip_with("a", "b", lambda p, q: p + F.col("u") * (q - p)).alias("x"), "a", "b", "u")


def oversample(df: DataFrame, label: str, features: str, keys: list[str], **options) -> DataFrame:
    """J-e: the original rows and the synthetic ones: (label, features, synthetic)."""
    new = synthetic_rows(df, label, features, keys, **options)
    return (df.select(label, features, F.lit(False).alias("synthetic"))
            .unionByName(new.select(F.col("label").alias(label), F.col("x").alias(features),
                                    F.lit(True).alias("synthetic"))))
