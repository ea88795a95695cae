"""A tree of metric balls over points of any dimension, built and searched by joins.

``build`` splits every node of more than ``cap`` points among up to ``branch`` of its own points (the
pivots, drawn by a hash): each point goes to the nearest pivot.  A node keeps its centre, the exact
largest distance of a point below it, and their number and weight.  One pass per level; a level reads
and writes only the points of nodes that are still too large, and each pass is a table in the shared
checkpoint folder.  Points must be distinct within a root, so splits make progress; points whose
distances all round to zero stay one leaf.

``near_pairs`` descends the tree on both sides at once.  A pair of nodes stays while the triangle
inequality allows a distance of at most ``eps`` between their points; its children meet by equi-joins on
the two parents, so no level holds more than the children of pairs that stayed.

``nearest`` finds the exact k nearest points of each point in its root: the nearest ones of its own leaf
bound the distance, and the leaf meets only nodes that reach below the bound.

``in_tiles`` compares the points of leaf pairs: a task holds the leaves of two groups, about 2 * ``TILE`` points, so a point is
shuffled once per group, not once per leaf.  A group of ``nearest`` is the band of two leaves, at most 2 * ``cap`` points.  How much the
bounds prune depends on the data: points spread evenly over many dimensions leave most leaves near each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import materialize, with_prefix_sums

SLACK = 1e-9          # rounding of the bounds; never of the comparison of two points
TILE = 65_536         # points of a group of leaves, at most (and the rest of its last leaf), of up to WIDTH coordinates; wider ones
WIDTH = 64            # in proportion fewer, so that a group holds 32 MB of vectors at most;
GROUPS = 8            # as many groups until that is reached: 36 tiles to share out, and a leaf travels about as often as there are groups
PAIRS = 1 << 18       # close calls that are settled at a time


def sqdist(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda acc, z: acc + z)


def dist(a, b) -> Column:
    return F.sqrt(sqdist(a, b))


def block_sqdist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of two blocks, summed coordinate by coordinate as ``sqdist`` does."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


@dataclass
class PivotTree:
    """``points``: the input with ``node`` (its leaf) and ``off`` (distance from the leaf's centre);
    ``nodes``: (node, parent, centre, r, n, w, leaf), parent NULL for a root."""
    points: DataFrame
    nodes: DataFrame

    def children(self) -> DataFrame:
        """(up, node, centre, r, n, w, leaf): children by parent, and each leaf under itself."""
        cols = ["node", "centre", "r", "n", "w", "leaf"]
        below = self.nodes.where("parent is not null").select(F.col("parent").alias("up"), *cols)
        return below.unionByName(self.nodes.where("leaf").select(F.col("node").alias("up"), *cols))


def build(points: DataFrame, cap: int = 1024, branch: int = 16, root: Column | None = None) -> PivotTree:
    """``points``: (pid, x, w, ...) with distinct x within each root; ``root``: a string without '.'."""
    cols = points.columns
    first = Window.partitionBy("node").orderBy(F.xxhash64("node", "pid"), "pid")
    todo = points.withColumn("node", F.lit("r") if root is None else root)
    done, levels, arity, parent = [], [], 1, F.lit(None).cast("string")
    while True:
        # only the first rows of each node and task are shuffled (partial group limit)
        drawn = todo.withColumn("i", F.row_number().over(first)).where(F.col("i") <= arity)
        pivots = drawn.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("pivots"))
        best = F.array_min(F.transform("pivots", lambda p: F.struct(
            sqdist(F.col("x"), p["x"]).alias("d"), p["i"].alias("i"), p["x"].alias("c"))))
        met = todo.join(pivots, "node").withColumn("best", best)
        name = F.col("node") if arity == 1 else F.concat_ws(".", "node", F.col("best.i").cast("string"))
        met = met.select(*cols, name.alias("node"), parent.alias("parent"), F.col("best.c").alias("centre"),
                         F.sqrt("best.d").alias("off"))
        met = materialize(met, "pivot-level")
        level = met.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("centre").alias("centre"), F.max("off").alias("r"),
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
        level = materialize(level.withColumn("leaf", (F.col("n") <= cap) | (F.col("r") == 0)), "pivot-nodes")
        levels.append(level)
        large = level.where("not leaf").select("node")
        kept = met.select(*cols, "node", "off")
        done.append(kept.join(large, "node", "left_anti").select(*cols, "node", "off"))
        if large.isEmpty():
            break
        todo = kept.join(large, "node", "left_semi").select(*cols, "node")
        arity, parent = branch, F.col("node")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return PivotTree(materialize(union(done), "pivot-points"), union(levels))


def near_pairs(tree: PivotTree, eps: float, weight: int) -> tuple[DataFrame, DataFrame]:
    """(sure, open) pairs (a, b) with a <= b.  In a sure pair every point of a is within eps of every
    point of b and both weigh at least ``weight``; open pairs are leaves whose points decide.  Together
    they cover each two points within eps of each other once."""
    kids = tree.children()
    side = lambda s: [F.col(c).alias(c + s) for c in ("up", "node", "centre", "r", "w", "leaf")]
    roots = tree.nodes.where("parent is null")
    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    at = roots.select(F.col("node").alias("up"), "node", "centre", "r", "w", "leaf")
    sure, open_ = [], []
    while True:
        met = pairs.join(at.select(*side("_a")), F.col("a") == F.col("up_a")) \
            .join(at.select(*side("_b")), F.col("b") == F.col("up_b"))
        met = met.where((F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b")))
        met = met.withColumn("gap", dist("centre_a", "centre_b")).withColumn("reach", F.col("r_a") + F.col("r_b"))
        met = met.where(F.col("gap") <= (F.col("reach") + eps) * (1 + SLACK))
        within = ((F.col("gap") + F.col("reach")) * (1 + SLACK) <= eps) & (F.least("w_a", "w_b") >= weight)
        met = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"),
                         within.alias("sure"), (F.col("leaf_a") & F.col("leaf_b")).alias("last"))
        met = materialize(met, "pivot-pairs")
        sure.append(met.where("sure").select("a", "b"))
        open_.append(met.where("not sure and last").select("a", "b"))
        pairs = met.where("not sure and not last").select("a", "b")
        if pairs.isEmpty():
            break
        at = kids
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(sure), union(open_)


def within(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """``block_sqdist(a, b) <= limit``: by one product of matrices, and coordinate by coordinate where its rounding could matter."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    slack = 64 * (a.shape[1] + 8) * np.finfo(float).eps * (na.max(initial=0.0) + nb.max(initial=0.0) + limit)
    if not np.isfinite(slack):
        return block_sqdist(a, b) <= limit
    d = a @ b.T
    d *= -2
    d += na[:, None]
    d += nb
    near = d <= limit + slack
    if near.any():
        i, j = np.nonzero(near)
        close = d[i, j] >= limit - slack
        i, j = i[close], j[close]
        for at in range(0, len(i), PAIRS):
            p, q = i[at:at + PAIRS], j[at:at + PAIRS]
            exact = np.zeros(len(p))
            for c in range(a.shape[1]):
                gap = a[p, c] - b[q, c]
                exact += gap * gap
            near[p, q] = exact <= limit
    return near


PACKED = "node string, centre array<double>, r double, ids array<{pid}>, x binary, mark array<long>"


def packed(tree: PivotTree, points: DataFrame, mark: str) -> DataFrame:
    """One row per leaf: its ball, the ids, the vectors as one matrix, and the numbers ``mark`` of its points."""
    schema = PACKED.format(pid=points.schema["pid"].dataType.simpleString())

    def pack(table: pa.Table) -> pa.Table:
        x = np.ascontiguousarray(table["x"].combine_chunks().flatten(), np.float64)
        ids = table["pid"].combine_chunks()
        return pa.table({"node": table["node"].slice(0, 1), "centre": table["centre"].slice(0, 1), "r": table["r"].slice(0, 1),
                         "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "x": pa.array([x.tobytes()], pa.binary()),
                         "mark": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), table["mark"].combine_chunks())})

    ball = tree.nodes.where("leaf").select("node", "centre", "r")
    rows = points.select("node", "pid", "x", F.col(mark).cast("long").alias("mark")).join(F.broadcast(ball), "node")
    return rows.select("node", "centre", "r", "pid", "x", "mark").groupBy("node").applyInArrow(pack, schema)


@dataclass
class Leaf:
    centre: np.ndarray
    r: float
    ids: list
    x: np.ndarray
    mark: np.ndarray

    def facing(self, other: Leaf, eps: float) -> np.ndarray:
        """Places of the points that may have one of ``other`` within eps."""
        bound = (other.r + eps) * (1 + 1e-6)
        return np.flatnonzero(within(self.x, other.centre[None, :], bound * bound)[:, 0])


def tile_pairs(tree: PivotTree, pairs: DataFrame) -> DataFrame:
    """``pairs`` with their tile (ta, tb).  Leaves that follow each other in the tree make groups of about as many points,
    a tile is two groups: a leaf travels once per tile, not once per pair, and a task holds two groups at most.  The number of
    groups is the same for small and large tables, so that what is shuffled grows with the points (up to GROUPS * TILE of them)."""
    leaves = tree.nodes.where("leaf").select("node", "n", F.size("centre").alias("d"))
    total, d = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("d"), F.lit(0))).first()
    size = max(1, min(TILE * WIDTH // max(WIDTH, d), -(-total // GROUPS)))
    placed = with_prefix_sums(leaves.drop("d"), [F.col("node")], {"seen": F.col("n")}, inclusive=False)
    group = materialize(placed.select("node", F.floor(F.col("seen") / size).cast("long").alias("g")), "pivot-groups")
    both = pairs.join(group.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a").join(
        group.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b")
    return both.select("a", "b", F.least("ga", "gb").alias("ta"), F.greatest("ga", "gb").alias("tb"))


def in_tiles(tiled: DataFrame, leaves: DataFrame, run, schema: str) -> DataFrame:
    """``run(pairs, leaves)`` of each tile: its pairs [(a, b)] and their leaves by node -> a table of ``schema``."""
    ends = tiled.select(F.col("ta").alias("la"), F.col("tb").alias("lb"), F.explode(F.array("a", "b")).alias("node")).distinct()
    met = ends.join(leaves, "node")

    def one(pairs: pa.Table, held: pa.Table) -> pa.Table:
        found = {}
        for b in held.to_batches():
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                centre = row.column("centre").flatten().to_numpy()
                x = np.frombuffer(row.column("x")[0].as_buffer()).reshape(-1, len(centre))
                found[row.column("node")[0].as_py()] = Leaf(centre, row.column("r")[0].as_py(), row.column("ids").flatten().to_pylist(), x,
                                                            row.column("mark").flatten().to_numpy())
        return run(list(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)), found)

    return tiled.groupBy("ta", "tb").cogroup(met.groupBy("la", "lb")).applyInArrow(one, schema)


def nearest(tree: PivotTree, k: int) -> DataFrame:
    """(pid, near): the k nearest other points of the same root, near = array of (d, pid, x) by distance
    (squared) and pid; fewer where the root holds fewer."""
    pid = tree.points.schema["pid"].dataType.simpleString()
    found = f"array<struct<d:double,pid:{pid},x:array<double>>>"

    def best(mine: pd.DataFrame, others: pd.DataFrame, limit: np.ndarray) -> list:
        x, y = stacked(mine["x"]), stacked(others["x"])
        ids, theirs, vectors = mine["pid"].tolist(), others["pid"].tolist(), others["x"].tolist()
        out = []
        for start in range(0, len(x), 256):
            d = block_sqdist(x[start:start + 256], y)
            for i, row in enumerate(d, start):
                if len(row) > k + 1:           # ties of the last place stay until the sort by pid
                    bound = min(limit[i], np.partition(row, k)[k])
                else:
                    bound = limit[i]
                hits = [(row[j], theirs[j], vectors[j]) for j in np.nonzero(row <= bound)[0] if theirs[j] != ids[i]]
                out.append(sorted(hits, key=lambda h: h[:2])[:k])
        return out

    def own(g: pd.DataFrame) -> pd.DataFrame:
        near = best(g, g, np.full(len(g), np.inf))
        return pd.DataFrame({"pid": g["pid"], "x": g["x"], "node": g["node"], "near": near,
                             "limit": [n[-1][0] if len(n) == k else np.inf for n in near]})

    start = materialize(tree.points.select("pid", "x", "node").groupBy("node").applyInPandas(
        own, f"pid {pid}, x array<double>, node string, near {found}, limit double"), "nearest-own")
    # a leaf with few points takes the bound of the smallest ball above it that holds more than k
    path = F.split("node", r"\.")
    up = tree.nodes.where("leaf").select("node", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(path)), lambda i: F.concat_ws(".", F.slice(path, F.lit(1), i)))).alias("above"))
    wide = up.join(tree.nodes.where(F.col("n") > k).select(F.col("node").alias("above"), "r"), "above") \
        .groupBy("node").agg((F.min("r") * 2 * (1 + SLACK)).alias("wide"))
    start = start.join(wide, "node", "left").withColumn(
        "limit", F.least("limit", F.coalesce(F.col("wide") * F.col("wide"), F.lit(float("inf"))))).drop("wide")
    start = materialize(start, "nearest-limits")
    reach = start.groupBy("node").agg(F.sqrt(F.max("limit")).alias("u"))
    balls = tree.nodes.where("leaf").join(reach, "node").select(
        F.col("node").alias("a"), F.col("centre").alias("ca"), F.col("r").alias("ra"), "u")
    kids = tree.children()
    at = tree.nodes.where("parent is null").withColumn("up", F.col("node"))
    pairs = balls.select("a", F.substring_index("a", ".", 1).alias("b"))
    last = []
    while True:
        met = pairs.join(balls, "a").join(at.select(F.col("up").alias("b"), "node", "centre", "r", "leaf"), "b")
        met = met.where(dist("ca", "centre") <= (F.col("ra") + F.col("r") + F.col("u")) * (1 + SLACK))
        met = materialize(met.select("a", F.col("node").alias("b"), "leaf"), "nearest-pairs")
        last.append(met.where("leaf and a <> b").select("a", "b"))
        pairs = met.where("not leaf").select("a", "b")
        if pairs.isEmpty():
            break
        at = kids
    pairs = reduce(DataFrame.unionByName, last)
    ball = tree.nodes.select(F.col("node").alias("b"), "centre", "r")
    mine = pairs.join(ball, "b").join(start.select(F.col("node").alias("a"), "pid", "x", "limit"), "a").where(
        dist("x", "centre") <= (F.col("r") + F.sqrt("limit")) * (1 + SLACK)).select(
        "a", "b", F.lit(0).alias("side"), "pid", "x", "limit")
    theirs = pairs.join(balls, "a").join(start.select(F.col("node").alias("b"), "pid", "x"), "b").where(
        dist("x", "ca") <= (F.col("ra") + F.col("u")) * (1 + SLACK)).select(
        "a", "b", F.lit(1).alias("side"), "pid", "x", F.lit(0.0).alias("limit"))

    def across(g: pd.DataFrame) -> pd.DataFrame:
        here, there = g[g["side"] == 0], g[g["side"] == 1]
        if len(here) == 0 or len(there) == 0:
            return pd.DataFrame({"pid": g["pid"][:0], "near": pd.Series([], dtype=object)})
        near = best(here, there, here["limit"].to_numpy(dtype=float))
        out = pd.DataFrame({"pid": here["pid"].tolist(), "near": near})
        return out[[len(n) > 0 for n in near]]

    more = mine.unionByName(theirs).groupBy("a", "b").applyInPandas(across, f"pid {pid}, near {found}")
    both = start.select("pid", "near").unionByName(more)
    return both.groupBy("pid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
