import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import metric_dbscan as md
from tabsmith.operators import pivot_tree as pt
from tabsmith.operators import score as sc
from tabsmith.operators.dbscan import DBSCAN
from tabsmith.session import scratch_path
from tests.test_unsupervised import _brute_dbscan


def _points(seed, d=6):
    """A hot spot of copies and of close neighbours, clusters, a chain and scattered points."""
    rnd = random.Random(seed)
    spot = [0.5] * d
    pts = [tuple(spot)] * 60
    pts += [tuple(v + rnd.uniform(-0.02, 0.02) for v in spot) for _ in range(120)]
    for _ in range(3):
        c = [rnd.uniform(0, 3) for _ in range(d)]
        pts += [tuple(v + rnd.gauss(0, 0.08) for v in c) for _ in range(50)]
    pts += [tuple([0.5 + 0.24 * k] + spot[1:]) for k in range(1, 9)]
    pts += [tuple(rnd.uniform(0, 3) for _ in range(d)) for _ in range(40)]
    rnd.shuffle(pts)
    return pts


def _frame(spark, pts):
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(pts)], "id long, v array<double>").repartition(5)


@pytest.mark.parametrize("cap", [16, 1024])
def test_metric_dbscan_matches_brute_force(spark, cap):
    pts = _points(cap)
    rows = _frame(spark, pts)
    m = md.fit(rows.select("id", F.col("v").alias("x")), 0.25, 4,
               {"id_col": "id", "features": "v", "prediction": "prediction"}, cap)
    want = _brute_dbscan(pts, 0.25, 4)
    assert {r.id: r.prediction for r in m.fit_labels().collect()} == want
    assert -1 in want.values() and len(set(want.values())) > 2
    path = scratch_path(spark, "metric-model")
    m.save(path, spark)
    back = sc.load_model(path, spark).transform(rows)
    assert {r.id: r.prediction for r in back.collect()} == want and back.columns == ["id", "v", "prediction"]


def test_points_are_compared_exactly_by_products():
    """Points at exactly the limit, a rounding beside it, far from the origin, and beyond what a product can hold."""
    grid = np.array([[i * 0.1, j * 0.1, 0.3] for i in range(12) for j in range(12)])
    for a, limit in ((grid, 0.09), (grid, 0.01), (grid + 1e6, 0.04), (grid * 1e200, 1e300), (np.repeat(grid[:5], 3, 0), 0.0)):
        assert (pt.within(a, a[::-1], limit) == (pt.block_sqdist(a, a[::-1]) <= limit)).all()


def test_forest_links_what_the_matrix_links():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.02, 0.1, 1.0):
        near = rng.random((40, 30)) < share
        links = md.forest(near)
        assert all(near[i, j] for i, j in links)
        group = {**{("r", i): i for i in range(40)}, **{("c", j): 40 + j for j in range(30)}}
        rest = dict(group)
        for held, pairs in ((group, zip(*np.nonzero(near))), (rest, links)):
            for i, j in pairs:
                a, b = held["r", int(i)], held["c", int(j)]
                held.update({k: min(a, b) for k, g in held.items() if g in (a, b)})
        assert group == rest and len(links) == 70 - len(set(group.values()))


def test_leaves_travel_once_per_tile(spark, monkeypatch):
    """A group holds several leaves, and a tile all their pairs: a point isn't copied for every pair of leaves."""
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(0, 1) for _ in range(12)], 1) for i in range(400)]
    tree = pt.build(spark.createDataFrame(rows, "pid long, x array<double>, w long"), cap=10)
    pairs = pt.near_pairs(tree, 0.6, 5)[1]
    monkeypatch.setattr(pt, "GROUPS", 4)
    monkeypatch.setattr(pt, "TILE", 1600)
    tiled = pt.tile_pairs(tree, pairs)
    assert tiled.count() == pairs.count() > 500 and tiled.select("ta", "tb").distinct().count() <= 10
    held = lambda pairs, leaves: pa.table({"pairs": [len(pairs)], "points": [sum(len(v.ids) for v in leaves.values())]})
    seen = pt.in_tiles(tiled, pt.packed(tree, tree.points, "w"), held, "pairs long, points long").agg(F.sum("pairs"), F.sum("points")).first()
    assert seen[0] == pairs.count() and seen[1] <= 4 * 400


def test_groups_of_leaves_do_not_grow_with_the_points(spark):
    """Each group meets every other: their number is the same for ten times the points, so the copies of a point are, too."""
    def groups(n, d):
        nodes = spark.range(200).select(F.format_string("r.%03d", "id").alias("node"), F.array_repeat(F.lit(0.0), d).alias("centre"),
                                        F.lit(n).cast("long").alias("n"), F.lit(True).alias("leaf"))
        own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
        return pt.tile_pairs(pt.PivotTree(None, nodes), own).select("ta").distinct().count()

    assert groups(100, 64) == groups(1000, 64) == pt.GROUPS
    assert groups(1000, 640) >= 200_000 // 6_600      # wide vectors: a task's memory is bounded


def test_dense_balls_are_settled_without_their_points(spark):
    rnd = random.Random(1)
    rows = [(i, [0.5 + rnd.uniform(-0.01, 0.01) for _ in range(8)], 1) for i in range(600)]
    tree = pt.build(spark.createDataFrame(rows, "pid long, x array<double>, w long"), cap=50)
    sure, open_ = pt.near_pairs(tree, 0.5, 5)
    assert [tuple(r) for r in sure.collect()] == [("r", "r")] and open_.isEmpty()
    assert tree.nodes.where("leaf").agg(F.max("n")).first()[0] <= 50


def test_dbscan_of_many_dimensions_small_cases(spark):
    rows = [(1, [0.0] * 5), (2, [0.0] * 5), (3, [0.0] * 4 + [0.1]), (4, [9.0] * 5), (5, None),
            (6, [float("nan")] + [0.0] * 4), (7, [None] + [0.0] * 4), (8, [float("inf")] * 5)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    m = DBSCAN("v", eps=0.5, min_samples=3, id_col="id").fit(d)
    want = {1: 0, 2: 0, 3: 0, 4: -1, 5: -1, 6: -1, 7: -1, 8: -1}
    assert {r.id: r.prediction for r in m.fit_labels().collect()} == want
    assert {r.id: r.prediction for r in m.transform(d).collect()} == want
    assert m.transform(d.limit(0)).count() == 0
    assert DBSCAN("v", id_col="id").fit(d.limit(0)).fit_labels().count() == 0
    alone = DBSCAN("v", eps=0.5, min_samples=3, id_col="id").fit(d.where("id = 4"))
    assert [r.prediction for r in alone.transform(d.where("id = 4")).collect()] == [-1]


@pytest.mark.parametrize("cap,k", [(8, 5), (64, 3)])
def test_nearest_has_recall_one(spark, cap, k):
    pts = sorted(set(_points(3 + k)))
    rows = [(i, list(p), 1, "a" if i % 3 else "b") for i, p in enumerate(pts)] + [(900, [5.0] * 6, 1, "c")]
    d = spark.createDataFrame(rows, "pid long, x array<double>, w long, g string").repartition(4)
    tree = pt.build(d, cap, 4, root=F.col("g"))
    got = {r.pid: [n.pid for n in r.near] for r in pt.nearest(tree, k).collect()}
    for i, x, _, g in rows:
        others = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y, _, h in rows if h == g and j != i)
        assert got[i] == [j for _, j in others[:k]]
