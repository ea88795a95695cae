"""Histogram boosting against a plain numpy trainer, one node at a time."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators import boosting as bo


def plain(x, y, w, loss, classes, rounds, rate, growth, depth, leaves, l2, least_h, least_rows):
    """Margins of the training rows after ``rounds``; features hold few distinct values, so every value is its own bin."""
    n, d = x.shape
    if loss == "squared":
        start = np.array([np.average(y, weights=w)])
    else:
        share = np.array([w[y == k].sum() for k in range(classes)]) + 1e-12
        share = np.log(share / share.sum())
        start = share if loss == "softmax" else np.array([share[1] - share[0]])
    margin = np.repeat(start[:, None], n, 1)
    for _ in range(rounds):
        if loss == "softmax":
            e = np.exp(margin - margin.max(0))
            p = e / e.sum(0)
            g, h = w * (p - (np.arange(classes)[:, None] == y)), w * p * (1 - p)
        elif loss == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
        else:
            g, h = w * (margin - y), np.ones_like(margin) * w
        step = np.zeros_like(margin)
        for k in range(len(margin)):
            def split(rows):
                best = (0, None)
                G, H = g[k][rows].sum(), h[k][rows].sum()
                for f in range(d):
                    for t in np.unique(x[rows, f])[:-1]:
                        left = rows & (x[:, f] <= t)
                        right = rows & ~left
                        a, b, c, e = g[k][left].sum(), h[k][left].sum(), g[k][right].sum(), h[k][right].sum()
                        if min(b, e) < least_h or min(left.sum(), right.sum()) < least_rows:
                            continue
                        gain = a * a / (b + l2) + c * c / (e + l2) - G * G / (H + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
                return best
            root = np.ones(n, bool)
            out, queue, made, number = [], [], 1, 0
            gain, parts = split(root)
            if parts is None:
                out.append(root)
            else:
                queue.append((0 if growth == "level" else -gain, number, 0, root, parts))
            while queue:
                if growth == "leaf" and made >= leaves:
                    out += [q[3] for q in queue]
                    break
                _, _, at, rows, parts = heapq.heappop(queue)
                made += 1
                for part in parts:
                    number += 1
                    gain, next_parts = split(part) if at + 1 < depth and part.sum() >= 2 * least_rows else (0, None)
                    if next_parts is None:
                        out.append(part)
                    else:
                        heapq.heappush(queue, (at + 1 if growth == "level" else -gain, number, at + 1, part, next_parts))
            for rows in out:
                step[k][rows] = -g[k][rows].sum() / (h[k][rows].sum() + l2) * rate
        margin += step
    return margin


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 7, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)]).astype(float)
    return x, rng


def frame(spark, x, y, w):
    pdf = pd.DataFrame({"i": range(len(y)), "features": list(x), "label": y.astype(float), "w": w.astype(float)})
    return spark.createDataFrame(pdf)


def margins(model, df):
    out = model.transform(df).orderBy("i")
    if model.loss == "squared":
        return np.array([r[0] for r in out.select("prediction").collect()])[None, :]
    raw = np.array([r[0] for r in out.select(vector_to_array("rawPrediction")).collect()]).T
    return raw if model.loss == "softmax" else raw[1:]


@pytest.mark.parametrize("loss,growth,least_rows", [("softmax", "level", 1), ("softmax", "leaf", 5), ("logistic", "leaf", 1), ("squared", "level", 3)])
def test_equals_plain_trainer(spark, loss, growth, least_rows):
    x, rng = data()
    score = x[:, 0] * (x[:, 3] + 1) + x[:, 2] * x[:, 1] + rng.normal(size=len(x)) * 0.1
    y = {"softmax": np.digitize(score, [5, 12]), "logistic": (score > 9).astype(int), "squared": score}[loss]
    w = rng.uniform(0.5, 2, len(x)).round(3)
    df = frame(spark, x, y, w)
    # no two splits of these data have the same gain, so both trainers meet the same trees
    m = bo.HistogramBoosting(loss=loss, nClasses=3 if loss == "softmax" else 2, growth=growth, maxIter=3, stepSize=0.3, maxDepth=4, maxLeaves=7,
                             regLambda=1.0, minHessian=0.5, minInstancesPerNode=least_rows, weightCol="w").fit(df)
    want = plain(x, y, w, loss, 3 if loss == "softmax" else 2, 3, 0.3, growth, 4, 7, 1.0, 0.5, least_rows)
    got = margins(m, df)
    assert np.abs(got - want).max() < 1e-6


def test_probabilities_ranks_and_saved_model(spark, tmp_path):
    x, rng = data(1500, 2)
    y = np.digitize(x[:, 0] + 3 * x[:, 2], [3, 7, 11])
    df = frame(spark, x, y, np.ones(len(y)))
    m = bo.HistogramBoosting(nClasses=4, maxIter=10, stepSize=0.3).fit(df)
    out = m.transform(df)
    p = np.array([r[0] for r in out.select(vector_to_array("probability")).collect()])
    assert p.shape == (1500, 4) and np.abs(p.sum(1) - 1).max() < 1e-12 and (p >= 0).all()
    assert out.filter("prediction = label").count() > 1400
    from tabsmith.plans.jobs import evaluate
    scores = evaluate(out, "classification", "label", 4)
    assert scores["roc_auc"] > 0.98
    assert abs(m.featureImportances.toArray().sum() - 1) < 1e-9 and m.featureImportances.toArray()[[0, 2]].sum() > 0.8
    from tabsmith.operators.score import load_model
    m.save(str(tmp_path / "m"), spark)
    again = load_model(str(tmp_path / "m"), spark).transform(df)
    assert again.select("i", "prediction").exceptAll(out.select("i", "prediction")).isEmpty()


def test_leaf_growth_is_not_worse_at_equal_leaves(spark):
    """Best-first trees of 8 leaves against levels of depth 3, on training log loss."""
    x, rng = data(2000, 3)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3) ^ (x[:, 2] > 0.4)).astype(int) + (x[:, 0] > 9)
    df = frame(spark, x, y, np.ones(len(y)))

    def loss(m):
        p = np.array([r[0] for r in m.transform(df).orderBy("i").select(vector_to_array("probability")).collect()])
        return -np.log(p[np.arange(len(y)), y]).mean()

    level = loss(bo.HistogramBoosting(nClasses=3, maxIter=6, maxDepth=3, stepSize=0.3).fit(df))
    leaf = loss(bo.HistogramBoosting(nClasses=3, maxIter=6, maxDepth=0, maxLeaves=8, growth="leaf", stepSize=0.3).fit(df))
    sampled = loss(bo.HistogramBoosting(nClasses=3, maxIter=6, maxDepth=0, maxLeaves=8, growth="leaf", stepSize=0.3, topShare=0.3, otherShare=0.2).fit(df))
    assert leaf <= level + 1e-9 and sampled < 1.5 * level


def test_exclusive_columns_share_bins_and_change_nothing(spark):
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 12, 900)
    x = np.column_stack([np.eye(12)[kind], rng.normal(size=900).round(2), (rng.random(900) < 0.1) * rng.integers(1, 5, 900)])
    y = np.isin(kind, [1, 4, 7]).astype(int) + (x[:, 12] > 0.5)
    df = spark.createDataFrame([(i, Vectors.sparse(14, [(j, v) for j, v in enumerate(r) if v]), float(t)) for i, (r, t) in enumerate(zip(x.tolist(), y))], ["i", "features", "label"])
    kw = dict(nClasses=3, maxIter=4, growth="leaf", maxLeaves=6, maxDepth=0, stepSize=0.3)
    rows = df.select(vector_to_array("features").alias("x"))
    summary = bo.column_summaries(rows)
    groups = bo.exclusive_groups(rows, [bo.cut_points(*summary[f], 255) for f in range(14)], summary)
    assert sorted(map(len, groups)) == [1, 1, 12] and sorted(f for g in groups for f in g) == list(range(14))
    one, two = (bo.HistogramBoosting(bundle=b, **kw).fit(df) for b in (True, False))
    pd.testing.assert_frame_equal(one.nodes, two.nodes)


def test_defined_cases(spark):
    schema = "features array<double>, label double, w double"
    nan = float("nan")
    rows = [([1.0, nan, 5.0], 0.0, 1.0), ([1.0, 2.0, 5.0], 1.0, 1.0), ([1.0, nan, 5.0], 0.0, 1.0), ([1.0, 3.0, 5.0], 1.0, 1.0), ([9.0, 9.0, 9.0], None, 1.0),
            ([9.0, 9.0, 9.0], 7.0, 1.0), ([9.0, 9.0, 9.0], 1.0, 0.0), ([9.0, 9.0, 9.0], nan, 1.0)]
    df = spark.createDataFrame(rows, schema)
    m = bo.HistogramBoosting(loss="logistic", maxIter=5, stepSize=1.0, regLambda=0.1, weightCol="w").fit(df)
    assert set(m.nodes["feature"]) <= {-1, 1}            # constant features are never split; NaN is smallest
    assert [r.prediction for r in m.transform(df.limit(4)).collect()] == [0.0, 1.0, 0.0, 1.0]
    empty = bo.HistogramBoosting(nClasses=3, maxIter=3).fit(df.limit(0))
    assert {r.prediction for r in empty.transform(df).collect()} == {0.0}
    one = bo.HistogramBoosting(nClasses=2, maxIter=3, loss="logistic").fit(df.filter("label = 1 and w > 0"))
    assert {r.prediction for r in one.transform(df).collect()} == {1.0}


def test_cut_points_hold_equal_parts():
    v, c = bo._compressed(np.arange(100_000.0), np.ones(100_000, np.int64), 2048)
    assert c.sum() == 100_000 and len(v) <= 2048
    cuts = bo.cut_points(v, c, 64)
    assert len(cuts) == 63 and np.abs(np.diff(cuts) / 100_000 * 64 - 1).max() < 0.1
    assert bo.cut_points(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1]), 64).tolist() == [1.5, 3.0]


def test_hot_value_and_many_blocks(spark, monkeypatch):
    """A third of the rows equal; sums over many blocks, tasks and passes give the same trees."""
    x, rng = data(3000, 5)
    x[:1000] = x[0]
    y = (x[:, 0] + x[:, 1] > 8).astype(int)
    df = frame(spark, x, y, np.ones(len(y)))
    kw = dict(loss="logistic", maxIter=3, growth="leaf", maxLeaves=6)
    one = bo.HistogramBoosting(**kw).fit(df)
    for name, v in (("BLOCK_ROWS", 37), ("FAN_IN", 3), ("CHUNK", 20), ("CELLS", 200), ("KEEP", 1)):
        monkeypatch.setattr(bo, name, v)
    two = bo.HistogramBoosting(**kw).fit(df.repartition(9))
    assert one.nodes.shape == two.nodes.shape
    assert np.abs(margins(one, df) - margins(two, df)).max() < 1e-9


@pytest.mark.parametrize("loss", ["squared", "logistic", "softmax"])
def test_rows_of_a_cell_are_added_up_exactly(spark, monkeypatch, loss):
    """A table with few combinations of bins is fitted on its cells, with the trees of its rows."""
    rng = np.random.default_rng(5)
    a, b, w = rng.integers(0, 9, 3000), rng.integers(0, 7, 3000), rng.integers(1, 4, 3000)
    y = a * 0.5 - b + rng.normal(size=3000) if loss == "squared" else ((a + b + rng.integers(0, 3, 3000)) % 3 if loss == "softmax" else (a + rng.normal(size=3000) > b))
    df = spark.createDataFrame([([float(p), float(q)], float(v), float(u)) for p, q, v, u in zip(a, b, y, w)],
                               "features array<double>, label double, w double").repartition(3)
    read, sizes = bo.Fitting._read, []

    def seen(self, blocks):
        read(self, blocks)
        sizes.append(sum(len(r["y"]) // 8 for r in self.blocks.select("y").collect()))

    monkeypatch.setattr(bo.Fitting, "_read", seen)
    fit = lambda: bo.HistogramBoosting(loss=loss, nClasses=3 if loss == "softmax" else 2, maxIter=4, maxDepth=3, stepSize=0.3, weightCol="w",
                                       labelCol="label", minInstancesPerNode=30).fit(df)
    whole = fit()
    monkeypatch.setattr(bo, "CELLS_FROM", 100)
    cells = fit()
    assert sizes[0] == 3000 and sizes[1] <= 63 * (1 if loss == "squared" else 3)
    assert cells.nodes[["feature", "threshold", "left", "cover"]].equals(whole.nodes[["feature", "threshold", "left", "cover"]])
    assert np.allclose(cells.nodes["value"], whole.nodes["value"], atol=1e-9)


def test_small_sums_and_large_sums_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(r.tolist(), float(r[0] * r[1] > 0)) for r in x], "features array<double>, label double").repartition(2)
    fit = lambda: bo.HistogramBoosting(loss="logistic", maxIter=3, maxDepth=3, labelCol="label").fit(df).nodes
    near = fit()
    monkeypatch.setattr(bo, "DIRECT", 0)
    far = fit()
    assert near[["feature", "threshold"]].equals(far[["feature", "threshold"]]) and np.allclose(near["value"], far["value"])


@pytest.mark.parametrize("loss,growth,more", [("logistic", "level", {}), ("softmax", "leaf", dict(maxLeaves=6)), ("squared", "level", dict(subsamplingRate=0.7)),
                                              ("logistic", "leaf", dict(topShare=0.3, otherShare=0.2)), ("squared", "leaf", dict(featureSubsetStrategy="0.5"))])
def test_one_job_and_a_job_per_pass_give_the_same_trees(spark, monkeypatch, loss, growth, more):
    """A table that makes one task grows all rounds in one job: the trees of the passes, with few jobs."""
    x, rng = data(900, 7)
    y = {"softmax": (x[:, 0] + x[:, 1]) % 3, "logistic": x[:, 0] + x[:, 1] > 8, "squared": x[:, 0] * x[:, 2]}[loss]
    monkeypatch.setattr(bo, "BLOCK_ROWS", 200)
    df = frame(spark, x, np.asarray(y, float), np.ones(len(x))).coalesce(1)      # the same blocks, so the same draws, in every fit
    passes = []
    one_pass = bo.Fitting._pass
    monkeypatch.setattr(bo.Fitting, "_pass", lambda self, *a: passes.append(1) or one_pass(self, *a))
    fit = lambda: bo.HistogramBoosting(loss=loss, nClasses=3 if loss == "softmax" else 2, growth=growth, maxIter=12, maxDepth=3, stepSize=0.3, **more).fit(df).nodes
    near = fit()
    assert not passes
    monkeypatch.setattr(bo, "FEW_ROWS", 0)
    for direct in (bo.DIRECT, 0):
        monkeypatch.setattr(bo, "DIRECT", direct)
        far = fit()
        assert near[["round", "tree", "node", "feature", "threshold", "left", "right"]].equals(far[["round", "tree", "node", "feature", "threshold", "left", "right"]])
        assert np.allclose(near[["value", "gain", "cover"]], far[["value", "gain", "cover"]])
        if direct == 0 or growth == "leaf":
            break
    assert len(passes) >= 12


def test_alike_rows_are_scored_once(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 5, 600), rng.integers(0, 2, 600), rng.normal(size=600)]).astype(float)
    x[::7, 0] = np.nan
    x[::11, 0] = 2.5             # a threshold itself
    flat = [{"feature": [0, -1, 1, -1, -1], "threshold": [2.5, 0, 0.5, 0, 0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "value": np.array([0, 1.5, 0, 2.25, -4.0])},
            {"feature": [0, -1, -1], "threshold": [0.5, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": np.array([0, 0.1, 0.7])},
            {"feature": [-1], "threshold": [0], "left": [-1], "right": [-1], "value": np.array([0.3])}]
    trees = [(0, bo.stepped(flat[0])), (1, bo.stepped(flat[1])), (0, bo.stepped(flat[2]))]
    assert {f: c.tolist() for f, c in bo.thresholds(trees).items()} == {0: [0.5, 2.5], 1: [0.5]}
    seen = []
    whole = bo.route_values
    monkeypatch.setattr(bo, "route_values", lambda part, t: seen.append(part.shape[1]) or whole(part, t))
    got = bo.margins(x, trees, [0.5, -1.0])
    assert max(seen) <= 6
    a, b = np.nan_to_num(x[:, 0], nan=-1.0), x[:, 1]
    want = np.column_stack([0.5 + np.where(a > 2.5, np.where(b > 0.5, -4.0, 2.25), 1.5) + 0.3, -1.0 + np.where(a > 0.5, 0.7, 0.1)])
    assert (got == want).all()
    monkeypatch.setattr(bo, "CELL_CODES", 1)
    assert (bo.margins(x, trees, [0.5, -1.0]) == got).all()
    assert bo.margins(x, [], [0.5]).tolist() == [[0.5]] * 600 and bo.margins(x[:0], trees, [0.0, 0.0]).shape == (0, 2)


@pytest.mark.parametrize("shared", [True, False])
def test_masks_find_the_nodes_of_a_walk(shared, monkeypatch):
    """Nodes found from the last one up are those of the walk from the root, for whole, lopsided and empty trees."""
    rng = np.random.default_rng(5)
    groups = [[0, 1], [2]] if shared else [[0], [1], [2]]
    bins = bo.Bins.build([np.arange(float(n)) for n in (100, 154, 255)], groups)
    columns = np.stack([rng.integers(0, w, 3000) for w in bins.width]).astype(np.uint8)
    for splits in (0, 1, 7, 63):
        t = bo.Tree()
        for _ in range(splits):
            node = int(rng.choice(np.flatnonzero(np.array(t.feature) < 0)))
            t.feature[node] = int(rng.integers(3))
            t.bin[node] = int(rng.integers(len(bins.edges[t.feature[node]])))
            t.left[node], t.right[node] = t.child(node), t.child(node)
        flat = t.arrays(bins)
        found = bo._by_masks(columns, flat)
        monkeypatch.setattr(bo, "MASK_ROWS", 1 << 30)
        assert (found == bo.route(columns, flat)).all()
        monkeypatch.undo()


def test_squared_loss_of_even_weights_adds_two_sums(monkeypatch):
    """Second derivatives are the rows' own weights there, so their sums aren't made again; those of other weights are."""
    rng = np.random.default_rng(6)
    columns, calls, real = rng.integers(0, 8, (3, 500)).astype(np.uint8), [], np.bincount
    tree = {"column": np.zeros(1, np.int32), "low": np.zeros(1, np.int16), "high": np.zeros(1, np.int16), "kids": np.zeros(2, np.int32), "steps": 0,
            "value": np.zeros(1), "shared": False}
    monkeypatch.setattr(bo.np, "bincount", lambda *a, **k: calls.append(1) or real(*a, **k))
    for w, sums in ((np.ones(500), 2), (np.full(500, 2.0), 3)):
        calls.clear()
        block = bo.Block(0, columns, rng.normal(size=500), w, np.ones(500), np.zeros((1, 500)))
        total, = bo._histograms([block], bo.Round("squared", [], [tree], [np.zeros(1, np.int64)]), np.array([8, 8, 8]))
        assert len(calls) == 3 * sums and total.shape == (3, 1, 24)
        for c in range(3):
            for q, v in enumerate((-w * block.y, w, np.ones(500))):
                assert np.allclose(total[q, 0, 8 * c:8 * c + 8], real(columns[c], v, 8))


def test_a_task_scores_each_combination_of_thresholds_once(spark, monkeypatch):
    """Rows of later batches between the same thresholds take the scores found before."""
    x, rng = data(600, 4)
    df = frame(spark, x, (x[:, 0] + x[:, 1]) % 3, np.ones(len(x))).coalesce(1)
    m = bo.HistogramBoosting(loss="softmax", nClasses=3, maxIter=3, maxDepth=2).fit(df)
    trees = [(k, bo.stepped(t)) for k, t in m.trees()]
    cuts = bo.thresholds(trees)
    wide = np.concatenate([x, rng.normal(size=x.shape) * 9, np.full((1, x.shape[1]), np.nan), np.full((1, x.shape[1]), np.inf)])
    scored, walked = bo.known_margins(trees, m.start, cuts), []
    plain = bo.margins
    want = plain(wide, trees, m.start, cuts)
    monkeypatch.setattr(bo, "margins", lambda x, *a: walked.append(len(x)) or plain(x, *a))
    for _ in range(2):
        for i in range(0, len(wide), 100):
            assert np.array_equal(scored(wide[i:i + 100]), want[i:i + 100])
    kinds = len(np.unique(bo._code_of(wide.T, cuts)))
    assert sum(walked) == kinds < len(wide)
    monkeypatch.setattr(bo, "KNOWN", 0)
    assert np.array_equal(bo.known_margins(trees, m.start, cuts)(wide), want)


@pytest.mark.parametrize("nodes", [1, 3, 40])
def test_columns_added_up_together_give_the_sums_of_each(nodes):
    rng = np.random.default_rng(nodes)
    width = np.array([200, 2, 30, 11, 2, 9, 1, 2])
    columns = np.stack([rng.integers(0, w, 5000) for w in width]).astype(np.uint8)
    at, v = rng.integers(0, nodes, 5000), rng.integers(0, 9, (3, 5000)).astype(float)
    groups = bo.joint_columns(width, nodes)
    assert sorted(c for g in groups for c in g) == list(range(len(width))) and len(groups) < len(width)
    cells = bo.joint_cells(width, groups)
    assert all(n * nodes <= bo.JOINT or len(g) == 1 for n, g in zip(cells, groups))
    sums = [np.stack([np.bincount(at * n + code, q, nodes * n) for q in v]) for n, code in zip(cells, bo.joint_codes(columns, width, groups))]
    want = [np.stack([np.bincount(at * w + columns[c], q, nodes * w) for q in v]).reshape(3, nodes, w) for c, w in enumerate(width.tolist())]
    assert np.array_equal(bo.apart(sums, width, groups), np.concatenate(want, 2))


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("leaves,deep", [(20, 40), (64, 64), (300, 9), (200, 70)])
def test_words_of_open_ends_give_the_leaves_of_the_walk(monkeypatch, shared, leaves, deep):
    """Trees of any shape, also of more than 64 leaves: the walk from the root, node by node."""
    rng = np.random.default_rng(leaves + shared)
    groups = [[0, 1], [2], [3], [4]] if shared else [[f] for f in range(5)]
    bins = bo.Bins.build([np.arange(k, dtype=float) for k in (40, 30, 9, 200, 1)], groups)
    columns = np.stack([rng.integers(0, w, 6000) for w in bins.width]).astype(np.uint8)
    t, open_ = bo.Tree(), [0]
    while open_ and len(t.feature) < 2 * leaves - 1:
        node = open_.pop(rng.integers(len(open_)) if rng.random() < 0.5 else -1)
        if t.depth[node] < deep:
            t.feature[node] = int(rng.integers(5))
            t.bin[node] = int(rng.integers(len(bins.edges[t.feature[node]])))
            t.left[node], t.right[node] = t.child(node), t.child(node)
            open_ += [t.left[node], t.right[node]]
    tree = t.arrays(bins)
    node, steps = bo._by_words(bo.route_codes(columns, bins.width), tree)
    assert len(t.feature) > bo.MASK_NODES and (steps > 0) == (sum(f < 0 for f in t.feature) > 64)
    found = bo.route(columns, tree)
    assert (found == bo.route(columns, tree, bo.route_codes(columns, bins.width))).all()
    monkeypatch.setattr(bo, "MASK_ROWS", 1 << 30)
    assert len(np.unique(found)) > 1 and (found == bo.route(columns, tree)).all()
