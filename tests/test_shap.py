"""Contributions of tree models against enumeration of all feature subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabsmith.operators import boosting as bo
from tabsmith.operators import shap


def expected(tree, value, x, known, node=0):
    """Mean value of the tree when only the features of ``known`` are given."""
    f = tree["feature"][node]
    if f < 0:
        return value[node]
    left, right = tree["left"][node], tree["right"][node]
    if f in known:
        return expected(tree, value, x, known, right if x[f] > tree["threshold"][node] else left)
    a, b = tree["cover"][left], tree["cover"][right]
    return (a * expected(tree, value, x, known, left) + b * expected(tree, value, x, known, right)) / (a + b)


def enumerated(trees, d, x):
    phi = np.zeros((d, trees[0][1].shape[1]))
    for t, value in trees:
        for i in range(d):
            rest = [j for j in range(d) if j != i]
            for k in range(d):
                for s in combinations(rest, k):
                    w = factorial(k) * factorial(d - 1 - k) / factorial(d)
                    phi[i] += w * (expected(t, value, x, {*s, i}) - expected(t, value, x, set(s)))
    return phi.T


def frame(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(1), rng.integers(0, 2, n), rng.normal(size=n).round(1)]).astype(float)
    y = np.digitize(x[:, 0] * (1 + x[:, 2]) + 2 * x[:, 1] * x[:, 3], [4, 9])
    df = spark.createDataFrame(pd.DataFrame({"i": range(n), "a": list(x), "label": y.astype(float), "clash": 1, "x": "x", "row": 2}))
    return x, df.withColumn("features", array_to_vector("a")).drop("a")


@pytest.mark.parametrize("loss", ["softmax", "squared"])
def test_boosted_trees_against_subsets(spark, loss):
    x, df = frame(spark)
    m = bo.HistogramBoosting(loss=loss, nClasses=3, maxIter=3, maxDepth=4, growth="leaf", maxLeaves=9).fit(df)
    out = shap.contributions(m, df.limit(12)).orderBy("i").collect()
    k = len(m.start)
    trees = []
    for o, t in m.trees():
        value = np.zeros((len(t["feature"]), k))
        value[:, o] = t["value"]
        trees.append((t, value))
    for r in out:
        assert np.abs(np.array(r.contributions)[:, :4] - enumerated(trees, 4, x[r.i])).max() < 1e-9


def test_contributions_sum_to_the_score(spark):
    _, df = frame(spark)
    m = bo.HistogramBoosting(nClasses=3, maxIter=6, growth="leaf", maxLeaves=20, maxDepth=0).fit(df)
    out = shap.contributions(m, m.transform(df)).select("contributions", vector_to_array("rawPrediction").alias("raw"), "clash", "x", "row").collect()
    assert max(np.abs(np.array(r.contributions).sum(1) - np.array(r.raw)).max() for r in out) < 1e-9
    assert {(r.clash, r.x, r.row) for r in out} == {(1, "x", 2)}


@pytest.mark.parametrize("make,score", [
    (lambda: RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), "probability"), (lambda: DecisionTreeClassifier(maxDepth=4), "probability"),
    (lambda: RandomForestRegressor(numTrees=3, maxDepth=5, seed=1), "prediction")])
def test_spark_models(spark, make, score):
    x, df = frame(spark)
    m = make().fit(df)
    column = vector_to_array(score) if score == "probability" else F.array(score)
    out = shap.contributions(m, m.transform(df)).select("i", "contributions", column.alias("score")).orderBy("i").collect()
    assert max(np.abs(np.array(r.contributions).sum(1) - np.array(r.score)).max() for r in out) < 1e-9
    trees, _ = shap._spark_trees(m, spark)
    for r in out[:4]:
        want = enumerated([(t, v * w) for t, v, w in trees], 4, x[r.i])
        assert np.abs(np.array(r.contributions)[:, :4] - want).max() < 1e-9


def test_spark_boosted_classifier_margins(spark):
    _, df = frame(spark)
    two = df.withColumn("label", (F.col("label") > 0).cast("double"))
    m = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(two)
    out = shap.contributions(m, m.transform(two)).select("contributions", vector_to_array("rawPrediction")[1].alias("raw")).collect()
    assert max(abs(sum(r.contributions[0]) - r.raw) for r in out) < 1e-9


def test_importance_empty_and_unused(spark):
    _, df = frame(spark)
    m = bo.HistogramBoosting(nClasses=3, maxIter=3).fit(df)
    names = ["a", "b", "c", "d"]
    got = shap.importance(m, df, names)
    each = np.abs(np.array([r.contributions for r in shap.contributions(m, df).collect()])[:, :, :4]).mean((0, 1))
    assert np.abs(np.array([got[k] for k in names]) - each).max() < 1e-9
    assert shap.importance(m, df.limit(0), names) == dict.fromkeys(names, 0.0)
    none = bo.HistogramBoosting(nClasses=3, maxIter=3).fit(df.withColumn("label", F.lit(1.0)))
    assert set(shap.importance(none, df, names).values()) == {0.0}


def test_path_with_many_features():
    """30 features on one path: patterns are told apart by rows of bits."""
    d = 30
    n = 2 * d + 1
    tree = {"feature": np.array([k // 2 if k % 2 == 0 and k < 2 * d else -1 for k in range(n)]), "threshold": np.full(n, 0.5),
            "left": np.array([k + 1 if k % 2 == 0 and k < 2 * d else -1 for k in range(n)]), "right": np.array([k + 2 if k % 2 == 0 and k < 2 * d else -1 for k in range(n)]),
            "cover": np.array([float(d + 2 - k // 2) if k % 2 == 0 else 1.0 for k in range(n)])}
    value = np.arange(n, dtype=float)[:, None]
    made = shap.leaves(tree, value)
    paths = shap.Paths(made, sum(p.value * np.prod(p.share) for p in made), d, True)
    x = np.random.default_rng(0).integers(0, 2, (6, d)).astype(float)
    x[0] = 1
    got = shap.explain(paths, x).sum(2)[:, 0] + paths.base[0]
    assert np.abs(got - [expected(tree, value, r, set(range(d)))[0] for r in x]).max() < 1e-6


@pytest.mark.parametrize("nan_left", [True, False])
def test_tables_of_cells_equal_the_leaves(nan_left, monkeypatch):
    """Also on the thresholds, beyond them, at infinity and NaN; with tables for all leaves, some, or none."""
    rng = np.random.default_rng(3)
    paths = []
    for _ in range(60):
        f = np.sort(rng.choice(5, rng.integers(1, 4), replace=False))
        ends = np.sort(rng.integers(0, 5, (len(f), 2)).astype(float), 1)
        ends[:, 1] += 1
        ends[rng.random(len(f)) < 0.3, 0] = -np.inf
        ends[rng.random(len(f)) < 0.3, 1] = np.inf
        paths.append(shap.Path(f, ends[:, 0], ends[:, 1], rng.random(len(f)), rng.normal(size=2)))
    whole = shap.Paths([*paths, shap.Path(np.zeros(0, np.int64), *np.zeros((3, 0)), np.ones(2))], np.zeros(2), 6, nan_left)
    x = rng.choice([*np.arange(-1, 8.0), 0.5, 2.5, np.nan, np.inf, -np.inf], (500, 6))
    want = shap.explain(whole, x)
    for cells in (1, 60, 1 << 16):
        monkeypatch.setattr(shap, "CELLS", cells)
        tables = shap.Tables(whole)
        assert bool(tables.rest.paths) == (cells < 1 << 16)
        assert np.allclose(tables.explain(x), want, rtol=1e-12, atol=1e-12)
