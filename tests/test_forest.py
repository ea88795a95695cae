"""Random forest regressor against a plain numpy trainer on the same bootstrap counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import forest as fo
from tabsmith.operators import models as mo


def plain(x, y, count, depth):
    """Predictions of a tree grown row by row on bootstrap counts."""
    out = np.zeros(len(y))

    def grow(at, level):
        w = count[at]
        mean = (w * y[at]).sum() / w.sum()
        best = (1e-9, None)
        for f in range(x.shape[1]) if level < depth else ():
            seen = np.unique(x[at[w > 0], f])
            for cut in (seen[:-1] + seen[1:]) / 2:
                left = x[at, f] <= cut
                wl, wr = w[left].sum(), w[~left].sum()
                gain = (w * y[at])[left].sum() ** 2 / wl + (w * y[at])[~left].sum() ** 2 / wr - (w * y[at]).sum() ** 2 / w.sum()
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut))
        if best[1] is None:
            out[at] = mean
        else:
            left = x[at, best[1][0]] <= best[1][1]
            grow(at[left], level + 1)
            grow(at[~left], level + 1)

    grow(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("sums", [fo.SUMS, 1])
def test_forest_equals_plain_trees_on_the_same_draws(spark, monkeypatch, sums):
    monkeypatch.setattr(fo, "SUMS", sums)      # 1: a pass for each tree
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=300)
    df = spark.createDataFrame([(r.tolist(), float(v), i) for i, (r, v) in enumerate(zip(x, y))], "features array<double>, label double, i int").coalesce(1)
    m = mo.get_model("random_forest_regressor", "regression", label="label", params={"numTrees": 3, "maxDepth": 3}).fit(df)
    assert [int(t["feature"].size) <= 15 for _, t in m.trees()] == [True] * 3
    got = np.array([r["prediction"] for r in m.transform(df).orderBy("i").collect()])
    want = np.mean([plain(x, y, fo.drawn(42, k, 0, 300).astype(float), 3) for k in range(3)], 0)
    # rows whose values the draw left out may lie on either side of an equal cut
    assert np.mean(np.abs(got - want) < 1e-9) > 0.9
    assert abs(sum(m.featureImportances.toArray()) - 1) < 1e-9


def test_bootstrap_counts_are_poisson():
    n = np.concatenate([fo.drawn(42, k, 7, 10_000) for k in range(20)])
    assert abs(n.mean() - 1) < 0.01 and abs((n == 0).mean() - np.exp(-1)) < 0.005 and abs(n.var() - 1) < 0.02


def test_forest_without_rows_and_unlabelled_rows(spark):
    df = spark.createDataFrame([([1.0], 2.0), ([2.0], None), ([float("nan")], 4.0)], "features array<double>, label double")
    empty = mo.get_model("random_forest_regressor", "regression", label="label").fit(df.limit(0))
    assert [r["prediction"] for r in empty.transform(df).collect()] == [0.0] * 3
    m = mo.get_model("random_forest_regressor", "regression", label="label").fit(df)
    assert m.transform(df).where(F.col("prediction").between(2, 4)).count() == 3


@pytest.mark.parametrize("weighted", [False, True])
def test_few_combinations_of_bins_give_the_same_trees_in_one_pass(spark, monkeypatch, weighted):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (3000, 3)).astype(float)
    x[::50, 1] = np.nan
    y = np.nan_to_num(x[:, 0] * 2 - x[:, 1] * x[:, 2]) + rng.integers(0, 9, 3000)
    w = rng.integers(0, 4, 3000) if weighted else np.ones(3000)
    df = spark.createDataFrame([(r.tolist(), float(v), float(u)) for r, v, u in zip(x, y, w)], "features array<double>, label double, w double").coalesce(1)
    passes = []
    sums = fo._sums
    monkeypatch.setattr(fo, "_sums", lambda *a: passes.append(1) or sums(*a))
    fit = lambda: mo.get_model("random_forest_regressor", "regression", label="label", weight="w", params={"numTrees": 5, "maxDepth": 6}).fit(df).nodes
    near = fit()
    assert not passes
    monkeypatch.setattr(fo, "SUMS", 500)       # two trees a pass
    assert fit().equals(near) and not passes
    monkeypatch.setattr(fo, "SUMS", 8 << 20)
    monkeypatch.setattr(fo, "MOST_CELLS", 0)
    far = fit()
    assert len(passes) == 6 and far.equals(near)
