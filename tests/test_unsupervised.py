from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith.operators.unsupervised import IsolationForest
from tests.conftest import SF001


def test_isolation_forest_ranks_injected_outliers_first(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    df = ev.select("event_id", F.when(F.col("event_id") % 250 == 0, F.lit(10_000.0))
                   .otherwise(F.col("value")).alias("v"), (F.col("user_id") * 1.0).alias("u"))
    df = VectorAssembler(inputCols=["v", "u"], outputCol="features").transform(df)
    model = IsolationForest(n_trees=50).fit(df)
    out = model.transform(df)
    top = [r.event_id for r in out.orderBy(F.col("anomaly_score").desc()).limit(4).collect()]
    assert sorted(top) == [0, 250, 500, 750]
    assert out.where("prediction = -1").count() >= 4
    assert set(r.prediction for r in out.select("prediction").distinct().collect()) <= {-1, 1}


def _brute_dbscan(points, eps, mp):
    n = len(points)
    nb = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) <= eps * eps]
          for i in range(n)]
    core = [len(nb[i]) >= mp for i in range(n)]
    lab = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            if core[i]:
                for j in nb[i]:
                    if core[j] and lab[j] > lab[i]:
                        lab[j] = lab[i]
                        changed = True
    out = {}
    for i in range(n):
        if core[i]:
            out[i] = lab[i]
        else:
            c = [lab[j] for j in nb[i] if core[j]]
            out[i] = min(c) if c else None
    names = {v: k for k, v in enumerate(sorted({v for v in out.values() if v is not None}))}
    return {i: (names[v] if v is not None else -1) for i, v in out.items()}


def test_dbscan_matches_brute_force_with_hot_cell(spark):
    import random

    from tabsmith.operators.dbscan import DBSCAN
    rnd = random.Random(3)
    pts = [(0.5, 0.5)] * 40                                   # one hot cell (duplicates)
    pts += [(rnd.uniform(0, 3), rnd.uniform(0, 3)) for _ in range(160)]
    pts += [(0.5 + 0.29 * k, 0.5) for k in range(1, 6)]       # a chain leaving the hot cell
    df = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate(pts)],
                               "id long, xy array<double>")
    got = {r.id: r.prediction for r in DBSCAN("xy", eps=0.3, min_samples=4, id_col="id").fit(df)
           .fit_labels().collect()}
    assert got == _brute_dbscan(pts, 0.3, 4)


def test_importance_scores_only_copies_that_differ(spark, monkeypatch):
    """A copy equal to its row isn't scored; the shares stay those over all rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tabsmith.operators import models as mo

    class Sign:
        scored = spark.sparkContext.accumulator(0)

        def transform(self, df):
            seen, vec = self.scored, F.udf(lambda v: (seen.add(1), float(v[0] > 0))[1], "double")
            return df.withColumn("prediction", vec("features"))

    rows = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, float(i == 3), 5.0]) for i in range(20)], "k int, x array<double>")
    got = mo.permutation_importance(Sign(), rows.select("k", array_to_vector("x").alias("features")), ["a", "b", "c"], ["k"])
    assert 0 < got["a"] <= 1 and got["b"] == 0 and got["c"] == 0
    assert Sign.scored.value <= 20 + 20 + 2       # each row, each change of a, two of b, none of c


def test_grid_edges_compare_few_points_of_crowded_cells(spark, monkeypatch):
    """Two crowded cells whose sub-cells at first stay undecided: finer ones settle them, without comparing their points."""
    import numpy as np

    from tabsmith.operators import dbscan as db

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(0, 0.01, (400, 2)), rng.uniform(0, 0.01, (400, 2)) + [0.98, 0.0], rng.uniform(0, 0.01, (5, 2)) + [3.0, 0.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    names = []
    real = db._sqdist
    monkeypatch.setattr(db, "materialize", lambda d, n, real=db.materialize: (names.append((n, r := real(d, n))), r)[1])
    got = {r["id"]: r["prediction"] for r in db.DBSCAN(features="x", eps=0.99, min_samples=4, id_col="id").fit(df).fit_labels().collect()}
    gap = np.sqrt(((x[:400, None] - x[None, 400:800]) ** 2).sum(2)).min()
    assert got[0] == 0 and got[400] == (0 if gap <= 0.99 else 1) and got[804] == got[400] + 1 and real is db._sqdist
    assert len({got[i] for i in range(400)}) == 1 and len({got[i] for i in range(400, 800)}) == 1
    assert [d for n, d in names if n == "dbscan-open"][-1].count() == 0      # nothing left for points to decide
