from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith.operators import improve as im
from tabsmith.operators import models as mo
from tabsmith.operators import oversample as ov
from tabsmith.operators import score as sc
from tabsmith.operators.bundle import Bundle
from tabsmith.operators.dbscan import DBSCAN
from tabsmith.plans import improvement, jobs
from tabsmith.session import scratch_path


def _trials(scores):
    return [improvement.Trial(i, "s", "m", None, score=v) for i, v in enumerate(scores)]


def test_judged_missing_scores_never_win_or_pass(spark):
    rows = improvement.judged(spark, _trials([None, 0.5, 0.4, 0.9, None]), 0.45, "classification", "f1_score",
                              "maximize", 0.8)
    assert [r["improved"] for r in rows] == [0, 1, 0, 1, 0]
    assert [r["passed"] for r in rows] == [False, False, False, True, False]
    rows = improvement.judged(spark, _trials([None, 2.0, 1.0]), 1.5, "regression", "rmse", "minimize", 1.0)
    assert [r["improved"] for r in rows] == [0, 0, 1] and [r["passed"] for r in rows] == [False, False, True]


def test_search_of_a_multiclass_booster(spark, monkeypatch):
    monkeypatch.setitem(mo.PARAM_GRIDS, "gradient_boosting", {"maxIter": [2], "maxDepth": [1, 2]})
    d = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"),
                               F.floor(F.col("id") / 30).cast("double").alias("y"))
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    model, tried, best = im.random_search(d, "gradient_boosting", "classification", "y", 3, 90, ["k"], "f1_score")
    assert len(tried) == 2 and tried[best][1] == max(v for _, v in tried) and model.numClasses == 3
    assert set(mo.native_importances(model, ["x"])) == {"x"}


def test_improved_bundle_scores_held_out_rows(spark, monkeypatch):
    d = spark.range(200).select(
        F.col("id").alias("k"), (F.col("id") % 17 * 1.0).alias("a"), (F.col("id") % 17 * 2.0).alias("b"),
        (F.col("id") % 5 * 1.0).alias("c"), F.when(F.col("id") % 8 == 0, "yes").otherwise("no").alias("y"))
    r = jobs.run_full(spark, d, target="y", key_cols=["k"], models=["logistic_regression"])
    assert "k" not in r.feature_names
    scores = iter([0.1, 0.2, 0.3])      # baseline, changed data, held-out rows
    monkeypatch.setattr(im, "score_of", lambda *a: next(scores))
    every = improvement.candidates
    monkeypatch.setattr(improvement, "candidates", lambda *a: every(*a)[-1:])
    got = jobs.improve(spark, r, threshold=0.9)
    assert got["improved"] and got["evaluation_score"] == 0.3
    change = got["attempts"][0]["parameters"]
    assert change["dropped"] == "b" and change["synthetic_rows"] > 0
    assert "b" not in Bundle.load(spark, r.model_paths["logistic_regression_improved"]).names
    held = jobs.score_holdout(spark, r, "logistic_regression_improved")
    assert held["eval_size"] == 31 and 0 <= held["metrics"]["accuracy"] <= 1
    log = spark.read.parquet(f"{r.store_root}/model_runs").collect()
    assert [x["improved"] for x in log] == [1] and log[0]["evaluation_score"] == 0.3


def test_failed_candidate_is_logged_and_cannot_win(spark):
    d = spark.range(60).select(F.col("id").alias("k"), *[(F.col("id") % m * 1.0).alias(f"v{m}") for m in (3, 5, 7, 11)])
    r = jobs.run_full(spark, d, task="clustering", key_cols=["k"], models=["kmeans", "no_such_model"])
    assert r.best_model == "kmeans" and list(r.model_paths) == ["kmeans"]
    log = spark.read.parquet(f"{r.store_root}/model_runs").collect()
    assert [x["model_name"] for x in log] == ["no_such_model"] and log[0]["parameters"]["error"]


def test_oversampling_small_cases(spark):
    rows = [(i, "a", [float(i), 0.0]) for i in range(20)] + [(100 + i, "b", [float(i), 1.0]) for i in range(7)]
    d = spark.createDataFrame(rows + [(300, None, [0.0, 0.0]), (301, "a", None)], "k long, y string, x array<double>")
    made = ov.synthetic_rows(d, "y", "x", ["k"]).collect()
    assert len(made) == 13 and all(m["label"] == "b" and m["x"][1] == 1.0 and 0 <= m["x"][0] <= 6 for m in made)
    again = ov.synthetic_rows(d, "y", "x", ["k"]).collect()
    assert sorted(m["x"] for m in made) == sorted(m["x"] for m in again)
    few = d.where("k < 105 or y is null")                                      # five rows are too few
    assert ov.synthetic_rows(few, "y", "x", ["k"]).count() == 0
    assert ov.oversample(d.limit(0), "y", "x", ["k"]).count() == 0


def test_dbscan_saved_and_loaded_labels_a_hot_cell_and_a_long_chain(spark):
    hot = spark.range(400).select(F.col("id"), F.array(F.lit(0.1), F.lit(0.1)).alias("x"))
    chain = spark.range(400, 700).select(F.col("id"), F.array((F.col("id") - 395) * 0.3, F.lit(50.0)).alias("x"))
    d = hot.unionByName(chain)
    m = DBSCAN("x", eps=0.5, min_samples=3, id_col="id").fit(d)
    path = scratch_path(spark, "dbscan-model")
    m.save(path, spark)
    back = sc.load_model(path, spark).transform(d)
    fit = {r["id"]: r["prediction"] for r in m.fit_labels().collect()}
    assert {r["id"]: r["prediction"] for r in back.collect()} == fit
    assert {fit[i] for i in range(400)} == {0} and {fit[i] for i in range(400, 700)} == {1}


def test_permutation_importance_of_equal_rows(spark):
    class Ten:
        def transform(self, d):
            from pyspark.ml.functions import vector_to_array
            return d.withColumn("prediction", vector_to_array("features")[0] * 10)
    d = spark.range(1000).select("id", (F.col("id") % 2 * 1.0).alias("a"), (F.floor(F.col("id") / 2) % 2 * 1.0).alias("b"))
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d)
    got = mo.permutation_importance(Ten(), d, ["a", "b"], ["id"], discrete=False)
    assert 4 < got["a"] < 6 and got["b"] == 0


def test_correlations_of_null_and_constant_columns(spark):
    d = spark.createDataFrame([(1.0, 2.0, None, 5.0), (2.0, 4.0, 1.0, 5.0), (3.0, 6.0, 2.0, 5.0), (5.0, 9.0, 4.0, 5.0)],
                              "a double, b double, c double, d double")
    got = {(r["left"], r["right"]): r["corr"] for r in im.correlation_pairs(d, d.columns).collect()}
    assert len(got) == 6 and abs(got["a", "c"] - 1) < 1e-9 and got["a", "d"] is None and got["a", "b"] > 0.99
