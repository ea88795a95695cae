"""Candidate models (M1-M13) on Spark ML, importances (G1-G4) and search grids.

Spark ML estimators train distributed (tree aggregation / per-partition
gradient sums); the driver holds only model parameters.  Names follow the
reference's model list.  All boosted presets are trained by softmax, logistic or squared-loss
histogram boosting (``boosting.py``), the leaf-wise ones by its best-first growth; the random forest
regressor by ``forest.py``.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize, with_global_index
from .boosting import HistogramBoosting
from .forest import HistogramForestRegressor

SEED = 42
DEFAULT_TREE_DEPTH = 10   # scikit-learn grows trees without limit; Spark allows at most 30

# Candidate lists per task (J1 planner rules).
CLASSIFIERS = ["logistic_regression", "random_forest", "gradient_boosting", "xgboost", "lightgbm"]
REGRESSORS = ["linear_regression", "random_forest_regressor", "gradient_boosting_regressor",
              "xgboost_regressor", "lightgbm_regressor"]

# Search spaces (Spark parameter names; None depth -> 30).
PARAM_GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200, 300], "maxDepth": [5, 10, 20, 30],
                      "minInstancesPerNode": [1, 2, 4]},
    "random_forest_regressor": {"numTrees": [50, 100, 200, 300], "maxDepth": [5, 10, 20, 30]},
    "xgboost": {"stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [3, 5, 7, 10],
                "subsamplingRate": [0.6, 0.8, 1.0], "maxIter": [50, 100, 200, 300],
                "featureSubsetStrategy": ["0.6", "0.8", "1.0"]},
    "xgboost_regressor": {"stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [3, 5, 7, 10],
                          "subsamplingRate": [0.6, 0.8, 1.0], "maxIter": [50, 100, 200, 300]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7],
                          "stepSize": [0.01, 0.05, 0.1, 0.2]},
    "gradient_boosting_regressor": {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7],
                                    "stepSize": [0.01, 0.05, 0.1, 0.2]},
    "lightgbm": {"stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [4, 5, 6, 7],
                 "maxIter": [50, 100, 200, 300], "subsamplingRate": [0.6, 0.8, 1.0]},
    "lightgbm_regressor": {"stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [4, 5, 6, 7],
                           "maxIter": [50, 100, 200, 300]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
}


# Default candidates of each task, at every number of rows.
DEFAULT_MODELS = {
    "classification": ["logistic_regression", "random_forest", "xgboost", "gradient_boosting"],
    "nlp_classification": ["logistic_regression"],
    "regression": ["linear_regression", "random_forest_regressor", "xgboost_regressor"],
    "time_series_forecasting": ["random_forest_regressor", "xgboost_regressor"],
    "clustering": ["kmeans", "dbscan"],
    "anomaly_detection": ["isolation_forest"],
}
# Rounds, depth and rate of the boosted presets (depth 0: any), and what second-order training adds.
BOOSTED = {"gradient_boosting": dict(maxIter=100, maxDepth=3, stepSize=0.1), "xgboost": dict(maxIter=100, maxDepth=6, stepSize=0.3),
           "lightgbm": dict(maxIter=100, maxDepth=0, stepSize=0.1)}
SECOND_ORDER = {"gradient_boosting": dict(regLambda=0.0), "xgboost": dict(regLambda=1.0, minHessian=1.0),
                "lightgbm": dict(growth="leaf", maxLeaves=31, regLambda=0.0, minInstancesPerNode=20)}
FAMILIES = {"classification": CLASSIFIERS, "nlp_classification": CLASSIFIERS,
            "regression": REGRESSORS, "time_series_forecasting": REGRESSORS}


def planned_models(task: str, models: list[str] | None = None) -> list[str]:
    """The caller's candidates, or the task's defaults."""
    return list(models) if models else list(DEFAULT_MODELS.get(task, ["random_forest"]))


def alternative_models(task: str, exclude: list[str] | None = None) -> list[str]:
    """H3: models of the task's family that were not tried yet, in the family's order."""
    tried = {m.lower() for m in exclude or ()}
    return [m for m in FAMILIES.get(task, ()) if m not in tried]


def get_model(name: str, task: str = "classification", n_classes: int = 2, n_rows: int | None = None,
              features: str = "features", label: str = "label_idx", weight: str | None = None,
              params: dict | None = None):
    """Spark ML estimator for a reference model name (unknown name -> ValueError)."""
    name = name.lower()
    p = dict(params or {})
    common = dict(featuresCol=features, labelCol=label)
    wcol = {"weightCol": weight} if weight else {}
    if name == "logistic_regression":
        c = float(p.pop("C", 1.0))
        n = max(int(n_rows or 1), 1)
        return LogisticRegression(maxIter=1000, regParam=1.0 / (c * n), elasticNetParam=0.0,
                                  standardization=False, **common, **wcol)
    if name == "linear_regression":
        return LinearRegression(regParam=0.0, elasticNetParam=0.0, **common, **wcol)
    if name == "random_forest":
        kw = dict(numTrees=100, featureSubsetStrategy="sqrt", maxDepth=DEFAULT_TREE_DEPTH, seed=SEED)
        kw.update(p)
        return RandomForestClassifier(**kw, **common, **wcol)
    if name == "random_forest_regressor":
        kw = dict(numTrees=100, maxDepth=DEFAULT_TREE_DEPTH, seed=SEED)
        kw.update(p)
        return HistogramForestRegressor(**kw, **common, **wcol)
    base, regression = name.removesuffix("_regressor"), name.endswith("_regressor")
    if base in BOOSTED:
        kw = dict(**BOOSTED[base], seed=SEED)
        kw.update(p)
        loss = "squared" if regression else "softmax" if n_classes > 2 else "logistic"
        return HistogramBoosting(loss, n_classes, **(SECOND_ORDER[base] | kw), **common, **wcol)
    if name == "kmeans":
        kw = dict(k=8, seed=SEED, initMode="k-means||")
        kw.update(p)
        return KMeans(featuresCol=features, **kw)
    if name in ("dbscan", "isolation_forest"):
        from . import unsupervised
        return unsupervised.make(name, features=features, **p)
    raise ValueError(f"Model {name} is not supported")


def search_size(grid: dict) -> int:
    """H1: n = min(20, max(5, 3 * #parameters))."""
    return min(20, max(5, 3 * len(grid)))


# ---------------------------------------------------------------- G1-G4
def native_importances(model, names: list[str]) -> dict[str, float] | None:
    """G1 tree importances, G2 |coefficients| (first
    class row when multinomial); G4 names.  None for a model that has neither."""
    if hasattr(model, "featureImportances"):
        vec = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix") and getattr(model, "numClasses", 2) > 2:
        vec = abs(model.coefficientMatrix.toArray()[0])
    elif hasattr(model, "coefficients"):
        vec = abs(model.coefficients.toArray())
    else:
        return None
    return {names[i] if i < len(names) else f"feature_{i}": float(v) for i, v in enumerate(vec)}


def permutation_importance(model, df: DataFrame, names: list[str], keys: list[str], features: str = "features",
                           output: str = "prediction", discrete: bool = True, seed: int = SEED) -> dict[str, float]:
    """G3 (re-aimed SHAP): how much predictions change when one feature takes another row's value.

    All rows take part.  Rows are ordered by a hash of their *keys*, and a row's donor is the row
    before it (the last one for the first), so equal rows have different donors.  ``discrete``:
    share of changed predictions (classes, clusters), else the mean absolute change.  The copies
    (a row and a feature in which it differs from its donor; the others are the row itself and change
    nothing) are scored as they are made and only summed; nothing wider is shuffled.
    Defined cases: no rows give 0 for every feature.
    """
    n = df.count()
    if not n:
        return {name: 0.0 for name in names}
    rows = df.select(*keys, features).withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    rows = materialize(with_global_index(rows, [F.col("_h"), *[F.col(k) for k in keys]], "_i"), "importance-rows")
    rows = rows.withColumn("_vec", vector_to_array(features))
    donors = rows.select(((F.col("_i") + 1) % n).alias("_i"), F.col("_vec").alias("_donor"))
    base = model.transform(rows.select("_i", features, "_vec")).select(
        "_i", "_vec", F.col(output).cast("double").alias("_p0"))
    differs = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda j: ~F.get("_vec", j).eqNullSafe(F.get("_donor", j)))
    copies = base.join(donors, "_i").select("*", F.explode(differs).alias("_j"))
    copies = copies.withColumn(features, array_to_vector(F.transform(
        "_vec", lambda v, i: F.when(i == F.col("_j"), F.col("_donor")[i]).otherwise(v))))
    change = F.abs(F.col(output).cast("double") - F.col("_p0"))
    change = (change > 0).cast("double") if discrete else change
    per = model.transform(copies.drop("_vec", "_donor")).groupBy("_j").agg(F.sum(change).alias("v")).collect()
    return {name: 0.0 for name in names} | {names[r["_j"]]: float(r["v"] or 0.0) / n for r in per}
