"""Queries that fit models or run whole jobs (M1-M13, G1-G3, H1, H5, H9, I1, I2, J1-J3, S14, ST1-ST3).

Fitted values have no SQL form.  These queries return what must hold for any right fit (row
sets, class sets, ranges, score equations, order of results), and their DuckDB twins state it.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from ..operators import features as fe
from ..operators import improve as im
from ..operators import models as mo
from ..operators import oversample as ov
from ..operators import score as sc
from ..operators import shap
from ..operators import split as sp
from ..operators.boosting import HistogramBoosting
from ..operators.unsupervised import IsolationForest
from ..session import scratch_path
from ..sources import io
from ..streaming import stream as st
from ._base import register, table

_DOCS = "labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL"
_VALID_DOCS = f"SELECT l.doc_id, true AS valid, true AS fits FROM {_DOCS}"
_VALID_LINES = "SELECT l_orderkey, l_linenumber, true AS valid, true AS fits FROM lineitem"


def _doc_frame(spark, sf_dir):
    lab, doc = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return (lab.join(doc, "doc_id").where("quality is not null")
            .select("doc_id", "quality", "toxic", "lang", "source", "n_chars", "text"))


def _classification_tables(spark, sf_dir, label="quality"):
    """(training table, all rows, fitted preprocessing, label indexer); fitted on the training part."""
    d = _doc_frame(spark, sf_dir).drop("text")
    train = materialize(sp.part(sp.stratified_split(d, label, ["doc_id"]), "train"), "query-part")
    fit = fe.fit_features(train, fe.FeatureSpec(numerical=["n_chars"], categorical=["lang", "source"]))
    li = fe.label_indexer(label).fit(train)
    return (materialize(li.transform(fit.transform(train)), "query-train"),
            materialize(li.transform(fit.transform(d)), "query-all"), fit, li)


def _regression_tables(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                                 "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")
    train = materialize(sp.part(sp.random_split(li, ["l_orderkey", "l_linenumber"]), "train"), "query-part")
    fit = fe.fit_features(train, fe.FeatureSpec(numerical=["l_quantity", "l_discount", "l_tax"],
                                                categorical=["l_returnflag", "l_linestatus"]))
    # the steps' columns in between aren't read again, so they aren't written
    add = lambda d: fit.transform(d).select("l_orderkey", "l_linenumber", "features", F.col("l_extendedprice").alias("label"))
    return materialize(add(train), "query-train"), materialize(add(li), "query-all")


def _class_rows(model, train, rows, key, label="label_idx", n_classes=2):
    """(key, valid, fits): the prediction is a class, the confidence a share from 1 / classes; on the
    training rows the model errs no more often than the largest class would."""
    tp = model.transform(train)
    top = train.groupBy(label).count().agg(F.max("count")).first()[0]
    fits = tp.where(F.col("prediction") == F.col(label)).count() >= top
    out = model.transform(rows)
    valid = F.col("prediction").isin([float(i) for i in range(n_classes)])
    if "probability" in out.columns:
        share = vector_to_array("probability")
        total = F.aggregate(share, F.lit(0.0), lambda a, b: a + b)
        conf = F.array_max(share)
        valid = valid & (conf >= 1.0 / n_classes - 1e-9) & (conf <= 1 + 1e-9) & (F.abs(total - 1) < 1e-9) & (F.size(share) == n_classes)
    return out.select(key, valid.alias("valid"), F.lit(fits).alias("fits"))


def _line_rows(model, train, rows, in_range):
    """As above: predictions are finite (averages of training labels: in their range), and the training
    error is at most that of the mean."""
    low, high, var = train.agg(F.min("label"), F.max("label"), F.var_pop("label")).first()
    mse = model.transform(train).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    p = F.col("prediction")
    valid = p.between(low - 1e-6, high + 1e-6) if in_range else p.isNotNull() & ~F.isnan(p)
    return model.transform(rows).select("l_orderkey", "l_linenumber", valid.alias("valid"), F.lit(mse <= var).alias("fits"))


@register("m1_logistic_regression", f"""
WITH c AS (SELECT l.quality AS q, count(*) AS n FROM {_DOCS} GROUP BY 1),
e AS (SELECT q, n, ceil(n * CAST(0.15 AS DOUBLE)) AS n_eval FROM c),
t AS (SELECT q, n - n_eval - ceil((n - n_eval) * CAST(0.176 AS DOUBLE)) AS n FROM e)
SELECT CAST((SELECT count(*) FROM {_DOCS}) AS BIGINT) AS n_rows, CAST(2 AS INTEGER) AS n_classes,
  round(sum(CASE WHEN q = 1 THEN n ELSE 0 END) / sum(n), 3) AS mean_probability, CAST(0 AS BIGINT) AS n_bad FROM t
""")
def m1_logistic_regression(spark, sf_dir):
    """Two classes; with a free intercept the mean probability on the training rows is the share of class 1."""
    train, rows, _, _ = _classification_tables(spark, sf_dir)
    m = mo.get_model("logistic_regression", n_rows=train.count()).fit(train)
    prob = lambda d: m.transform(d).select(vector_to_array("probability")[1].alias("p"), "prediction")
    bad = F.count_if((F.col("p") < 0) | (F.col("p") > 1) | (F.col("prediction") != (F.col("p") > 0.5).cast("double")))
    mean = prob(train).agg(F.round(F.avg("p"), 3)).first()[0]
    return prob(rows).agg(F.count("*").alias("n_rows"), F.lit(m.numClasses).alias("n_classes"),
                          F.lit(mean).alias("mean_probability"), bad.alias("n_bad"))


@register("m2_linear_regression_one_feature", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem
""")
def m2_linear_regression_one_feature(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    li = table(spark, sf_dir, "lineitem")
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li) \
        .withColumn("label", F.col("l_extendedprice"))
    m = mo.get_model("linear_regression", "regression", label="label").fit(d)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                 "slope double, intercept double")


@register("m3_random_forest_classifier", _VALID_DOCS)
def m3_random_forest_classifier(spark, sf_dir):
    train, rows, _, _ = _classification_tables(spark, sf_dir)
    return _class_rows(mo.get_model("random_forest").fit(train), train, rows, "doc_id")


@register("m4_random_forest_regressor", _VALID_LINES)
def m4_random_forest_regressor(spark, sf_dir):
    train, rows = _regression_tables(spark, sf_dir)
    m = mo.get_model("random_forest_regressor", "regression", label="label").fit(train)
    return _line_rows(m, train, rows, in_range=True)


@register("m5_boosted_classifier_multiclass",
          "SELECT o_orderkey, true AS valid, true AS fits FROM orders WHERE o_orderstatus IS NOT NULL")
def m5_boosted_classifier_multiclass(spark, sf_dir):
    """Three-class orders status by softmax boosting: shares of three classes that sum to 1."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority") \
        .where("o_orderstatus is not null")
    train = materialize(sp.part(sp.stratified_split(o, "o_orderstatus", ["o_orderkey"]), "train"), "query-part")
    fit = fe.fit_features(train, fe.FeatureSpec(numerical=["o_totalprice"], categorical=["o_orderpriority"]))
    li = fe.label_indexer("o_orderstatus").fit(train)
    tf = materialize(li.transform(fit.transform(train)), "query-train")
    rows = li.transform(fit.transform(o))
    m = mo.get_model("gradient_boosting", n_classes=len(li.labels)).fit(tf)
    return _class_rows(m, tf, rows, "o_orderkey", n_classes=len(li.labels))


@register("m6_boosted_regressor", _VALID_LINES)
def m6_boosted_regressor(spark, sf_dir):
    train, rows = _regression_tables(spark, sf_dir)
    m = mo.get_model("gradient_boosting_regressor", "regression", label="label").fit(train)
    return _line_rows(m, train, rows, in_range=False)


@register("m7_m8_boosted_presets", f"""
SELECT v.*, p.preset FROM ({_VALID_DOCS}) v, (SELECT unnest(['xgboost', 'lightgbm']) AS preset) p
""")
def m7_m8_boosted_presets(spark, sf_dir):
    train, rows, _, _ = _classification_tables(spark, sf_dir)
    out = [_class_rows(mo.get_model(name).fit(train), train, rows, "doc_id").withColumn("preset", F.lit(name))
           for name in ("xgboost", "lightgbm")]
    return out[0].unionByName(out[1])


@register("m9_kmeans", "SELECT vec_id, true AS at_nearest FROM embeddings")
def m9_kmeans(spark, sf_dir):
    """Every row belongs to the centre that is nearest to it (eight centres)."""
    e = table(spark, sf_dir, "embeddings").withColumn("features", array_to_vector("embedding"))
    m = mo.get_model("kmeans").fit(e)
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in m.clusterCenters()])
    x = vector_to_array("features")
    dist = F.transform(centers, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                                      lambda s, z: s + z))
    return m.transform(e).withColumn("_d", dist).select(
        "vec_id", (F.get("_d", F.col("prediction")) <= F.array_min("_d") + 1e-6).alias("at_nearest"))


@register("m11_isolation_forest", "SELECT event_id, event_id % 250 = 0 AS among_top FROM events")
def m11_isolation_forest(spark, sf_dir):
    """Every 250th event is moved far out; exactly those rows have the highest scores."""
    from pyspark.ml.feature import VectorAssembler
    far = F.col("event_id") % 250 == 0
    ev = table(spark, sf_dir, "events").withColumn("value", F.when(far, F.lit(10_000.0)).otherwise(F.col("value")))
    d = VectorAssembler(inputCols=["value", "user_id"], outputCol="features").transform(ev)
    scored = materialize(IsolationForest().fit(d).transform(d).select("event_id", "anomaly_score"), "query-scores")
    n = scored.where(far).count()
    cut = scored.orderBy(F.col("anomaly_score").desc()).limit(n).agg(F.min("anomaly_score")).first()[0]
    return scored.select("event_id", (F.col("anomaly_score") >= cut).alias("among_top"))


@register("g1_g3_importances", f"""
WITH f AS (SELECT 'n_chars' AS feature_name UNION SELECT 'lang_' || d.lang FROM {_DOCS} AND d.lang IS NOT NULL
           UNION SELECT 'source_' || d.source FROM {_DOCS} AND d.source IS NOT NULL)
SELECT m.model_name, f.feature_name, true AS valid FROM f,
  (SELECT unnest(['random_forest', 'logistic_regression', 'kmeans']) AS model_name) m
""")
def g1_g3_importances(spark, sf_dir):
    """Tree importances (G1: sum 1), |coefficients| (G2), permutation importance (G3: shares) with G4 names."""
    train, rows, fit, _ = _classification_tables(spark, sf_dir)
    out = []
    forest = mo.native_importances(mo.get_model("random_forest").fit(train), fit.names)
    whole = abs(sum(forest.values()) - 1) < 1e-6
    out += [("random_forest", k, whole and v >= 0) for k, v in forest.items()]
    line = mo.native_importances(mo.get_model("logistic_regression", n_rows=train.count()).fit(train), fit.names)
    out += [("logistic_regression", k, v >= 0) for k, v in line.items()]
    moved = mo.permutation_importance(mo.get_model("kmeans").fit(train), rows, fit.names, ["doc_id"])
    out += [("kmeans", k, 0 <= v <= 1) for k, v in moved.items()]
    return spark.createDataFrame(out, "model_name string, feature_name string, valid boolean")


@register("g3_tree_contributions", "SELECT l_orderkey, l_linenumber, true AS adds_up, true AS used_only FROM lineitem")
def g3_tree_contributions(spark, sf_dir):
    """Shapley contributions of a leaf-wise boosted model: they and the base sum to the prediction of every line, and
    features that no split uses contribute nothing."""
    train, rows = _regression_tables(spark, sf_dir)
    m = mo.get_model("lightgbm_regressor", "regression", label="label", params={"maxIter": 10}).fit(train)
    used = F.array(*[F.lit(v > 0) for v in m.featureImportances.toArray().tolist()])
    out = shap.contributions(m, m.transform(rows).select("l_orderkey", "l_linenumber", "prediction", "features"))
    phi = F.col("contributions")[0]
    total = F.aggregate(phi, F.lit(0.0), lambda a, b: a + b)
    idle = F.aggregate(F.zip_with(F.slice(phi, 1, F.size(phi) - 1), used, lambda v, u: F.when(u, 0.0).otherwise(F.abs(v))), F.lit(0.0), lambda a, b: a + b)
    return out.select("l_orderkey", "l_linenumber", (F.abs(total - F.col("prediction")) < 1e-6 * (1 + F.abs("prediction"))).alias("adds_up"),
                      (idle == 0).alias("used_only"))


@register("m8_leaf_growth_loss", "SELECT true AS no_worse, true AS shares_sum, CAST(count(*) AS BIGINT) AS n_rows FROM orders WHERE o_orderstatus IS NOT NULL")
def m8_leaf_growth_loss(spark, sf_dir):
    """Three classes, 8 leaves a tree: the log loss of best-first growth isn't above that of levels of depth 3."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate").where("o_orderstatus is not null")
    o = o.withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01")))
    fit = fe.fit_features(o, fe.FeatureSpec(numerical=["o_totalprice", "day"], categorical=["o_orderpriority"]))
    li = fe.label_indexer("o_orderstatus").fit(o)
    rows = materialize(li.transform(fit.transform(o)), "query-train")
    share, own = vector_to_array("probability"), F.col("label_idx").cast("int")
    loss = F.avg(-F.log(F.greatest(F.get(share, own), F.lit(1e-300))))
    even = F.abs(F.aggregate(share, F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9
    got = {}
    for name, settings in (("level", dict(maxDepth=3)), ("leaf", dict(growth="leaf", maxDepth=0, maxLeaves=8))):
        m = HistogramBoosting("softmax", len(li.labels), maxIter=8, stepSize=0.3, labelCol="label_idx", **settings).fit(rows)
        got[name] = m.transform(rows).agg(loss.alias("loss"), F.bool_and(even).alias("even"), F.count("*").alias("n")).first()
    return spark.createDataFrame([(got["leaf"]["loss"] <= got["level"]["loss"] + 1e-6, got["leaf"]["even"] and got["level"]["even"], got["leaf"]["n"])],
                                 "no_worse boolean, shares_sum boolean, n_rows long")


@register("h1_random_search", """
SELECT unnest([0.01, 0.1, 1.0, 10.0]::DOUBLE[]) AS "C", true AS valid, CAST(1 AS INTEGER) AS n_best, true AS refitted
""")
def h1_random_search(spark, sf_dir):
    """Grid of the logistic model, 3 stratified folds: one best, none above it, refitted with its setting."""
    train, _, _, li = _classification_tables(spark, sf_dir)
    n = train.count()
    model, tried, best = im.random_search(train, "logistic_regression", "classification", "label_idx", len(li.labels),
                                          n, ["doc_id"], "f1_score")
    top = max(v for _, v in tried)
    refit = abs(model.getRegParam() * n * tried[best][0]["C"] - 1) < 1e-9
    rows = [(float(c["C"]), 0 <= v <= 1, int(tried[best][1] == top), refit) for c, v in tried]
    return spark.createDataFrame(rows, "C double, valid boolean, n_best int, refitted boolean")


@register("h5_oversampled_classes", f"""
WITH c AS (SELECT l.quality, count(*) AS n FROM {_DOCS} GROUP BY 1)
SELECT quality, CAST(n AS BIGINT) AS n_original, CAST(CASE WHEN (SELECT min(n) FROM c) < 6 THEN 0
  ELSE (SELECT max(n) FROM c) - n END AS BIGINT) AS n_synthetic, CAST(0 AS BIGINT) AS n_off FROM c
""")
def h5_oversampled_classes(spark, sf_dir):
    """H5 / J-e: every class reaches the size of the largest; a synthetic row lies between two rows of its class."""
    d = _doc_frame(spark, sf_dir)
    x = F.array(F.col("n_chars").cast("double"), F.length("text").cast("double"), F.size(F.split("text", " ")).cast("double"))
    d = d.select("doc_id", "quality", F.transform(x, lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))
    new = materialize(ov.synthetic_rows(d, "quality", "x", ["doc_id"]), "query-synthetic")
    rows = d.select(F.col("quality").alias("label"), "x").distinct()
    for end in ("a", "b"):
        new = new.join(rows.select("label", F.col("x").alias(end), F.lit(1).alias(f"in_{end}")), ["label", end], "left")
    gap = F.aggregate(F.zip_with("x", F.zip_with("a", "b", lambda p, q: p + F.col("u") * (q - p)),
                                 lambda v, w: F.abs(v - w)), F.lit(0.0), lambda s, z: s + z)
    off = F.col("in_a").isNull() | F.col("in_b").isNull() | (gap > 1e-6) | ~F.col("u").between(0, 1)
    made = new.groupBy(F.col("label").alias("quality")).agg(F.count("*").alias("n_synthetic"), F.count_if(off).alias("n_off"))
    return (d.groupBy("quality").agg(F.count("*").alias("n_original")).join(made, "quality", "left")
            .fillna(0, ["n_synthetic", "n_off"]).select("quality", "n_original", "n_synthetic", "n_off"))


def _run_rows(spark, r, goal="maximize", metric=None):
    """(model_name, n_best, best_first, n_train, n_val, n_eval) of a run."""
    from ..sources.store import ResultStore
    m = ResultStore(spark, r.store_root).read("model_metrics")
    col = F.col(metric or r.metric)
    top = m.agg(F.max(col) if goal == "maximize" else F.min(col)).first()[0]
    best = m.where("is_best_model = 1").select(col).collect()
    size = {x["split"]: x["count"] for x in spark.read.parquet(r.splits_path).groupBy("split").count().collect()}
    n = lambda p: size.get(p, 0) + size.get("all", 0)
    return m.select("model_name", F.lit(len(best)).alias("n_best"), F.lit(len(best) == 1 and best[0][0] == top).alias("best_first"),
                    *[F.lit(n(p)).cast("long").alias(f"n_{p}") for p in ("train", "val", "eval")])


def _sizes(source):
    return f"""n AS (SELECT count(*) AS n FROM {source}),
e AS (SELECT n, ceil(n * CAST(0.15 AS DOUBLE)) AS n_eval FROM n),
s AS (SELECT n, n_eval, ceil((n - n_eval) * CAST(0.176 AS DOUBLE)) AS n_val FROM e)"""


def _run_sql(models, source, split=True):
    sizes = ("CAST(n - n_val - n_eval AS BIGINT) AS n_train, CAST(n_val AS BIGINT) AS n_val, CAST(n_eval AS BIGINT) AS n_eval"
             if split else "CAST(n AS BIGINT) AS n_train, CAST(n AS BIGINT) AS n_val, CAST(n AS BIGINT) AS n_eval")
    names = ", ".join(f"'{m}'" for m in models)
    return f"""WITH {_sizes(source)}
SELECT m.model_name, CAST(1 AS INTEGER) AS n_best, true AS best_first, {sizes}
FROM s, (SELECT unnest([{names}]) AS model_name) m"""


@register("j1_full_run_metrics", _run_sql(mo.DEFAULT_MODELS["regression"], "lineitem"))
def j1_full_run_metrics(spark, sf_dir):
    """J1, plain regression on all of lineitem: all candidates fitted, one best, exact part sizes."""
    from ..plans import jobs
    r = jobs.run_full(spark, table(spark, sf_dir, "lineitem"), target="l_extendedprice",
                      key_cols=["l_orderkey", "l_linenumber"], time_series=False)
    return _run_rows(spark, r)


@register("m12_failed_candidate_and_predictions", """
SELECT 'no_such_model' AS failed, CAST(1 AS BIGINT) AS n_scored_models, CAST(ceil(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS n_predictions,
  true AS all_numbers, true AS measured FROM lineitem
""")
def m12_failed_candidate_and_predictions(spark, sf_dir):
    """An unknown candidate is logged and doesn't stop the run (M12); the other one's held-out rows are scored
    (S11: one stored prediction per row) and measured (E13)."""
    from ..plans import jobs
    r = jobs.run_full(spark, table(spark, sf_dir, "lineitem"), target="l_extendedprice", key_cols=["l_orderkey", "l_linenumber"],
                      models=["linear_regression", "no_such_model"], time_series=False)
    held = jobs.score_holdout(spark, r, "linear_regression")["metrics"]
    failed = [x["model_name"] for x in spark.read.parquet(f"{r.store_root}/model_runs").select("model_name").collect()]
    p = spark.read.parquet(f"{r.store_root}/predictions")
    return p.agg(F.lit(",".join(failed)).alias("failed"), F.lit(len(r.metrics)).cast("long").alias("n_scored_models"), F.count("*").alias("n_predictions"),
                 F.bool_and(F.col("predicted_value").try_cast("double").isNotNull()).alias("all_numbers"),
                 F.lit(held["rmse"] > 0 and held["mae"] > 0 and held["r2_score"] <= 1).alias("measured"))


@register("j1_anomaly_run", _run_sql(["isolation_forest"], "events", split=False))
def j1_anomaly_run(spark, sf_dir):
    """J1 without a label (X5: every part is the whole table): isolation forest on events."""
    from ..plans import jobs
    r = jobs.run_full(spark, table(spark, sf_dir, "events"), task="anomaly_detection", key_cols=["event_id"])
    return _run_rows(spark, r, metric="anomaly_ratio")


@register("j1_clustering_run", _run_sql(["kmeans", "dbscan"], "events", split=False))
def j1_clustering_run(spark, sf_dir):
    """J1 without a label: k-means and DBSCAN on value and user of all events."""
    from ..plans import jobs
    ev = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    r = jobs.run_full(spark, ev, task="clustering", key_cols=["event_id"])
    return _run_rows(spark, r)


_ATTEMPTS = [(1, "hyperparameter_tuning", "logistic_regression"),
             *[(2, "alternative_model", m) for m in mo.CLASSIFIERS if m != "logistic_regression"],
             (3, "data_improvement", None)]


@register("j2_j3_holdout_and_improve", f"""
WITH c AS (SELECT l.quality AS q, count(*) AS n FROM {_DOCS} GROUP BY 1)
SELECT v.step, v.model_name, true AS valid, CAST((SELECT sum(ceil(n * CAST(0.15 AS DOUBLE))) FROM c) AS BIGINT) AS n_eval
FROM (VALUES ('0 holdout', 'best'), {", ".join(f"('{a} {s}', '{m or 'best'}')" for a, s, m in _ATTEMPTS)}) v(step, model_name)
""")
def j2_j3_holdout_and_improve(spark, sf_dir):
    """J1 on documents joined to labels with two candidates, J2 held-out scoring, J3 with a gate that no
    model reaches, so that every attempt runs (all five models of the family are fitted)."""
    from ..plans import jobs
    d = _doc_frame(spark, sf_dir).drop("text", "toxic")
    r = jobs.run_full(spark, d, target="quality", key_cols=["doc_id"], models=["logistic_regression", "random_forest"])
    hold = jobs.score_holdout(spark, r, r.best_model)
    imp = jobs.improve(spark, r, model_name="logistic_regression", threshold=1.01)
    shown = r.best_model in r.model_paths and 0 <= hold["metrics"]["f1_score"] <= 1
    rows = [("0 holdout", "best", shown)]
    best = round(imp["baseline_score"], 4)
    for a in imp["attempts"]:
        score = a["validation_score"]
        # scores are shown with four places: a win never looks lower, a higher score is always a win
        ok = score is not None and 0 <= score <= 1 and (score >= best if a["improved"] else score <= best)
        best = max(best, score or best)
        named = "best" if a["strategy"] == "data_improvement" else a["model_name"]
        rows.append((f"{a['attempt']} {a['strategy']}", named, ok and "error" not in a["parameters"]))
    return spark.createDataFrame(rows, "step string, model_name string, valid boolean").withColumn(
        "n_eval", F.lit(hold["eval_size"]).cast("long"))


@register("i1_batch_scoring", f"SELECT l.doc_id, true AS valid FROM {_DOCS}")
def i1_batch_scoring(spark, sf_dir):
    """I1 + S13: a batch read from CSV, scored, written as CSV and read again: label and confidence."""
    train, _, fit, li = _classification_tables(spark, sf_dir)
    m = mo.get_model("logistic_regression", n_rows=train.count()).fit(train)
    path, out_path = scratch_path(spark, "batch-csv"), scratch_path(spark, "batch-out")
    _doc_frame(spark, sf_dir).select("doc_id", "lang", "source", "n_chars").write.option("header", True).csv(path)
    io.score_csv(spark, path, out_path, lambda b: sc.score_batch(b, fit, m, labels=li.labels, keep=["doc_id"]))
    back = io.load(spark, out_path, "csv")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), (
        F.col("predicted_value").cast("string").isin(list(li.labels)) & F.col("confidence").between(0.5, 1)).alias("valid"))


@register("s14_model_reload_same_predictions", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_diff FROM {_DOCS}")
def s14_model_reload_same_predictions(spark, sf_dir):
    """Predictions after save + load equal those of the fitted model (differences counted)."""
    train, rows, _, _ = _classification_tables(spark, sf_dir)
    m = mo.get_model("random_forest").fit(train)
    path = scratch_path(spark, "model-rf")
    io.save_model(m, path)
    m2 = sc.load_model(path, spark)
    a = m.transform(rows).select("doc_id", F.col("prediction").alias("p1"))
    b = m2.transform(rows).select("doc_id", F.col("prediction").alias("p2"))
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1") != F.col("p2")).alias("n_diff"))


@register("st1_file_stream_totals", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type
""")
def st1_file_stream_totals(spark, sf_dir):
    """ST1: events split into files, read back as a stream one file per trigger."""
    ev = table(spark, sf_dir, "events")
    src = scratch_path(spark, "events-stream-src")
    ev.repartition(8, "event_id").write.parquet(src)
    s = st.file_stream(spark, src, ev.schema)
    agg = s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = st.run_to_table(agg, scratch_path(spark, "st1-out"), mode="complete")
    return spark.read.parquet(out)


@register("st2_stream_scoring", f"SELECT l.doc_id, true AS as_batch FROM {_DOCS}")
def st2_stream_scoring(spark, sf_dir):
    """ST2: a saved model scores each micro-batch of a document stream as it scores the batch."""
    train, _, fit, li = _classification_tables(spark, sf_dir)
    m = mo.get_model("logistic_regression", n_rows=train.count()).fit(train)
    src = scratch_path(spark, "docs-stream-src")
    _doc_frame(spark, sf_dir).select("doc_id", "lang", "source", "n_chars").repartition(4).write.parquet(src)
    rows = spark.read.parquet(src)
    s = st.file_stream(spark, src, rows.schema)
    out = spark.read.parquet(st.run_to_table(st.score_stream(s, fit.model, m, ["doc_id"], li.labels),
                                             scratch_path(spark, "st2-out")))
    batch = sc.score_batch(rows, fit, m, li.labels, ["doc_id"])
    same = F.col("predicted_value").eqNullSafe(F.col("v")) & F.col("confidence").eqNullSafe(F.col("c"))
    return out.join(batch.select("doc_id", F.col("predicted_value").alias("v"), F.col("confidence").alias("c")), "doc_id") \
        .select("doc_id", same.alias("as_batch"))


@register("st3_running_metrics", """
SELECT lang, CAST(count(*) AS BIGINT) AS n, count_if(y = p) / count(*) AS accuracy,
  coalesce(count_if(y = 1 AND p = 1) / nullif(count_if(p = 1), 0), 0.0) AS precision,
  coalesce(count_if(y = 1 AND p = 1) / nullif(count_if(y = 1), 0), 0.0) AS recall,
  coalesce(2.0 * count_if(y = 1 AND p = 1) / nullif(count_if(y = 1) + count_if(p = 1), 0), 0.0) AS f1_score,
  sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae
FROM (SELECT d.lang, l.quality AS y, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS p
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
GROUP BY lang
""")
def st3_running_metrics(spark, sf_dir):
    """ST3: running metrics over a stream of labelled rule predictions; final state = batch."""
    from .metrics import binary_predictions
    b = binary_predictions(spark, sf_dir).select("lang", "y", "p")
    src = scratch_path(spark, "pred-stream-src")
    b.repartition(6).write.parquet(src)
    s = st.file_stream(spark, src, spark.read.parquet(src).schema)
    out = st.run_to_table(st.running_metrics(s, "y", "p", run_col="lang"), scratch_path(spark, "st3-out"),
                          mode="complete")
    return spark.read.parquet(out)


_DB_EPS, _DB_MIN = 0.04, 5


@register("m10_dbscan_2d", f"""
WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
                     FROM embeddings),
nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b
       ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_DB_EPS} * {_DB_EPS}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {_DB_MIN}),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
r(id, lab) AS (SELECT id, id FROM core UNION SELECT ce.b, r.lab FROM r JOIN ce ON ce.a = r.id),
comp AS (SELECT id, min(lab) AS lab FROM r GROUP BY id),
border AS (SELECT nb.a AS id, min(comp.lab) AS lab FROM nb JOIN comp ON nb.b = comp.id
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT lab, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT lab FROM lab))
SELECT p.id AS vec_id, CAST(coalesce(num.cluster, -1) AS INTEGER) AS prediction
FROM p LEFT JOIN lab ON p.id = lab.id LEFT JOIN num ON lab.lab = num.lab
""")
def m10_dbscan_2d(spark, sf_dir):
    """DBSCAN on the first two embedding coordinates (the whole table), eps 0.04, 5 samples."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("xy"))
    from ..operators.dbscan import DBSCAN
    m = DBSCAN(features="xy", eps=_DB_EPS, min_samples=_DB_MIN, id_col="vec_id").fit(e)
    return m.fit_labels()


_DB64_EPS, _DB64_MIN = 1.17, 4


@register("m10_dbscan_64d", f"""
WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON list_distance(a.x, b.x) <= CAST({_DB64_EPS} AS DOUBLE)),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {_DB64_MIN}),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
r(id, lab) AS (SELECT id, id FROM core UNION SELECT ce.b, r.lab FROM r JOIN ce ON ce.a = r.id),
comp AS (SELECT id, min(lab) AS lab FROM r GROUP BY id),
border AS (SELECT nb.a AS id, min(comp.lab) AS lab FROM nb JOIN comp ON nb.b = comp.id
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT lab, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT lab FROM lab))
SELECT p.id AS vec_id, CAST(coalesce(num.cluster, -1) AS INTEGER) AS prediction
FROM p LEFT JOIN lab ON p.id = lab.id LEFT JOIN num ON lab.lab = num.lab
""")
def m10_dbscan_64d(spark, sf_dir):
    """DBSCAN on all 64 coordinates of every embedding, eps 1.17, 4 samples (balls of a metric tree)."""
    from ..operators.dbscan import DBSCAN
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return DBSCAN(features="embedding", eps=_DB64_EPS, min_samples=_DB64_MIN, id_col="vec_id").fit(e).fit_labels()


@register("h5_nearest_in_class", """
WITH p AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL),
d AS (SELECT a.id AS vec_id, b.id AS near_id, list_distance(a.x, b.x) AS distance,
      row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS place
      FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id)
SELECT vec_id, CAST(place AS INTEGER) AS place, near_id, distance FROM d WHERE place <= 5
""")
def h5_nearest_in_class(spark, sf_dir):
    """The exact five nearest vectors of the same label for every embedding: the neighbours that H5 takes."""
    from ..operators import pivot_tree as pt
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    points = e.select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("x"), F.lit(1).alias("w"),
                      F.hex(F.encode(F.col("label").cast("string"), "utf-8")).alias("root"))
    near = pt.nearest(pt.build(points, root=F.concat(F.lit("c"), F.col("root"))), 5)
    near = near.select(F.col("pid").alias("vec_id"), F.posexplode("near").alias("i", "n"))
    return near.select("vec_id", (F.col("i") + 1).cast("int").alias("place"), F.col("n.pid").alias("near_id"),
                       F.sqrt("n.d").alias("distance"))


@register("j1_clustering_64d", _run_sql(["kmeans", "dbscan"], "embeddings", split=False))
def j1_clustering_64d(spark, sf_dir):
    """J1 without a label on the 64 coordinates of every embedding as columns: both candidates are scored."""
    from ..plans import jobs
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(64)])
    return _run_rows(spark, jobs.run_full(spark, e, task="clustering", key_cols=["vec_id"]))
