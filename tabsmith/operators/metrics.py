"""Evaluation metrics as aggregates over a predictions table.

Every metric is one (or a few) distributed aggregates; nothing is collected
except the final one-row result.  ROC AUC is exact with ties: group by
distinct score, take the running count of negatives below each score with a
range-partitioned prefix sum (no single-task window), then
AUC = sum(pos * (neg_below + neg_tied / 2)) / (P * N).
"""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import with_prefix_sums


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- E1-E4
def binary_counts(df: DataFrame, y, p, positive=1) -> DataFrame:
    yy, pp = _c(y), _c(p)
    pos_t, pos_p = yy == F.lit(positive), pp == F.lit(positive)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(yy == pp).alias("correct"),
        F.count_if(pos_t & pos_p).alias("tp"),
        F.count_if(~pos_t & pos_p).alias("fp"),
        F.count_if(pos_t & ~pos_p).alias("fn"),
    )


def binary_metrics(df: DataFrame, y, p, positive=1) -> DataFrame:
    """Accuracy and binary precision/recall/F1 (0 on zero division)."""
    c = binary_counts(df, y, p, positive)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        F.try_divide(F.col("correct"), F.col("n")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
    )


# ---------------------------------------------------------------- E5
def macro_metrics(df: DataFrame, y, p) -> DataFrame:
    """E5: accuracy + macro precision/recall/F1 over classes seen in either column.

    Only the confusion table (classes x classes, small) is aggregated further.
    """
    conf = df.groupBy(_c(y).cast("string").alias("_y"), _c(p).cast("string").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"))
    acc = conf.agg(F.try_divide(F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)),
                                F.sum("_n")).alias("accuracy"))
    as_true = conf.select(F.col("_y").alias("cls"), F.when(F.col("_y") == F.col("_p"), F.col("_n"))
                          .otherwise(0).alias("tp"), F.lit(0).alias("fp"),
                          F.when(F.col("_y") != F.col("_p"), F.col("_n")).otherwise(0).alias("fn"))
    as_pred = conf.select(F.col("_p").alias("cls"), F.lit(0).alias("tp"),
                          F.when(F.col("_y") != F.col("_p"), F.col("_n")).otherwise(0).alias("fp"),
                          F.lit(0).alias("fn"))
    per = as_true.unionByName(as_pred).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = per.select(
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("pr"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("rc"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
    macro = per.agg(F.avg("pr").alias("precision"), F.avg("rc").alias("recall"),
                    F.avg("f1").alias("f1_score"))
    return _one_row_join(acc, macro)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row aggregates side by side (equi-join on a constant key)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def classification_metrics(df: DataFrame, y, p, positive=None, n_classes: int | None = None) -> DataFrame:
    """Binary rule when y has at most 2 classes, macro otherwise (reference's choice); with the number of
    the model's classes also macro when y holds a class beyond them, which the binary rule may not count."""
    if n_classes is not None and not df.where(_c(y) >= n_classes).isEmpty():
        return macro_metrics(df, y, p)
    n_cls = df.select(_c(y)).where(_c(y).isNotNull()).distinct().limit(3).count()
    if n_cls > 2:
        return macro_metrics(df, y, p)
    if positive is None:
        mx = df.agg(F.max(_c(y))).first()[0]
        positive = mx if mx is not None else 1
    return binary_metrics(df, y, p, positive)


# ---------------------------------------------------------------- E6
def roc_auc(df: DataFrame, y, score, positive=1) -> DataFrame:
    """Exact binary ROC AUC with ties; NULL if only one class is present."""
    g = df.groupBy(_c(score).cast("double").alias("_s")).agg(
        F.count_if(_c(y) == F.lit(positive)).alias("_pos"),
        F.count_if(_c(y) != F.lit(positive)).alias("_neg"))
    run = with_prefix_sums(g, [F.col("_s")], {"_neg_below": F.col("_neg")}, inclusive=False)
    return run.agg(F.try_divide(
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0)),
        (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, y, probs, classes: list | None = None) -> DataFrame:
    """One-vs-rest macro AUC.  ``probs`` is an array/vector column whose i-th
    entry belongs to the i-th class in sorted order (or ``classes``)."""
    arr = _c(probs)
    if isinstance(df.select(arr).schema.fields[0].dataType, T.ArrayType) is False:
        arr = vector_to_array(arr)
    if classes is None:
        classes = sorted(r[0] for r in df.select(_c(y)).where(_c(y).isNotNull()).distinct().collect())
    cls_arr = F.array(*[F.lit(c) for c in classes])
    ex = df.select(_c(y).alias("_y"), F.posexplode(arr).alias("_i", "_s"))
    ex = ex.withColumn("_cls", F.element_at(cls_arr, F.col("_i") + 1))
    g = ex.groupBy("_i", F.col("_s").cast("double").alias("_s")).agg(
        F.count_if(F.col("_y") == F.col("_cls")).alias("_pos"),
        F.count_if(F.col("_y") != F.col("_cls")).alias("_neg"))
    run = with_prefix_sums(g, [F.col("_i"), F.col("_s")], {"_cum": F.col("_neg")}, inclusive=False)
    # class-local running count = global running count - count at the class start
    start = run.groupBy("_i").agg(F.min("_cum").alias("_c0"))
    run = run.join(start, "_i").withColumn("_neg_below", F.col("_cum") - F.col("_c0"))
    per = run.groupBy("_i").agg(F.try_divide(
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0)),
        (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("_auc"))
    return per.agg(F.avg("_auc").alias("roc_auc"))


# ---------------------------------------------------------------- E8-E10
def regression_metrics(df: DataFrame, y, p, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R^2 (zero variance: 1 if perfect else 0) in one pass.

    ``by``: grouping keys (one metrics row per group, e.g. per run and model).
    """
    yy, pp = _c(y).cast("double"), _c(p).cast("double")
    by = list(by or [])
    a = (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("n"),
               F.sum((yy - pp) * (yy - pp)).alias("sse"),
               F.avg(F.abs(yy - pp)).alias("mae"),
               F.var_pop(yy).alias("vp"))
    sst = F.col("vp") * F.col("n")
    r2 = (F.when(sst != 0, 1 - F.try_divide(F.col("sse"), sst))
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select(*by, F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"), F.col("mae"),
                    r2.alias("r2_score"))


# ---------------------------------------------------------------- E11
def silhouette_sq_euclidean(df: DataFrame, features, cluster) -> DataFrame:
    """Exact silhouette with squared Euclidean distance (Spark's evaluator: per-cluster sums,
    no pairs of points).  One row; NULL with fewer than two clusters or no rows."""
    spark = df.sparkSession
    vec = _c(features)
    if isinstance(df.select(vec).schema.fields[0].dataType, T.ArrayType):
        vec = array_to_vector(vec.cast("array<double>"))
    pts = df.select(vec.alias("features"), _c(cluster).cast("double").alias("prediction")).na.drop()
    value = None
    if pts.select("prediction").distinct().limit(2).count() > 1:
        value = float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(pts))
    return spark.createDataFrame([(value,)], "silhouette_score double")


# ---------------------------------------------------------------- E12
def anomaly_ratio(df: DataFrame, p) -> DataFrame:
    """Share of -1 predictions; 0 for no rows."""
    return df.agg(F.coalesce(F.avg((_c(p) == -1).cast("double")), F.lit(0.0)).alias("anomaly_ratio"))
