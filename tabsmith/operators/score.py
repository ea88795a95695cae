"""Scoring and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .improve import THRESHOLDS

UNSUPERVISED = ("clustering", "anomaly_detection")


def passes(score: Column, task: str, threshold: float | None = None) -> Column:
    """I4: pass/fail by task threshold; unsupervised tasks always pass."""
    if task in UNSUPERVISED:
        return F.lit(True)
    _, goal, t0 = THRESHOLDS.get(task, THRESHOLDS["classification"])
    thr = t0 if threshold is None else threshold
    ok = score >= F.lit(thr) if goal == "maximize" else score <= F.lit(thr)
    return F.coalesce(ok, F.lit(False))


def predicted_vs_actual(df: DataFrame, y: str, p: str, key: str, n: int = 20) -> DataFrame:
    """Actual, predicted, string-equality match flag; first ``n`` rows by key (a report)."""
    return (df.select(key, F.col(y).alias("actual"), F.col(p).alias("predicted"),
                      (F.col(y).cast("string") == F.col(p).cast("string")).alias("is_match"))
            .orderBy(key).limit(n))


def history(runs: DataFrame, n: int = 50, order_col: str = "id") -> DataFrame:
    """The last ``n`` experiment rows, newest first (a top-n report)."""
    return runs.orderBy(F.col(order_col).desc()).limit(n)


# ---------------------------------------------------------------- S14 load / I1 batch scoring
def load_model(path: str, spark=None):
    """Load a saved Spark ML model by the class recorded in its metadata, or one of our own
    by the table that it writes (looked up where the path lies, not on the driver's disk)."""
    import importlib

    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    from ..sources.io import path_exists
    spark = spark or SparkSession.getActiveSession()
    if path_exists(spark, f"{path}/nodes"):
        from .unsupervised import IsolationForestModel
        return IsolationForestModel.load(path, spark)
    if path_exists(spark, f"{path}/core"):
        from .dbscan import DBSCANModel
        return DBSCANModel.load(path, spark)
    if path_exists(spark, f"{path}/trees"):
        from .boosting import BoostedTreesModel
        return BoostedTreesModel.load(path, spark)
    meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
    jcls = meta["class"]
    if jcls.startswith("pyspark."):
        mod, cls = jcls.rsplit(".", 1)
        return getattr(importlib.import_module(mod), cls).load(path)
    mod, cls = jcls.rsplit(".", 1)
    pymod = importlib.import_module(mod.replace("org.apache.spark.ml", "pyspark.ml"))
    return getattr(pymod, cls).load(path)


def score_batch(df: DataFrame, features_model, model, labels: list[str] | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Features -> model -> predicted value (original label when indexed) and
    Confidence = max class probability, 4 places (NULL without probabilities)."""
    out = model.transform(features_model.transform(df))
    pred = F.col("prediction")
    if labels:
        arr = F.array(*[F.lit(v) for v in labels])
        pred = F.get(arr, F.col("prediction").cast("int"))
    conf = F.lit(None).cast("double")
    if "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array
        conf = F.round(F.array_max(vector_to_array("probability")), 4)
    return out.select(*(keep or []), pred.cast("string").alias("predicted_value"),
                      conf.alias("confidence"))


# ---------------------------------------------------------------- I5 rows typed as text
def parse_rows(df: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """Comma-separated values -> one column per name; a value that reads as a
    number becomes a double, otherwise the trimmed text stays (``<name>_text``)."""
    parts = F.split(F.col(text_col), ",")
    cols = []
    for i, n in enumerate(names):
        raw = F.trim(F.get(parts, i))  # a short row has NULL there
        cols.append(raw.try_cast("double").alias(n))
        cols.append(F.when(raw.try_cast("double").isNull(), raw).alias(f"{n}_text"))
    return df.select("*", *cols)


# ---------------------------------------------------------------- I7 stored model replies
REPLY_SCHEMA = ("task string, target string, drop_columns array<string>, primary_metric string, "
                "optimization_goal string, reasoning string")


def closed_object(text: Column) -> Column:
    """(json, whole): the first JSON object in ``text``, closed after its last finished field if it is cut off.

    One walk over the characters that matter and the runs between them keeps the depth of brackets, whether a string is open, and whether a key or a
    value of the outer object is being read.  A field is finished when its string or bracket closes, or a
    comma ends its number or word.  What stands before the object (prose, fences) and behind it isn't read;
    NULL without an object."""
    def step(s, c):
        quoted, depth = s["quoted"], s["depth"]
        quote = (c == '"') & ~s["escaped"]
        opens, closes = ~quoted & c.isin("{", "["), ~quoted & (depth > 0) & c.isin("}", "]")
        now = depth + F.when(opens & ((depth > 0) | (c == "{")), 1).when(closes, -1).otherwise(0)
        outer = (depth == 1) & ~quoted
        ended = s["value"] & (((depth == 1) & quoted & quote) | (closes & (now == 1)))
        walked = F.struct(
            (s["at"] + F.length(c)).alias("at"), now.alias("depth"), F.when(depth > 0, quoted != quote).otherwise(False).alias("quoted"),
            (quoted & (c == "\\") & ~s["escaped"]).alias("escaped"),
            F.when(outer & (c == ":"), True).when(outer & (c == ","), False).otherwise(s["value"]).alias("value"),
            F.when((depth == 0) & (now == 1), s["at"] + 1).otherwise(s["start"]).alias("start"),
            F.when(ended, s["at"] + 1).when(outer & s["value"] & (c == ","), s["at"]).otherwise(s["keep"]).alias("keep"),
            F.when((depth == 1) & (now == 0), s["at"] + 1).otherwise(s["end"]).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(walked)

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"),
                    F.lit(False).alias("value"), F.lit(0).alias("start"), F.lit(0).alias("keep"), F.lit(0).alias("end"))
    s = F.aggregate(F.regexp_extract_all(text, F.lit(r'[{}\[\]",:\\]|[^{}\[\]",:\\]+'), F.lit(0)), zero, step)
    cut = F.when(s["keep"] > 0, F.concat(F.substr(text, s["start"], s["keep"] - s["start"] + 1), F.lit("}"))).otherwise(F.lit("{}"))
    return F.when(s["start"] > 0, F.struct(F.when(s["end"] > 0, F.substr(text, s["start"], s["end"] - s["start"] + 1)).otherwise(cut).alias("json"),
                                           (s["end"] > 0).alias("whole")))


def read_replies(df: DataFrame, text_col: str) -> DataFrame:
    """The fields of stored model replies, also of cut-off ones: ``reply_state`` parsed (a whole object), repaired
    (cut off, but its task is there) or failed, then the finished fields; a reply without a task yields NULLs."""
    found = df.withColumn("_object", closed_object(F.col(text_col))).withColumn("_reply", F.from_json("_object.json", REPLY_SCHEMA))
    state = F.when(F.col("_reply.task").isNull(), "failed").when(F.col("_object.whole"), "parsed").otherwise("repaired")
    return (found.withColumns({"reply_state": state, "_reply": F.when(F.col("_reply.task").isNotNull(), F.col("_reply"))})
            .select(*[F.col(f"`{c}`") for c in df.columns], "reply_state", "_reply.*"))
