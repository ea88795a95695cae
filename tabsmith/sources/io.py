"""Scans and sinks.

Reads are plain Spark readers (column pruning / filter pushdown come from the
format); writes are single distributed jobs (``partitionBy`` instead of one
file per part).  Paths for run outputs default to the shared checkpoint
folder the cluster names (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import nan_to_null, order_hash

# Text tokens read as missing in CSV input (pandas' default NA set, common part).
NA_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "#N/A", "n/a", "-NaN", "-nan",
             "<NA>", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A"]

SOURCE_TYPES = ("csv", "json", "sql", "parquet")


def load(spark: SparkSession, source, source_type: str = "csv", schema=None,
         multiline_json: bool | None = None) -> DataFrame:
    """CSV with header and inferred types, JSON, SQL query (``(url, query)``
    or ``(url, query, column, low, high, tasks)`` for JDBC, or a query text over registered
    views), parquet.  NaN -> NULL."""
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"Unsupported source type: {source_type}")  # S4
    if source_type == "csv":
        r = spark.read.option("header", True).option("mode", "PERMISSIVE")
        df = (r.schema(schema) if schema is not None else r).csv(source)
        blank = {f.name: F.when(F.trim(F.col(f"`{f.name}`")).isin(NA_TOKENS), None).otherwise(F.col(f"`{f.name}`"))
                 for f in df.schema.fields if f.dataType.simpleString() == "string"}
        df = df.withColumns(blank) if blank else df
        df = _infer_text(df, list(blank)) if blank and schema is None else df
    elif source_type == "json":
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        if multiline_json is None:
            multiline_json = _looks_like_array(spark, source)
        df = r.option("multiLine", bool(multiline_json)).json(source)
    elif source_type == "sql":
        if isinstance(source, (tuple, list)):
            url, query, *bounds = source
            r = spark.read.format("jdbc").option("url", url)
            if bounds:  # read in ranges of a numeric column, one task each
                column, low, high, parts = bounds
                r = (r.option("dbtable", f"({query}) q").option("partitionColumn", column)
                     .option("lowerBound", low).option("upperBound", high).option("numPartitions", parts))
            else:
                r = r.option("query", query)
            df = r.load()
        else:
            df = spark.sql(source)
    else:
        df = spark.read.parquet(source)
    return nan_to_null(df)


# Types that a text column may be read as, narrowest first, with the form that all its values must have.  Flags
# like Y/N, clock times without a date and the like stay text, so a file reads the same on every day.
READ_AS = [("int", r"[+-]?[0-9]{1,10}"), ("bigint", r"[+-]?[0-9]{1,19}"),
           ("double", r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity)"), ("boolean", "true|True|TRUE|false|False|FALSE"),
           ("date", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"),
           ("timestamp", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]+)?)?(Z|[+-][0-9]{1,2}:[0-9]{2})?")]


def _infer_text(df: DataFrame, names: list[str]) -> DataFrame:
    """Each text column as the narrowest type of READ_AS that every value reads as, from one aggregate over
    all rows; text stays text when there is none or no value."""
    def read(name, kind, form):
        value = F.trim(F.col(f"`{name}`"))
        return F.when(value.rlike(f"^(?:{form})$"), value.try_cast(kind))

    row = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)],
                 *[F.count(read(n, *k)).alias(f"{k[0]}{i}") for i, n in enumerate(names) for k in READ_AS]).first()
    cast = {}
    for i, n in enumerate(names):
        kind = next((k for k in READ_AS if row[f"n{i}"] and row[f"{k[0]}{i}"] == row[f"n{i}"]), None)
        if kind:
            cast[n] = read(n, *kind)
    return df.withColumns(cast) if cast else df


def _looks_like_array(spark: SparkSession, path: str) -> bool:
    """A JSON file that starts with '[' is one array document (records orientation)."""
    try:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        return bool(first) and first[0]["value"].lstrip().startswith("[")
    except Exception:  # noqa: BLE001
        return False


def sample_rows(df: DataFrame, n: int, key_cols: list[str] | None = None, seed: int = 42,
                exact: bool = True) -> DataFrame:
    """Exactly ``n`` rows in repeatable md5(seed, key) order when over the cap
    (a top-n by key: per-partition top-n then one merge), else a Bernoulli sample."""
    keys = key_cols or df.columns
    if exact:
        h = order_hash(*keys, seed=seed)
        return df.withColumn("_s", h).orderBy("_s", *keys).limit(n).drop("_s")
    total = df.count()
    return df if total <= n else df.sample(False, min(1.0, n / total), seed)


def preview(df: DataFrame, key_cols: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by key as JSON records."""
    return df.orderBy(*key_cols).limit(n).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                                                 .alias("record"))


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One write of all parts, partitioned by ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_run_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """Run metadata document as one JSON row."""
    spark.createDataFrame([(json.dumps(meta, default=str),)], "doc string").coalesce(1) \
        .write.mode("overwrite").text(path)


def read_run_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def export_per_model(metrics: DataFrame, importances: DataFrame, path: str,
                     shared: dict[str, DataFrame] | None = None) -> None:
    """Metrics and importances per model as CSV, one job per table (``partitionBy(model_name)``
    writes one folder per model), and the run's shared tables (arrays and maps as JSON text)."""
    metrics.write.mode("overwrite").option("header", True).partitionBy("model_name").csv(f"{path}/metrics")
    names = metrics.select(F.col("id").alias("metric_id"), "model_name")
    importances.join(names, "metric_id").write.mode("overwrite").option("header", True) \
        .partitionBy("model_name").csv(f"{path}/importances")
    for name, df in (shared or {}).items():
        flat = [F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`")
                for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_model(model, path: str, spark: SparkSession | None = None) -> None:
    """Spark ML models via their writer; own models via ``save(path, spark)``."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path, spark)


def score_csv(spark: SparkSession, source: str, target: str, score) -> None:
    """Read a batch as CSV, apply ``score`` (DataFrame -> DataFrame), write the result as CSV."""
    score(load(spark, source, "csv")).write.mode("overwrite").option("header", True).csv(target)
