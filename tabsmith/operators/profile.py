"""Dataset profiling (A1-A15): counts, missing ratios, distinct counts, roles,
class balance, task detection, time-series detection and leakage signs.

Every statistic is an aggregate over the whole table.  Per-column statistics
are computed in one pass (``count``, ``avg(length)``, HyperLogLog
``approx_count_distinct``) and unpivoted into a tidy frame with one row per
column — the only thing the driver ever holds is that frame (bounded by the
column count).  Exact distinct counts are computed per column as separate
single-column aggregates (each scan reads one column), and in ``"auto"`` mode
only for columns whose approximate count lies near a rule threshold.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import is_categorical, is_numeric, is_time, parse_timestamp, py_round

# Rule thresholds and name keywords.
TEXT_MIN_DISTINCT = 50          # string with more distinct values ...
TEXT_MIN_AVG_LEN = 20           # ... and longer mean length is text
CLASSIFICATION_MAX_DISTINCT = 20
TS_TARGET_MIN_DISTINCT = 10
GROUP_MAX_DISTINCT = 500
DATE_PARSE_MIN_SHARE = 0.8
TIME_NAME_KEYWORDS = ["date", "timestamp", "time", "datetime", "period", "day"]
GROUP_NAME_KEYWORDS = ["id", "store", "product", "region", "category", "entity", "group",
                       "location", "site"]
THRESHOLDS = [TS_TARGET_MIN_DISTINCT, CLASSIFICATION_MAX_DISTINCT, TEXT_MIN_DISTINCT,
              GROUP_MAX_DISTINCT]


# ---------------------------------------------------------------- column classes
def column_classes(df: DataFrame) -> dict[str, list[str]]:
    """numerical / categorical (string, bool) / datetime columns, in column order."""
    out = {"numerical": [], "categorical": [], "datetime": []}
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            out["numerical"].append(f.name)
        elif is_categorical(f.dataType):
            out["categorical"].append(f.name)
        elif is_time(f.dataType):
            out["datetime"].append(f.name)
    return out


def _missing(df: DataFrame, c: str):
    """NULL, and NaN for floating columns (pandas counts both as missing)."""
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


# ---------------------------------------------------------------- A1
def shape(df: DataFrame) -> DataFrame:
    """A1: one row (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("int"))


# ---------------------------------------------------------------- A2
def missing_ratios(df: DataFrame, keep_zero: bool = False) -> DataFrame:
    """A2: (column_name, missing_ratio) — nulls / rows, kept where > 0, then rounded to 4."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, missing_ratio double")
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count_if(_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("n_null"))
                        for i, c in enumerate(df.columns)])
    tidy = one.select("_rows", F.explode(entries).alias("e")).select(
        "e.column_name", F.try_divide(F.col("e.n_null"), F.col("_rows")).alias("ratio"))
    if not keep_zero:
        tidy = tidy.where(F.col("ratio") > 0)  # filter before rounding, as the rule says
    return tidy.select("column_name", F.round("ratio", 4).alias("missing_ratio"))


# ---------------------------------------------------------------- A3
def exact_distinct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3 exact: (column_name, n_distinct), nulls excluded; one single-column aggregate per column."""
    cols = list(cols if cols is not None else df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct bigint")
    parts = [df.select(F.lit(c).alias("column_name"),
                       F.count_distinct(F.col(c)).cast("long").alias("n_distinct")) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def _near_threshold(v: int) -> bool:
    return any(abs(v - t) <= 0.15 * t + 2 for t in THRESHOLDS)


def column_stats(df: DataFrame, exact: bool | str = "auto") -> list[dict]:
    """One pass: rows, nulls, approx distinct and mean string length per column.

    Returns a list of dicts (one per column — bounded by the column count).
    ``exact``: True = exact distinct for all columns, "auto" = exact only near
    a rule threshold, False = HyperLogLog only.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(~_missing(df, f.name)).alias(f"_nn{i}"))
        if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            aggs.append(F.approx_count_distinct(F.col(f.name), 0.02).alias(f"_ad{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.avg(F.length(F.col(f.name))).alias(f"_len{i}"))
    row = df.agg(*aggs).first().asDict()
    n = int(row["_rows"])
    stats = []
    for i, f in enumerate(fields):
        stats.append({
            "column_name": f.name, "data_type": f.dataType.simpleString(), "dtype": f.dataType,
            "rows": n, "n_null": n - int(row[f"_nn{i}"]),
            "n_distinct": row.get(f"_ad{i}"), "avg_len": row.get(f"_len{i}"), "exact": False,
        })
    want = [s["column_name"] for s in stats if s["n_distinct"] is not None and (
        exact is True or (exact == "auto" and _near_threshold(int(s["n_distinct"]))))]
    if want:
        ex = {r["column_name"]: int(r["n_distinct"]) for r in exact_distinct(df, want).collect()}
        for s in stats:
            if s["column_name"] in ex:
                s["n_distinct"], s["exact"] = ex[s["column_name"]], True
    return stats


# ---------------------------------------------------------------- A5
def role_of(dtype: T.DataType, n_distinct: int | None, avg_len: float | None) -> str | None:
    if is_numeric(dtype):
        return "numerical"
    if isinstance(dtype, T.StringType):
        if (n_distinct or 0) > TEXT_MIN_DISTINCT and (avg_len or 0) > TEXT_MIN_AVG_LEN:
            return "text"
        return "categorical"
    if isinstance(dtype, T.BooleanType):
        return "categorical"
    if is_time(dtype):
        return "datetime"
    return None


def column_profile(df: DataFrame, target: str | None = None, exact: bool | str = "auto") -> DataFrame:
    """Tidy profile, one row per column (A1-A5), target flagged."""
    stats = column_stats(df, exact)
    rows = [(s["column_name"], s["data_type"], s["rows"], s["n_null"],
             (s["n_null"] / s["rows"]) if s["rows"] else 0.0,
             int(s["n_distinct"]) if s["n_distinct"] is not None else None,
             float(s["avg_len"]) if s["avg_len"] is not None else None,
             role_of(s["dtype"], s["n_distinct"], s["avg_len"]), s["column_name"] == target)
            for s in stats]
    schema = ("column_name string, data_type string, rows bigint, n_null bigint, missing_ratio double, "
              "n_distinct bigint, avg_len double, role string, is_target boolean")
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------- A6 / A7
def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n) with nulls excluded."""
    return (df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class"))
            .agg(F.count(F.lit(1)).alias("n")))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row (n_classes, majority, minority, imbalance_ratio '1:X' or NULL)."""
    dist = class_distribution(df, target)
    agg = dist.agg(F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("majority"),
                   F.min("n").alias("minority"))
    ratio = F.concat(F.lit("1:"), py_round(F.col("majority") / F.col("minority"), 0).cast("long").cast("string"))
    return agg.withColumn("imbalance_ratio", F.when(F.col("n_classes") > 1, ratio))


# ---------------------------------------------------------------- A8
def detect_task(dtype: T.DataType | None, n_distinct: int | None, has_target: bool) -> str:
    if not has_target:
        return "unknown"
    if is_categorical(dtype) or (n_distinct is not None and n_distinct < CLASSIFICATION_MAX_DISTINCT):
        return "classification"
    return "regression"


# ---------------------------------------------------------------- A9-A11
def _name_has(name: str, words: list[str], whole_word: bool = False) -> bool:
    low = name.lower()
    if not whole_word:
        return any(w in low for w in words)
    import re
    parts = re.split(r"[^a-z0-9]+", low)
    return any(w in parts for w in words)


def date_parse_shares(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Share of *all* rows whose value parses as a date/time, per column (one pass)."""
    if not cols:
        return {}
    row = df.agg(*[F.avg(parse_timestamp(c).isNotNull().cast("double")).alias(f"_p{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: float(row[f"_p{i}"] or 0.0) for i, c in enumerate(cols)}


def detect_time_series(df: DataFrame, target: str | None = None, stats: list[dict] | None = None,
                       whole_word: bool = False, parse_numeric: bool = False) -> dict | None:
    """Time column, target gate and group columns; None if not a series."""
    stats = stats or column_stats(df, "auto")
    by_name = {s["column_name"]: s for s in stats}
    time_cols = [f.name for f in df.schema.fields if is_time(f.dataType)]
    if not time_cols:
        cands = [f.name for f in df.schema.fields
                 if _name_has(f.name, TIME_NAME_KEYWORDS, whole_word)
                 and (isinstance(f.dataType, T.StringType) or (parse_numeric and is_numeric(f.dataType)))]
        shares = date_parse_shares(df, cands)
        time_cols = [c for c in cands if shares.get(c, 0.0) > DATE_PARSE_MIN_SHARE]
    if not time_cols:
        return None
    time_col = time_cols[0]
    if target and target in by_name:
        t = by_name[target]
        if is_categorical(t["dtype"]):
            return None
        if (t["n_distinct"] or 0) < TS_TARGET_MIN_DISTINCT:
            return None
    groups = [s["column_name"] for s in stats
              if s["column_name"] not in (time_col, target)
              and _name_has(s["column_name"], GROUP_NAME_KEYWORDS, whole_word)
              and s["n_distinct"] is not None and s["n_distinct"] < GROUP_MAX_DISTINCT]
    return {"is_time_series": True, "time_column": time_col, "group_columns": groups}


# ---------------------------------------------------------------- A12
def analyze(df: DataFrame, target: str | None = None, exact: bool | str = "auto",
            whole_word: bool = False) -> dict:
    """The profile document (counts per role, missing map, imbalance, task, lists, series keys)."""
    stats = column_stats(df, exact)
    n = stats[0]["rows"] if stats else df.count()
    roles = {"numerical": [], "categorical": [], "text": []}
    for s in stats:
        r = role_of(s["dtype"], s["n_distinct"], s["avg_len"])
        if r in roles and s["column_name"] != target:
            roles[r].append(s["column_name"])
    missing = {s["column_name"]: round(s["n_null"] / n, 4) for s in stats if n and s["n_null"] > 0}
    tstat = next((s for s in stats if s["column_name"] == target), None)
    task = detect_task(tstat["dtype"] if tstat else None, tstat["n_distinct"] if tstat else None,
                       tstat is not None)
    imb = None
    if task == "classification":
        imb = imbalance(df, target).first()["imbalance_ratio"]
    meta = {
        "rows": int(n), "columns": len(df.columns),
        "numerical_features": len(roles["numerical"]),
        "categorical_features": len(roles["categorical"]),
        "text_features": len(roles["text"]),
        "missing_values": missing, "imbalance_ratio": imb,
        "dataset_type": "tabular", "detected_task": task,
        "feature_names": {**roles, "target": target},
    }
    tsinfo = detect_time_series(df, target if tstat else None, stats, whole_word=whole_word)
    if tsinfo:
        meta.update(tsinfo)
        meta["dataset_type"] = "time_series"
    else:
        meta["is_time_series"] = False
    return meta


def metadata_json(meta: dict) -> str:
    return json.dumps(meta, sort_keys=True, default=str)


# ---------------------------------------------------------------- A13-A15 leakage signs
def identifier_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns whose non-null values are all different and cover every row."""
    cols = [c for c in (cols or df.columns)
            if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType, T.DoubleType,
                                                      T.FloatType))]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string")
    parts = [df.select(F.lit(c).alias("column_name"),
                       F.count_distinct(F.col(c)).alias("n_distinct"),
                       F.count(F.lit(1)).alias("rows")) for c in cols]
    d = reduce(DataFrame.unionByName, parts)
    return d.where((F.col("n_distinct") == F.col("rows")) & (F.col("rows") > 1)).select("column_name")


def empty_flag(c: str, dtype: T.DataType):
    col = F.col(c)
    cond = col.isNull()
    if is_numeric(dtype):
        cond = cond | (col == 0)
    elif isinstance(dtype, T.StringType):
        cond = cond | (F.trim(col) == "")
    return cond.cast("double")


def null_by_class(df: DataFrame, target: str, gap: float = 0.9) -> DataFrame:
    """Columns empty (null/zero/blank) for one class and filled for another.

    One grouped aggregate (rows per class = number of classes), then the
    max-min gap of the empty share per column.
    """
    cols = [f for f in df.schema.fields if f.name != target
            and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    per_class = df.where(F.col(target).isNotNull()).groupBy(target).agg(
        *[F.avg(empty_flag(f.name, f.dataType)).alias(f"_e{i}") for i, f in enumerate(cols)])
    spread = per_class.agg(*[(F.max(f"_e{i}") - F.min(f"_e{i}")).alias(f"_g{i}")
                             for i in range(len(cols))])
    entries = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"_g{i}").alias("empty_gap"))
                        for i, f in enumerate(cols)])
    return (spread.select(F.explode(entries).alias("e")).select("e.*")
            .where(F.col("empty_gap") > gap))


def alias_columns(df: DataFrame, target: str, corr_limit: float = 0.999) -> DataFrame:
    """Columns that carry the target in another form.

    one-to-one: every value maps to one target value and every target value to
    one column value (two grouped distinct counts per column), or
    |Pearson| > corr_limit for numeric pairs.
    """
    out = []
    tnum = is_numeric(df.schema[target].dataType)
    for f in df.schema.fields:
        c = f.name
        if c == target or isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            continue
        pair = df.where(F.col(c).isNotNull() & F.col(target).isNotNull()).select(c, target)
        name = F.lit(c).alias("column_name")
        fwd = pair.groupBy(c).agg(F.count_distinct(target).alias("k")).agg(name, F.max("k").alias("fwd"))
        back = pair.groupBy(target).agg(F.count_distinct(c).alias("k")).agg(name, F.max("k").alias("back"))
        if tnum and is_numeric(f.dataType):
            r = F.corr(F.col(c).cast("double"), F.col(target).cast("double"))
        else:
            r = F.lit(None).cast("double")
        cr = pair.agg(name, r.alias("r"))
        out.append(fwd.join(back, "column_name").join(cr, "column_name")
                   .select("column_name", "fwd", "back", "r"))
    if not out:
        return df.sparkSession.createDataFrame([], "column_name string, reason string")
    allc = reduce(DataFrame.unionByName, out)
    reason = (F.when((F.col("fwd") == 1) & (F.col("back") == 1), "one_to_one")
              .when(F.abs(F.col("r")) > corr_limit, "correlated"))
    return allc.select("column_name", reason.alias("reason")).where(F.col("reason").isNotNull())
