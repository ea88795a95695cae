"""Checked queries for profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as pr
from ._base import register, table

ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
TABLE_WIDTH = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
               "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
               "benchmark": 2, "labels": 3, "conversations": 4}


@register("a1_table_shapes", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS rows, CAST({w} AS INTEGER) AS columns FROM {t}"
    for t, w in TABLE_WIDTH.items()))
def a1_table_shapes(spark, sf_dir):
    parts = [pr.shape(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "rows", "columns")
             for t in ALL_TABLES]
    return reduce(DataFrame.unionByName, parts)


_INJECT_COLS = ["l_orderkey", "price", "flag", "l_tax", "ship"]


def _inject_spark():
    return {
    "l_orderkey": F.col("l_orderkey"),
    "price": F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_extendedprice")),
    "flag": F.when(F.col("l_discount") == 0, None).otherwise(F.col("l_returnflag")),
    "l_tax": F.col("l_tax"),
    "ship": F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_shipdate")),
    }
_INJECT_SQL = """SELECT l_orderkey,
  CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_returnflag END AS flag,
  l_tax,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS ship
FROM lineitem"""


def _injected(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*[c.alias(n) for n, c in _inject_spark().items()])


@register("a2_missing_ratios", f"""
WITH t AS ({_INJECT_SQL})
SELECT column_name, round(ratio, 4) AS missing_ratio FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL) / count(*) AS ratio FROM t"
                      for c in _INJECT_COLS)}
) WHERE ratio > 0
""")
def a2_missing_ratios(spark, sf_dir):
    return pr.missing_ratios(_injected(spark, sf_dir))


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("a3_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM customer"
    for c in _CUSTOMER))
def a3_distinct_counts(spark, sf_dir):
    return pr.exact_distinct(table(spark, sf_dir, "customer"))


_LEN_COLS = [("documents", "text"), ("documents", "lang"), ("documents", "source"),
             ("conversations", "text"), ("pages", "url"), ("part", "p_name")]


@register("a4_mean_string_length", " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS column_name, round(avg(length({c})), 4) AS avg_len FROM {t}"
    for t, c in _LEN_COLS))
def a4_mean_string_length(spark, sf_dir):
    parts = []
    for t, c in _LEN_COLS:
        st = [s for s in pr.column_stats(table(spark, sf_dir, t).select(c), exact=False)][0]
        parts.append((f"{t}.{c}", float(st["avg_len"])))
    return spark.createDataFrame(parts, "column_name string, avg_len double")


# Role SQL generated from the schema: numeric -> numerical; string -> text/categorical rule.
_ROLE_TABLES = {
    "documents": [("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"),
                 ("c_mktsegment", "s")],
    "conversations": [("conv_id", "n"), ("turn", "n"), ("role", "s"), ("text", "s")],
}


def _role_sql(t, c, kind):
    if kind == "n":
        return f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'numerical' AS role"
    if kind == "t":
        return f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'datetime' AS role"
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) > 50 "
            f"AND avg(length({c})) > 20 THEN 'text' ELSE 'categorical' END AS role FROM {t}")


@register("a5_column_roles", " UNION ALL ".join(
    _role_sql(t, c, k) for t, cols in _ROLE_TABLES.items() for c, k in cols))
def a5_column_roles(spark, sf_dir):
    parts = []
    for t in _ROLE_TABLES:
        prof = pr.column_profile(table(spark, sf_dir, t), exact="auto")
        parts.append(prof.select(F.lit(t).alias("table_name"), "column_name", "role"))
    return reduce(DataFrame.unionByName, parts)


@register("a6_class_distribution", """
SELECT toxic AS class, CAST(count(*) AS BIGINT) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic
""")
def a6_class_distribution(spark, sf_dir):
    return pr.class_distribution(table(spark, sf_dir, "labels"), "toxic")


_IMB_TARGETS = [("labels", "toxic"), ("labels", "quality"), ("orders", "o_orderstatus"),
                ("lineitem", "l_returnflag")]


@register("a7_imbalance_ratio", " UNION ALL ".join(f"""
SELECT '{t}.{c}' AS target, CAST(count(*) AS BIGINT) AS n_classes, CAST(max(n) AS BIGINT) AS majority,
  CAST(min(n) AS BIGINT) AS minority,
  CASE WHEN count(*) > 1 THEN '1:' || CAST(CAST(round_even(max(n) / min(n), 0) AS BIGINT) AS VARCHAR) END
    AS imbalance_ratio
FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})""" for t, c in _IMB_TARGETS))
def a7_imbalance_ratio(spark, sf_dir):
    parts = [pr.imbalance(table(spark, sf_dir, t), c).select(F.lit(f"{t}.{c}").alias("target"), "*")
             for t, c in _IMB_TARGETS]
    return reduce(DataFrame.unionByName, parts)


_TASK_TARGETS = [("lineitem", "l_extendedprice", "n"), ("orders", "o_orderstatus", "s"),
                 ("labels", "quality", "n"), ("customer", "c_nationkey", "n"),
                 ("part", "p_size", "n"), ("lineitem", "l_linenumber", "n")]


@register("a8_task_detection", " UNION ALL ".join(
    (f"SELECT '{t}.{c}' AS target, 'classification' AS task" if k == "s" else
     f"SELECT '{t}.{c}' AS target, CASE WHEN count(DISTINCT {c}) < 20 THEN 'classification' "
     f"ELSE 'regression' END AS task FROM {t}") for t, c, k in _TASK_TARGETS))
def a8_task_detection(spark, sf_dir):
    rows = []
    for t, c, _ in _TASK_TARGETS:
        df = table(spark, sf_dir, t).select(c)
        st = pr.column_stats(df, exact="auto")[0]
        rows.append((f"{t}.{c}", pr.detect_task(st["dtype"], st["n_distinct"], True)))
    return spark.createDataFrame(rows, "target string, task string")


def _time_text_frame(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.when(F.col("event_id") % 10 < 3, F.lit("x")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("period_label"),
        F.when(F.col("event_id") % 10 < 1, F.lit("bad")).otherwise(F.col("ts").cast("string"))
        .alias("created_date"),
        F.when(F.col("event_id") % 20 == 0, F.lit("?")).otherwise(F.date_format("ts", "MM/dd/yyyy"))
        .alias("Day_Text"),
        "event_type", "value")


_TIME_TEXT_SQL = """SELECT event_id,
  CASE WHEN event_id % 10 < 3 THEN 'x' ELSE strftime(ts, '%Y-%m-%d') END AS period_label,
  CASE WHEN event_id % 10 < 1 THEN 'bad' ELSE CAST(ts AS VARCHAR) END AS created_date,
  CASE WHEN event_id % 20 = 0 THEN '?' ELSE strftime(ts, '%m/%d/%Y') END AS Day_Text,
  event_type, value FROM events"""


@register("a9_time_column_detection", f"""
WITH t AS ({_TIME_TEXT_SQL}),
s AS (
  SELECT 1 AS pos, 'period_label' AS column_name,
    avg(CASE WHEN TRY_CAST(period_label AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS parse_share FROM t
  UNION ALL SELECT 2, 'created_date',
    avg(CASE WHEN TRY_CAST(created_date AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM t
  UNION ALL SELECT 3, 'Day_Text',
    avg(CASE WHEN TRY_STRPTIME(Day_Text, '%m/%d/%Y') IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM t)
SELECT column_name, round(parse_share, 4) AS parse_share,
  pos = (SELECT min(pos) FROM s WHERE parse_share > 0.8) AS is_time_column
FROM s
""")
def a9_time_column_detection(spark, sf_dir):
    df = _time_text_frame(spark, sf_dir)
    cands = [c for c in df.columns if pr._name_has(c, pr.TIME_NAME_KEYWORDS)
             and dict(df.dtypes)[c] == "string"]
    shares = pr.date_parse_shares(df, cands)
    info = pr.detect_time_series(df, None)
    chosen = info["time_column"] if info else None
    rows = [(c, shares[c], c == chosen) for c in cands]
    return spark.createDataFrame(rows, "column_name string, parse_share double, is_time_column boolean")


_GATE_TARGETS = ["value", "event_type", "user_id", "event_id"]


@register("a10_series_target_gate", " UNION ALL ".join(
    ("SELECT 'event_type' AS target, false AS is_time_series" if c == "event_type" else
     f"SELECT '{c}' AS target, count(DISTINCT {c}) >= 10 AS is_time_series FROM events")
    for c in _GATE_TARGETS))
def a10_series_target_gate(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    stats = pr.column_stats(ev, "auto")
    rows = [(c, pr.detect_time_series(ev, c, stats) is not None) for c in _GATE_TARGETS]
    return spark.createDataFrame(rows, "target string, is_time_series boolean")


@register("a11_group_columns", """
SELECT column_name FROM (
  SELECT 'event_id' AS column_name, count(DISTINCT event_id) AS n FROM events
  UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events
) WHERE n < 500
""")
def a11_group_columns(spark, sf_dir):
    info = pr.detect_time_series(table(spark, sf_dir, "events"), "value")
    return spark.createDataFrame([(g,) for g in info["group_columns"]], "column_name string")


@register("a12_profile_document", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS INTEGER) AS columns,
  CAST(2 AS INTEGER) AS numerical_features,
  CAST((CASE WHEN count(DISTINCT event_type) > 50 AND avg(length(event_type)) > 20 THEN 0 ELSE 1 END)
     + (CASE WHEN count(DISTINCT props) > 50 AND avg(length(props)) > 20 THEN 0 ELSE 1 END) AS INTEGER)
    AS categorical_features,
  CAST((CASE WHEN count(DISTINCT event_type) > 50 AND avg(length(event_type)) > 20 THEN 1 ELSE 0 END)
     + (CASE WHEN count(DISTINCT props) > 50 AND avg(length(props)) > 20 THEN 1 ELSE 0 END) AS INTEGER)
    AS text_features,
  CASE WHEN count(DISTINCT value) < 20 THEN 'classification' ELSE 'regression' END AS detected_task,
  'time_series' AS dataset_type, true AS is_time_series, 'ts' AS time_column,
  CASE WHEN count(DISTINCT user_id) < 500 THEN 'user_id' ELSE '' END AS group_columns
FROM events
""")
def a12_profile_document(spark, sf_dir):
    meta = pr.analyze(table(spark, sf_dir, "events"), "value")
    row = (meta["rows"], meta["columns"], meta["numerical_features"], meta["categorical_features"],
           meta["text_features"], meta["detected_task"], meta["dataset_type"], meta["is_time_series"],
           meta.get("time_column"), ",".join(meta.get("group_columns", [])))
    return spark.createDataFrame([row], "rows bigint, columns int, numerical_features int, "
                                 "categorical_features int, text_features int, detected_task string, "
                                 "dataset_type string, is_time_series boolean, time_column string, "
                                 "group_columns string")


@register("a13_identifier_columns", """
SELECT column_name FROM (
  SELECT 'o_orderkey' AS column_name, count(DISTINCT o_orderkey) = count(*) AS u FROM orders
  UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) = count(*) FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) = count(*) FROM orders
  UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate) = count(*) FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) = count(*) FROM orders
) WHERE u
""")
def a13_identifier_columns(spark, sf_dir):
    return pr.identifier_columns(table(spark, sf_dir, "orders"))


_LEAK_SQL = """SELECT l.quality, d.lang, d.source,
  CASE WHEN l.quality = 1 THEN NULL ELSE d.n_chars END AS leak_len, d.n_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def _leak_frame(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents")
    j = lab.join(doc, "doc_id")
    return j.select("quality", "lang", "source",
                    F.when(F.col("quality") == 1, None).otherwise(F.col("n_chars")).alias("leak_len"),
                    "n_chars")


@register("a14_empty_by_class", f"""
WITH t AS ({_LEAK_SQL}), g AS (
  SELECT quality,
    avg(CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1.0 ELSE 0.0 END) AS e_lang,
    avg(CASE WHEN source IS NULL OR trim(source) = '' THEN 1.0 ELSE 0.0 END) AS e_source,
    avg(CASE WHEN leak_len IS NULL OR leak_len = 0 THEN 1.0 ELSE 0.0 END) AS e_leak,
    avg(CASE WHEN n_chars IS NULL OR n_chars = 0 THEN 1.0 ELSE 0.0 END) AS e_n
  FROM t WHERE quality IS NOT NULL GROUP BY quality)
SELECT column_name, round(empty_gap, 4) AS empty_gap FROM (
  SELECT 'lang' AS column_name, max(e_lang) - min(e_lang) AS empty_gap FROM g
  UNION ALL SELECT 'source', max(e_source) - min(e_source) FROM g
  UNION ALL SELECT 'leak_len', max(e_leak) - min(e_leak) FROM g
  UNION ALL SELECT 'n_chars', max(e_n) - min(e_n) FROM g
) WHERE empty_gap > 0.9
""")
def a14_empty_by_class(spark, sf_dir):
    return pr.null_by_class(_leak_frame(spark, sf_dir), "quality")


_ALIAS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status_code FROM orders"""


@register("a15_alias_columns", f"""
WITH t AS ({_ALIAS_SQL})
SELECT column_name, 'one_to_one' AS reason FROM (
  SELECT 'o_orderkey' AS column_name,
    (SELECT max(k) FROM (SELECT count(DISTINCT o_orderstatus) k FROM t GROUP BY o_orderkey)) AS fwd,
    (SELECT max(k) FROM (SELECT count(DISTINCT o_orderkey) k FROM t GROUP BY o_orderstatus)) AS back
  UNION ALL SELECT 'o_custkey',
    (SELECT max(k) FROM (SELECT count(DISTINCT o_orderstatus) k FROM t GROUP BY o_custkey)),
    (SELECT max(k) FROM (SELECT count(DISTINCT o_custkey) k FROM t GROUP BY o_orderstatus))
  UNION ALL SELECT 'o_totalprice',
    (SELECT max(k) FROM (SELECT count(DISTINCT o_orderstatus) k FROM t GROUP BY o_totalprice)),
    (SELECT max(k) FROM (SELECT count(DISTINCT o_totalprice) k FROM t GROUP BY o_orderstatus))
  UNION ALL SELECT 'o_orderpriority',
    (SELECT max(k) FROM (SELECT count(DISTINCT o_orderstatus) k FROM t GROUP BY o_orderpriority)),
    (SELECT max(k) FROM (SELECT count(DISTINCT o_orderpriority) k FROM t GROUP BY o_orderstatus))
  UNION ALL SELECT 'status_code',
    (SELECT max(k) FROM (SELECT count(DISTINCT o_orderstatus) k FROM t GROUP BY status_code)),
    (SELECT max(k) FROM (SELECT count(DISTINCT status_code) k FROM t GROUP BY o_orderstatus))
) WHERE fwd = 1 AND back = 1
""")
def a15_alias_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                 F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
                 .otherwise(2).alias("status_code"))
    return pr.alias_columns(o, "o_orderstatus")
