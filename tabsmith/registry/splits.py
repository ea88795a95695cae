"""Checked queries for splits (X1-X6) and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pr
from ..operators import project as pj
from ..operators import split as sp
from ._base import register, table


def _md5(*cols):
    inner = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws('|', '42', {inner}))"


@register("x1_ordered_split", """
SELECT event_id, CASE WHEN i < CAST(floor(n * 0.70) AS BIGINT) THEN 'train'
                      WHEN i < CAST(floor(n * 0.85) AS BIGINT) THEN 'val' ELSE 'eval' END AS split
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
""")
def x1_ordered_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return sp.ordered_split(ev, ["ts", "event_id"]).select("event_id", "split")


@register("x2_random_split", f"""
WITH t AS (SELECT l_orderkey, l_linenumber,
             row_number() OVER (ORDER BY {_md5('l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) - 1 AS i,
             count(*) OVER () AS n FROM lineitem),
s AS (SELECT *, CAST(ceil(0.15 * n) AS BIGINT) AS ne FROM t),
v AS (SELECT *, CAST(ceil(0.176 * (n - ne)) AS BIGINT) AS nv FROM s)
SELECT l_orderkey, l_linenumber,
  CASE WHEN i < ne THEN 'eval' WHEN i < ne + nv THEN 'val' ELSE 'train' END AS split FROM v
""")
def x2_random_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return sp.random_split(li, ["l_orderkey", "l_linenumber"])


_STRAT_SQL = """
WITH t AS (SELECT {key}, {label},
             row_number() OVER (PARTITION BY {label} ORDER BY {h}, {key}) - 1 AS i,
             count(*) OVER (PARTITION BY {label}) AS n FROM {src}),
s AS (SELECT *, CAST(ceil(n * 0.15) AS BIGINT) AS ne FROM t),
v AS (SELECT *, CAST(ceil((n - ne) * 0.176) AS BIGINT) AS nv FROM s)
SELECT {key}, CASE WHEN i < ne THEN 'eval' WHEN i < ne + nv THEN 'val' ELSE 'train' END AS split FROM v
"""


@register("x3_stratified_split", _STRAT_SQL.format(
    key="o_orderkey", label="o_orderstatus", h=_md5("o_orderkey"), src="orders"))
def x3_stratified_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sp.auto_split(o, "o_orderstatus", ["o_orderkey"], "classification").select("o_orderkey", "split")


@register("x4_split_fallback", f"""
WITH t AS (SELECT o_orderkey,
             row_number() OVER (ORDER BY {_md5('o_orderkey')}, o_orderkey) - 1 AS i,
             count(*) OVER () AS n FROM orders),
s AS (SELECT *, CAST(ceil(0.15 * n) AS BIGINT) AS ne FROM t),
v AS (SELECT *, CAST(ceil(0.176 * (n - ne)) AS BIGINT) AS nv FROM s)
SELECT o_orderkey, CASE WHEN i < ne THEN 'eval' WHEN i < ne + nv THEN 'val' ELSE 'train' END AS split FROM v
""")
def x4_split_fallback(spark, sf_dir):
    """A one-row class (the order with the top price) makes stratifying impossible -> plain random."""
    o = table(spark, sf_dir, "orders")
    top = o.agg(F.max("o_totalprice").alias("_top"))
    lab = (o.join(F.broadcast(top), F.col("o_totalprice") == F.col("_top"), "left")
           .select("o_orderkey", F.when(F.col("_top").isNotNull(), F.lit("rare"))
                   .otherwise(F.col("o_orderstatus")).alias("label")))
    return sp.auto_split(lab, "label", ["o_orderkey"], "classification").select("o_orderkey", "split")


@register("x6_cv_folds", f"""
SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5('o_orderkey')}, o_orderkey) - 1) % 3 AS INTEGER) AS fold
FROM orders
""")
def x6_cv_folds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sp.cv_folds(o, "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


@register("x5_no_label_split", """
SELECT 'all' AS split, CAST(count(*) AS BIGINT) AS n FROM embeddings
""")
def x5_no_label_split(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return sp.auto_split(e, None, ["vec_id"], "clustering").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- P1-P9
@register("p1_drop_exact_case", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
""")
def p1_drop_exact_case(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return pj.drop_columns(o, ["O_TOTALPRICE", "o_orderpriority", "o_orderdate", "no_such_column"])


@register("p2_resolve_target", """
SELECT l_orderkey, l_linenumber, 'l_extendedprice' AS target_name, l_extendedprice AS label FROM lineitem
""")
def p2_resolve_target(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    name = pj.resolve_target(li, " L_EXTENDEDPRICE ")
    df, label, _ = pj.features_and_label(li, name)
    return df.select("l_orderkey", "l_linenumber", F.lit(label).alias("target_name"),
                     F.col(label).alias("label"))


@register("p4_feature_columns", "SELECT * EXCLUDE (l_extendedprice), l_extendedprice AS label FROM lineitem")
def p4_feature_columns(spark, sf_dir):
    """Every line's features, and its label under the name that the trainers read."""
    df, label, feats = pj.features_and_label(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return df.select(*feats, F.col(label).alias("label"))


@register("p5_drop_incomplete", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE NOT (l_quantity > 45) AND l_discount <> 0 AND l_linenumber <> 7
""")
def p5_drop_incomplete(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = li.select("l_orderkey", "l_linenumber",
                   F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"),
                   F.when(F.col("l_discount") == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
                   F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_shipdate")).alias("ship"))
    return pj.drop_incomplete(df).select("l_orderkey", "l_linenumber")


_P6_CLASSES = {"numerical": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
               "categorical": ["l_returnflag", "l_linestatus"], "datetime": ["l_shipdate"]}


@register("p6_columns_by_class", "SELECT " + ", ".join(f"{c} AS {k}_{c}" for k, cs in _P6_CLASSES.items() for c in cs) + " FROM lineitem")
def p6_columns_by_class(spark, sf_dir):
    """Every line with its columns selected by class."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*[F.col(c).alias(f"{k}_{c}") for k in _P6_CLASSES for c in pj.columns_of_class(li, k)])


@register("p9_report_rounding", """
SELECT column_name, round_even(ratio * 100, 2) AS missing_pct FROM (
  SELECT 'price' AS column_name, count_if(l_quantity > 45) / count(*) AS ratio FROM lineitem
  UNION ALL SELECT 'flag', count_if(l_discount = 0) / count(*) FROM lineitem)
""")
def p9_report_rounding(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = li.select(F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_extendedprice")).alias("price"),
                   F.when(F.col("l_discount") == 0, None).otherwise(F.col("l_returnflag")).alias("flag"))
    m = pr.missing_ratios(df, keep_zero=True)
    # percent from the unrounded ratio, as the report does
    raw = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("r")) for c in df.columns])
    out = raw.select(F.explode(entries).alias("e")).select(
        "e.column_name", pj.report_round(F.col("e.r"), "percent").alias("missing_pct"))
    return out.join(m.select("column_name"), "column_name")
