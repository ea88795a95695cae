"""Checked queries for scans/sinks (S1-S14), lookups (J-a..J-d, G5), H4, I5, I7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import improve as im
from ..operators import score as sc
from ..operators import select as se
from ..session import scratch_path
from ..sources import io
from ._base import register, table
from .metrics import _CAND_SQL, candidate_metrics


# ---------------------------------------------------------------- S1-S8, S12
_CSV_TYPES = {"c_custkey": "int", "c_name": "string", "c_acctbal": "double", "flag": "string", "clock": "string", "code": "int", "answer": "boolean",
              "day": "date", "at": "timestamp", "gaps": "double", "no_flag": "string"}


@register("s1_csv_round_trip", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS flag,
  lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':30' AS clock, CAST(c_custkey % 1000 AS INTEGER) AS code, c_custkey % 3 = 0 AS answer,
  CAST(DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER) AS VARCHAR) AS day,
  strftime(TIMESTAMP '2020-01-01 06:07:08' + to_days(CAST(c_custkey % 300 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS at,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 4 END AS gaps, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'N' END AS no_flag,
  true AS types_as_stated
FROM customer
""")
def s1_csv_round_trip(spark, sf_dir):
    """Customers written as CSV text with flags, clock times, leading zeros, dates and NA tokens, and read back by inference."""
    key = F.col("c_custkey")
    plus = lambda start, form: F.date_format(F.to_timestamp(F.lit(start)) + F.make_dt_interval((key % 300).cast("int")), form)
    text = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.when(key % 2 == 0, "Y").otherwise("N").alias("flag"),
        F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":30")).alias("clock"), F.lpad((key % 1000).cast("string"), 4, "0").alias("code"),
        F.when(key % 3 == 0, "True").otherwise("False").alias("answer"), plus("2020-01-01 00:00:00", "yyyy-MM-dd").alias("day"),
        plus("2020-01-01 06:07:08", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.when(key % 7 == 0, "N/A").otherwise((F.col("c_acctbal") / 4).cast("string")).alias("gaps"), F.when(key % 5 == 0, "NA").otherwise("N").alias("no_flag"))
    path = scratch_path(spark, "customer-csv")
    text.write.option("header", True).csv(path)
    back = io.load(spark, path, "csv")
    as_stated = dict(back.dtypes) == _CSV_TYPES
    return back.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "at": F.date_format("at", "yyyy-MM-dd HH:mm:ss"),
                             "types_as_stated": F.lit(as_stated)})


@register("s2_json_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s2_json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "nation-json")
    table(spark, sf_dir, "nation").write.json(path)
    back = io.load(spark, path, "json")
    return back.select(*[F.col(c).cast("int").alias(c) if c != "n_name" else F.col(c)
                         for c in ("n_nationkey", "n_name", "n_regionkey")])


@register("s3_sql_source", """
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment
""")
def s3_sql_source(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("tabsmith_customer")
    return io.load(spark, "SELECT c_mktsegment, count(*) AS n FROM tabsmith_customer WHERE c_acctbal > 0 "
                   "GROUP BY c_mktsegment", "sql")


@register("s5_exact_sample", """
SELECT l_orderkey, l_linenumber FROM lineitem
ORDER BY md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), l_orderkey, l_linenumber
LIMIT 1000
""")
def s5_exact_sample(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return io.sample_rows(li, 1000, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@register("s6_preview_records", """
SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS record
FROM nation ORDER BY n_nationkey LIMIT 5
""")
def s6_preview_records(spark, sf_dir):
    return io.preview(table(spark, sf_dir, "nation"), ["n_nationkey"])


@register("s7_split_part_counts", """
WITH t AS (SELECT row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS i,
             count(*) OVER () AS n FROM orders),
s AS (SELECT *, CAST(ceil(0.15 * n) AS BIGINT) AS ne FROM t),
v AS (SELECT *, CAST(ceil(0.176 * (n - ne)) AS BIGINT) AS nv FROM s)
SELECT CASE WHEN i < ne THEN 'eval' WHEN i < ne + nv THEN 'val' ELSE 'train' END AS split,
  CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1
""")
def s7_split_part_counts(spark, sf_dir):
    from ..operators import split as sp
    o = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-splits")
    io.write_splits(sp.random_split(o, ["o_orderkey"]), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("s12_export_per_model", f"""
WITH m AS ({_CAND_SQL})
SELECT model_name, CAST(count(*) AS BIGINT) AS n_rows, round(sum(r2_score), 4) AS r2_sum FROM m GROUP BY model_name
""")
def s12_export_per_model(spark, sf_dir):
    m = candidate_metrics(spark, sf_dir)
    imp = importances(spark, sf_dir)
    path = scratch_path(spark, "export")
    io.export_per_model(m, imp, path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/metrics")
    return back.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.round(F.sum("r2_score"), 4).alias("r2_sum"))


# ---------------------------------------------------------------- importances derived from data
_IMP_FEATURES = ["l_quantity", "l_tax", "l_discount"]
_IMP_SQL = f"""
WITH m AS ({_CAND_SQL}),
ex AS ({" UNION ALL ".join(
    f"SELECT l_suppkey AS pipeline_id, {no} AS candidate_no, {f} AS x, {expr} AS pred, '{f}' AS feature_name "
    f"FROM lineitem" for no, _, expr in [(1, 'a', '1000 * l_quantity + sqrt(l_partkey)'),
                                          (2, 'b', '1500 * l_quantity + sqrt(l_partkey)'),
                                          (3, 'c', '2000 * l_quantity + sqrt(l_partkey)'),
                                          (4, 'd', '1500 * l_quantity * (1 + l_tax) + sqrt(l_partkey)')]
    for f in _IMP_FEATURES)}),
imp AS (SELECT pipeline_id * 10 + candidate_no AS metric_id, feature_name,
          coalesce(abs(corr(x, pred)), 0.0) AS importance_score FROM ex GROUP BY 1, 2)"""


def importances(spark, sf_dir):
    """Importance of each input for each rule candidate: |corr(input, prediction)| per run."""
    from .metrics import _CANDS
    li = table(spark, sf_dir, "lineitem")
    cands = F.array(*[F.struct(F.lit(no).alias("candidate_no"), F.expr(expr).cast("double").alias("pred"))
                      for no, _, expr in _CANDS])
    feats = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("x"))
                      for f in _IMP_FEATURES])
    ex = li.select(F.col("l_suppkey").alias("pipeline_id"), F.explode(cands).alias("c"), feats.alias("fs"))
    ex = ex.select("pipeline_id", "c.*", F.explode("fs").alias("f")).select(
        "pipeline_id", "candidate_no", "pred", "f.*")
    return ex.groupBy((F.col("pipeline_id") * 10 + F.col("candidate_no")).cast("long").alias("metric_id"),
                      "feature_name").agg(F.coalesce(F.abs(F.corr("x", "pred")), F.lit(0.0))
                                          .alias("importance_score"))


@register("g5_top_importances", f"""
{_IMP_SQL}
SELECT metric_id, feature_name, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY importance_score DESC, feature_name) AS rank FROM imp)
WHERE rank <= 20
""")
def g5_top_importances(spark, sf_dir):
    t = se.top_importances(importances(spark, sf_dir))
    return t.select("metric_id", "feature_name", F.col("rank").cast("int"))


# ---------------------------------------------------------------- J-a .. J-d
@register("ja_run_lookup", f"""
WITH m AS ({_CAND_SQL}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY r2_score DESC, id) AS rn FROM m) WHERE rn = 1)
SELECT b.pipeline_id, s.s_name, b.model_name, n.n_name FROM b
JOIN supplier s ON s.s_suppkey = b.pipeline_id LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
""")
def ja_run_lookup(spark, sf_dir):
    best = se.best_rows(candidate_metrics(spark, sf_dir), "r2_score")
    sup = table(spark, sf_dir, "supplier")
    nat = table(spark, sf_dir, "nation")  # 25 rows: broadcast by size
    j = best.join(sup, best.pipeline_id == sup.s_suppkey).join(
        F.broadcast(nat), sup.s_nationkey == nat.n_nationkey, "left")
    return j.select("pipeline_id", "s_name", "model_name", "n_name")


@register("jb_importances_of_best", f"""
{_IMP_SQL},
b AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY r2_score DESC, id) AS rn FROM m) WHERE rn = 1)
SELECT metric_id, feature_name, importance_score FROM imp WHERE metric_id IN (SELECT id FROM b)
""")
def jb_importances_of_best(spark, sf_dir):
    best = se.best_rows(candidate_metrics(spark, sf_dir), "r2_score").select(F.col("id").alias("metric_id"))
    return importances(spark, sf_dir).join(best, "metric_id", "left_semi")


@register("jc_distinct_model_names", f"""
WITH m AS ({_CAND_SQL}) SELECT DISTINCT model_name FROM m
""")
def jc_distinct_model_names(spark, sf_dir):
    return candidate_metrics(spark, sf_dir).select("model_name").distinct()


@register("jd_never_best_models", f"""
WITH m AS ({_CAND_SQL}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY r2_score DESC, id) AS rn FROM m) WHERE rn = 1)
SELECT DISTINCT model_name FROM m WHERE model_name NOT IN (SELECT model_name FROM b)
""")
def jd_never_best_models(spark, sf_dir):
    m = candidate_metrics(spark, sf_dir)
    best = se.best_rows(m, "r2_score").select("model_name")
    return m.select("model_name").distinct().join(best, "model_name", "left_anti")


# ---------------------------------------------------------------- H4
@register("h4_correlated_columns", """
WITH t AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, 2 * l_quantity AS q2,
             -l_quantity + 0.001 * l_tax AS qneg, l_discount + l_tax AS dt FROM lineitem),
p AS (SELECT 'l_extendedprice' AS c, abs(corr(l_quantity, l_extendedprice)) AS r FROM t
  UNION ALL SELECT 'l_discount', abs(corr(l_quantity, l_discount)) FROM t
  UNION ALL SELECT 'l_discount', abs(corr(l_extendedprice, l_discount)) FROM t
  UNION ALL SELECT 'l_tax', abs(corr(l_quantity, l_tax)) FROM t
  UNION ALL SELECT 'l_tax', abs(corr(l_extendedprice, l_tax)) FROM t
  UNION ALL SELECT 'l_tax', abs(corr(l_discount, l_tax)) FROM t
  UNION ALL SELECT 'q2', abs(corr(l_quantity, q2)) FROM t
  UNION ALL SELECT 'qneg', abs(corr(l_quantity, qneg)) FROM t
  UNION ALL SELECT 'qneg', abs(corr(q2, qneg)) FROM t
  UNION ALL SELECT 'dt', abs(corr(l_discount, dt)) FROM t
  UNION ALL SELECT 'dt', abs(corr(l_tax, dt)) FROM t)
SELECT DISTINCT c AS column_name FROM p WHERE r > 0.95
""")
def h4_correlated_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (2 * F.col("l_quantity")).alias("q2"),
                  (-F.col("l_quantity") + 0.001 * F.col("l_tax")).alias("qneg"),
                  (F.col("l_discount") + F.col("l_tax")).alias("dt"))
    return im.correlated_columns(t, t.columns)


@register("h4_correlation_pairs", """
SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", corr(l_quantity, l_extendedprice) AS corr FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
""")
def h4_correlation_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return im.correlation_pairs(li, ["l_quantity", "l_extendedprice", "l_discount"])


# ---------------------------------------------------------------- I5 / I7
@register("i5_parse_value_rows", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS qty, NULL::VARCHAR AS qty_text,
  NULL::DOUBLE AS flag, l_returnflag AS flag_text, l_tax AS tax, NULL::VARCHAR AS tax_text FROM lineitem
""")
def i5_parse_value_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber",
                     F.concat_ws(", ", F.col("l_quantity").cast("string"), "l_returnflag",
                                 F.col("l_tax").cast("string")).alias("row_text"))
    return sc.parse_rows(rows, "row_text", ["qty", "flag", "tax"]).drop("row_text")


_REPLY_SPARK = """
CASE WHEN c_custkey % 3 = 0 THEN concat('```json\\n{"task": "classification", "target": "', c_mktsegment,
       '", "drop_columns": ["c_name", "c_custkey"], "primary_metric": "f1_score", "optimization_goal": "maximize", "reasoning": "ok"}\\n```')
     WHEN c_custkey % 3 = 1 THEN substr(concat('{"task": "regression", "target": "c_acctbal", "drop_columns": ["c_name"], "reasoning": "balance of ', c_name, ' and more text"}'), 1, 60 + CAST(c_nationkey AS INT))
     ELSE concat('{"target": "', c_name, '"') END
"""


@register("i7_read_model_replies", """
WITH t AS (SELECT c_custkey, c_mktsegment, c_name, c_nationkey,
  CASE WHEN c_custkey % 3 = 0 THEN 'parsed' WHEN c_custkey % 3 = 1 THEN 'repaired' ELSE 'failed' END AS reply_state,
  substr('{"task": "regression", "target": "c_acctbal", "drop_columns": ["c_name"], "reasoning": "balance of ' || c_name || ' and more text"}', 1, 60 + c_nationkey) AS cut
FROM customer)
SELECT c_custkey, reply_state,
  CASE reply_state WHEN 'parsed' THEN 'classification' WHEN 'repaired' THEN 'regression' END AS task,
  CASE reply_state WHEN 'parsed' THEN c_mktsegment WHEN 'repaired' THEN nullif(regexp_extract(cut, '"target"\\s*:\\s*"([^"]+)"', 1), '') END AS target,
  CASE reply_state WHEN 'parsed' THEN 2 WHEN 'repaired' THEN
    CASE WHEN regexp_extract(cut, '"drop_columns"\\s*:\\s*\\[([^\\]]*)\\]', 1) = '' THEN 0 ELSE 1 END END AS n_drop
FROM t
""")
def i7_read_model_replies(spark, sf_dir):
    """Replies built from customer rows: fenced JSON, cut-off JSON (cut by nation key), no task."""
    c = table(spark, sf_dir, "customer")
    t = c.select("c_custkey", F.expr(_REPLY_SPARK).alias("reply_text"))
    r = sc.read_replies(t, "reply_text")
    return r.select("c_custkey", "reply_state", "task", "target",
                    F.when(F.col("reply_state") != "failed", F.coalesce(F.size("drop_columns"), F.lit(0))).cast("int").alias("n_drop"))


@register("s8_run_meta_round_trip", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS INTEGER) AS columns, 'classification' AS detected_task,
  (SELECT '1:' || CAST(CAST(round_even(max(n) / min(n), 0) AS BIGINT) AS VARCHAR)
   FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS imbalance_ratio
FROM orders
""")
def s8_run_meta_round_trip(spark, sf_dir):
    """The profile document of orders written as the run metadata and read back."""
    from ..operators import profile as pr
    meta = pr.analyze(table(spark, sf_dir, "orders"), "o_orderstatus")
    path = scratch_path(spark, "run-meta")
    io.write_run_meta(spark, {"metadata": meta, "target_column": "o_orderstatus"}, path)
    back = io.read_run_meta(spark, path)["metadata"]
    return spark.createDataFrame([(back["rows"], back["columns"], back["detected_task"], back["imbalance_ratio"])],
                                 "rows bigint, columns int, detected_task string, imbalance_ratio string")


@register("s9_result_store_append", f"""
WITH m AS ({_CAND_SQL})
SELECT model_name, CAST(count(*) AS BIGINT) AS n_rows, round(sum(rmse), 4) AS rmse_sum FROM m GROUP BY model_name
""")
def s9_result_store_append(spark, sf_dir):
    """Metrics rows appended to the model_metrics table in two batches, read back."""
    from ..sources.store import ResultStore
    m = candidate_metrics(spark, sf_dir)
    full = m.select("id", "pipeline_id", "model_name", *[F.lit(None).cast("double").alias(c) for c in
                    ("accuracy", "precision", "recall", "f1_score")], "rmse", "mae", "r2_score",
                    F.lit(None).cast("double").alias("silhouette_score"),
                    F.lit(None).cast("double").alias("training_time_seconds"),
                    F.lit(None).cast("double").alias("roc_auc"), F.lit(0).alias("is_best_model"),
                    F.lit(None).cast("double").alias("anomaly_ratio"))
    store = ResultStore(spark, scratch_path(spark, "store"))
    first = F.col("model_name").isin("slope_1000", "slope_1500")   # two appends cover every row
    store.append("model_metrics", full.where(first))
    store.append("model_metrics", full.where(~first))
    back = store.read("model_metrics")
    return back.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.round(F.sum("rmse"), 4).alias("rmse_sum"))


@register("scalars_array_map", """
WITH c AS (SELECT c_custkey, string_split(c_name, '#') AS parts, [c_custkey, c_nationkey, c_custkey % 7] AS nums, c_acctbal, c_mktsegment FROM customer)
SELECT c_custkey, CAST(len(parts) AS INTEGER) AS n_parts, upper(parts[1]) AS head, list_max(nums) AS largest, list_sum(list_transform(nums, lambda x: x * 2)) AS doubled,
  CAST(len(list_filter(nums, lambda x: x > 3)) AS INTEGER) AS over_three, array_to_string(list_sort(list_distinct(nums)), ',') AS ordered,
  list_contains(nums, c_custkey % 7) AS held, c_acctbal AS looked_up, CAST(2 AS INTEGER) AS n_keys, c_mktsegment || '!' AS changed FROM c
""")
def scalars_array_map(spark, sf_dir):
    """Array and map functions over every customer."""
    key = F.col("c_custkey").cast("long")
    c = table(spark, sf_dir, "customer").withColumns({
        "parts": F.split("c_name", "#"), "nums": F.array(key, F.col("c_nationkey").cast("long"), key % 7),
        "m": F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("segment"), F.col("c_mktsegment"))})
    more = F.transform_values("m", lambda k, v: F.when(k == "segment", F.concat(v, F.lit("!"))).otherwise(v))
    return c.select("c_custkey", F.size("parts").alias("n_parts"), F.upper(F.get("parts", F.lit(0))).alias("head"), F.array_max("nums").alias("largest"),
                    F.aggregate(F.transform("nums", lambda x: x * 2), F.lit(0).cast("long"), lambda s, x: s + x).alias("doubled"),
                    F.size(F.filter("nums", lambda x: x > 3)).alias("over_three"),
                    F.array_join(F.array_sort(F.array_distinct("nums")).cast("array<string>"), ",").alias("ordered"),
                    F.array_contains("nums", key % 7).alias("held"), F.element_at("m", "balance").cast("double").alias("looked_up"),
                    F.size(F.map_keys("m")).alias("n_keys"), F.element_at(more, "segment").alias("changed"))
