"""Checked queries for metrics (E1-E12), selection (R1, R2, P8) and gates.

Predictions come from fixed rules over the test tables, so no fitted model is
needed: binary = labels joined to documents, multiclass = orders, regression =
lineitem.  The candidate-metrics table scores four rule regressors per
supplier (one "run" per supplier) over the whole lineitem table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import improve as im
from ..operators import metrics as me
from ..operators import project as pj
from ..operators import score as sc
from ..operators import select as se
from ._base import register, table

# ---------------------------------------------------------------- rule predictions
_BIN_SQL = """SELECT l.doc_id, l.quality AS y, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS p,
  least(1.0, d.n_chars / 5000.0) AS prob, d.lang
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def binary_predictions(spark, sf_dir):
    lab, doc = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("y"),
        F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("p"),
        F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("prob"), "lang")


_MULTI_SQL = """SELECT o_orderkey, o_orderstatus AS y,
  CASE WHEN o_totalprice < 100000 THEN 'F' WHEN o_totalprice < 250000 THEN 'O' ELSE 'P' END AS p,
  o_totalprice / 600000.0 AS s FROM orders"""


def multiclass_predictions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("y"),
                    F.when(F.col("o_totalprice") < 100000, "F").when(F.col("o_totalprice") < 250000, "O")
                    .otherwise("P").alias("p"), (F.col("o_totalprice") / 600000.0).alias("s"))


# sqrt(l_partkey) keeps the scores off exact decimal ties when rounded for reports
_CANDS = [(1, "slope_1000", "1000 * l_quantity + sqrt(l_partkey)"),
          (2, "slope_1500", "1500 * l_quantity + sqrt(l_partkey)"),
          (3, "slope_2000", "2000 * l_quantity + sqrt(l_partkey)"),
          (4, "taxed_1500", "1500 * l_quantity * (1 + l_tax) + sqrt(l_partkey)")]

_CAND_SQL = f"""
WITH ex AS ({" UNION ALL ".join(
    f"SELECT l_suppkey AS pipeline_id, {no} AS candidate_no, '{name}' AS model_name, "
    f"l_extendedprice AS y, {expr} AS pred FROM lineitem" for no, name, expr in _CANDS)}),
m AS (SELECT pipeline_id, candidate_no, model_name,
        sqrt(sum((y - pred) * (y - pred)) / count(*)) AS rmse, avg(abs(y - pred)) AS mae,
        CASE WHEN var_pop(y) * count(*) <> 0 THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))
             WHEN sum((y - pred) * (y - pred)) = 0 THEN 1.0 ELSE 0.0 END AS r2_score
      FROM ex GROUP BY pipeline_id, candidate_no, model_name)
SELECT pipeline_id * 10 + candidate_no AS id, * FROM m"""


def candidate_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cands = F.array(*[F.struct(F.lit(no).alias("candidate_no"), F.lit(name).alias("model_name"),
                               F.expr(expr).cast("double").alias("pred")) for no, name, expr in _CANDS])
    ex = li.select(F.col("l_suppkey").alias("pipeline_id"), F.col("l_extendedprice").alias("y"),
                   F.explode(cands).alias("c")).select("pipeline_id", "y", "c.*")
    m = me.regression_metrics(ex, "y", "pred", by=["pipeline_id", "candidate_no", "model_name"])
    return m.withColumn("id", (F.col("pipeline_id") * 10 + F.col("candidate_no")).cast("long"))


# ---------------------------------------------------------------- E1-E12
@register("e1_e4_binary_metrics", f"""
WITH t AS ({_BIN_SQL})
SELECT count_if(y = p) / count(*) AS accuracy,
  coalesce(count_if(y = 1 AND p = 1) / nullif(count_if(p = 1), 0), 0.0) AS precision,
  coalesce(count_if(y = 1 AND p = 1) / nullif(count_if(y = 1), 0), 0.0) AS recall,
  coalesce(2.0 * count_if(y = 1 AND p = 1) / nullif(count_if(y = 1) + count_if(p = 1), 0), 0.0) AS f1_score
FROM t
""")
def e1_e4_binary_metrics(spark, sf_dir):
    return me.classification_metrics(binary_predictions(spark, sf_dir), "y", "p")


@register("e5_macro_metrics", f"""
WITH t AS ({_MULTI_SQL}),
c AS (SELECT DISTINCT y AS cls FROM t UNION SELECT DISTINCT p FROM t),
k AS (SELECT cls, count_if(t.y = cls AND t.p = cls) AS tp, count_if(t.y <> cls AND t.p = cls) AS fp,
             count_if(t.y = cls AND t.p <> cls) AS fn FROM c, t GROUP BY cls)
SELECT (SELECT count_if(y = p) / count(*) FROM t) AS accuracy,
  avg(coalesce(tp / nullif(tp + fp, 0), 0.0)) AS precision,
  avg(coalesce(tp / nullif(tp + fn, 0), 0.0)) AS recall,
  avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)) AS f1_score
FROM k
""")
def e5_macro_metrics(spark, sf_dir):
    return me.classification_metrics(multiclass_predictions(spark, sf_dir), "y", "p")


_AUC_SQL = """
WITH t AS ({src}), g AS (SELECT CAST({s} AS DOUBLE) AS s, count_if({pos}) AS pos, count_if(NOT ({pos})) AS neg
  FROM t GROUP BY 1),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM g)
SELECT sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM r
"""


@register("e6_roc_auc_exact", _AUC_SQL.format(src=_BIN_SQL, s="prob", pos="y = 1"))
def e6_roc_auc_exact(spark, sf_dir):
    return me.roc_auc(binary_predictions(spark, sf_dir), "y", "prob")


@register("e7_roc_auc_ovr_macro", f"""
WITH t AS ({_MULTI_SQL}),
ex AS (SELECT o_orderkey, y, 'F' AS cls, 1.0 - s AS sc FROM t
       UNION ALL SELECT o_orderkey, y, 'O', 1.0 - abs(s - 0.3) FROM t
       UNION ALL SELECT o_orderkey, y, 'P', s FROM t),
g AS (SELECT cls, CAST(sc AS DOUBLE) AS sc, count_if(y = cls) AS pos, count_if(y <> cls) AS neg FROM ex GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
a AS (SELECT cls, sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY cls)
SELECT avg(auc) AS roc_auc FROM a
""")
def e7_roc_auc_ovr_macro(spark, sf_dir):
    m = multiclass_predictions(spark, sf_dir)
    probs = F.array(1.0 - F.col("s"), 1.0 - F.abs(F.col("s") - 0.3), F.col("s"))
    return me.roc_auc_ovr(m.withColumn("probs", probs), "y", "probs", classes=["F", "O", "P"])


@register("e8_e10_regression_metrics", """
SELECT sqrt(sum((y - p) * (y - p)) / count(*)) AS rmse, avg(abs(y - p)) AS mae,
  1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2_score
FROM (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)
""")
def e8_e10_regression_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return me.regression_metrics(li, "l_extendedprice", F.col("l_quantity") * 1500)


@register("e11_silhouette_sq_euclidean", """
WITH pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nrm AS (SELECT vec_id, label, e, list_sum(list_transform(e, lambda x: x * x)) AS sq FROM pts),
unn AS (SELECT vec_id, label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM pts),
cs AS (SELECT label, i, sum(v) AS s FROM unn GROUP BY label, i),
cn AS (SELECT label, count(*) AS n, sum(sq) AS q FROM nrm GROUP BY label),
dt AS (SELECT u.vec_id, c.label AS cl, sum(u.v * c.s) AS xy FROM unn u JOIN cs c ON u.i = c.i GROUP BY u.vec_id, c.label),
d AS (SELECT nrm.vec_id, nrm.label, dt.cl, cn.n, cn.n * nrm.sq - 2 * dt.xy + cn.q AS num
      FROM nrm JOIN dt ON nrm.vec_id = dt.vec_id JOIN cn ON cn.label = dt.cl),
s AS (SELECT vec_id, max(CASE WHEN cl = label THEN n END) AS na,
        max(CASE WHEN cl = label AND n > 1 THEN num / (n - 1) END) AS a,
        min(CASE WHEN cl <> label THEN num / n END) AS b FROM d GROUP BY vec_id)
SELECT avg(CASE WHEN na <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette_score FROM s
""")
def e11_silhouette_sq_euclidean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return me.silhouette_sq_euclidean(e, "embedding", "label")


@register("e12_anomaly_ratio", """
SELECT coalesce(avg(CASE WHEN value > 45 THEN 1.0 ELSE 0.0 END), 0.0) AS anomaly_ratio FROM events
""")
def e12_anomaly_ratio(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return me.anomaly_ratio(ev.select(F.when(F.col("value") > 45, -1).otherwise(1).alias("p")), "p")


# ---------------------------------------------------------------- R1, R2, P8
@register("r1_best_model_per_run", f"""
WITH m AS ({_CAND_SQL})
SELECT pipeline_id, 'r2_score' AS metric, model_name FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY r2_score DESC, id) AS rn FROM m) WHERE rn = 1
UNION ALL
SELECT pipeline_id, 'rmse', model_name FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY rmse ASC, id) AS rn FROM m) WHERE rn = 1
""")
def r1_best_model_per_run(spark, sf_dir):
    m = candidate_metrics(spark, sf_dir)
    a = se.best_rows(m, "r2_score").select("pipeline_id", F.lit("r2_score").alias("metric"), "model_name")
    b = se.best_rows(m, "rmse").select("pipeline_id", F.lit("rmse").alias("metric"), "model_name")
    return a.unionByName(b)


@register("r2_comparison_table", f"""
WITH m AS ({_CAND_SQL})
SELECT pipeline_id, model_name, round_even(rmse, 4) AS rmse, round_even(mae, 4) AS mae,
  round_even(r2_score, 4) AS r2_score FROM m
""")
def r2_comparison_table(spark, sf_dir):
    m = candidate_metrics(spark, sf_dir)
    return se.comparison_table(m, "regression", keys=["pipeline_id"])


@register("p8_latest_run_best", f"""
WITH m AS ({_CAND_SQL}),
f AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY r2_score DESC, id) = 1 AS best FROM m)
SELECT pipeline_id, model_name FROM f
WHERE pipeline_id = (SELECT max(pipeline_id) FROM m) AND best
""")
def p8_latest_run_best(spark, sf_dir):
    m = se.flag_best(candidate_metrics(spark, sf_dir), "r2_score")
    return pj.latest_best(m).select("pipeline_id", "model_name")


# ---------------------------------------------------------------- H7, H8
@register("h7_threshold_gate", f"""
WITH m AS ({_CAND_SQL})
SELECT id, r2_score >= 0.70 AS meets_threshold FROM m
""")
def h7_threshold_gate(spark, sf_dir):
    m = candidate_metrics(spark, sf_dir)
    return m.select("id", im.meets_threshold(F.col("r2_score"), "regression").alias("meets_threshold"))


@register("h8_attempt_log", f"""
WITH m AS ({_CAND_SQL})
SELECT pipeline_id, candidate_no AS attempt, model_name, round(r2_score, 4) AS validation_score,
  CASE WHEN max(r2_score) OVER (PARTITION BY pipeline_id ORDER BY candidate_no
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL
         OR r2_score > max(r2_score) OVER (PARTITION BY pipeline_id ORDER BY candidate_no
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
       THEN 1 ELSE 0 END AS improved
FROM m
""")
def h8_attempt_log(spark, sf_dir):
    m = candidate_metrics(spark, sf_dir).withColumnRenamed("candidate_no", "attempt")
    out = im.attempt_improvements(m, "r2_score", "maximize", run_col="pipeline_id", attempt_col="attempt")
    return out.select("pipeline_id", "attempt", "model_name",
                      F.col("r2_score").alias("validation_score"), "improved")


# ---------------------------------------------------------------- I3, I4, I6
@register("i3_predicted_vs_actual", f"""
WITH t AS ({_MULTI_SQL})
SELECT o_orderkey, y AS actual, p AS predicted, CAST(y AS VARCHAR) = CAST(p AS VARCHAR) AS is_match
FROM t ORDER BY o_orderkey LIMIT 20
""")
def i3_predicted_vs_actual(spark, sf_dir):
    m = multiclass_predictions(spark, sf_dir)
    return sc.predicted_vs_actual(m, "y", "p", key="o_orderkey", n=20)


@register("i4_pass_fail_by_group", f"""
WITH t AS ({_BIN_SQL})
SELECT lang,
  coalesce(2.0 * count_if(y = 1 AND p = 1) / nullif(count_if(y = 1) + count_if(p = 1), 0), 0.0) >= 0.75 AS passed
FROM t GROUP BY lang
""")
def i4_pass_fail_by_group(spark, sf_dir):
    b = binary_predictions(spark, sf_dir)
    c = b.groupBy("lang").agg(F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
                              F.count_if(F.col("y") == 1).alias("npos"), F.count_if(F.col("p") == 1).alias("npred"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("npos") + F.col("npred")), F.lit(0.0))
    return c.select("lang", sc.passes(f1, "classification").alias("passed"))


@register("i6_history_last_50", f"""
WITH m AS ({_CAND_SQL})
SELECT id, pipeline_id, model_name FROM m ORDER BY id DESC LIMIT 50
""")
def i6_history_last_50(spark, sf_dir):
    return sc.history(candidate_metrics(spark, sf_dir), n=50).select("id", "pipeline_id", "model_name")


# ---------------------------------------------------------------- H2 by AUC
@register("h2_search_score_roc_auc", """
WITH t AS (SELECT l_returnflag = 'R' AS pos, l_quantity AS s FROM lineitem),
g AS (SELECT s, count_if(pos) AS p, count_if(NOT pos) AS n FROM t GROUP BY s),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
m AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 150000 THEN 0.6 ELSE 0.2 END AS f FROM orders),
ex AS (SELECT 'F' AS c, y, f AS s FROM m UNION ALL SELECT 'O', y, 0.9 - f FROM m UNION ALL SELECT 'P', y, 0.1 FROM m),
eg AS (SELECT c, CAST(s AS DOUBLE) AS s, count_if(y = c) AS p, count_if(y <> c) AS n FROM ex GROUP BY 1, 2),
er AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM eg),
ea AS (SELECT c, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM er GROUP BY c)
SELECT 'two classes' AS kind, (SELECT sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) FROM r) AS score
UNION ALL SELECT 'three classes', (SELECT avg(auc) FROM ea)
""")
def h2_search_score_roc_auc(spark, sf_dir):
    """The search's score by AUC: two classes from a raw score, three from class shares."""
    from pyspark.ml.functions import array_to_vector

    from ..operators.improve import score_of
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("y"), array_to_vector(F.array(-F.col("l_quantity"), F.col("l_quantity"))).alias("rawPrediction"))
    o = table(spark, sf_dir, "orders")
    f = F.when(F.col("o_totalprice") > 150000, 0.6).otherwise(0.2)
    shares = o.where("o_orderstatus is not null").select(
        (F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1).cast("double").alias("y"),
        array_to_vector(F.array(f, 0.9 - f, F.lit(0.1))).alias("probability"))
    rows = [("two classes", score_of(li, "classification", "roc_auc", "y", 2)), ("three classes", score_of(shares, "classification", "roc_auc", "y", 3))]
    return spark.createDataFrame(rows, "kind string, score double")
