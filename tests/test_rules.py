import math

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import metrics as me
from tabsmith.operators import models as mo
from tabsmith.operators import project as pj
from tabsmith.operators import score as sc
from tabsmith.operators import select as se
from tabsmith.operators import split as sp
from tabsmith.sources import io
from tests.conftest import SF001


def test_splits_disjoint_and_complete(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    n = o.count()
    for parts in (sp.random_split(o, ["o_orderkey"]), sp.random_split(o, ["o_orderkey"], method="hash"),
                  sp.stratified_split(o, "o_orderstatus", ["o_orderkey"])):
        assert parts.count() == n
        assert parts.select("o_orderkey").distinct().count() == n
    tr, va, ev = sp.part_sizes(n)
    got = {r.split: r["count"] for r in sp.random_split(o, ["o_orderkey"]).groupBy("split").count().collect()}
    assert got == {"train": tr, "val": va, "eval": ev}


def test_split_fallback_and_no_label(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(40)], "k int, y string")
    assert sp.min_class_count(df, "y") == 1
    out = sp.auto_split(df, "y", ["k"], "classification")
    assert out.count() == 40
    assert sp.no_label_split(df).where("split = 'all'").count() == 40


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert me.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.875)
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert me.roc_auc(one, "y", "s").first()[0] is None


def test_zero_division_and_r2_constant(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    m = me.binary_metrics(df, "y", "p").first()
    assert (m.precision, m.recall, m.f1_score, m.accuracy) == (0.0, 0.0, 0.0, 1.0)
    c = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert me.regression_metrics(c, "y", "p").first().r2_score == 1.0
    e = spark.createDataFrame([], "p int")
    assert me.anomaly_ratio(e, "p").first()[0] == 0.0


def test_best_model_skips_nan_and_keeps_first_on_ties(spark):
    m = spark.createDataFrame([(1, 1, "a", 0.5), (2, 1, "b", 0.5), (3, 1, "c", float("nan")),
                               (4, 2, "d", None), (5, 2, "e", 0.1)],
                              "id int, pipeline_id int, model_name string, r2_score double")
    best = {r.pipeline_id: r.model_name for r in se.best_rows(m, "r2_score").collect()}
    assert best == {1: "a", 2: "e"}
    with pytest.raises(ValueError):
        se.goal_of("r2_score", "max")


def test_target_resolution_and_guards(spark):
    df = spark.createDataFrame([(1, 2.0)], "Id int, Price double")
    assert pj.resolve_target(df, " price ") == "Price"
    assert pj.resolve_target(df, "nothing") is None
    with pytest.raises(ValueError):
        pj.require_target(df, "regression", None)
    assert pj.drop_columns(df, ["id", "Price"]).columns == ["Id"]
    with pytest.raises(ValueError):
        io.load(spark, "/nowhere", "xml")
    with pytest.raises(ValueError):
        mo.get_model("svm")


def test_alternatives_and_search_size():
    assert mo.alternative_models("classification", ["logistic_regression", "xgboost"]) == [
        "random_forest", "gradient_boosting", "lightgbm"]
    assert mo.alternative_models("clustering") == []
    assert mo.search_size(mo.PARAM_GRIDS["logistic_regression"]) == 5
    assert mo.search_size(mo.PARAM_GRIDS["xgboost"]) == 15


def test_reply_reading(spark):
    df = spark.createDataFrame([
        ('```json\n{"task": "classification", "target": "placed", "drop_columns": ["student_id"]}\n```',),
        ('{"task": "regression", "target": "sales", "drop_columns": ["a", "b"], "reasoning": "cut he',),
        ('{"target": "x"',)], "t string")
    r = sc.read_replies(df, "t").collect()
    assert (r[0].reply_state, r[0].task, r[0].drop_columns) == ("parsed", "classification", ["student_id"])
    assert (r[1].reply_state, r[1].target, r[1].drop_columns, r[1].reasoning) == ("repaired", "sales", ["a", "b"], None)
    assert r[2].reply_state == "failed" and r[2].task is None


def test_step_difference_for_unsupervised(spark):
    from tabsmith.plans.jobs import make_plan
    meta = {"missing_values": {}, "categorical_features": 1, "numerical_features": 2, "rows": 10}
    steps = make_plan(meta, "clustering")["pipeline_steps"]
    full = make_plan(meta, "regression")["pipeline_steps"]
    df = spark.createDataFrame([(full,)], "s array<string>")
    diff = df.select(F.array_except("s", F.array(F.lit("train_test_split"), F.lit("explainability")))).first()[0]
    assert diff == steps


def test_silhouette_two_clusters(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 1.0], 0), ([10.0, 0.0], 1), ([10.0, 1.0], 1)],
                               "x array<double>, k int")
    s = me.silhouette_sq_euclidean(df, "x", "k").first()[0]
    # a = 1, b = mean(100, 101) = 100.5 for every point
    assert s == pytest.approx(1 - 1 / 100.5)
    assert not math.isnan(s)


def test_nan_counts_as_missing(spark):
    from tabsmith.operators import profile as pr
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "c")], "x double, s string")
    got = {r.column_name: r.missing_ratio for r in pr.missing_ratios(df).collect()}
    assert got == {"x": 0.5, "s": 0.25}
    st = {s["column_name"]: s["n_null"] for s in pr.column_stats(df, exact=True)}
    assert st == {"x": 2, "s": 1}


def test_one_hot_time_is_still_cut_by_position(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 950, 5).otherwise(F.col("id")).alias("ts"), F.lit(1.0).alias("y"))
    got = sp.auto_split(rows, "y", ["id"], "regression", is_time_series=True, time_order=["ts"])
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 700, "val": 150, "eval": 150}
    late = {r.split: r["m"] for r in got.groupBy("split").agg(F.min("ts").alias("m")).collect()}
    assert late["train"] == late["val"] == 5


def test_default_models_do_not_depend_on_rows():
    from tabsmith.operators import models as mo
    from tabsmith.plans.jobs import make_plan
    assert make_plan({"rows": 10 ** 9}, "regression")["models"] == make_plan({"rows": 10}, "regression")["models"]
    assert make_plan({}, "clustering")["models"] == ["kmeans", "dbscan"]
    assert "explainability" not in make_plan({}, "clustering")["pipeline_steps"]
    assert mo.alternative_models("regression", ["XGBoost_regressor"]) == [m for m in mo.REGRESSORS if m != "xgboost_regressor"]


def test_short_typed_row_and_na_tokens(spark, tmp_path):
    from tabsmith.operators import score as sc
    from tabsmith.sources import io
    r = sc.parse_rows(spark.createDataFrame([("4,5",)], "t string"), "t", ["a", "b", "c"]).first()
    assert (r.a, r.b, r.c) == (4.0, 5.0, None)
    (tmp_path / "x.csv").write_text("n,s,f\n10,a,1.5\nNA,NA,NA\n30,b,2\n")
    df = io.load(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"n": "int", "s": "string", "f": "double"}
    assert [x.n for x in df.collect()] == [10, None, 30]


def test_binary_label_has_two_classes(spark):
    from tabsmith.operators import features as fe
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "y string")
    out = fe.label_indexer("y").fit(df).transform(df)
    assert out.schema["label_idx"].metadata["ml_attr"]["vals"] == ["a", "b"]


def test_result_rows_carry_a_time_and_read_errors_show(spark, tmp_path):
    import pytest
    from tabsmith.sources.store import ResultStore
    store = ResultStore(spark, str(tmp_path / "store"))
    assert store.read("pipeline_metadata").count() == 0
    store.append("pipeline_metadata", [(1, 1, "regression", ["a"], ["m"], None)])
    assert store.read("pipeline_metadata").first().timestamp is not None
    (tmp_path / "store" / "predictions").mkdir()
    with pytest.raises(Exception, match="infer schema"):
        store.read("predictions")


def test_replies_cut_at_every_position(spark):
    """The fields whose value had ended before the cut, whatever stands around and inside of them."""
    import json
    fields = [("task", "classification"), ("notes", {"a": [1, {"b": "}]"}], "c": "x, y"}), ("n", -1.5e3), ("target", 'pl"ac\\ed \U0001f600'),
              ("drop_columns", ["a,b", "c\"]"]), ("known", None), ("primary_metric", "f1"), ("optimization_goal", "maximize"), ("reasoning", "{é} [")]
    body, ends = "{", []
    for i, (k, v) in enumerate(fields):
        body += ("" if i == 0 else ", ") + json.dumps(k) + ": " + json.dumps(v, ensure_ascii=False)
        ends.append(len(body) + (1 if not isinstance(v, (str, dict, list)) else 0))    # a number or word ends with what follows it
    body += "}"
    before = "Sure: here [it] is\n```json\n"
    rows = [(n, before + body[:n]) for n in range(len(body) + 1)]
    rows.append((len(body) + 1, before + body + "\n```\nDone {\"task\": 1}"))
    got = {r.n: r for r in sc.read_replies(spark.createDataFrame(rows, "n int, t string"), "t").collect()}
    for n, _ in rows:
        done = {k: v for (k, v), e in zip(fields, ends) if e <= n}
        want = "failed" if "task" not in done else "parsed" if n >= len(body) else "repaired"
        assert got[n].reply_state == want, n
        for k in ("task", "target", "drop_columns", "primary_metric", "optimization_goal", "reasoning"):
            assert getattr(got[n], k) == done.get(k), (n, k)


def test_replies_without_an_object(spark):
    df = spark.createDataFrame([(None,), ("",), ("no object",), ("[1, 2]",), ("{}",), ("}{",), ('{"task"',), ('{"task": "a" junk} x',)], "t string")
    assert {r.reply_state for r in sc.read_replies(df, "t").collect()} == {"failed"}
    assert sc.read_replies(df.limit(0), "t").count() == 0
