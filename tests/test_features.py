from pyspark.ml.functions import vector_to_array

from tabsmith.operators import features as fe


def test_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    fit = fe.fit_features(train, fe.FeatureSpec(categorical=["c"], impute=False))
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    rows = {r.c: r.v for r in fit.transform(new).select("c", vector_to_array("features").alias("v")).collect()}
    assert rows["a"] == [1.0, 0.0] and rows["z"] == [0.0, 0.0]
    assert fit.names == ["c_a", "c_b"]


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert fe.most_frequent(df, "c") == "a"
    out = fe.mode_impute(df, df, ["c"]).collect()
    assert sorted(r.c for r in out) == ["a", "a", "b"]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    out = fe.standard_scale(df, df, ["x", "k"]).collect()
    assert sorted(r.x for r in out) == [-1.0, 1.0] and all(r.k == 0.0 for r in out)
