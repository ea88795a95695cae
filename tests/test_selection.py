from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsmith.functions import selection as se
from tabsmith.operators import split as sp


@pytest.mark.parametrize("whole", [0, 4000])
def test_cut_keys_equal_a_sort(spark, monkeypatch, whole):
    """A class that holds a third of the rows, small classes, a class of one row."""
    monkeypatch.setattr(se, "WHOLE", whole)
    d = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, "one")
        .otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("y"))
    got = {r.id: r.split for r in sp.stratified_split(d, "y", ["id"]).collect()}
    assert len(got) == 3000
    rows = d.withColumn("h", sp.order_hash("id")).collect()
    for y in {r.y for r in rows}:
        mine = sorted((r.h, r.id) for r in rows if r.y == y)
        _, n_val, n_eval = sp.part_sizes(len(mine))
        want = ["eval"] * n_eval + ["val"] * n_val + ["train"] * (len(mine) - n_eval - n_val)
        assert [got[i] for _, i in mine] == want


@pytest.mark.parametrize("whole", [0, 4000])
def test_equal_keys_nulls_and_other_types_keep_exact_sizes(spark, monkeypatch, whole):
    monkeypatch.setattr(se, "WHOLE", whole)
    same = spark.range(1000).select(F.lit(7).alias("t"), F.col("id").alias("payload"))
    assert Counter(r.split for r in sp.ordered_split(same, ["t"]).collect()) == {"train": 700, "val": 150, "eval": 150}
    hot = spark.range(1000).select(F.when(F.col("id") < 600, F.col("id") * 1.0).when(F.col("id") < 900, 600.0)
                                   .otherwise(F.col("id") * 1.0).alias("t"), "id")
    out = sp.ordered_split(hot, ["t"]).collect()
    assert Counter(r.split for r in out) == {"train": 700, "val": 150, "eval": 150} and len({r.id for r in out}) == 1000
    assert {r.split for r in out if r.t < 600} == {"train"} and {r.split for r in out if r.t > 600} == {"eval"}
    gaps = spark.range(100).select(F.when(F.col("id") >= 20, F.lpad(F.col("id").cast("string"), 3, "0")).alias("t"), "id")
    out = {r.id: r.split for r in sp.ordered_split(gaps, ["t", "id"]).collect()}
    assert [out[i] for i in range(100)] == ["train"] * 70 + ["val"] * 15 + ["eval"] * 15      # NULL first
    nan = spark.range(50).select(F.when(F.col("id") < 45, F.col("id") * 1.0).otherwise(float("nan")).alias("t"), "id")
    out = {r.id: r.split for r in sp.ordered_split(nan, ["t", "id"]).collect()}
    assert [out[i] for i in range(50)] == ["train"] * 35 + ["val"] * 7 + ["eval"] * 8         # NaN last
    assert sp.random_split(same.limit(0), ["t"]).count() == 0
    assert [r.split for r in sp.random_split(same.limit(1), ["payload"]).collect()] == ["eval"]


def test_missed_brackets_are_numbered_whole(spark, monkeypatch):
    monkeypatch.setattr(se, "WHOLE", 0)
    monkeypatch.setattr(se, "MARGIN", 0.0)
    monkeypatch.setattr(se, "ACCURACY", 2)
    d = spark.range(500).select("id")
    out = {r.id: r.split for r in sp.ordered_split(d, ["id"]).collect()}
    assert [out[i] for i in range(500)] == ["train"] * 350 + ["val"] * 75 + ["eval"] * 75


def test_the_order_of_a_bracket_samples_only_the_bracket(spark):
    """Sampling the order of the keys in a bracket doesn't read the table once more."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    n = 20_000
    d = spark.range(n).mapInPandas(counted, "id long")
    parts = sp.random_split(d, ["id"])
    assert read.value <= 4 * n
    assert parts.count() == n
