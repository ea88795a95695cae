"""Quality classifier: held-out accuracy, defined results, flattened trees."""

import random

import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import op05_quality as op
from tabsmith.llm.trees import boost, random_forest


def corpus(seed=4, n=900):
    rnd = random.Random(seed)
    vocab = ["the", "river", "and", "stone", "walks", "under", "Moon.", "of", "light,"]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(3, 80))]
        bad = i % 4 == 0
        if bad:
            junk = rnd.choice(["$$$", "!!", " |"])
            w = [x + junk for x in w]
        rows.append((i, " ".join(w), "src"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(5000, None, "s"), (5001, "", "s"), (None, "some text", "s"), rows[0], (5002, "w" * 300_000, "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame([*labels, (0, 0), (1, None), (None, 1), (99999, 1)], "doc_id long, quality int")
    model = op.fit(docs, lab)
    got = op.score(docs, model).withColumn("held", op.held_out("doc_id"))
    assert got.count() == len(rows) + len(odd)
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    right = got.filter("held").join(truth, "doc_id").select(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.97
    assert got.filter("doc_id is null").first().held is False


def test_no_labels_or_one_label(spark):
    rows, labels = corpus(n=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in op.score(docs, op.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in op.score(docs, op.fit(docs, ones)).collect())
    assert op.score(docs.limit(0), op.fit(docs.limit(0), ones)).count() == 0


def test_held_out_rows_never_teach(spark):
    rows, labels = corpus(n=400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    turned = lab.withColumn("quality", F.when(op.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = op.fit(docs, lab), op.fit(docs, turned)
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_trees_against_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    for model, link in ((boost(x, y), lambda r: 1 / (1 + np.exp(-r))), (random_forest(x, y), lambda r: r)):
        raw = model.raw(x)
        for i in range(0, 500, 50):
            total = model.base
            for c, t, leaf in zip(model.column, model.threshold, model.leaf, strict=True):
                at = 0
                while at < len(c):
                    at = 2 * at + (2 if x[i, c[at]] > t[at] else 1)
                total += leaf[at - len(c)]
            assert abs(total - raw[i]) < 1e-9
        assert ((link(raw) >= 0.5) == (y == 1)).mean() > 0.95
