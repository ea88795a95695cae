"""Rows whose class is not in the training part are scored, written and counted as errors."""

import pytest

from tabsmith.operators import features as fe
from tabsmith.operators import improve as im
from tabsmith.operators import metrics as me
from tabsmith.operators.bundle import Bundle
from tabsmith.operators.models import get_model
from tabsmith.plans import jobs


def parts(spark):
    cols = "k int, x double, y string"
    train = spark.createDataFrame([(i, float(i % 2) * 4 + i * 0.01, "ab"[i % 2]) for i in range(40)], cols)
    other = spark.createDataFrame([(100, 0.0, "a"), (101, 4.0, "b"), (102, 4.1, "rare"), (103, 0.1, "odd"), (104, 0.1, None)], cols)
    fitted = fe.fit_features(train, fe.FeatureSpec(numerical=["x"]))
    return train, other, Bundle("classification", "y", fitted.model, ["a", "b"], fitted.names)


def test_unseen_classes_count_as_errors(spark):
    train, other, b = parts(spark)
    t = b.table(train, ["k"])
    assert t.schema["label_idx"].metadata["ml_attr"]["vals"] == ["a", "b"]
    model = get_model("logistic_regression", n_rows=40).fit(t)
    assert model.numClasses == 2
    pred = model.transform(b.table(other, ["k"]))
    got = {r.key_0: r.label_idx for r in pred.collect()}
    assert set(got) == {100, 101, 102, 103} and (got[100], got[101]) == (0.0, 1.0)
    assert got[102] >= 2 and got[103] >= 2 and got[102] != got[103]
    m = jobs.evaluate(pred, "classification", "label_idx", 2)
    assert m["accuracy"] == 0.5
    # four classes: a and b 2/3 each, the unseen ones 0
    assert m["f1_score"] == pytest.approx(1 / 3)
    assert im.score_of(pred, "classification", "f1_score", "label_idx", 2) == pytest.approx(1 / 3)
    assert im.score_of(pred, "classification", "roc_auc", "label_idx", 2) == pytest.approx(m["roc_auc"])


def test_binary_rule_is_not_used_beyond_its_classes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (9.0, 0.0)], "y double, p double")
    assert me.classification_metrics(df, "y", "p", positive=1.0, n_classes=2).first().f1_score == pytest.approx(0.4)
