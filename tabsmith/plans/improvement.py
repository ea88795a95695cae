"""Improvement of a run's model as a table of attempts.

The possible attempts are listed first (``candidates``): a grid search, the untried models of
the family, and changed training data.  Each fitted one adds a row to the table of trials; after
each row the gate (H7) and the improvement over the trials before it (H8) are computed on that
table, and the first trial that passes the gate ends the job.  A trial that fails is a row, too,
with its error among the parameters; its score is NULL and never wins.

All trials use the metric and goal of the run, its class weights and its saved baseline.  The
best improving trial is saved as a bundle (preprocessing, labels, model) of its own.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from ..operators import features as fe
from ..operators import improve as im
from ..operators import models as mo
from ..operators import oversample as ov
from ..operators import split as sp
from ..operators.bundle import Bundle
from ..session import scratch_path
from ..sources.store import ResultStore

TRIAL = "seq int, attempt int, strategy string, model_name string, score double, baseline double"


@dataclass
class Trial:
    attempt: int
    strategy: str
    model_name: str | None              # None: the model of the best trial so far
    run: object                         # (name) -> (bundle, validation table, parameters)
    bundle: Bundle | None = None
    score: float | None = None
    seconds: float = 0.0
    parameters: dict = field(default_factory=dict)


@dataclass
class Data:
    """What the trials are fitted on and scored with."""
    train_raw: DataFrame
    val_raw: DataFrame
    spec: fe.FeatureSpec
    base: Bundle
    keys: list[str]
    weighted: bool
    train: DataFrame | None = None
    val: DataFrame | None = None

    @property
    def row_keys(self) -> list[str]:
        return [f"key_{i}" for i in range(len(self.keys))]

    def tables(self, bundle: Bundle, name: str) -> tuple[DataFrame, DataFrame]:
        return tuple(materialize(bundle.table(d, self.keys), f"improve-{part}-{name}")
                     for part, d in (("train", self.train_raw), ("val", self.val_raw)))

    def weights(self, train: DataFrame) -> tuple[DataFrame, str | None]:
        if not self.weighted:
            return train, None
        label = self.base.label
        return fe.with_class_weights(train, fe.class_weights(train, label), label, "weight"), "weight"


def _fit(data: Data, bundle: Bundle, train: DataFrame, name: str) -> Bundle:
    train, weight = data.weights(train)
    est = mo.get_model(name, bundle.task, n_classes=bundle.n_classes, n_rows=train.count(), label=bundle.label,
                       weight=weight)
    return bundle.with_model(est.fit(train))


def _search(data: Data, metric: str, goal: str, seed: int, name: str):
    train, weight = data.weights(data.train)
    b = data.base
    model, tried, best = im.random_search(train, name, b.task, b.label, b.n_classes, train.count(), data.row_keys,
                                          metric, goal, weight, seed)
    return b.with_model(model), data.val, {"settings": len(tried), **tried[best][0]}


def _other_model(data: Data, name: str):
    return _fit(data, data.base, data.train, name), data.val, {}


def _changed_data(data: Data, seed: int, name: str):
    """H6: without correlated numeric columns (H4), small classes filled up (H5, J-e)."""
    gone = {r["column_name"] for r in im.correlated_columns(data.train_raw, data.spec.numerical).collect()}
    spec = replace(data.spec, numerical=[c for c in data.spec.numerical if c not in gone])  # Q12: text stays text
    fitted = fe.fit_features(data.train_raw, spec)
    bundle = replace(data.base, features=fitted.model, names=fitted.names, model=None)
    train, val = data.tables(bundle, "changed")
    added = 0
    if bundle.label == "label_idx" and len(spec.numerical) >= 2:
        wide = train.withColumn("features", vector_to_array("features"))
        rows = materialize(ov.oversample(wide, bundle.label, "features", data.row_keys, seed=seed), "improve-oversampled")
        added = rows.where("synthetic").count()
        train = rows.select(array_to_vector("features").alias("features"), bundle.label)
    return _fit(data, bundle, train, name), val, {"dropped": ",".join(sorted(gone)), "synthetic_rows": added}


def candidates(data: Data, name: str, metric: str, goal: str, seed: int) -> list[Trial]:
    """All attempts in order: one row per model that may be fitted."""
    rows = [Trial(1, "hyperparameter_tuning", name, partial(_search, data, metric, goal, seed))] \
        if name in mo.PARAM_GRIDS else []
    rows += [Trial(2, "alternative_model", other, partial(_other_model, data))
             for other in mo.alternative_models(data.base.task, [name])]
    return rows + [Trial(3, "data_improvement", None, partial(_changed_data, data, seed))]


def judged(spark: SparkSession, trials: list[Trial], baseline: float | None, task: str, metric: str, goal: str,
           threshold: float) -> list:
    """The trials in order with ``passed`` (H7) and ``improved`` (H8)."""
    rows = [(i, t.attempt, t.strategy, t.model_name, t.score, baseline) for i, t in enumerate(trials)]
    table = spark.createDataFrame(rows, TRIAL).withColumn("run", F.lit(0)).withColumn(
        "passed", im.meets_threshold(F.col("score"), task, metric, goal, threshold))
    return im.attempt_improvements(table, "score", goal, "run", "seq", "baseline").orderBy("seq").collect()


def improve(spark: SparkSession, result, spec: fe.FeatureSpec, model_name: str | None = None,
            threshold: float | None = None, seed: int = 42, max_attempts: int = 3) -> dict:
    """J3.  Returns the final model's name, scores and the judged attempts; an improved bundle is
    added to ``result.model_paths`` as ``<model>_improved`` (Q22)."""
    if result.task not in im.THRESHOLDS:
        return {"improved": False, "attempts": [], "reason": "no quality gate for this task"}
    metric, goal, bar = im.gate_of(result.task, result.metric, result.goal, threshold)
    parts = spark.read.parquet(result.splits_path)
    name = model_name or result.best_model
    base = Bundle.load(spark, result.model_paths[name])
    data = Data(sp.part(parts, "train"), sp.part(parts, "val"), spec, replace(base, model=None), result.keys,
                "handle_imbalance" in result.plan["pipeline_steps"])
    data.train, data.val = data.tables(data.base, "base")
    score = lambda b, t: im.score_of(b.model.transform(t), b.task, metric, b.label, b.n_classes)
    baseline = score(base, data.val)
    report = {"baseline_score": baseline, "final_score": baseline, "model_name": name, "improved": False,
              "evaluation_score": None, "attempts": [], "metric": metric}
    first = judged(spark, [Trial(0, "baseline", name, None, base, baseline)], None, result.task, metric, goal, bar)
    if first[0]["passed"]:
        return report | {"already_passed": True}

    done, verdicts, best = [], [], Trial(0, "baseline", name, None, base, baseline)
    for trial in candidates(data, name, metric, goal, seed):
        if trial.attempt > max_attempts:
            break
        trial.model_name = trial.model_name or best.model_name
        start = time.perf_counter()
        try:
            trial.bundle, table, trial.parameters = trial.run(trial.model_name)
            trial.seconds = time.perf_counter() - start
            trial.score = score(trial.bundle, table)
        except Exception as e:  # noqa: BLE001 - a failed trial is a row of the table, with its error
            trial.parameters = {"error": repr(e)[:500]}
        done.append(trial)
        verdicts = judged(spark, done, baseline, result.task, metric, goal, bar)
        if verdicts[-1]["improved"]:
            best = trial
        if verdicts[-1]["passed"]:
            break

    held_out = None
    if best.strategy != "baseline":
        held_out = score(best.bundle, best.bundle.table(sp.part(parts, "eval")))     # Q15
        path = scratch_path(spark, f"model-{result.run_id}-{best.model_name}-improved")
        result.model_paths[f"{best.model_name}_improved"] = best.bundle.save(spark, path)
    rows = [(result.run_id * 1000 + 500 + v["seq"], result.run_id, None, v["model_name"], v["strategy"], v["attempt"],
             {k: str(x) for k, x in t.parameters.items()}, v["score"], held_out if t is best else None,
             round(t.seconds, 2), v["improved"]) for t, v in zip(done, verdicts)]
    if rows:
        ResultStore(spark, result.store_root).append("model_runs", rows)
    return report | {"already_passed": False, "improved": best.strategy != "baseline", "final_score": best.score,
                     "evaluation_score": held_out, "model_name": best.model_name,
                     "attempts": [v.asDict() | {"validation_score": v["score"], "parameters": t.parameters}
                                  for t, v in zip(done, verdicts)]}
