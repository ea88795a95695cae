"""Shapley values of tree models, exact for the trees' own row counts.

A leaf gives ``value`` to a row whose features meet the conditions on its path.  With the features of
a set S known, a condition of a known feature counts 1 or 0 and one of an unknown feature counts
the share of training rows that took this way.  The Shapley value of feature i for one leaf is

    value * (o_i - z_i) * sum_k w(k) * [t^k] prod_{j != i} (z_j + o_j t),   w(k) = k! (m-1-k)! / m!

with m features on the path, o the row's 0/1 conditions and z the shares; conditions of one feature are
merged first.  The products grow factor by factor along the path.  They depend on a row through its m
bits only, so a batch evaluates each pattern of bits that occurs once, and looks it up for all rows.  Leaves of few features
are added up beforehand for every combination of intervals between their thresholds (``Tables``), so a row is one lookup per table.

On Spark: the flattened trees (bounded by the model, never by rows) go to all tasks; rows are explained
where they lie, in one map.  ``importance`` passes on one sum per feature and task.

Defined results: a row's contributions and the base (the trees' mean) sum to its score, for
classes of boosted trees on the scale of ``rawPrediction``; a feature that no tree uses gets 0; NaN counts as
smaller than every number in boosted trees and goes right in Spark's (as these score it).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import scratch_path
from .boosting import BoostedTreesModel

SLICE = 8_192      # rows explained at a time


@dataclass
class Path:
    """A leaf: its distinct features, their intervals (low, high], the shares z, and the value per output."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


@dataclass
class Paths:
    """All leaves of an ensemble; the mean of every output; whether NaN goes left."""

    paths: list[Path]
    base: np.ndarray
    n_features: int
    nan_left: bool


def leaves(tree: dict[str, np.ndarray], value: np.ndarray) -> list[Path]:
    """Paths to the leaves of a flattened tree; ``value`` is (nodes x outputs)."""
    out = []
    todo = [(0, {})]
    while todo:
        node, held = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            keys = sorted(held)
            spans = np.array([held[k] for k in keys]).reshape(-1, 3)
            out.append(Path(np.array(keys, np.int64), spans[:, 0], spans[:, 1], spans[:, 2], value[node]))
            continue
        low, high, share = held.get(f, (-np.inf, np.inf, 1.0))
        t, total = float(tree["threshold"][node]), tree["cover"][node]
        for child, a, b in ((int(tree["left"][node]), low, min(high, t)), (int(tree["right"][node]), max(low, t), high)):
            part = tree["cover"][child] / total if total > 0 else 0.5
            todo.append((child, held | {f: (a, b, share * part)}))
    return out


def weights(bits: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley weights (patterns x m) of a leaf of value 1, for rows of 0/1 conditions ``bits``."""
    n, m = bits.shape
    w = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    before = [np.ones((n, 1))]                       # products of the factors before each one
    for j in range(m):
        before.append(_times(before[-1], share[j], bits[:, j]))
    out, after = np.zeros((n, m)), np.ones((n, 1))   # and behind it
    for i in range(m - 1, -1, -1):
        rest = np.zeros((n, m))
        for k in range(after.shape[1]):
            rest[:, k:k + i + 1] += before[i] * after[:, k:k + 1]
        out[:, i] = (bits[:, i] - share[i]) * (rest @ w)
        after = _times(after, share[i], bits[:, i])
    return out


def _times(poly: np.ndarray, z: float, o: np.ndarray) -> np.ndarray:
    """poly * (z + o t), one polynomial per row."""
    out = np.zeros((len(poly), poly.shape[1] + 1))
    out[:, :-1] = z * poly
    out[:, 1:] += o[:, None] * poly
    return out


def explain(paths: Paths, x: np.ndarray) -> np.ndarray:
    """Contributions (rows x outputs x features)."""
    n = len(x)
    out = np.zeros((n, len(paths.base), paths.n_features))
    if paths.nan_left:
        x = np.where(np.isnan(x), -np.inf, x)
    for p in paths.paths:
        m = len(p.features)
        if not m:
            continue
        v = x[:, p.features]
        if paths.nan_left:
            met = ((v > p.low) | (p.low == -np.inf)) & (v <= p.high)
        else:
            met = ((v > p.low) | (p.low == -np.inf) | np.isnan(v)) & ((v <= p.high) | (p.high == np.inf))
        if m <= 24:
            code = met @ (1 << np.arange(m))
            if 1 << m <= 4 * n:
                seen = np.flatnonzero(np.bincount(code, minlength=1 << m))
                back = np.zeros(1 << m, np.int64)
                back[seen] = np.arange(len(seen))
                back = back[code]
            else:
                seen, back = np.unique(code, return_inverse=True)
            bits = (seen[:, None] >> np.arange(m) & 1).astype(np.float64)
        else:
            bits, back = np.unique(met, axis=0, return_inverse=True)
            bits = bits.astype(np.float64)
        phi = weights(bits, p.share)
        for k in np.flatnonzero(p.value):
            out[:, k, p.features] += (phi * p.value[k])[back]
    return out


# ---------------------------------------------------------------- leaves by their cells
CELLS = 1 << 14          # combinations of intervals in a table,
LEAVES_A_TABLE = 4       # which pays for so many leaves at least
TABLE_VALUES = 4 << 20   # values in all tables


@dataclass
class Table:
    """Summed contributions of some leaves by the intervals of their features."""

    features: list[int]
    cuts: list[np.ndarray]
    nan: list[int]           # interval of NaN
    values: np.ndarray       # (outputs x features x cells)


class Tables:
    """Leaves that use the same few features depend on a row only through the intervals between their thresholds: they are
    explained once for every combination of intervals, whatever rows there are, and looked up.  Leaves whose features
    have too many combinations stay as they are (``rest``)."""

    def __init__(self, paths: Paths):
        self.paths, self.tables, rest = paths, [], []
        used: dict[tuple, list[Path]] = {}
        for p in paths.paths:
            if len(p.features):
                used.setdefault(tuple(p.features.tolist()), []).append(p)
        left, room = dict(sorted(used.items(), key=lambda kv: (-len(kv[0]), kv[0]))), TABLE_VALUES
        while left:
            features, group = next(iter(left.items()))
            names, held = set(features), list(group)
            del left[features]
            if self._size(held, names) <= CELLS:
                for other in list(left):               # others whose features go into the same table
                    if self._size(held + left[other], names | set(other)) <= CELLS:
                        names |= set(other)
                        held += left.pop(other)
            size = self._size(held, names) * len(names) * len(paths.base)
            if self._size(held, names) > CELLS or len(held) < LEAVES_A_TABLE or size > room:
                rest += held
                continue
            room -= size
            self.tables.append(self._table(held, sorted(names)))
        self.rest = Paths(rest, paths.base, paths.n_features, paths.nan_left)

    @staticmethod
    def _cuts(held: list[Path], f: int) -> np.ndarray:
        ends = np.concatenate([np.concatenate([p.low[p.features == f], p.high[p.features == f]]) for p in held])
        return np.unique(ends[np.isfinite(ends)])

    def _size(self, held: list[Path], names: set[int]) -> int:
        size = 1
        for f in names:
            size *= len(self._cuts(held, f)) + 1 + (not self.paths.nan_left)
            if size > CELLS:
                break
        return size

    def _table(self, held: list[Path], names: list[int]) -> Table:
        cuts = [self._cuts(held, f) for f in names]
        # a value in each interval: its upper end, then one above all, and NaN where it goes a way of its own
        ends = [np.concatenate([c, [np.inf], [] if self.paths.nan_left else [np.nan]]) for c in cuts]
        grid = np.meshgrid(*ends, indexing="ij")
        x = np.zeros((grid[0].size, self.paths.n_features))
        for f, v in zip(names, grid):
            x[:, f] = v.reshape(-1)
        found = explain(Paths(held, self.paths.base, self.paths.n_features, self.paths.nan_left), x)
        return Table(names, cuts, [0 if self.paths.nan_left else len(c) + 1 for c in cuts], np.ascontiguousarray(found[:, :, names].transpose(1, 2, 0)))

    def explain(self, x: np.ndarray) -> np.ndarray:
        """As the function ``explain``."""
        out = explain(self.rest, x) if self.rest.paths else np.zeros((len(x), len(self.paths.base), self.paths.n_features))
        for t in self.tables:
            cell = np.zeros(len(x), np.int64)
            for f, c, nan in zip(t.features, t.cuts, t.nan):
                v = x[:, f]
                cell *= len(c) + 1 + (not self.paths.nan_left)
                cell += np.where(np.isnan(v), nan, np.searchsorted(c, v, side="left"))
            for k, output in enumerate(t.values):
                for f, value in zip(t.features, output):
                    out[:, k, f] += value.take(cell)
        return out


# ---------------------------------------------------------------- models
def _spark_trees(model, spark) -> tuple[list[tuple[dict, np.ndarray, float]], int]:
    """(flattened tree, node values x outputs, weight) of Spark's tree models, from their saved nodes."""
    path = scratch_path(spark, "explained-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        nodes = data.select("treeID", "nodeData.*").toPandas()
        given = getattr(model, "treeWeights", None) or [1.0] * int(nodes["treeID"].max() + 1)
    else:
        nodes, given = data.toPandas().assign(treeID=0), [1.0]
    classes = getattr(model, "numClasses", 0) if "Classification" in type(model).__name__ and "GBT" not in type(model).__name__ else 0
    if "RandomForest" in type(model).__name__:
        given = [1.0 / len(given)] * len(given)
    out = []
    for tree, g in nodes.groupby("treeID"):
        g = g.sort_values("id").reset_index(drop=True)
        place = {int(i): k for k, i in enumerate(g["id"])}
        split = list(g["split"])
        inner = g["leftChild"].to_numpy() >= 0
        feature = np.array([s["featureIndex"] if on else -1 for s, on in zip(split, inner, strict=True)])
        left = np.array([place[int(i)] if on else -1 for i, on in zip(g["leftChild"], inner, strict=True)])
        right = np.array([place[int(i)] if on else -1 for i, on in zip(g["rightChild"], inner, strict=True)])
        threshold = np.zeros(len(g))
        for k in np.flatnonzero(inner):
            held = list(split[k]["leftCategoriesOrThreshold"])
            if split[k]["numCategories"] < 0:
                threshold[k] = held[0]
            elif split[k]["numCategories"] == 2 and len(held) == 1:      # a 0/1 feature: the category that goes left
                threshold[k] = 0.5
                if held[0] == 1:
                    left[k], right[k] = right[k], left[k]
            else:
                raise ValueError("features with more than two categories can't be explained; encode them first")
        if classes:
            stats = np.array([np.asarray(s, np.float64) for s in g["impurityStats"]])
            value = stats / np.maximum(stats.sum(1, keepdims=True), 1e-300)
        else:
            value = g["prediction"].to_numpy(np.float64)[:, None]
        out.append(({"feature": feature, "threshold": threshold, "left": left, "right": right, "cover": g["rawCount"].to_numpy(np.float64)},
                    value, float(given[int(tree)])))
    return out, int(model.numFeatures)


def paths_of(model, spark) -> Paths:
    """Leaves of a boosted model of this package, or of Spark's decision trees, forests and boosted trees (scores: class
    shares of trees and forests, margins of boosted classifiers, predictions of regressors)."""
    if isinstance(model, BoostedTreesModel):
        start = np.array(model.start, np.float64)
        found, n = [], model.numFeatures
        for k, t in model.trees():
            value = np.zeros((len(t["feature"]), len(start)))
            value[:, k] = t["value"]
            found.append((t, value, 1.0))
    else:
        found, n = _spark_trees(model, spark)
        start = np.zeros(found[0][1].shape[1] if found else 1)
    paths, base = [], start.copy()
    for t, value, weight in found:
        made = leaves(t, value * weight)
        paths += made
        for p in made:
            base += p.value * np.prod(p.share)
    return Paths(paths, base, n, isinstance(model, BoostedTreesModel))


def _array(df: DataFrame, features: str):
    return F.col(features) if isinstance(df.schema[features].dataType, ArrayType) else vector_to_array(features)


def contributions(model, df: DataFrame, features: str = "features", output: str = "contributions") -> DataFrame:
    """``df`` with an array per output: the contribution of each feature, then the base."""
    paths = paths_of(model, df.sparkSession)
    tables = Tables(paths)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                x = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                phi = tables.explain(x)
                whole = np.concatenate([phi, np.broadcast_to(paths.base[None, :, None], (*phi.shape[:2], 1))], 2)
                n, outputs, width = whole.shape
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * outputs * width + 1, width), pa.int32()), pa.array(whole.reshape(-1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * outputs + 1, outputs), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["row", output])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != features]).alias("row"), _array(df, features).alias("x"))
    schema = StructType([rows.schema["row"], StructField(output, ArrayType(ArrayType(DoubleType())))])
    return rows.mapInArrow(run, schema).select("row.*", output)


def importance(model, df: DataFrame, names: list[str], features: str = "features") -> dict[str, float]:
    """Mean absolute contribution of each feature over all rows (and outputs); no rows give 0."""
    paths = paths_of(model, df.sparkSession)
    tables = Tables(paths)

    def run(batches):
        total, n = np.zeros(paths.n_features), 0
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                x = np.asarray(part.column(0).flatten(), np.float64).reshape(part.num_rows, -1)
                total += np.abs(tables.explain(x)).mean(1).sum(0)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(paths.n_features)), pa.array(total), pa.array(np.full(paths.n_features, n))],
                                         names=["feature", "total", "n"])

    got = (df.select(_array(df, features).alias("x")).mapInArrow(run, "feature long, total double, n long")
           .groupBy("feature").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("v")).collect())
    held = {r["feature"]: r["v"] for r in got}
    return {name: float(held.get(i, 0.0)) for i, name in enumerate(names)}
