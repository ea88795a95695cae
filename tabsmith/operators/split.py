"""Train / validation / evaluation splits.

Result: the input frame plus a ``split`` column ('train', 'val', 'eval') —
one table, written partitioned by ``split`` (S7), instead of six files.

* ``ordered_split``: positional cut (70 % / 85 %) over a total order.
* ``random_split``: exact form cuts the md5(seed, key) order at ceil(0.15 n) and
  ceil(0.176 (n - n_eval)), the sizes of two successive 75/25-style holdouts; the form
  ``method="hash"`` assigns parts from a per-row hash in one pass.
* ``stratified_split``: the same cut inside every class.

  All three select the keys at the cuts (``selection.parts_by_cuts``) and label rows by comparison, so
  the rows themselves are neither sorted nor shuffled.
* ``cv_folds``: fold = per-class position mod k.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import hash_unit, order_hash
from ..functions.ordering import with_global_index
from ..functions.selection import parts_by_cuts, small

EVAL_FRACTION = 0.15
VAL_FRACTION = 0.176      # of the rows left after the evaluation part
ORDERED_CUTS = (0.70, 0.85)


def _keys(key_cols) -> list[str]:
    return [key_cols] if isinstance(key_cols, str) else list(key_cols)


def _named(parts: DataFrame, names: tuple) -> DataFrame:
    return parts.withColumn("split", F.element_at(F.array(*[F.lit(v) for v in names]), F.col("_part") + 1)).drop("_part")


def _hash_cuts(df: DataFrame, keys: list[str], seed: int, eval_fraction: float, val_fraction: float,
               group: str | None = None) -> DataFrame:
    """Evaluation, validation and training parts in md5 order, per group where one is named."""
    h = order_hash(*keys, seed=seed)
    n_eval = lambda n: F.ceil(n * eval_fraction)
    cuts = [(eval_fraction, n_eval),
            (eval_fraction + (1 - eval_fraction) * val_fraction,
             lambda n: n_eval(n) + F.ceil((n - n_eval(n)) * val_fraction))]
    lead = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")      # 60 leading bits, in hash order
    parts = parts_by_cuts(df, [h] + [F.col(k) for k in keys], cuts, group, lead)
    return _named(parts, ("eval", "val", "train"))


def ordered_split(df: DataFrame, order: list[str | Column], cuts=ORDERED_CUTS) -> DataFrame:
    """First int(0.70 n) rows train, next up to int(0.85 n) val, rest eval."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    at = [(cut, lambda n, cut=cut: F.floor(n * cut)) for cut in cuts]
    return _named(parts_by_cuts(df, order, at), ("train", "val", "eval"))


def part_sizes(n: int, eval_fraction=EVAL_FRACTION, val_fraction=VAL_FRACTION) -> tuple[int, int, int]:
    n_eval = int(math.ceil(eval_fraction * n))
    rest = n - n_eval
    n_val = int(math.ceil(val_fraction * rest))
    return rest - n_val, n_val, n_eval


def random_split(df: DataFrame, key_cols, seed: int = 42, method: str = "exact",
                 eval_fraction=EVAL_FRACTION, val_fraction=VAL_FRACTION) -> DataFrame:
    """Random three-way split, repeatable from the key columns and seed."""
    keys = _keys(key_cols)
    if method == "hash":
        u = hash_unit(*keys, seed=seed)
        val_hi = eval_fraction + (1 - eval_fraction) * val_fraction
        return df.withColumn("split", F.when(u < eval_fraction, "eval")
                             .when(u < val_hi, "val").otherwise("train"))
    return _hash_cuts(df, keys, seed, eval_fraction, val_fraction)


def class_positions(df: DataFrame, label: str, key_cols, seed: int = 42) -> DataFrame:
    """Per-class 0-based position in md5 order plus the class size ``_nc``."""
    keys = _keys(key_cols)
    hashed = df.withColumn("_h", order_hash(*keys, seed=seed))
    idx = with_global_index(hashed, [F.col(label), F.col("_h")] + [F.col(k) for k in keys], "_idx")
    # one row per class: at most the number of classes
    starts = idx.groupBy(label).agg(F.min("_idx").alias("_start"), F.count(F.lit(1)).alias("_nc"))
    out = idx.join(F.broadcast(starts), label, "left") if small(starts) else idx.join(starts, label, "left")
    return out.withColumn("_cpos", F.col("_idx") - F.col("_start")).drop("_idx", "_start", "_h")


def stratified_split(df: DataFrame, label: str, key_cols, seed: int = 42,
                     eval_fraction=EVAL_FRACTION, val_fraction=VAL_FRACTION) -> DataFrame:
    """Per-class cut with per-class sizes ceil(0.15 n_c), ceil(0.176 (n_c - eval_c))."""
    return _hash_cuts(df.where(F.col(label).isNotNull()), _keys(key_cols), seed, eval_fraction, val_fraction, label)


def min_class_count(df: DataFrame, label: str) -> int:
    r = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count")).first()[0]
    return int(r or 0)


def auto_split(df: DataFrame, label: str | None, key_cols, task: str, is_time_series: bool = False,
               time_order: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The run's split rule: X5 no label, X1 series, X3 classification (X4 fallback), X2 otherwise.

    One rule at every size: positional cuts over a global order, which range
    partitions the rows on a total order, so a hot time or class is spread.
    """
    if label is None:
        return no_label_split(df)
    df = df.where(F.col(label).isNotNull())  # Q19: rows without a label cannot be scored
    if is_time_series:
        return ordered_split(df, list(time_order or []) + _keys(key_cols))
    if task in ("classification", "nlp_classification") and min_class_count(df, label) >= 2:
        return stratified_split(df, label, key_cols, seed)
    return random_split(df, key_cols, seed)


def no_label_split(df: DataFrame) -> DataFrame:
    """Without a label train = val = eval = the whole set (marked 'all')."""
    return df.withColumn("split", F.lit("all"))


def part(df: DataFrame, name: str) -> DataFrame:
    """Rows of one part; 'all' rows belong to every part."""
    return df.where(F.col("split").isin(name, "all")).drop("split")


def cv_folds(df: DataFrame, label: str | None, key_cols, k: int = 3, seed: int = 42) -> DataFrame:
    """fold = per-class position mod k (plain position when there is no label)."""
    keys = _keys(key_cols)
    if label is None:
        idx = with_global_index(df.withColumn("_h", order_hash(*keys, seed=seed)),
                                [F.col("_h")] + [F.col(c) for c in keys], "_idx")
        return idx.withColumn("fold", (F.col("_idx") % k).cast("int")).drop("_idx", "_h")
    pos = class_positions(df, label, keys, seed)
    return pos.withColumn("fold", (F.col("_cpos") % k).cast("int")).drop("_cpos", "_nc")
