"""Parts of an ordered table cut at exact positions, by selecting the keys at the cuts.

Sorting a table only to cut it in two or three parts moves and writes every row.  Here

1. one aggregate per group (no sort) counts the rows and brackets each cut with a quantile summary;
2. one pass counts the rows before each bracket and numbers only the keys inside it (about
   2 * ``MARGIN`` of the table) in a range-partitioned order, which gives the key at the cut;
3. each row compares its own key with the keys at the cuts.  The table is neither sorted nor shuffled.

Rows that share the key at a cut are numbered among themselves, so parts have exact sizes even where a
key value repeats.  Groups that are small, or whose leading key has NULL or NaN values or no numeric form,
are numbered whole, keys only; so is a group whose summary missed the cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import materialize, with_global_index

MARGIN = 0.001        # half width of a bracket as a share of the group
ACCURACY = 10_000     # rank error of the quantile summary: 1 / ACCURACY, a tenth of the margin
WHOLE = 4_000         # rows up to which a group is numbered whole


def small(df: DataFrame, limit: int = 100_000) -> bool:
    """Size check before broadcasting a per-group table."""
    return df.limit(limit + 1).count() <= limit


def _meet(df: DataFrame, per_group: DataFrame) -> DataFrame:
    return df.join(F.broadcast(per_group) if small(per_group) else per_group, "_g", "left")


def _number_leads(df: DataFrame, lead: str) -> Column:
    kind = df.schema[lead].dataType.typeName()
    col = F.col(lead)
    if kind in ("float", "double"):
        return F.when(~F.isnan(col), col)
    if kind in ("byte", "short", "integer", "long", "decimal", "date", "timestamp", "timestamp_ntz"):
        return col
    return F.lit(None).cast("long")


def _places(keys: DataFrame, groups: DataFrame, n_cuts: int) -> DataFrame:
    """(_g, j, k, pos, c): exact positions of the keys inside the bracket of cut j at position c."""
    met = keys.join(F.broadcast(groups) if small(groups) else groups, "_g")
    inside = [F.col("whole") | F.col("lead").between(F.col("q")[2 * j], F.col("q")[2 * j + 1]) for j in range(n_cuts)]
    before = [F.coalesce(F.sum((~F.col("whole") & (F.col("lead") < F.col("q")[2 * j])).cast("long")), F.lit(0))
              for j in range(n_cuts)]
    less = met.groupBy("_g").agg(F.array(*before).alias("less"))
    cut = F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(j)) for j, hit in enumerate(inside)])))
    order = [F.col("_g"), F.col("j"), F.col("k")]
    # written before it is ordered: the sampling of the order would read the whole table once more
    idx = with_global_index(materialize(met.select("_g", "k", cut.alias("j")), "cut-brackets"), order, "i")
    start = idx.groupBy("_g", "j").agg(F.min("i").alias("start")).join(less, "_g").join(groups.select("_g", "c"), "_g")
    start = start.select("_g", "j", (F.get("less", F.col("j")) - F.col("start")).alias("shift"),
                         F.get("c", F.col("j")).alias("c"))
    return idx.join(F.broadcast(start) if small(start) else start, ["_g", "j"]).select(
        "_g", "j", "k", (F.col("i") + F.col("shift")).alias("pos"), "c")


def _cut_keys(keys: DataFrame, groups: DataFrame, n_cuts: int) -> DataFrame:
    """(_g, j, last, tied, p0): the last key before cut j, whether the next row shares it, and the
    position of its first row."""
    places = materialize(_places(keys, groups, n_cuts), "cut-places")
    ends = places.where((F.col("pos") == F.col("c") - 1) | (F.col("pos") == F.col("c"))).groupBy("_g", "j").agg(
        F.max_by("k", F.when(F.col("pos") < F.col("c"), F.col("pos"))).alias("last"),
        F.max_by("k", F.when(F.col("pos") == F.col("c"), F.col("pos"))).alias("next"),
        F.count_if(F.col("pos") < F.col("c")).alias("found"))
    ends = ends.where("found > 0").withColumn(
        "tied", F.col("next").isNotNull() & F.col("last").eqNullSafe(F.col("next")))
    ends = materialize(ends.select("_g", "j", "last", "tied"), "cut-ends")
    tied = places.join(ends.where("tied"), ["_g", "j"]).where(F.col("k").eqNullSafe(F.col("last")))
    p0 = tied.groupBy("_g", "j").agg(F.min("pos").alias("p0"))
    return ends.join(p0, ["_g", "j"], "left")


def parts_by_cuts(df: DataFrame, order: list[Column], cuts: list[tuple[float, Callable[[Column], Column]]],
                  group: str | None = None, lead: Column | None = None, name: str = "_part") -> DataFrame:
    """``df`` with ``name``: the number of cuts at or before the row's position in ``order`` (0-based, per
    ``group``).  A cut is (share, n -> position), rising, the position within a row of share * n.  ``lead``: a
    number that never falls along ``order`` (default: its first column)."""
    cols, n_cuts = df.columns, len(cuts)
    df = df.withColumn("_g", F.lit(0) if group is None else F.col(group)).withColumn(
        "_k", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    keys = df.select("_g", F.col("_k").alias("k"), (order[0] if lead is None else lead).alias("lead"))
    keys = keys.withColumn("lead", _number_leads(keys, "lead"))
    shares = [min(1.0, max(0.0, f + m)) for f, _ in cuts for m in (-MARGIN, MARGIN)]
    groups = keys.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.count("lead").alias("m"),
                                    F.percentile_approx("lead", shares, ACCURACY).alias("q"))
    groups = groups.withColumn("c", F.array(*[at(F.col("n")).cast("long") for _, at in cuts])).withColumn(
        "whole", (F.col("n") <= WHOLE) | (F.col("m") < F.col("n")))
    groups = materialize(groups, "cut-groups")
    found = materialize(_cut_keys(keys, groups, n_cuts), "cut-keys")
    wanted = groups.select("_g", F.posexplode("c").alias("j", "at")).where("at > 0")
    missed = wanted.join(found, ["_g", "j"], "left_anti").select("_g").distinct()
    if not missed.isEmpty():
        again = groups.join(missed, "_g", "left_semi").withColumn("whole", F.lit(True))
        found = found.join(missed, "_g", "left_anti").unionByName(_cut_keys(keys, again, n_cuts))
    wide = found.groupBy("_g").agg(*[F.max_by(F.struct("last", "tied", "p0"), F.when(F.col("j") == j, 1)).alias(f"_c{j}")
                                     for j in range(n_cuts)])
    wide = materialize(groups.select("_g", F.col("c").alias("_at")).join(wide, "_g", "left"), "cut-table")
    out = _meet(df, wide)
    part = sum((F.when(F.col("_k") <= F.col(f"_c{j}.last"), 0).otherwise(1) for j in range(n_cuts)), F.lit(0))
    if not wide.where(" or ".join(f"_c{j}.tied" for j in range(n_cuts))).isEmpty():
        at_cut = [F.coalesce(F.col(f"_c{j}.tied") & F.col("_k").eqNullSafe(F.col(f"_c{j}.last")), F.lit(False))
                  for j in range(n_cuts)]
        first = F.coalesce(*[F.when(hit, F.col(f"_c{j}.p0")) for j, hit in enumerate(at_cut)])
        out = out.withColumn("_first", first)
        same = with_global_index(materialize(out.where("_first is not null"), "cut-shared"), [F.col("_g"), F.col("_k")], "_i")
        start = same.groupBy("_g", "_k").agg(F.min("_i").alias("_start"))
        same = same.join(start, (same["_g"] == start["_g"]) & same["_k"].eqNullSafe(start["_k"])).drop(
            start["_g"], start["_k"])
        pos = F.col("_i") - F.col("_start") + F.col("_first")
        by_place = sum((F.when(pos < F.col("_at")[j], 0).otherwise(1) for j in range(n_cuts)), F.lit(0))
        return out.where("_first is null").withColumn(name, part).select(*cols, name).unionByName(
            same.withColumn(name, by_place).select(*cols, name))
    return out.withColumn(name, part).select(*cols, name)
