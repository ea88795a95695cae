"""Global order without a single-task window.

An unpartitioned ``Window.orderBy`` moves every row into one task.  These
helpers instead range-partition the data on a total order (Spark samples the
keys, so a hot key value is spread over many partitions), number rows inside
each partition, and add per-partition offsets.  The offset table has one row
per partition — its size is bounded by the partition count, not by the data —
so it is safe to broadcast.

The sorted frame is written once under the shared checkpoint folder so that
partition ids and positions are fixed before offsets are computed (lineage cut;
a lost executor recomputes from the written table, not from the sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (lineage cut)."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sorted_with_position(df: DataFrame, order: list[Column | str],
                         num_partitions: int | None = None,
                         write: bool = True) -> DataFrame:
    """Range-partition + sort on ``order``; add ``_pid`` and in-partition ``_pos``."""
    n = _num_partitions(df, num_partitions)
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = s.withColumn("_ord_pid", F.spark_partition_id()).withColumn(
        "_ord_mid", F.monotonically_increasing_id())
    # monotonically_increasing_id = (partition << 33) + position in partition
    s = s.withColumn("_ord_pos", F.col("_ord_mid") - F.shiftleft(F.col("_ord_pid").cast("long"), 33)).drop("_ord_mid")
    if write:
        s = materialize(s, "sorted")
    return s


def with_global_index(df: DataFrame, order: list[Column | str], index_col: str = "_idx",
                      num_partitions: int | None = None, write: bool = True) -> DataFrame:
    """Add a 0-based dense position over the total order ``order``.

    ``order`` must be a total order (end it with a unique key) for the result
    to be repeatable.
    """
    s = sorted_with_position(df, order, num_partitions, write)
    counts = s.groupBy("_ord_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window below runs on a table of at most
    # num_partitions rows, never on the data.
    w = Window.orderBy("_ord_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_ord_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_ord_off"))
    out = s.join(F.broadcast(offsets), "_ord_pid").withColumn(
        index_col, (F.col("_ord_off") + F.col("_ord_pos")).cast("long"))
    return out.drop("_ord_pid", "_ord_pos", "_ord_off")


def with_prefix_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column],
                     inclusive: bool = True, num_partitions: int | None = None,
                     write: bool = True) -> DataFrame:
    """Running totals of ``sums`` (name -> numeric column) over the total order.

    Within a partition a window partitioned by the Spark partition id runs over
    rows one task already holds; carries from earlier partitions come from a
    per-partition totals table (bounded by the partition count, broadcast).
    """
    tmp = {name: f"_v_{name}" for name in sums}
    base = df.withColumns({tmp[k]: v for k, v in sums.items()})
    s = sorted_with_position(base, order, num_partitions, write)
    totals = s.groupBy("_ord_pid").agg(*[F.sum(tmp[k]).alias(f"_t_{k}") for k in sums])
    w_all = Window.orderBy("_ord_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_ord_pid", *[
        F.coalesce(F.sum(f"_t_{k}").over(w_all), F.lit(0)).alias(f"_c_{k}") for k in sums])
    frame_end = 0 if inclusive else -1
    w_in = Window.partitionBy("_ord_pid").orderBy("_ord_pos").rowsBetween(Window.unboundedPreceding, frame_end)
    out = s.join(F.broadcast(carry), "_ord_pid")
    out = out.withColumns({
        k: F.col(f"_c_{k}") + F.coalesce(F.sum(tmp[k]).over(w_in), F.lit(0)) for k in sums
    })
    drop = ["_ord_pid", "_ord_pos"] + list(tmp.values()) + [f"_c_{k}" for k in sums]
    return out.drop(*drop)
