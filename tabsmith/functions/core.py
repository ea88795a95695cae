"""Column-level helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Text layouts tried (in this order) when a string column is
# read as a date/time, after Spark's own ISO cast.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "dd-MMM-yyyy",
    "yyyyMMdd",
]


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_categorical(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def is_time(dt: T.DataType) -> bool:
    return isinstance(dt, TIME_TYPES)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL once at load, so later aggregates skip missing like pandas."""
    repl = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            repl[f.name] = F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
    return df.withColumns(repl) if repl else df


def parse_timestamp(c: Column | str) -> Column:
    """Text (or time) -> timestamp, NULL when no known layout matches."""
    col = F.col(c) if isinstance(c, str) else c
    s = col.cast("string")
    tries = [F.try_to_timestamp(s)] + [F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS]
    return F.coalesce(*tries)


def order_hash(*cols: Column | str, seed: int = 42) -> Column:
    """Repeatable pseudo-random order key: md5 of the seed and the key columns."""
    parts = [F.lit(str(seed))] + [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"),
                                             F.lit("\u0000")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_unit(*cols: Column | str, seed: int = 42) -> Column:
    """Repeatable uniform number in [0, 1) from key columns (no shuffle needed)."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every float/double column (used for oracle comparisons and reports)."""
    repl = {f.name: F.round(F.col(f.name), digits) for f in df.schema.fields
            if isinstance(f.dataType, FLOAT_TYPES)}
    return df.withColumns(repl) if repl else df


def py_round(c: Column, digits: int = 0) -> Column:
    """Round half to even, as Python's round()."""
    return F.bround(c, digits)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a frame has fewer partitions than the cluster
    can run at once (e.g. one large unsplittable file) and the next step is
    CPU-heavy per row.  On a large input this is a no-op."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
