"""Registry plumbing: every checked query is (spark, sf_dir) -> DataFrame plus
its DuckDB SQL twin.  Doubles are rounded to 4 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.core import nan_to_null, round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def register(name: str, sql: str | None = None, rounded: bool = True):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with oracle ``sql``."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return round_doubles(out, 4) if rounded else out

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run

    return deco


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_FLOAT_TYPES = ("DOUBLE", "FLOAT", "REAL")


def rounded_oracle(sql_by_name: dict[str, str], sample_dir: str | None = None) -> dict[str, str]:
    """Wrap each SQL so its floating columns are rounded to 4 places, like the Spark side.

    Column types come from DuckDB ``DESCRIBE`` (binding only) over the test
    tables; a query that cannot be described is returned unchanged.
    """
    import glob
    import os
    try:
        import duckdb
    except ImportError:
        return dict(sql_by_name)
    cands = [sample_dir] if sample_dir else sorted(glob.glob("/root/testdata/sf*"))
    base = next((d for d in cands if d and os.path.exists(os.path.join(d, "region.parquet"))), None)
    if base is None:
        return dict(sql_by_name)
    con = duckdb.connect()
    for t in _TABLES:
        p = os.path.join(base, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    out = {}
    for name, sql in sql_by_name.items():
        try:
            desc = con.execute(f"DESCRIBE {sql}").fetchall()
        except Exception:  # noqa: BLE001
            out[name] = sql
            continue
        floats = [r[0] for r in desc if str(r[1]).upper() in _FLOAT_TYPES
                  or str(r[1]).upper().startswith("DECIMAL")]
        if not floats:
            out[name] = sql
            continue
        repl = ", ".join(f'CAST(round("{c}", 4) AS DOUBLE) AS "{c}"' for c in floats)
        out[name] = f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS __q"
    con.close()
    return out
