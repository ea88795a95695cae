"""All checked queries: ``QUERIES`` name -> (spark, sf_dir) -> DataFrame, ``ORACLE`` name -> SQL."""

from importlib import import_module

from ._base import ORACLE, QUERIES

_MODULES = ["timeseries", "profile", "splits", "metrics", "features", "sources", "models"]

for _m in _MODULES:
    import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "ORACLE"]
