"""Connected components by repeated contraction, without collecting any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    In each round every node is replaced by its smallest neighbour (or itself), edges are
    rewritten and made distinct, until none is left; then the rounds' maps are applied in
    order.  Every round's tables are written, so a lost executor repeats one round at most.
    ``max_rounds`` is a guard: a chain of n nodes takes about log n rounds.
    """
    spark = edges.sparkSession
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                           .select("node", F.least("node", "m").alias("to")), "contract")
        maps.append(step)
        left = materialize(
            left.join(step.toDF("a", "ta"), "a").join(step.toDF("b", "tb"), "b").filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    out = maps[0].select("node", F.col("to").alias("component"))
    for step in maps[1:]:
        out = out.join(step.toDF("component", "_to"), "component", "left").select(
            "node", F.coalesce("_to", "component").alias("component"))
    return materialize(out, "components")
