"""Connected components as iterated joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step is one
    aggregation (the minimum neighbour, combined before the shuffle) and one join, so a node
    with very many edges is an ordinary skewed join key that adaptive execution splits; no
    neighbour list is ever gathered. The edge set is written to the shared folder every round,
    which keeps the plan short and survives lost executors; the round before is deleted then.

    Self loops and null ends are ignored; an empty input gives an empty result.
    Returns ``node`` and ``component`` with the type of ``src``.
    """
    current = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct(),
        "components",
    )
    state = _state(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        last, current = current, materialize(small, "components")
        discard(last)
        before, state = state, _state(current)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (row["n"], row["h"])
