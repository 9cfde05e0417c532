"""Maximum spanning forests of weighted graphs, in Borůvka rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import discard, materialize
from plumbline.operators.graph import connected_components


def maximum_spanning_forest(edges: DataFrame, order: list[str]) -> DataFrame:
    """The edges of a maximum spanning tree of each component of ``edges`` (``a``, ``b``, and the numbers in ``order``).

    An edge is stronger than another if it is larger in the first column of ``order`` in which they
    differ; equals go by the smaller ``a``, then the smaller ``b`` (ids are numbers, ``a`` < ``b``
    after swapping), so the forest is unique. Each round every component takes its strongest edge
    to another one, and what these edges connect becomes one component: components at least halve,
    so rounds grow with the logarithm of the nodes. Edges within a component are dropped and of
    parallel ones the strongest stays, so that what a round moves shrinks; a node with very many
    edges is combined before the shuffle. Loops and null ends are ignored, null weights are the
    weakest. Returns ``a``, ``b`` and the columns of ``order``.
    """
    first, second = F.least("a", "b"), F.greatest("a", "b")
    rows = edges.filter("a is not null and b is not null and a <> b").select(F.struct(*order, (-first).alias("a"), (-second).alias("b")).alias("e"))
    left = materialize(_strongest(rows.select((-F.col("e.a")).alias("ca"), (-F.col("e.b")).alias("cb"), "e")), "tree-edges")
    forest = []
    while not left.isEmpty():
        ends = left.select(F.col("ca").alias("c"), "ca", "cb", "e").unionByName(left.select(F.col("cb").alias("c"), "ca", "cb", "e"))
        best = ends.groupBy("c").agg(F.max(F.struct("e", "ca", "cb")).alias("m")).select("m.e", "m.ca", "m.cb").distinct()
        taken = materialize(best, "tree-round")
        forest.append(taken.select("e"))
        merged = materialize(connected_components(taken, "ca", "cb"), "tree-components")
        into = lambda side, to: merged.select(F.col("node").alias(side), F.col("component").alias(to))
        moved = left.join(into("ca", "na"), "ca").join(into("cb", "nb"), "cb").filter("na <> nb")
        last, left = left, materialize(_strongest(moved.select(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb"), "e")), "tree-edges")
        discard(last)
        discard(merged)
    if not forest:
        return edges.select("a", "b", *order).limit(0)
    return reduce(DataFrame.unionByName, forest).select((-F.col("e.a")).alias("a"), (-F.col("e.b")).alias("b"), *[F.col(f"e.{c}").alias(c) for c in order])


def _strongest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ca", "cb").agg(F.max("e").alias("e"))
