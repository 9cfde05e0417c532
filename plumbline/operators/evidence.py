"""Evidence of a sample gathered into one row, and texts made from and checked against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize


def sample_detail(samples: DataFrame, findings: DataFrame, families: DataFrame, members: DataFrame, leaks: DataFrame) -> DataFrame:
    """One row per sample with its findings (sorted), family and leak risk; ``members`` maps sample_id to family_id."""
    found = findings.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "finding", "severity"))), ";").alias("findings"))
    return (
        samples.select("sample_id", "label", "split")
        .join(found, "sample_id", "left")
        .join(members, "sample_id", "left")
        .join(families.select("family_id", "size"), "family_id", "left")
        .join(leaks.select("family_id", "risk"), "family_id", "left")
        .select("sample_id", "label", "split", "findings", "family_id", F.col("size").alias("family_size"), "risk")
    )


def narrative(detail: DataFrame) -> DataFrame:
    """A sentence per sample from its evidence alone."""
    parts = F.array_compact(
        F.array(
            F.when(F.col("findings").isNotNull(), F.concat(F.lit("measured issues: "), F.col("findings"))),
            F.when(F.col("family_size").isNotNull(), F.concat(F.lit("one of "), F.col("family_size").cast("string"), F.lit(" copies"))),
            F.when(F.col("risk").isNotNull(), F.concat(F.lit("copies cross splits at "), F.col("risk"), F.lit(" risk"))),
        )
    )
    return detail.select("sample_id", F.when(F.size(parts) > 0, F.concat(F.lit("Sample "), F.col("sample_id").cast("string"), F.lit(": "), F.array_join(parts, ", "), F.lit("."))).otherwise(F.concat(F.lit("Sample "), F.col("sample_id").cast("string"), F.lit(": no issue found."))).alias("text"))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)")), lambda x: x.cast("double"))


def unverified_numbers(claims: DataFrame, text: str, evidence: str) -> DataFrame:
    """Adds ``unverified``: how many numbers of ``text`` are not in the numbers ``evidence``, within 2 % or 0.006, also as per cent; 0 to 3 pass."""
    known = F.col(evidence)
    close = lambda a, b: F.abs(a - b) <= F.greatest(0.02 * F.abs(b), F.lit(0.006))
    stray = F.filter(numbers(F.col(text)), lambda x: ~(x.isin(0.0, 1.0, 2.0, 3.0) | F.exists(known, lambda k: close(x, k) | close(x, 100 * k))))
    return claims.withColumn("unverified", F.size(stray))


def lineage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trees of the families that ``edges`` (a, b, rank: smaller is stronger) connect.

    ``nodes`` has sample_id, family_id and area. The root is the largest area, ties to the smaller
    id; each step attaches every node that has an edge to an attached one by its strongest edge
    (ties to the smaller parent). Returns sample_id, family_id, parent_id and depth. The number
    of steps is the depth of the trees.
    """
    root = nodes.groupBy("family_id").agg(F.max(F.struct("area", (-F.col("sample_id")).alias("i"))).alias("m")).select("family_id", (-F.col("m.i")).alias("sample_id"))
    both = materialize(edges.select("a", "b", "rank").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank")), "lineage-edges")
    done = materialize(root.select("sample_id", "family_id", F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth")), "lineage")
    front, depth = done, 0
    while True:
        depth += 1
        reach = both.join(front.select(F.col("sample_id").alias("a"), "family_id"), "a").join(done.select(F.col("sample_id").alias("b")), "b", "left_anti")
        front = materialize(reach.groupBy("b").agg(F.min(F.struct("rank", "a", "family_id")).alias("m")).select(F.col("b").alias("sample_id"), "m.family_id", F.col("m.a").alias("parent_id"), F.lit(depth).alias("depth")), "lineage-front")
        if front.isEmpty():
            return done
        done = materialize(done.unionByName(front), "lineage")
