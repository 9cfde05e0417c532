"""Ranks and running sums over a global order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize


def ranked(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rk`` (from 1) in the given order, and ``{column}_sum``, the sum of each column of ``sums`` up to the row.

    Rows are dealt into consecutive ranges of the order, ranked within them, and moved by what the
    ranges before hold; there is one small row per range. The order should leave no ties.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as ranges
    ahead = held.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}__ahead") for c in ("__n", *(f"__{c}" for c in sums))])
    within = Window.partitionBy("__range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({"__rk": F.row_number().over(within), **{f"__{c}_sum": F.sum(c).over(upto) for c in sums}}).join(ahead, "__range")
    return own.select(*df.columns, (F.col("__rk") + F.col("__n__ahead")).alias("rk"), *[(F.col(f"__{c}_sum") + F.col(f"__{c}__ahead")).alias(f"{c}_sum") for c in sums])
