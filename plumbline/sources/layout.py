"""Splits and labels from the folders of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder names that mean a split.
SPLIT_ALIASES = {
    "train": ("train", "training", "trn"),
    "val": ("val", "valid", "validation", "dev"),
    "test": ("test", "testing", "tst", "holdout"),
}


def assign_layout(paths: DataFrame) -> DataFrame:
    """``path``, ``split``, ``label``, ``layout`` and ``reason`` (why a file has no label).

    One folder that all paths share is dropped, if some path is deeper than folder and file. If four fifths of the paths name a split in the
    first folder, the layout is split/class/file; if in the second, class/split/file; else
    class/file without splits. Two aggregates decide, one row each.
    """
    parts = paths.withColumn("p", F.split("path", "/"))
    root = parts.agg((F.count_distinct(F.col("p")[0]) == 1).alias("shared"), F.max(F.size("p")).alias("depth")).select(F.when(F.col("shared") & (F.col("depth") > 2), 1).otherwise(0).alias("skip"))
    cut = parts.crossJoin(root).withColumn("p", F.slice("p", F.col("skip") + 1, F.greatest(F.size("p") - F.col("skip"), F.lit(0)))).drop("skip")
    name = lambda i: F.lower(F.get("p", F.lit(i)))
    alias = lambda c: F.coalesce(*[F.when(c.isin(*names), split) for split, names in SPLIT_ALIASES.items()])
    folder = lambda i: F.when(F.size("p") > i + 1, name(i))
    votes = cut.agg(F.avg(alias(folder(0)).isNotNull().cast("int")).alias("first"), F.avg(alias(folder(1)).isNotNull().cast("int")).alias("second"))
    layout = votes.select(F.when(F.col("first") >= 0.8, "split_first").when(F.col("second") >= 0.8, "class_first").otherwise("class_only").alias("layout"))
    j = cut.crossJoin(layout)
    at = lambda i: F.when(F.size("p") > i + 1, F.get("p", F.lit(i)))
    label = F.when(F.col("layout") == "split_first", at(1)).otherwise(at(0))
    split = F.when(F.col("layout") == "split_first", alias(folder(0))).when(F.col("layout") == "class_first", alias(folder(1)))
    return j.select("path", F.coalesce(split, F.lit("unsplit")).alias("split"), label.alias("label"), "layout", F.when(label.isNull(), "no class folder").alias("reason"))
