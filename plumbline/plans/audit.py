"""A whole audit: stages in order, each written under its name and skipped when it is there already."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import review_queries, text_queries, vector_queries

STAGES: list[tuple[str, Callable]] = [
    ("profile", text_queries.version_stats),
    ("quality", text_queries.quality_escalate),
    ("families", text_queries.exact_families),
    ("leakage", text_queries.family_leaks),
    ("shortcuts", text_queries.shortcut_findings),
    ("labels", vector_queries.label_scores),
    ("cases", vector_queries.case_numbers),
    ("debt", review_queries.debt),
    ("preflight", review_queries.preflight),
]


def run_audit(spark: SparkSession, sf_dir: str, path: str, stages=STAGES) -> DataFrame:
    """Run the stages; returns ``stage``, ``rows``, ``seconds``, ``skipped``. A stage that was written whole is not run again."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    done = []
    for name, stage in stages:
        marker = fs_path(f"{path}/{name}/_SUCCESS")
        there = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
        began = time.time()
        if not there:
            stage(spark, sf_dir).write.mode("overwrite").parquet(f"{path}/{name}")
        done.append((name, spark.read.parquet(f"{path}/{name}").count(), round(time.time() - began, 3), there))
    return spark.createDataFrame(done, "stage string, rows bigint, seconds double, skipped boolean")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document: facts, debt, preflight, the strongest shortcuts and the worst leaks."""
    top = lambda df, n, *order: df.orderBy(*order).limit(n).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("x"))
    facts = review_queries.facts(spark, sf_dir)
    parts = {
        "facts": facts.select(F.to_json(F.struct(*facts.columns)).alias("x")),
        "debt": top(review_queries.debt(spark, sf_dir), 8, "dimension"),
        "preflight": top(review_queries.preflight(spark, sf_dir), 14, "check"),
        "shortcuts": top(text_queries.shortcut_findings(spark, sf_dir), 8, F.desc("strength"), "cue", "value", "label"),
        "leaks": top(text_queries.family_leaks(spark, sf_dir), 10, F.desc("size"), "family_id"),
    }
    out = None
    for name, df in parts.items():  # one row each
        df = df.withColumnRenamed("x", name)
        out = df if out is None else out.crossJoin(df)
    return out
