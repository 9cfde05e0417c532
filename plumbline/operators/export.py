"""What a cleaned version comes with: the decisions applied, the samples removed and relabelled, and its version number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.review import DECISIVE, case_status


def final_decisions(active: DataFrame) -> DataFrame:
    """The vote that settles each settled case: the latest adjudication of a resolved one, the latest of the equal votes of a decided one.

    One row per case: ``case_id``, ``action``, ``target``, ``decision_id``, ``reviewer``, ``decided_at``, ``adjudicated``.
    """
    settled = case_status(active).filter("status in ('decided', 'resolved')").select("case_id", F.col("status").alias("how"))
    votes = active.join(settled, "case_id").filter((F.col("how") == "resolved") & F.col("adjudicate") | (F.col("how") == "decided") & F.col("action").isin(*DECISIVE))
    last = votes.groupBy("case_id").agg(F.max(F.struct("created_at", "decision_id", "action", "target", "reviewer", "how")).alias("d"))
    return last.select("case_id", "d.action", "d.target", "d.decision_id", "d.reviewer", F.col("d.created_at").alias("decided_at"), (F.col("d.how") == "resolved").alias("adjudicated"))


def applied(samples: DataFrame, final: DataFrame) -> DataFrame:
    """``samples`` (sample_id, path, sha, label, split) with the decision on the case of their number, and ``applied``: keep, remove or relabel.

    A relabelling without a target, and votes that decide nothing (unsure, escalate), keep the sample.
    """
    met = samples.join(final, samples["sample_id"] == final["case_id"])
    relabel = (F.col("action") == "relabel") & F.col("target").isNotNull()
    return met.filter(F.col("action").isin(*DECISIVE)).withColumn("applied", F.when(F.col("action") == "remove", "remove").when(relabel, "relabel").otherwise("keep"))


def action_log(decided: DataFrame) -> DataFrame:
    """One row per decision applied: case, action, path, reviewer, time, and whether it was an adjudication."""
    return decided.select("case_id", F.col("applied").alias("action"), "path", "reviewer", "decided_at", "adjudicated")


def removed_list(decided: DataFrame) -> DataFrame:
    """The samples that the cleaned version doesn't have, and the decisions that removed them."""
    return decided.filter("applied = 'remove'").select("path", "sha", "label", "split", "case_id", "decision_id")


def relabel_map(decided: DataFrame) -> DataFrame:
    """The samples whose label changed: from what to what, by which decision."""
    return decided.filter("applied = 'relabel'").select("path", "sha", F.col("label").alias("from_label"), F.col("target").cast("string").alias("to_label"), "case_id", "decision_id")


def summary(samples: DataFrame, decided: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: how many samples the version keeps, removes and relabels, of how many cases, and its number: one more than the highest of ``versions`` (``version_number``; none: 1)."""
    number = versions.agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).cast("bigint").alias("version_number"))
    counts = decided.agg(F.count("*").alias("applied_cases"), F.count_if(F.col("applied") == "remove").alias("removed"), F.count_if(F.col("applied") == "relabel").alias("relabelled"))
    return samples.agg(F.count("*").alias("samples")).crossJoin(counts).crossJoin(number).select("version_number", "samples", (F.col("samples") - F.col("removed")).alias("exported"), "removed", "relabelled", "applied_cases")  # one row each
