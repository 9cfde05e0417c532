"""What training data may have led to a wrong prediction: links, what is known of the linked samples, and what to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Findings and verdicts that make a contributing label suspicious, and how many harmful samples without a case are proposed.
SUSPICIOUS_ACTIONS = ("REVIEW", "LOW_PRIORITY_REVIEW")
SUSPICIOUS_VERDICTS = ("POSSIBLE_RELABEL", "STRONG_REVIEW")
INSPECTED = 5
NEAREST, HARMFUL, KIN = "nearest_neighbor", "harmful_influence", "same_family"


def family_links(failures: DataFrame, families: DataFrame, split: DataFrame) -> DataFrame:
    """Links to the training samples of a failure's own family, with rank 0 (``family_id`` and ``sample_id`` in ``families``)."""
    kin = families.join(split.filter("split = 'train'").select("sample_id"), "sample_id", "left_semi").select("family_id", F.col("sample_id").alias("train_id"))
    own = families.join(failures.select("sample_id"), "sample_id", "left_semi")
    return own.join(kin, "family_id").filter("sample_id <> train_id").select("sample_id", "train_id", F.lit(KIN).alias("link_type"), F.lit(1.0).alias("score"), F.lit(0).alias("rank"))


def described_links(failures: DataFrame, links: DataFrame, labels: DataFrame, findings: DataFrame, cases: DataFrame, families: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """``links`` (sample_id, train_id, link_type, score, rank) with what is known of each training sample.

    Adds its label, whether that is the failure's prediction or truth, its suspicion and recommended
    action (``findings``), case and verdict (``cases``), family, and shortcut cues (``shortcuts``: sample_id, cue),
    and whether its label is suspicious. Links to samples without a label are left out.
    """
    of = lambda df, *columns: df.select(F.col("sample_id").alias("train_id"), *columns)
    cues = shortcuts.groupBy("sample_id").agg(F.array_sort(F.collect_set("cue")).alias("cues"))
    known = links.join(failures.select("sample_id", F.col("label").alias("actual"), F.col("pred").alias("predicted")), "sample_id").join(of(labels, F.col("label").alias("train_label")), "train_id")
    for side in (of(findings, "suspicion", "action"), of(cases, "case_no", "verdict"), of(families, "family_id"), of(cues, "cues")):
        known = known.join(side, "train_id", "left")
    suspicious = F.coalesce(F.col("action").isin(*SUSPICIOUS_ACTIONS), F.lit(False)) | F.coalesce(F.col("verdict").isin(*SUSPICIOUS_VERDICTS), F.lit(False))
    return known.withColumns({"matches_prediction": F.col("train_label") == F.col("predicted"), "matches_truth": F.col("train_label") == F.col("actual"), "suspicious": suspicious})


def blame_map(failures: DataFrame, described: DataFrame, cases: DataFrame, leaks: DataFrame) -> DataFrame:
    """One row per failure (sample_id, split, label, pred, conf), whether it has links or not.

    Contributing samples are those linked as nearest or harmful, each counted once. ``nearest_labels``
    is the nearest samples' label distribution, ``conflicting`` how many contributing samples carry
    the predicted label, ``suspicious`` how many labels are doubtful, ``shortcut_samples`` how many
    have a flagged cue, ``duplicate_families`` how many families they are of; ``leaks`` counts findings
    that the failure itself is in (``leaks``: sample_id). ``actions`` proposes the cases of suspicious
    samples and, of the five most harmful, the samples without a case. Links are evidence of
    similarity and estimated influence, not proof.
    """
    joined = lambda prefix, ids: F.concat(F.lit(prefix), ids.cast("string"))
    contributing = F.col("link_type").isin(NEAREST, HARMFUL)
    once = described.filter(contributing).withColumn("r", F.when(F.col("link_type") == HARMFUL, F.col("rank"))).groupBy("sample_id", "train_id").agg(
        F.first("matches_prediction").alias("conflicting"), F.first("suspicious").alias("suspicious"), F.first("case_no").alias("case_no"), F.first("family_id").alias("family_id"), F.first(F.size("cues") > 0).alias("cued"), F.min("r").alias("harm_rank")
    )
    review = F.when(F.col("suspicious") & F.col("case_no").isNotNull(), joined("review_case:", F.col("case_no")))
    inspect = F.when(F.col("case_no").isNull() & (F.col("harm_rank") <= INSPECTED), joined("inspect_sample:", F.col("train_id")))
    per_sample = once.groupBy("sample_id").agg(
        F.count("*").alias("contributing"), F.count_if("conflicting").alias("conflicting"), F.count_if("suspicious").alias("suspicious"), F.count_if(F.coalesce("cued", F.lit(False))).alias("shortcut_samples"), F.count_distinct("family_id").alias("duplicate_families"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce(review, inspect))), ",").alias("actions"),
    )
    near = F.col("link_type") == NEAREST
    per_link = described.groupBy("sample_id").agg(
        F.count_if(near).alias("nearest"), F.count_if(near & F.col("matches_prediction")).alias("nearest_predicted"), F.count_if(near & F.col("matches_truth")).alias("nearest_true"), F.count_if(F.col("link_type") == HARMFUL).alias("harmful"), F.count_if(F.col("link_type") == KIN).alias("family_samples"), F.max(F.when(near, F.col("score"))).alias("closest"),
    )
    spread = described.filter(near).groupBy("sample_id", "train_label").agg(F.count("*").alias("n")).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("train_label", "n"))).alias("s"))
    nearest_labels = spread.select("sample_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["train_label"].cast("string"), x["n"].cast("string"))), ",").alias("nearest_labels"))
    own = cases.select("sample_id", F.col("case_no").alias("own_case"), F.col("verdict").alias("own_verdict"))
    leaking = leaks.groupBy("sample_id").agg(F.count("*").alias("leaks"))
    out = failures.select("sample_id", "split", F.col("label").alias("actual"), F.col("pred").alias("predicted"), F.col("conf").alias("confidence"))
    for side in (own, leaking, per_link, per_sample, nearest_labels):
        out = out.join(side, "sample_id", "left")
    counts = ["leaks", "nearest", "nearest_predicted", "nearest_true", "harmful", "family_samples", "contributing", "conflicting", "suspicious", "shortcut_samples", "duplicate_families"]
    return out.fillna(0, counts).fillna("", ["nearest_labels", "actions"])
