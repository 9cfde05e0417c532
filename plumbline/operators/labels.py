"""Label evidence combined: suspicion, competing hypotheses, reason codes, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much each witness counts.
WEIGHTS = {"model": 0.35, "neighbor": 0.30, "centroid": 0.15, "dynamics": 0.10, "dup": 0.10}
LEAST_RELIABILITY = 0.05
#: How doubtful a category of training dynamics makes a label.
DYNAMICS = {"hard": 1.0, "forgotten": 0.7, "ambiguous": 0.5, "unstable": 0.4, "easy": 0.0}
REVIEW, LOW_PRIORITY = 0.55, 0.38
HYPOTHESES = ("likely_mislabeled", "rare_valid", "poor_quality", "domain_shifted", "ambiguous")


def score_labels(evidence: DataFrame) -> DataFrame:
    """``suspicion`` (weighted mean of the signals) and ``action`` for each sample.

    ``evidence`` has p_given, neighbor_same, neighbor_major_share, centroid_ratio, density_pct,
    dup_conflict (boolean) and severity (0 to 1). Where it has ``reliability_model``,
    ``reliability_neighbor`` or ``reliability_centroid``, the witness's weight is scaled by that,
    and where it has ``dynamics`` (a category, or null) that is a signal with the model's reliability.
    """
    c = F.col
    centroid = F.least(F.greatest((c("centroid_ratio") - 0.4) / 0.3, F.lit(0.0)), F.lit(1.0))
    weight = lambda k, witness: F.lit(WEIGHTS[k]) * (F.greatest(c(f"reliability_{witness}"), F.lit(LEAST_RELIABILITY)) if f"reliability_{witness}" in evidence.columns else F.lit(1.0))
    parts = {"model": 1 - c("p_given"), "neighbor": 1 - c("neighbor_same"), "centroid": centroid}
    terms = [(v, weight(k, k)) for k, v in parts.items()] + [(c("dup_conflict").cast("double"), F.lit(WEIGHTS["dup"]))]
    if "dynamics" in evidence.columns:
        signal = reduce(lambda acc, kv: F.when(c("dynamics") == kv[0], kv[1]).otherwise(acc), DYNAMICS.items(), F.lit(None).cast("double"))
        terms.append((F.coalesce(signal, F.lit(0.0)), F.when(signal.isNotNull(), weight("dynamics", "model")).otherwise(0.0)))
    suspicion = reduce(lambda a, b: a + b, [v * w for v, w in terms]) / reduce(lambda a, b: a + b, [w for _, w in terms])
    rare = (parts["model"] >= 0.5) & (c("neighbor_major_share") < 0.5) & (c("density_pct") <= 0.08) & (c("centroid_ratio") < 0.55) & (c("severity") < 0.6)
    action = F.when(rare, "LIKELY_RARE").when(c("suspicion") >= REVIEW, "REVIEW").when(c("suspicion") >= LOW_PRIORITY, "LOW_PRIORITY_REVIEW").otherwise("NO_ACTION")
    return evidence.withColumns({"s_centroid": centroid, "suspicion": suspicion}).withColumn("action", action)


def rare_or_wrong(scored: DataFrame) -> DataFrame:
    """Scores of five hypotheses, and the winner if it reaches 0.5 with a lead of 0.08, else ``uncertain``."""
    c = F.col
    other = (c("pred") != c("label")) & (c("p_given") < c("p_pred"))
    p_other = F.when(other, c("p_pred")).otherwise(0.0)
    agree = F.coalesce(other & (c("neighbor_major") == c("pred")) & (c("nearest_other") == c("pred")), F.lit(False))
    isolation = 1 - c("density_pct")
    mislabeled = F.least(F.lit(1.0), (p_other + c("neighbor_major_share") + c("s_centroid")) / 3 + F.when(agree, 0.15).otherwise(0.0))
    rare = (isolation + (1 - c("s_centroid")) + (1 - c("neighbor_major_share")) + F.when(c("severity") < 0.3, 1.0).otherwise(0.3)) / 4 * F.when(p_other >= 0.6, 0.6).otherwise(1.0)
    shifted = isolation * F.least(F.greatest((c("deviation") - 2) / 4, F.lit(0.0)), F.lit(1.0))
    ambiguous = 1 - F.least(F.greatest(c("gap") / 0.3, F.lit(0.0)), F.lit(1.0))
    values = dict(zip(HYPOTHESES, (mislabeled, rare, c("severity"), shifted, ambiguous * F.when(c("neighbor_major_share") >= 0.3, 1.0).otherwise(0.5))))
    ranked = F.array_sort(F.array(*[F.struct((-F.round(v, 4)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(values.items())]))
    out = scored.withColumns({"consistent": agree, "r": ranked, **{k: F.round(v, 4) for k, v in values.items()}})
    top, second = -c("r")[0]["s"], -c("r")[1]["s"]
    return out.withColumn("hypothesis", F.when((top >= 0.5) & (F.round(top - second, 4) >= 0.08), c("r")[0]["k"]).otherwise("uncertain")).drop("r")


#: From which measured reliability a witness counts, and from which a model, an influence or harm is remarkable.
MIN_RELIABILITY, UNCALIBRATED, HIGH_SELF_INFLUENCE, HARMS_FAILURES = 0.35, 0.1, 0.95, 3


def reason_codes(judged: DataFrame) -> DataFrame:
    """``codes``: the reasons that a sample's evidence gives, in a fixed order.

    Besides the columns of ``rare_or_wrong``, these are used where they are there, and give no
    reason where they are null: ``reliability_neighbor`` and ``reliability_centroid`` (a witness below
    ``MIN_RELIABILITY`` is called weak and says nothing), ``model_ece``, ``near_copy`` (a near copy of
    another sample, not its family's root), ``leak_risk`` (low, medium, high or critical, in place
    of ``leaks``), ``dynamics``, ``self_influence_pct``, ``failures_harmed``, ``in_shortcut`` and ``privacy``.
    """
    c = F.col
    has = lambda name: name in judged.columns
    differs = c("pred") != c("label")
    counts = lambda witness: F.coalesce(c(f"reliability_{witness}") >= MIN_RELIABILITY, F.lit(True)) if has(f"reliability_{witness}") else F.lit(True)
    near, far = counts("neighbor"), counts("centroid")
    leaks = c("leak_risk").isNotNull() if has("leak_risk") else c("leaks")
    rules: list[tuple[str, Column]] = [
        ("HIGH_MODEL_DISAGREEMENT", differs & (c("p_given") < 0.2)),
        ("MODEL_DISAGREEMENT", differs & (c("p_given") >= 0.2) & (c("p_given") < 0.4)),
        ("MODEL_AGREES", (c("p_given") >= 0.6)),
        ("HIGH_NEIGHBOR_DISAGREEMENT", near & (c("neighbor_same") < 0.35) & (c("neighbor_major_share") >= 0.5)),
        ("NEIGHBORS_AGREE", near & (c("neighbor_same") >= 0.6)),
        ("OUTSIDE_CLASS_CLUSTER", far & (c("centroid_ratio") >= 0.55)),
        ("INSIDE_CLASS_CLUSTER", far & (c("centroid_ratio") < 0.45)),
        ("CONSISTENT_ALTERNATIVE_LABEL", c("consistent") & near & far),
        ("LOW_DENSITY_REGION", c("density_pct") <= 0.05),
        ("QUALITY_OK", c("severity") < 0.6),
        ("SEVERE_QUALITY_ISSUE", c("severity") >= 0.9),
        ("QUALITY_CONCERN", (c("severity") >= 0.6) & (c("severity") < 0.9)),
        ("EXACT_DUPLICATE_COPY", c("is_copy")),
        ("DUPLICATE_LABEL_CONFLICT", c("dup_conflict")),
        ("CROSS_SPLIT_LEAKAGE", (c("leak_risk") == "medium") if has("leak_risk") else leaks),
        ("NO_LEAKAGE", ~leaks),
        ("RARE_HYPOTHESIS", c("hypothesis") == "rare_valid"),
        ("MISLABEL_HYPOTHESIS", c("hypothesis") == "likely_mislabeled"),
        ("AMBIGUOUS_HYPOTHESIS", c("hypothesis") == "ambiguous"),
        ("DOMAIN_SHIFT_HYPOTHESIS", c("hypothesis") == "domain_shifted"),
        ("EVALUATION_SAMPLE", c("split").isin("val", "test")),
    ]
    rules += [(name, ~there & c(value).isNotNull()) for name, there, value in (("NEIGHBOR_WITNESS_WEAK", near, "neighbor_same"), ("EMBEDDING_WITNESS_WEAK", far, "centroid_ratio"))]
    if has("leak_risk"):
        rules += [("CROSS_SPLIT_LEAKAGE_HIGH", c("leak_risk").isin("high", "critical")), ("SIMILAR_SUBJECT_ACROSS_SPLITS", c("leak_risk") == "low")]
    more = {
        "model_ece": ("MODEL_POORLY_CALIBRATED", lambda x: x > UNCALIBRATED),
        "near_copy": ("NEAR_DUPLICATE_MEMBER", lambda x: x & ~c("is_copy")),
        "self_influence_pct": ("HIGH_SELF_INFLUENCE", lambda x: x >= HIGH_SELF_INFLUENCE),
        "failures_harmed": ("HARMS_EVAL_FAILURES", lambda x: x >= HARMS_FAILURES),
        "in_shortcut": ("SHORTCUT_GROUP_MEMBER", lambda x: x),
        "privacy": ("PRIVACY_SENSITIVE_CONTENT", lambda x: x),
    }
    rules += [(name, when(c(column))) for column, (name, when) in more.items() if has(column)]
    if has("dynamics"):
        names = {"hard": "HARD_TO_LEARN", "forgotten": "FORGOTTEN_DURING_TRAINING", "ambiguous": "AMBIGUOUS_TRAINING", "unstable": "UNSTABLE_TRAINING", "easy": "EASY_TO_LEARN"}
        rules += [(name, c("dynamics") == category) for category, name in names.items()]
    return judged.withColumn("codes", F.array_compact(F.array(*[F.when(when, name) for name, when in rules])))


#: Verdict by the first rule that matches, with its severity.
SEVERITY = {"LEAKAGE_ACTION_NEEDED": 0.9, "POSSIBLE_RELABEL": 0.85, "STRONG_REVIEW": 0.8, "POSSIBLE_REMOVE": 0.6, "REVIEW": 0.5, "UNCERTAIN": 0.45, "LIKELY_RARE": 0.35, "KEEP": 0.1}


def deliberate(coded: DataFrame) -> DataFrame:
    """``rule``, ``verdict``, ``target`` and ``priority`` from the reason codes, by ordered rules."""
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains("codes", n) for n in names])
    model, near, far = has("HIGH_MODEL_DISAGREEMENT", "MODEL_DISAGREEMENT"), has("HIGH_NEIGHBOR_DISAGREEMENT"), has("OUTSIDE_CLASS_CLUSTER")
    two = model.cast("int") + near.cast("int") + far.cast("int") >= 2
    rules = [
        ("R1", has("CROSS_SPLIT_LEAKAGE", "CROSS_SPLIT_LEAKAGE_HIGH"), "LEAKAGE_ACTION_NEEDED"),
        ("R2", has("EXACT_DUPLICATE_COPY") & ~has("DUPLICATE_LABEL_CONFLICT"), "POSSIBLE_REMOVE"),
        ("R3", has("DUPLICATE_LABEL_CONFLICT"), "STRONG_REVIEW"),
        ("R4", has("SEVERE_QUALITY_ISSUE") & model & ~has("RARE_HYPOTHESIS"), "POSSIBLE_REMOVE"),
        ("R5", has("HIGH_MODEL_DISAGREEMENT") & near & far & has("CONSISTENT_ALTERNATIVE_LABEL") & ~has("SEVERE_QUALITY_ISSUE"), "POSSIBLE_RELABEL"),
        ("R6", has("RARE_HYPOTHESIS") & ~has("CONSISTENT_ALTERNATIVE_LABEL"), "LIKELY_RARE"),
        ("R7", two, "STRONG_REVIEW"),
        ("R8", model & has("NEIGHBORS_AGREE") & has("INSIDE_CLASS_CLUSTER"), "UNCERTAIN"),
        ("R9", model | near | far | has("QUALITY_CONCERN", "SEVERE_QUALITY_ISSUE", "AMBIGUOUS_HYPOTHESIS", "DOMAIN_SHIFT_HYPOTHESIS", "MISLABEL_HYPOTHESIS"), "REVIEW"),
    ]
    rule, verdict = F.lit("R10"), F.lit("KEEP")
    for name, when, v in reversed(rules):
        rule, verdict = F.when(when, name).otherwise(rule), F.when(when, v).otherwise(verdict)
    out = coded.withColumns({"rule": rule, "verdict": verdict})
    severity = reduce(lambda acc, kv: F.when(F.col("verdict") == kv[0], kv[1]).otherwise(acc), SEVERITY.items(), F.lit(0.0))
    strength = F.greatest("suspicion", F.when(F.col("leaks"), 0.85).otherwise(0.0), 0.8 * F.col("severity"))
    out = out.withColumn("strength", strength)
    impact = F.when(F.col("split").isin("val", "test"), 0.6 * F.col("strength")).otherwise(0.0)
    concerns = {"leakage": has("CROSS_SPLIT_LEAKAGE", "CROSS_SPLIT_LEAKAGE_HIGH"), "label": model | near | far, "quality": has("SEVERE_QUALITY_ISSUE", "QUALITY_CONCERN"), "duplicate": has("EXACT_DUPLICATE_COPY", "DUPLICATE_LABEL_CONFLICT")}
    uncertainty = F.when(F.col("verdict").isin("LEAKAGE_ACTION_NEEDED", "POSSIBLE_RELABEL"), "low").when(F.col("verdict").isin("UNCERTAIN", "REVIEW"), "high").otherwise("medium")
    return out.withColumns(
        {
            "impact": impact,
            "categories": F.array_compact(F.array(*[F.when(when, name) for name, when in concerns.items()])),
            "uncertainty": uncertainty,
            "target": F.when(F.col("verdict") == "POSSIBLE_RELABEL", F.col("pred")),
            "priority": F.round(0.45 * severity + 0.4 * F.col("strength") + 0.15 * impact, 4),
        }
    )


def witnesses(coded: DataFrame) -> DataFrame:
    """``witnesses``: what each source of evidence says of the label, as ``struct<witness, stance, weight>``, and ``dissent``.

    Stances are prosecution (against the label), defense and neutral. ``dissent`` is the weight of
    the witnesses who speak against the verdict: prosecutors of a sample that is kept or rare,
    defenders of one that is not.
    """
    c = F.col
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains("codes", n) for n in names])
    stance = lambda against, in_favour: F.when(against, "prosecution").when(in_favour, "defense").otherwise("neutral")
    said = [
        ("model", stance(has("HIGH_MODEL_DISAGREEMENT", "MODEL_DISAGREEMENT"), has("MODEL_AGREES")), F.abs(0.5 - c("p_given")) * 2, F.lit(True)),
        ("neighbor", stance(has("HIGH_NEIGHBOR_DISAGREEMENT"), has("NEIGHBORS_AGREE")), F.abs(0.5 - c("neighbor_same")) * 2, F.lit(True)),
        ("centroid", stance(has("OUTSIDE_CLASS_CLUSTER"), has("INSIDE_CLASS_CLUSTER")), F.abs(0.5 - c("centroid_ratio")) * 2, F.lit(True)),
        ("quality", stance(has("SEVERE_QUALITY_ISSUE", "QUALITY_CONCERN"), has("QUALITY_OK")), F.when(has("QUALITY_OK"), 0.4).otherwise(c("severity")), F.lit(True)),
        ("duplicate", stance(has("DUPLICATE_LABEL_CONFLICT", "EXACT_DUPLICATE_COPY"), F.lit(False)), F.when(has("DUPLICATE_LABEL_CONFLICT"), 1.0).otherwise(0.6), has("DUPLICATE_LABEL_CONFLICT", "EXACT_DUPLICATE_COPY")),
        ("split", stance(has("CROSS_SPLIT_LEAKAGE", "CROSS_SPLIT_LEAKAGE_HIGH"), has("NO_LEAKAGE")), F.when(has("CROSS_SPLIT_LEAKAGE", "CROSS_SPLIT_LEAKAGE_HIGH"), 0.9).otherwise(0.3), F.lit(True)),
        ("dynamics", stance(has("HARD_TO_LEARN", "FORGOTTEN_DURING_TRAINING"), has("EASY_TO_LEARN")), F.lit(0.6), has("HARD_TO_LEARN", "FORGOTTEN_DURING_TRAINING", "AMBIGUOUS_TRAINING", "UNSTABLE_TRAINING", "EASY_TO_LEARN")),
        ("rarity", stance(F.lit(False), has("RARE_HYPOTHESIS")), F.lit(0.8), has("RARE_HYPOTHESIS")),
        ("influence", stance(has("HIGH_SELF_INFLUENCE", "HARMS_EVAL_FAILURES"), F.lit(False)), F.when(has("HARMS_EVAL_FAILURES"), 0.8).otherwise(0.6), has("HIGH_SELF_INFLUENCE", "HARMS_EVAL_FAILURES")),
        ("shortcut", F.lit("neutral"), F.lit(0.3), has("SHORTCUT_GROUP_MEMBER")),
        ("privacy", F.lit("neutral"), F.lit(0.2), has("PRIVACY_SENSITIVE_CONTENT")),
    ]
    heard = F.array_compact(F.array(*[F.when(there, F.struct(F.lit(name).alias("witness"), s.alias("stance"), F.round(w, 4).alias("weight"))) for name, s, w, there in said]))
    against = F.when(c("verdict").isin("KEEP", "LIKELY_RARE"), "prosecution").otherwise("defense")
    return coded.withColumn("witnesses", heard).withColumn("dissent", F.round(F.aggregate("witnesses", F.lit(0.0), lambda a, w: a + F.when(w["stance"] == against, w["weight"]).otherwise(0.0)), 4))


def rule_trace(deliberated: DataFrame) -> DataFrame:
    """``trace``: the rules looked at for each sample, in order, with whether they matched; the last one did."""
    names = [f"R{i}" for i in range(1, 11)]
    looked = F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), (F.col("rule") == n).alias("matched"), F.lit(i).alias("i")) for i, n in enumerate(names)]), lambda t: t["i"] < F.substring(F.col("rule"), 2, 2).cast("int"))
    return deliberated.withColumn("trace", F.transform(looked, lambda t: F.struct(t["rule"].alias("rule"), t["matched"].alias("matched"))))


def case_candidates(*signals: DataFrame) -> DataFrame:
    """The distinct ``sample_id`` that any of the signals names: the samples to make cases of."""
    return reduce(lambda a, b: a.unionByName(b), [s.select("sample_id") for s in signals]).distinct()


#: What a review is worth, by objective.
OBJECTIVES = {
    "balanced": {"risk": 1.0, "impact": 0.6, "uncertainty": 0.3, "leakage": 0.6, "label": 0.6, "quality": 0.3, "coverage": 0.3},
    "leakage": {"risk": 0.5, "impact": 0.3, "uncertainty": 0.1, "leakage": 2.0, "label": 0.2, "quality": 0.1, "coverage": 0.1},
    "label_errors": {"risk": 0.8, "impact": 0.4, "uncertainty": 0.2, "leakage": 0.1, "label": 2.0, "quality": 0.1, "coverage": 0.2},
    "model_impact": {"risk": 0.5, "impact": 2.0, "uncertainty": 0.2, "leakage": 0.6, "label": 0.5, "quality": 0.1, "coverage": 0.2},
    "quality": {"risk": 0.5, "impact": 0.2, "uncertainty": 0.1, "leakage": 0.1, "label": 0.2, "quality": 2.0, "coverage": 0.1},
}


def case_value(cases: DataFrame, objective: str = "balanced") -> DataFrame:
    """``value`` of a review of each case, from its priority, impact, uncertainty, concerns and split; likely rare ones count less."""
    w, c = OBJECTIVES[objective], F.col
    concern = lambda name, share: F.when(F.array_contains("categories", name), w[name] * share * c("strength")).otherwise(0.0)
    doubt = F.when(c("uncertainty") == "low", 0.2).when(c("uncertainty") == "high", 1.0).otherwise(0.5)
    seen = F.when(c("split").isin("val", "test"), w["coverage"] * 0.2 * c("strength")).otherwise(0.0)
    value = w["risk"] * c("priority") + w["impact"] * c("impact") + w["uncertainty"] * 0.3 * doubt + concern("leakage", 1.0) + concern("label", 1.0) + concern("quality", 0.6) + seen
    return cases.withColumn("value", F.round(F.greatest(value * F.when(c("verdict") == "LIKELY_RARE", 0.6).otherwise(1.0), F.lit(0.0)), 6))
