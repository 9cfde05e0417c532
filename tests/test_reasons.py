"""Reason codes, witnesses and verdicts of made cases; contracts on levels."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import governance, labels

CALM = {
    "sample_id": 1, "label": 0, "pred": 0, "p_given": 0.8, "p_pred": 0.8, "neighbor_same": 0.8, "neighbor_major": 0, "neighbor_major_share": 0.1, "centroid_ratio": 0.3, "nearest_other": 1, "density_pct": 0.5, "consistent": False,
    "severity": 0.0, "is_copy": False, "dup_conflict": False, "leaks": False, "hypothesis": "uncertain", "split": "train", "suspicion": 0.1,
    "reliability_neighbor": 0.9, "reliability_centroid": 0.9, "model_ece": 0.05, "near_copy": False, "leak_risk": None, "dynamics": None, "self_influence_pct": 0.5, "failures_harmed": 0, "in_shortcut": False, "privacy": False,
}
KINDS = {int: "long", float: "double", bool: "boolean", str: "string"}
SCHEMA = ", ".join(f"{k} {'string' if v is None else KINDS[type(v)]}" for k, v in CALM.items())
ALIKE = {"pred": 1, "p_given": 0.1, "p_pred": 0.8, "neighbor_same": 0.1, "neighbor_major": 1, "neighbor_major_share": 0.8, "centroid_ratio": 0.7, "nearest_other": 1, "consistent": True, "hypothesis": "likely_mislabeled"}


@pytest.mark.parametrize(
    "change, there, absent, verdict",
    [
        ({}, {"MODEL_AGREES", "NEIGHBORS_AGREE", "INSIDE_CLASS_CLUSTER", "QUALITY_OK", "NO_LEAKAGE"}, {"EVALUATION_SAMPLE"}, "KEEP"),
        (ALIKE, {"HIGH_MODEL_DISAGREEMENT", "HIGH_NEIGHBOR_DISAGREEMENT", "OUTSIDE_CLASS_CLUSTER", "CONSISTENT_ALTERNATIVE_LABEL", "MISLABEL_HYPOTHESIS"}, set(), "POSSIBLE_RELABEL"),
        (ALIKE | {"reliability_neighbor": 0.2}, {"NEIGHBOR_WITNESS_WEAK", "OUTSIDE_CLASS_CLUSTER"}, {"HIGH_NEIGHBOR_DISAGREEMENT", "CONSISTENT_ALTERNATIVE_LABEL"}, "STRONG_REVIEW"),
        (ALIKE | {"reliability_neighbor": 0.2, "reliability_centroid": 0.1}, {"NEIGHBOR_WITNESS_WEAK", "EMBEDDING_WITNESS_WEAK"}, {"OUTSIDE_CLASS_CLUSTER"}, "REVIEW"),
        (ALIKE | {"reliability_neighbor": None}, {"HIGH_NEIGHBOR_DISAGREEMENT"}, {"NEIGHBOR_WITNESS_WEAK"}, "POSSIBLE_RELABEL"),
        ({"centroid_ratio": 0.55}, {"OUTSIDE_CLASS_CLUSTER"}, {"INSIDE_CLASS_CLUSTER"}, "REVIEW"),
        ({"density_pct": 0.05, "model_ece": 0.11}, {"LOW_DENSITY_REGION", "MODEL_POORLY_CALIBRATED"}, set(), "KEEP"),
        ({"near_copy": True}, {"NEAR_DUPLICATE_MEMBER"}, {"EXACT_DUPLICATE_COPY"}, "KEEP"),
        ({"near_copy": True, "is_copy": True}, {"EXACT_DUPLICATE_COPY"}, {"NEAR_DUPLICATE_MEMBER"}, "POSSIBLE_REMOVE"),
        ({"leak_risk": "critical", "split": "test"}, {"CROSS_SPLIT_LEAKAGE_HIGH", "EVALUATION_SAMPLE"}, {"NO_LEAKAGE", "CROSS_SPLIT_LEAKAGE"}, "LEAKAGE_ACTION_NEEDED"),
        ({"leak_risk": "medium"}, {"CROSS_SPLIT_LEAKAGE"}, {"NO_LEAKAGE", "CROSS_SPLIT_LEAKAGE_HIGH"}, "LEAKAGE_ACTION_NEEDED"),
        ({"leak_risk": "low"}, {"SIMILAR_SUBJECT_ACROSS_SPLITS"}, {"NO_LEAKAGE", "CROSS_SPLIT_LEAKAGE"}, "KEEP"),
        ({"self_influence_pct": 0.95, "failures_harmed": 3}, {"HIGH_SELF_INFLUENCE", "HARMS_EVAL_FAILURES"}, set(), "KEEP"),
        ({"in_shortcut": True, "privacy": True, "dynamics": "forgotten"}, {"SHORTCUT_GROUP_MEMBER", "PRIVACY_SENSITIVE_CONTENT", "FORGOTTEN_DURING_TRAINING"}, set(), "KEEP"),
        ({"self_influence_pct": None, "failures_harmed": None, "in_shortcut": None, "privacy": None, "near_copy": None, "model_ece": None}, {"MODEL_AGREES"}, {"HIGH_SELF_INFLUENCE", "PRIVACY_SENSITIVE_CONTENT", "NEAR_DUPLICATE_MEMBER"}, "KEEP"),
    ],
)
def test_reasons_and_verdicts(spark, change, there, absent, verdict):
    row = spark.createDataFrame([tuple((CALM | change).values())], SCHEMA)
    got = labels.witnesses(labels.deliberate(labels.reason_codes(row))).first()
    assert there <= set(got.codes) and not absent & set(got.codes)
    assert got.verdict == verdict
    heard = {w.witness for w in got.witnesses}
    assert ("influence" in heard) == bool({"HIGH_SELF_INFLUENCE", "HARMS_EVAL_FAILURES"} & set(got.codes)) and ("privacy" in heard) == ("PRIVACY_SENSITIVE_CONTENT" in got.codes)


def test_contracts_compare_levels_by_their_order(spark):
    actual = spark.createDataFrame([("a", "MODERATE"), ("b", "CRITICAL"), ("c", "READY"), ("d", "odd")], "metric string, level string")
    rules = [("a", "<=", "HIGH"), ("a", "<", "MODERATE"), ("b", "==", "CRITICAL"), ("b", "<=", "HIGH"), ("c", "<", "BLOCKED"), ("d", "<=", "CRITICAL"), ("e", "<=", "LOW")]
    got = {(r.metric, r.op): r.passed for r in governance.contract_levels(actual, rules).collect() if (r.metric, r.op) != ("b", "<=")}
    assert got == {("a", "<="): True, ("a", "<"): False, ("b", "=="): True, ("c", "<"): True, ("d", "<="): False, ("e", "<="): False}
    assert governance.contract_levels(actual, rules).filter("metric = 'b' and op = '<='").first().passed is False
    assert actual.select(F.max(governance.level_rank("level"))).first()[0] == 3


def test_blame_map_of_made_links(spark):
    from plumbline.operators import blame

    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    failures = make([(1, "test", 0, 1, 0.9), (2, "val", 1, 0, 0.8)], "sample_id long, split string, label int, pred int, conf double")
    labels_ = make([(i, i % 2, "train") for i in range(10, 20)], "sample_id long, label int, split string")
    families = make([(1, 7), (15, 7), (16, 7), (11, 8), (13, 8)], "sample_id long, family_id long")
    links = make([(1, 11, blame.NEAREST, 0.9, 1), (1, 13, blame.NEAREST, 0.8, 2), (1, 12, blame.NEAREST, 0.7, 3), (1, 11, blame.HARMFUL, 0.2, 1), (1, 14, blame.HARMFUL, 0.1, 2), (1, 99, blame.NEAREST, 0.1, 4)], "sample_id long, train_id long, link_type string, score double, rank int")
    links = links.unionByName(blame.family_links(failures, families, labels_))
    findings = make([(11, 0.7, "REVIEW"), (12, 0.1, "NO_ACTION")], "sample_id long, suspicion double, action string")
    cases = make([(11, 5, "REVIEW"), (1, 3, "STRONG_REVIEW"), (13, 9, "POSSIBLE_RELABEL")], "sample_id long, case_no long, verdict string")
    shortcuts = make([(12, "b"), (12, "a")], "sample_id long, cue string")
    known = blame.described_links(failures, links, labels_, findings, cases, families, shortcuts)
    assert {tuple(r.cues) for r in known.filter("train_id = 12").collect()} == {("a", "b")}
    got = {r.sample_id: r for r in blame.blame_map(failures, known, cases, make([(1,), (1,)], "sample_id long")).collect()}
    a, b = got[1], got[2]
    assert (a.own_case, a.own_verdict, a.leaks, a.nearest, a.nearest_predicted, a.nearest_true, a.harmful, a.family_samples, a.closest) == (3, "STRONG_REVIEW", 2, 3, 2, 1, 2, 2, 0.9)
    assert (a.contributing, a.conflicting, a.suspicious, a.shortcut_samples, a.duplicate_families, a.nearest_labels) == (4, 2, 2, 1, 1, "0:1,1:2")
    assert a.actions == "inspect_sample:14,review_case:5,review_case:9"
    assert (b.own_case, b.leaks, b.nearest, b.contributing, b.actions, b.closest) == (None, 0, 0, 0, "", None)


def test_export_of_made_decisions(spark):
    import datetime as dt

    from plumbline.operators import export

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    # case, reviewer, decision, action, target, adjudicate, time
    votes = [(1, 1, 10, "remove", None, False, at(1)), (1, 2, 11, "remove", None, False, at(2)), (2, 1, 12, "relabel", 3, False, at(1)), (3, 1, 13, "keep", None, False, at(1)), (3, 2, 14, "remove", None, False, at(1)), (3, 3, 15, "relabel", None, True, at(5)), (4, 1, 16, "escalate", None, False, at(1)), (5, 1, 17, "unsure", None, True, at(1)), (99, 1, 18, "remove", None, False, at(1))]
    active = spark.createDataFrame(votes, "case_id long, reviewer long, decision_id long, action string, target int, adjudicate boolean, created_at timestamp_ntz")
    samples = spark.createDataFrame([(i, f"p{i}", f"s{i}", "a", "train") for i in range(1, 8)], "sample_id long, path string, sha string, label string, split string")
    decided = export.applied(samples, export.final_decisions(active))
    assert {(r.case_id, r.action, r.reviewer, r.adjudicated) for r in export.action_log(decided).collect()} == {(1, "remove", 2, False), (2, "relabel", 1, False), (3, "keep", 3, True)}
    assert [(r.path, r.decision_id) for r in export.removed_list(decided).collect()] == [("p1", 11)]
    assert [(r.path, r.from_label, r.to_label) for r in export.relabel_map(decided).collect()] == [("p2", "a", "3")]
    versions = spark.createDataFrame([(4,), (2,)], "version_number int")
    assert tuple(export.summary(samples, decided, versions).first()) == (5, 7, 6, 1, 1, 3)
    assert export.summary(samples, decided, versions.limit(0)).first().version_number == 1


def test_lists_filter_search_and_sort(spark):
    from plumbline.operators import views

    cases = [(1, "REVIEW", "open", ["label"], ["A"], "cat", "train", "low", 7, "a/One.txt", "ff", 0.5, 0.1), (2, "KEEP", "decided", ["quality"], [], "dog", "test", "high", None, "b/two.txt", "0a", 0.9, 0.3), (3, "REVIEW", "disputed", ["label", "leakage"], ["A", "B"], "cat", "test", "medium", 7, "c/one.txt", "0b", 0.7, 0.3)]
    df = spark.createDataFrame(cases, "case_no long, verdict string, status string, categories array<string>, codes array<string>, label string, split string, uncertainty string, family_id long, path string, sha string, priority double, impact double").withColumn("updated_at", F.timestamp_micros(F.col("case_no") % 3))
    ids = lambda **k: [r.case_no for r in views.list_cases(df, **k).collect()]
    assert ids() == [2, 3, 1] and ids(sort="impact") == [2, 3, 1] and ids(sort="newest") == [2, 1, 3] and ids(sort="uncertainty") == [2, 3, 1] and ids(sort="case") == [1, 2, 3] and ids(sort="class") == [3, 1, 2] and ids(sort="name") == [1, 2, 3] and ids(sort="odd") == [2, 3, 1]
    assert ids(filters={"verdict": "REVIEW"}) == [3, 1] and ids(filters={"verdict": ["KEEP", "REVIEW"], "split": "test"}) == [2, 3] and ids(filters={"category": "leakage"}) == [3] and ids(filters={"reason_code": "A", "status": "open"}) == [1] and ids(filters={"family_id": 7, "uncertainty": "low", "label": "cat"}) == [1]
    assert ids(search="ONE") == [3, 1] and ids(search="2") == [2] and ids(search="0B") == [3] and ids(search="nothing") == []
    assert [(r.case_no, r.total) for r in views.list_cases(df, sort="case", limit=1, offset=1).collect()] == [(2, 3)]
    with pytest.raises(ValueError):
        views.list_cases(df, {"color": "red"})
    samples = spark.createDataFrame([("p/a", "ff", "cat", "train", "KEEP", 0.1, 0.2, True, False, None, False, ["too_short"]), ("p/b", "ee", "dog", "test", None, None, None, False, True, True, True, None), ("q/c", "dd", "cat", "test", "REVIEW", 0.9, 0.8, None, None, False, False, [])], "path string, sha string, label string, split string, verdict string, suspicion double, priority double, has_label_finding boolean, in_family boolean, leaks boolean, private boolean, quality array<string>")
    names = lambda **k: [r.path for r in views.list_samples(samples, **k).collect()]
    assert names() == ["p/a", "p/b", "q/c"] and names(sort="suspicion") == ["q/c", "p/a", "p/b"] and names(sort="priority", limit=1, offset=1) == ["p/a"]
    assert names(finding="label") == ["p/a"] and names(finding="duplicate") == names(finding="leakage") == names(finding="privacy") == ["p/b"] and names(finding="too_short") == ["p/a"] and names(finding="very_long") == []
    assert names(label="cat", split="test") == ["q/c"] and names(verdict="KEEP") == ["p/a"] and names(search="P/") == ["p/a", "p/b"] and names(search="DD") == ["q/c"]
    with pytest.raises(ValueError):
        views.list_samples(samples, sort="color")
