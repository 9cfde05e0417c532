"""Operators on small planted inputs."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import families, governance, metrics, modeling, review, similarity
from plumbline.operators.graph import connected_components
from plumbline.sources.layout import assign_layout


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("partitions", [1, 5])
def test_components_of_chain_star_and_cliques(spark, partitions):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2000 + j) for i in range(6) for j in range(i)] + [(2003, 2050), (7, 7)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(partitions)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == union_find(e for e in edges if e[0] != e[1])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_layouts(spark):
    def run(paths):
        return {r.path: (r.split, r.label, r.reason) for r in assign_layout(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}

    first = run(["root/Train/cat/1.png", "root/valid/dog/2.png", "root/test/cat/3.png", "root/test/dog/4.png", "root/orphan.png"])
    assert first["root/Train/cat/1.png"] == ("train", "cat", None)
    assert run(["cat/train/1.png", "dog/test/2.png"])["dog/test/2.png"] == ("test", "dog", None)
    assert run(["cat/1.png", "dog/2.png", "3.png"])["3.png"] == ("unsplit", None, "no class folder")


def test_leak_kinds(spark):
    rows = [(0, "same", "x", "train"), (1, "same", "x", "test"), (2, "Two  Words", "y", "train"), (3, "two words", "y", "val"), (4, "alone", "y", "val")]
    h = families.content_hash(spark.createDataFrame(rows, "sample_id long, text string, label string, split string"))
    got = {r.family_id: (r.kind, r.risk) for r in families.family_leaks(h).collect()}
    assert got == {0: ("exact_cross_split", "critical"), 2: ("transformed_cross_split", "medium")}


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 5))
    v[40] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "sample_id long, embedding array<double>")
    got = defaultdict(list)
    for r in similarity.knn_join(df, df, 4, block_rows=16).orderBy("sample_id", "rk").collect():
        got[r.sample_id].append(r.neighbor_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 4)
    for i in range(90):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        assert got[i] == want


def test_hamming_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    hashes = base + [b ^ int(sum(1 << int(k) for k in rng.choice(60, 9, replace=False))) for b in base]
    df = spark.createDataFrame(list(enumerate(hashes)), "sample_id long, hash long")
    got = {(r.a, r.b, r.distance) for r in similarity.hamming_join(df, 12).collect()}
    want = {(i, j, ((x ^ y) & (2**64 - 1)).bit_count()) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if i < j and ((x ^ y) & (2**64 - 1)).bit_count() <= 12}
    assert got == want and len(want) >= 40


def test_sql_functions(spark):
    similarity.register_functions(spark)
    assert spark.sql("select hamming(5L, 6L) h, cosine(array(1d, 0d), array(1d, 1d)) c").first().asDict() == {"h": 2, "c": pytest.approx(2**-0.5)}


def test_dynamics_categories(spark):
    rows = []
    for i, ps in enumerate(([0.1] * 4, [0.9, 0.1, 0.9, 0.1], [0.9] * 4, [0.9, 0.9, 0.55, 0.4])):
        rows += [(i, e, p, p > 0.5) for e, p in enumerate(ps)]
    got = {r.sample_id: (r.category, r.first_learned) for r in metrics.dynamics(spark.createDataFrame(rows, "sample_id long, epoch int, p double, correct boolean")).collect()}
    assert got == {0: ("hard", -1), 1: ("forgotten", -1), 2: ("easy", 0), 3: ("ambiguous", -1)}


def test_flipped_label_has_top_self_influence(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 0.1 + (np.array([2, 0, 0, 0]) if i % 2 else np.array([0, 2, 0, 0]))).tolist(), (i % 2) if i != 5 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, embedding array<double>, label int")
    assert modeling.self_influence(df).orderBy(F.desc("self_influence")).first().sample_id == 5


def test_ledger_break_is_found(spark):
    rows = [(o, s, "e", s, f"p{s}", "t") for o in (1, 2) for s in range(5)]
    chained = review.ledger_append(spark.createDataFrame(rows, "org long, seq long, event_type string, entity long, payload string, ts string"))
    assert all(r.valid for r in review.ledger_verify(chained).collect())
    edited = chained.withColumn("payload", F.when((F.col("org") == 2) & (F.col("seq") == 3), "x").otherwise(F.col("payload")))
    assert {r.org: r.broken_at for r in review.ledger_verify(edited).collect()} == {1: None, 2: 3}


CLEAN = dict(sample_count=1000, eval_count=300, provenance_coverage=1.0, unreadable_fraction=0.0, class_count=4, min_class_count=100, imbalance_ratio=1.5, missing_from_train=0, missing_from_eval=0, redundant_samples=0, eval_samples_leaking=0, exact_eval_leaks=0, leakage_high=0, quality_samples=0, shortcut_max=0.0, gaps_high=0, gaps_medium=0, unresolved_cases=0, unresolved_high_priority=0, unresolved_label_strong=0, unresolved_label_review=0)


@pytest.mark.parametrize(
    "change, overall, status",
    [({}, "LOW", "READY"), ({"exact_eval_leaks": 2, "eval_samples_leaking": 2}, "HIGH", "BLOCKED"), ({"imbalance_ratio": 25.0}, "MODERATE", "READY_WITH_WARNINGS"), ({"quality_samples": 130}, "CRITICAL", "READY"), ({"class_count": 1}, "LOW", "BLOCKED")],
)
def test_governance(spark, change, overall, status):
    facts = spark.createDataFrame([CLEAN | change])
    assert {r.overall for r in governance.debt(facts).collect()} == {overall}
    assert {r.status for r in governance.preflight(facts).collect()} == {status}


def test_streams_equal_batch(spark, sf_dir):
    from plumbline.plans.review_queries import case_status, issue_rates_window, stream_decisions, stream_issue_rates

    assert sorted(map(str, stream_decisions(spark, sf_dir).collect())) == sorted(map(str, case_status(spark, sf_dir).collect()))
    live = {(str(r.start)[:10], r.event_type): r.n for r in stream_issue_rates(spark, sf_dir).collect()}
    batch = {(r.day, r.event_type): r.n for r in issue_rates_window(spark, sf_dir).collect()}
    assert live and all(batch[k] == n for k, n in live.items())


def test_near_pairs_equal_brute_force_and_find_planted_copies(spark):
    import random

    from plumbline.operators import families, near_text

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(600)]
    texts, planted = [], set()
    for _ in range(20):
        base = rnd.sample(words, rnd.randrange(20, 90))
        edited, longer = list(base), base + rnd.sample(words, max(1, len(base) // 8))
        edited[len(base) // 2] = "changed"
        at = len(texts)
        texts += [" ".join(base), " ".join(edited), " ".join(longer)]
        planted |= {(at, at + 1)} if len(base) >= 60 else set()
    texts += [" ".join(rnd.sample(words, 50)) for _ in range(20)] + ["", "one two", "one  two", None, " ".join(words) * 20]
    df = families.content_hash(spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string"))
    reps = near_text.representatives(df)
    found = near_text.classify_pairs(near_text.near_pairs(reps.withColumn("text", families.normal_text())), reps).collect()
    ids = {r.sample_id for r in reps.collect()}
    runs = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t and t.split() else set()
    sets = {i: runs(t) for i, t in enumerate(texts) if i in ids and runs(t)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b): pytest.approx(r.jaccard) for r in found} == want and planted <= set(want)
    assert {r.relation for r in found} == {"near", "resized"}


def test_ranks_and_sums_by_ranges(spark):
    from pyspark.sql import functions as F

    from plumbline.operators.ranges import ranked

    rows = [(i, (i * 37) % 11, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v int, w int").repartition(5)
    got = {r.id: (r.rk, r.w_sum) for r in ranked(df, [F.desc("v"), F.col("id")], ("w",)).collect()}
    want, total = {}, 0
    for rk, (i, v, w) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += w
        want[i] = (rk, total)
    assert got == want
    assert ranked(df.limit(0), [F.col("id")]).count() == 0


def test_counterfactuals_equal_sums_over_pairs(spark):
    import numpy as np

    from plumbline.operators import predictions

    rng = np.random.default_rng(5)
    n, dims, classes = 60, 6, 3
    x, y = rng.normal(size=(n, dims)), rng.integers(0, classes, n)
    split = ["train" if i % 10 < 7 else "val" if i % 10 < 8 else "test" for i in range(n)]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), split[i]) for i in range(n)], "sample_id long, embedding array<double>, label int, split string")
    p = predictions.class_probabilities(df)
    rows = {r.sample_id: [q.p for q in r.probs] for r in p.collect()}
    probs = np.array([rows[i] for i in range(n)])
    assert probs.sum(1) == pytest.approx(np.ones(n))
    for i in range(n):  # a sample's own fold has no part in its centroids
        others = [j for j in range(n) if split[j] == "train" and j % 5 != i % 5]
        z = np.exp(20 * np.array([x[i] @ np.mean([x[j] for j in others if y[j] == k], axis=0) for k in range(classes)]))
        assert probs[i] == pytest.approx(z / z.sum())
    residual, ev = probs - np.eye(classes)[y], [i for i in range(n) if split[i] != "train"]
    effect = lambda i, k: sum((probs[i] - np.eye(classes)[k]) @ residual[e] * (x[i] @ x[e] + 1) for e in ev) / dims / len(ev)
    for r in predictions.counterfactuals(p).collect():
        i = r.sample_id
        assert r.influence == pytest.approx(effect(i, y[i]), abs=1e-6)
        options = {(o.action, o.target): o.delta for o in r.options}
        assert options[("keep", None)] == 0 and options[("remove", None)] == r.influence
        for k in range(classes):
            if k != y[i]:
                assert options[("relabel", k)] == pytest.approx(effect(i, y[i]) - effect(i, k), abs=2e-6)
        assert r.best_delta == min(options.values())
    failed = spark.createDataFrame([(7,), (8,)], "sample_id long")
    for r in predictions.pair_influence(p, failed, 2).collect():
        pair = lambda t: residual[r.sample_id] @ residual[t] * (x[r.sample_id] @ x[t] + 1) / dims  # noqa: B023, E731
        least = sorted(pair(t) for t in range(n) if split[t] == "train")
        assert r.influence == pytest.approx(least[r.rk - 1], abs=1e-6)


def test_label_scores_use_reliability_and_dynamics(spark):
    from plumbline.operators import labels

    base = "sample_id long, p_given double, neighbor_same double, neighbor_major_share double, centroid_ratio double, density_pct double, dup_conflict boolean, severity double"
    row = (1, 0.2, 0.5, 0.4, 0.55, 0.5, True, 0.0)
    plain = labels.score_labels(spark.createDataFrame([row], base)).first()
    assert plain.suspicion == pytest.approx((0.35 * 0.8 + 0.3 * 0.5 + 0.15 * 0.5 + 0.1) / 0.9)
    weighted = labels.score_labels(spark.createDataFrame([(*row, 0.5, 0.01, "hard"), (*row, 0.5, 0.01, None)], base + ", reliability_model double, reliability_neighbor double, dynamics string")).collect()
    num, den = 0.175 * 0.8 + 0.015 * 0.5 + 0.15 * 0.5 + 0.1, 0.175 + 0.015 + 0.25
    assert [r.suspicion for r in weighted] == pytest.approx([(num + 0.05) / (den + 0.05), num / den])


def test_equal_hashes_make_a_star(spark):
    from plumbline.operators.similarity import hamming_join

    df = spark.createDataFrame([(i, 5) for i in range(20)] + [(50, 7), (51, 7), (60, -1), (61, None)], "sample_id long, hash long")
    got = sorted((r.a, r.b, r.distance) for r in hamming_join(df, 3).collect())
    assert got == sorted([(0, i, 0) for i in range(1, 20)] + [(50, 51, 0), (0, 50, 1)])


def test_contract_of_sets_and_views(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import governance, views

    actual = spark.createDataFrame([("splits", ["train", "val"])], "metric string, values array<string>")
    got = {r.metric: (r.missing, r.passed) for r in governance.contract_includes(actual, [("splits", ["train"]), ("splits", ["train", "test"]), ("other", ["x"])]).collect()}
    assert got["other"] == ("x", False) and got["splits"] in (("", True), ("test", False))
    rows = spark.createDataFrame([(i, "AB"[i % 2], ["x"] if i % 3 else ["y", "x"], f"Name {i}") for i in range(30)], "id long, kind string, tags array<string>, name string")
    fit = views.matching(rows, equals={"kind": ["A"]}, contains={"tags": "y"}, like={"name": "name 1"})
    assert sorted(r.id for r in fit.collect()) == [12, 18]
    page = views.page(rows, [F.desc("id")], limit=5, offset=10).collect()
    assert [r.id for r in page] == [19, 18, 17, 16, 15] and {r.total for r in page} == {30}
    assert {(r.facet, r.value): r.n for r in views.facets(rows, "kind").collect()} == {("kind", "A"): 15, ("kind", "B"): 15}
