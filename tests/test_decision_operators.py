"""Spanning forests, quantiles, review queues, experiments and temperatures against plain computations."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import budget, experiments, profile, quantiles, trees


def kruskal(edges):
    """Edges (a, b, weights...) of the maximum spanning forest under the operator's order."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = set()
    for a, b, *w in sorted(edges, key=lambda e: (*[-x for x in e[2:]], e[0], e[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.add((a, b, *w))
    return out


@pytest.mark.parametrize("nodes, n, levels", [(40, 60, 2), (60, 400, 3), (300, 500, 1)])
def test_forest_equals_kruskal(spark, nodes, n, levels):
    rnd = random.Random(n)
    edges = {}
    for _ in range(n):
        a, b = sorted(rnd.sample(range(nodes), 2))
        edges[a, b] = (rnd.randrange(levels), rnd.choice([0.5, 0.8, 0.9]))
    rows = [(a, b, *w) if rnd.random() < 0.5 else (b, a, *w) for (a, b), w in edges.items()]
    rows += [(a, b, -1, 0.0) for a, b, *_ in rows[:20]] + [(7, 7, 9, 9.0), (None, 3, 9, 9.0)]  # weaker parallel edges, a loop, a null end
    df = spark.createDataFrame(rows, "a long, b long, rank int, sim double").withColumn("e", F.lit("clash"))
    got = trees.maximum_spanning_forest(df, ["rank", "sim"])
    assert {tuple(r) for r in got.collect()} == kruskal([(a, b, *w) for (a, b), w in edges.items()])


def test_forest_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1, 1.0) for i in range(200)]
    star = [(1000, 1001 + i, float(i % 3)) for i in range(300)]
    rows = chain + star + [(1001, 1002, 5.0)]
    got = trees.maximum_spanning_forest(spark.createDataFrame(rows, "a long, b long, w double"), ["w"])
    assert {tuple(r) for r in got.collect()} == kruskal(rows)
    assert trees.maximum_spanning_forest(spark.createDataFrame([], "a long, b long, w double"), ["w"]).count() == 0


@pytest.mark.parametrize("bins", [2, 1024])
def test_quantiles_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(1)
    columns = {
        "normal": rng.normal(size=500),
        "skew": np.exp(rng.normal(size=500) * (3 if bins == 2 else 30)),
        "ties": rng.integers(0, 3, 500).astype(float),
        "same": np.full(500, 7.25),
        "wide": np.append(rng.normal(size=498), [-1.7e308, 1.7e308]) if bins > 2 else rng.normal(size=500),
    }
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in columns.values()))), ", ".join(f"{c} double" for c in columns))
    df = df.withColumns({"holes": F.when(F.col("normal") > 0, F.col("skew")), "none": F.lit(None).cast("double"), "nan": F.when(F.col("ties") == 1, float("nan")).otherwise(F.col("ties")), "whole": F.col("ties").cast("int")})
    wanted = {f"{c}_{q}": (c, q) for c in [*columns, "holes", "none", "nan", "whole"] for q in (0.0, 0.3, 0.5, 0.995, 1.0)}
    got = quantiles.exact_quantiles(df, wanted)
    columns |= {"holes": columns["skew"][columns["normal"] > 0], "nan": columns["ties"][columns["ties"] != 1], "whole": columns["ties"]}
    for name, (c, q) in wanted.items():
        assert got[name] == (None if c == "none" else pytest.approx(np.percentile(columns[c], 100 * q), rel=1e-12)), name


def test_robust_scale_equals_sorting(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=301), np.where(rng.random(301) < 0.6, 4.0, rng.random(301))
    df = spark.createDataFrame(list(zip(range(301), x.tolist(), y.tolist())), "sample_id long, x double, y double")
    got = {r.sample_id: (r.x_z, r.y_z) for r in profile.robust_z(df, ["x", "y"]).collect()}
    mad = np.median(np.abs(x - np.median(x)))
    for i in range(301):
        assert got[i] == pytest.approx(((x[i] - np.median(x)) / (1.4826 * mad), (y[i] - 4.0) / (y.std() + 1e-9)))


def plain_greedy(cases, max_items, max_minutes):
    """Every case looked at again in every step."""
    left, family, label, spent, out = sorted(cases), Counter(), Counter(), 0.0, []
    while left and (max_items is None or len(out) < max_items):
        best = None
        for i, v, m, f, c in left:
            m = max(m or 0.0, 0.25)
            if max_minutes is not None and spent + m > max_minutes + 1e-9:
                continue
            gain = (v or 0.0) * ((0.5 ** family[f] if f is not None else 1.0) * 0.85 ** min(label[c], 10))
            if best is None or gain / m > best[0]:
                best = (gain / m, i, m, f, c)
        if best is None:
            break
        ratio, i, m, f, c = best
        left = [x for x in left if x[0] != i]
        spent += m
        out.append((i, round(spent, 6)))
        label[c] += 1
        if f is not None:
            family[f] += 1
    return out


@pytest.mark.parametrize("n, items, minutes", [(5000, 40, None), (5000, None, 12.0), (5000, 60, 45.0), (300, 300, None), (300, 50, 9.3)])
def test_queue_equals_plain_greedy(spark, n, items, minutes):
    rnd = random.Random(n)
    # A hot family and a hot class hold a third of the cases; values tie.
    cases = [(i, round(rnd.random() ** 3, 2), rnd.choice([0.5, 0.75, 1.0, 1.5, 6.0]), rnd.choice([1, None, rnd.randrange(2, 40)]), rnd.choice([0, 0, rnd.randrange(6)])) for i in range(n)] + [(n, None, None, None, None)]
    df = spark.createDataFrame(cases, "case_id long, value double, minutes double, family long, class int").withColumns({c: F.lit("clash") for c in ("kin", "own", "j", "r", "salt")})
    queue = budget.review_queue(df, items, minutes).orderBy("rank").collect()
    assert [(r.case_id, r.spent) for r in queue] == plain_greedy(cases, items, minutes)
    pruned = budget.candidates(df.select("case_id", "value", "minutes", "family", "class"), items or 48)
    assert n == 300 or pruned.count() < n


def test_queue_needs_a_budget_and_takes_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, None, 0)], "case_id long, value double, minutes double, family long, class int")
    with pytest.raises(ValueError):
        budget.review_queue(df)
    assert budget.review_queue(df, 0).count() == budget.review_queue(df.limit(0), 5).count() == budget.review_queue(df, 5, 0.5).count() == 0


def plain_fit(x, y, w, classes, c, mean, scale):
    """Gradient descent to convergence on one weighted data set."""
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    counts = np.bincount(y, w, classes)
    b = w * (w.sum() / ((counts > 0).sum() * np.maximum(counts, 1e-12)))[y]
    weights, one = np.zeros((classes, z.shape[1])), np.eye(classes)[y]
    for _ in range(20_000):
        p = np.exp(z @ weights.T - (z @ weights.T).max(1, keepdims=True))
        g = ((p / p.sum(1, keepdims=True) - one) * b[:, None]).T @ z / w.sum()
        g[:, :-1] += weights[:, :-1] / (c * w.sum())
        weights -= 0.3 * g
        if np.abs(g).max() < 1e-9:
            break
    return weights


def made_vectors(n=240, classes=3, dims=5, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(classes, dims)) * 1.3
    y = rng.integers(0, classes, n)
    x = centre[y] + rng.normal(size=(n, dims))
    split = np.where(np.arange(n) % 10 < 7, "train", "test")
    return x, y, split


def test_all_models_of_a_study_equal_separate_fits(spark):
    x, y, split = made_vectors()
    after = np.where(np.arange(240) % 11 == 0, (y + 1) % 3, y)
    rows = [(i, x[i].tolist(), int(y[i]), None if i % 13 == 0 else int(after[i]), i % 9 == 0) for i in range(240)]
    df = spark.createDataFrame(rows, "sample_id long, embedding array<double>, label int, after int, lucky boolean")
    study = experiments.Study(3, 2, 42, 0.02)
    fitted = study.fit(df, rounds=400, tolerance=1e-9)
    ids = np.arange(240)
    assert fitted.mean == pytest.approx(x.mean(0)) and fitted.scale == pytest.approx(x.std(0))
    for k, (variant, r) in enumerate(study.models):
        w = experiments.poisson(ids, 42 + r) if r else np.ones(240)
        w = w * {"before": np.ones(240), "guided": ids % 13 != 0, "random": ids % 9 != 0}[variant]
        want = plain_fit(x, after if variant == "guided" else y, w, 3, 0.02, x.mean(0), x.std(0))
        assert fitted.weights[k] == pytest.approx(want, abs=2e-4), (variant, r)


def test_study_tells_a_useful_change_from_noise(spark):
    x, y, split = made_vectors(900, seed=5)
    rng = np.random.default_rng(0)
    wrong = (split == "train") & (rng.random(900) < 0.35) & (y == 0)
    given = np.where(wrong, 1, y)
    df = spark.createDataFrame([(i, x[i].tolist(), int(given[i]), str(split[i])) for i in range(900)], "sample_id long, embedding array<double>, label int, split string").withColumns({c: F.lit("clash") for c in ("effect", "after", "leaks")})
    changes = spark.createDataFrame([(i, "relabel", 0) for i in np.flatnonzero(wrong).tolist()] + [(int(np.flatnonzero(split == "test")[0]), "eval_drop", None)], "sample_id long, effect string, target int")
    got = experiments.what_if_study(df, changes, replicates=4, resamples=100).collect()
    assert len(got) == 2 * 3 * 2
    row = {(r.variant, r.set, r.metric): r for r in got}
    guided, random_ = row["guided", "preserved_holdout", "macro_f1"], row["random", "preserved_holdout", "macro_f1"]
    assert guided.delta > 0 and guided.n == 269 and row["guided", "original_eval", "accuracy"].n == 270 == row["guided", "cleaned_eval", "accuracy"].n + 1
    assert random_.delta == 0 and random_.within_noise  # nothing is removed, so nothing is removed at random
    assert guided.low <= guided.high and guided.ci_low <= guided.delta <= guided.ci_high and row["guided", "original_eval", "macro_f1"].ci_low is None
    again = experiments.what_if_study(df, changes, replicates=4, resamples=100).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_temperature_equals_all_points(spark):
    rng = np.random.default_rng(4)
    logits, true_t = rng.normal(size=(400, 5)) * 4, 2.5
    p = np.exp(logits / true_t) / np.exp(logits / true_t).sum(1, keepdims=True)
    y = [int(rng.choice(5, p=q)) for q in p]
    sharp = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    rows = [(q.tolist(), k) for q, k in zip(sharp, y)] + [([0.5, 0.5], 7), ([None, 1.0], 1), (None, 0)]
    got = experiments.temperature_scale(spark.createDataFrame(rows, "probabilities array<double>, label int")).first()
    ts = [0.05 * 400 ** (k / 512) for k in range(513)]
    z = np.log(np.maximum(sharp, 1e-12))
    nll = lambda t: float(np.mean(np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1)) + (z / t).max(1) - (z / t)[np.arange(400), y]))
    best = min(ts, key=nll)
    assert (got.temperature, got.n) == (best, 400) and got.nll_after == pytest.approx(nll(best)) and got.nll_before == pytest.approx(nll(1.0)) and 1.8 < best < 3.5
    few = experiments.temperature_scale(spark.createDataFrame(rows[:19], "probabilities array<double>, label int")).first()
    none = experiments.temperature_scale(spark.createDataFrame([], "probabilities array<double>, label int")).first()
    assert few.temperature == 1.0 == none.temperature and few.nll_before == few.nll_after and none.nll_before is None
