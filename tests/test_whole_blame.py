"""Every failure is looked at, also those that the report of confident ones leaves out."""

import numpy as np

from plumbline.operators import predictions
from plumbline.plans import decision_queries


def test_every_failure_has_its_harmful_samples(spark):
    """More failures than the report of confident ones lists."""
    r = np.random.default_rng(4)
    n, dims, classes = 2400, 3, 2
    x, p, y = r.normal(size=(n, dims)).round(2), r.random(n), r.integers(0, classes, n)
    split = np.where(np.arange(n) < 100, "train", "test")
    rows = [(i, int(y[i]), str(split[i]), x[i].tolist(), [(0, float(p[i])), (1, float(1 - p[i]))]) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, label int, split string, embedding array<double>, probs array<struct<k:int,p:double>>")
    failures = df.filter("split = 'test'")
    residual = np.stack((p, 1 - p), 1) - np.eye(classes)[y]
    effect = np.round(-(residual[100:] @ residual[:100].T) * (x[100:] @ x[:100].T + 1) / dims, 6)
    best = np.argsort(-effect, axis=1, kind="stable")[:, :3]
    got = predictions.pair_influence(df, failures, 3).collect()
    assert len(got) == 3 * 2300
    assert all(abs(g.influence + effect[g.sample_id - 100, best[g.sample_id - 100, g.rk - 1]]) < 2e-6 for g in got)


def test_blame_chain_looks_at_all_failures(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(predictions.confident_failures, "__defaults__", (1,))
    chain = decision_queries.blame_chain(spark, sf_dir).select("harmful").collect()
    assert len(chain) > 1 and all(c.harmful == 3 for c in chain)
    assert "limit 2000" not in decision_queries.ORACLES["blame_chain"]
