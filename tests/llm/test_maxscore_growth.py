"""What operator 1 sends from queries to shards stays bounded and exact."""

import numpy as np
import pytest

from plumbline.llm import maxscore


@pytest.mark.parametrize("most", [100, 10_000, 50_000_000])
def test_nothing_is_broadcast_and_wide_numbers_are_exact(spark, most):
    v = np.random.default_rng(most).integers(-most, most, (400, 6))
    df = spark.createDataFrame([(i, [float(x) / 256 for x in row]) for i, row in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = maxscore.top_k(df, k=3, query_every=10, shard_rows=50, query_rows=8)
    got = sorted(tuple(r) for r in found.collect())
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    scores = v.astype(object) @ v.T.astype(object)
    want = [(q, r + 1, j, -s) for q in range(0, 400, 10) for r, (s, j) in enumerate(sorted((-int(scores[q, j]), j) for j in range(400) if j != q)[:3])]
    assert got == sorted(want)
