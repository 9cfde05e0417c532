"""Blocks of the index of cells and rings are sent to a cell of the grid once, not with every pair of blocks."""

import numpy as np

from plumbline.operators import neighbors


def shuffled(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_many_blocks_without_clusters(spark):
    v = np.random.default_rng(7).normal(size=(500, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "sample_id long, embedding array<double>")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # as large tables are joined
    before = shuffled(spark)
    got = {(r.sample_id, r.rk): (r.neighbor_id, r.sim) for r in neighbors.nearest(df, df, 3, block_rows=8).collect()}
    moved = shuffled(spark) - before
    spark.conf.unset(threshold)
    sims = np.round(v @ v.T, 4)
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    assert got == {(i, r + 1): (best[i, r], sims[i, best[i, r]]) for i in range(500) for r in range(3)}
    assert moved < 8_000_000  # 9,100,000 when each pair took its two blocks along
