"""Texts of one template are sent to where they are compared once, not with every pair."""

import random
from itertools import combinations

from plumbline.operators import near_text


def shuffled(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def template(n, words, seed):
    r = random.Random(seed)
    base = [f"{r.getrandbits(60):x}" for _ in range(words)]
    rows = []
    for _ in range(n):
        row = list(base)
        row[r.randrange(words)] = f"{r.getrandbits(60):x}"
        rows.append(" ".join(row))
    return rows


def sets_of(rows):
    return [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (t.split() for t in rows)]


def near(rows):
    s = sets_of(rows)
    return {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a, b in combinations(range(len(rows)), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8 - 1e-9}


def test_pairs_of_a_template_move_no_texts_each(spark):
    rows = template(240, 150, 1)
    df = spark.createDataFrame(list(enumerate(rows)), "sample_id long, text string").repartition(4)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # as large tables are joined
    before = shuffled(spark)
    got = {(x.a, x.b): x.jaccard for x in near_text.near_pairs(df).collect()}
    moved = shuffled(spark) - before
    spark.conf.unset(threshold)
    assert got == near(rows) and len(got) > 20_000
    assert moved < 1_800_000  # 2,400,000 when each pair took a set along, compressed as well as sets of one template are


def test_hubs_in_chunks(spark):
    rows = template(60, 40, 2) + template(50, 60, 3) + ["one two", "one two three", "ü ß é", "one two"]
    df = spark.createDataFrame(list(enumerate(rows)), "sample_id long, text string")
    met = spark.createDataFrame([(a, b, 40, 50) for a, b in combinations(range(len(rows)), 2)], "a long, b long, n_a int, n_b int")
    for most in (100, 700, 10**6):
        found = near_text._compared(met, df, 5, 0.8, shingles=most).collect()
        assert len(found) == len({(x.a, x.b) for x in found}) and {(x.a, x.b): x.jaccard for x in found} == near(rows)
