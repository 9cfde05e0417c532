"""Few links connect what all near pairs connect."""

import random

from plumbline.operators import near_text
from plumbline.operators.graph import connected_components


def groups(df):
    return {r.node: r.component for r in connected_components(df.select("a", "b"), "a", "b").collect()}


def edited(r, words, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
    return " ".join(words)


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "sample_id long, text string")


def test_a_template_and_chains(spark):
    r = random.Random(1)
    template = [f"t{i}" for i in range(150)]
    rows = [edited(r, template, 1) for _ in range(300)]  # all near each other
    for c in range(8):  # chains, whose ends are far from each other
        at = [f"c{c}w{i}" for i in range(90)]
        for _ in range(10):
            rows.append(" ".join(at))
            at = edited(r, at, 1).split()
    rows += [f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5} alone{i}" for i in range(60)] + ["", None, "one", "two words"]
    r.shuffle(rows)
    df = texts(spark, rows)
    for similarity in (0.8, 0.6):
        every, few = near_text.near_pairs(df, similarity=similarity), near_text.near_connections(df, similarity=similarity)
        assert groups(few) == groups(every)
        found = {(x.a, x.b): (x.jaccard, x.size_ratio) for x in every.collect()}
        links = few.collect()
        assert {(x.a, x.b): (x.jaccard, x.size_ratio) for x in links}.items() <= found.items()
        assert len(links) == len({(x.a, x.b) for x in links}) < len(found) / 5


def test_what_the_minima_miss_is_found(spark):
    r = random.Random(2)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(120)]
        rows += [" ".join(base), edited(r, base, 2)]
    df = texts(spark, rows)
    every = near_text.near_pairs(df)
    assert groups(near_text.near_connections(df, bands=1, rows=16)) == groups(every) and every.count() > 40


def test_no_texts(spark):
    assert near_text.near_connections(texts(spark, ["", None, "  "])).count() == 0
    assert near_text.near_connections(texts(spark, ["x"]).limit(0)).count() == 0
