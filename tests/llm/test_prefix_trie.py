"""The prefix trie against a dictionary of prefixes, its parentheses against a stack."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 500, 4000])
@pytest.mark.parametrize("deep", [0.3, 0.5, 0.9])
def test_parentheses_equal_a_stack(n, deep):
    rnd = random.Random(n)
    opens, depth, left = [True], 1, n - 1
    while depth:
        if left and (depth == 1 or rnd.random() < deep):
            opens.append(True)
            depth, left = depth + 1, left - 1
        elif depth > 1 or not left:
            opens.append(False)
            depth -= 1
    shape, stack, close = pt.Parentheses(np.array(opens)), [], {}
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        else:
            close[stack.pop()] = i
    at = np.flatnonzero(opens)
    assert shape.find_close(at).tolist() == [close[i] for i in at]
    sizes, leaves = shape.subtrees()
    assert sizes.tolist() == [sum(opens[i : close[i]]) for i in at]
    assert leaves.tolist() == [sum(a and not b for a, b in zip(opens[i : close[i]], opens[i + 1 : close[i] + 1])) for i in at]


def brute_force(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), digest, role, text))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        block = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        own = tuple(turns.get(block, [])[:h] + turns[c][h:])
        ends[own].append(c)
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
    kids, total = defaultdict(int), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        gain = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            total[node[:d]][0] += node not in kids
            total[node[:d]][1] += gain
    hashed = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(w), len(k), min(members[k[:-1]]) if k else None, len(w), kids[k], *total[k], hashed(ends.get(k, []))) for k, w in members.items()), key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(seed, convs, deepest=12):
    rnd = random.Random(seed)
    said = ["a", "b b", "c\tc\nc", "", None, "d " * 30]
    rows = []
    for c in rnd.sample(range(-60, 4 * convs), convs):
        length = rnd.randint(1, rnd.choice([2, 5, deepest]))
        rows += [(c, t, rnd.choice(["user", "assistant", None]) if rnd.random() < 0.2 else "user", said[min(int(rnd.expovariate(1.2)), 5)]) for t in range(length)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, shard_turns", [(1, 40, 10**6), (2, 120, 100), (3, 400, 60), (4, 300, 500)])
def test_trie_equals_brute_force(spark, seed, convs, shard_turns):
    rows = made(seed, convs)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("path", "words", "depth", "base", "n")})
    assert result(pt.prefix_trie(df, shard_turns)) == brute_force(rows)


def test_many_equal_conversations_and_a_long_one(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(5)]
    rows += [(1000, t, "user", f"line {t}") for t in range(400)] + [(1001, t, "user", f"line {t}") for t in range(350)]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), 100)) == brute_force(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (None, 0, "user", "nobody"), (23, 0, "user", "own"), (40, 1, "user", "a"), (40, None, "user", "b"), (41, 0, "user", "z"), (-5, 0, "user", "minus"), (0, 0, "user", "zero")]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_conversations(spark, sf_dir):
    from plumbline.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_prefix_trie"](spark, sf_dir)) == brute_force(rows)
