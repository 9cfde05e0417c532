"""Locally consistent parsing against a plain parser, and the likeness of neighbours against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import phrase_parsing as pp

WORD = (1 << 64) - 1


def scramble(x):
    for _ in range(2):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & WORD
    return x ^ x >> 32


def tossed(x):
    """Labels of symbols, one symbol at a time."""
    own = [v & 0xFFFFFFFF for v in x]
    for rest in range(3):
        pairs = zip([own[0] ^ 1, *own], own)
        own = [pp._toss(a, b) for a, b in pairs]
    return own


def plain_parse(text):
    """Phrases (level, name) and the name of the whole text, one phrase at a time."""
    x, level, found = [scramble((ord(c) + 1) * 0x9E3779B97F4A7C15 & WORD) for c in text], 0, Counter()
    while x:
        level += 1
        runs = []
        for v in x:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        for v, n in runs:
            if level <= pp.COARSE and n > pp.LONG:
                found[pp.COARSE, scramble(v + level & WORD)] += n - pp.LONG
        x = [v if n == 1 else scramble(v + n * 0xD6E8FEB86659FD93 & WORD) for v, n in runs]
        label = tossed(x)
        starts = [0, *(i for i in range(1, len(x) - 1) if label[i - 1] < label[i] > label[i + 1])]
        x = [scramble(sum(v * int(pp.PLACES[k]) for k, v in enumerate(x[a:b])) + (b - a) * 0xA0761D6478BD642F + level & WORD) for a, b in zip(starts, [*starts[1:], len(x)])]
        found.update((level, v) for v in x)
        if level >= pp.COARSE and len(x) == 1:
            return found, x[0]
    return found, 0


TEXTS = ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaa", "abababababababababababab", "The cat sat on the mat. " * 3, "\U0001f600é\x00" * 5, "".join(random.Random(1).choices("abcdef ", k=700)), "x" * 5000 + "y" + "x" * 4000]


@pytest.mark.parametrize("at_once", [10, 1 << 16])
def test_parse_equals_plain_parse(monkeypatch, at_once):
    monkeypatch.setattr(pp, "AT_ONCE", at_once)
    owner, name, level, whole = pp.parse(TEXTS)
    for i, t in enumerate(TEXTS):
        found, top = plain_parse(t)
        assert Counter((int(l), int(n)) for o, n, l in zip(owner, name, level) if o == i) == found
        assert int(whole[i]) == top
    prints = pp.fingerprints(TEXTS)
    assert prints == [pp.fingerprints([t])[0] for t in TEXTS] and len(set(prints)) == len(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc d", max_size=60), st.text(alphabet="abc d", max_size=60), st.integers(0, 1000))
def test_equal_substrings_share_their_interior_phrases(before, after, seed):
    """A passage in any surroundings keeps all its phrases of the third level but for some at its ends."""
    passage = "".join(random.Random(seed).choices("abcdefgh ", k=1500))
    names = lambda t: Counter({k: n for k, n in plain_parse(t)[0].items() if k[0] == pp.COARSE})
    alone, within = names(passage), names(before + passage + after)
    assert sum((alone & within).values()) >= sum(alone.values()) - 12


def test_likeness_follows_the_text_in_common():
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=k)) for k in (12, 60, 400, 3000)]
    for t, other in zip(texts, reversed(texts)):
        own, same, edited, far = pp.fingerprints([t, t, t[: len(t) - len(t) // 4] + other[: len(t) // 4], other[::-1]])
        assert pp.likeness(own, same) == 1.0
        assert 0.45 < pp.likeness(own, edited) < 0.95
        assert pp.likeness(own, far) < 0.1
    empty = pp.fingerprints([""])[0]
    assert pp.likeness(empty, empty) == 1.0 and pp.likeness(empty, own) == pp.likeness(own, empty) == 0.0


def test_long_runs_keep_their_likeness():
    unit = "Beverer " * 1000
    a, b = pp.fingerprints([unit, unit[:6000] + "".join(random.Random(3).choices("abcdef ghi", k=2000))])
    assert 0.5 < pp.likeness(a, b) < 0.95


def brute_force(rows):
    """Rows (id, text) in order, each with its edited text and likenesses."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows, out = sorted(rows, key=key), []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        p, e, n = pp.fingerprints([t, edited, following])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), p, e, pp.likeness(p, e), pp.likeness(p, n)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_query_equals_brute_force(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(i, rnd.choice(["", None, "abc " * i, "".join(rnd.choices("abcdefg é", k=rnd.randint(1, 900)))])) for i in rnd.sample(range(-50, 500), 40)] + [(None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("fingerprint", "part", "last", "h", "n", "following", "follows")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted(map(tuple, pp.edited_likeness(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_force(rows)


def test_repeated_rows_single_rows_and_none(spark):
    schema = "doc_id long, text string"
    assert pp.edited_likeness(spark.createDataFrame([], schema)).count() == 0
    one = pp.edited_likeness(spark.createDataFrame([(5, "abcdefgh")], schema)).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(5, hashlib.sha256(b"abcdefab").hexdigest())] and one[0].near_next == 1.0
    many = pp.edited_likeness(spark.createDataFrame([(1, "same text here")] * 300 + [(2, "y" * 200_000)], schema)).collect()
    assert sum(r.near_next == 1.0 for r in many) == 299 and len({r.fingerprint for r in many if r.doc_id == 1}) == 1


def test_query_over_the_documents(spark, sf_dir):
    from plumbline.llm.registry import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_phrase_parsing"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force([tuple(r) for r in docs])
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)
