"""Mirrored and crowded hash joins against every pair, and findings of versions."""

import random

from plumbline.operators import families, hash_pairs

SCHEMA = "sample_id long, hash long, flip long, band int, key string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def mirrored(x):
    return int(f"{x:064b}"[::-1], 2)


def every_pair(rows, limit):
    far = lambda a, b: (a ^ b).bit_count()
    first, found = {}, set()
    for i, h, f in sorted(rows):
        first.setdefault((h, f), i)
    for i, h, f in rows:
        if first[h, f] != i:
            found.add((first[h, f], i, 0, None if f is None else far(h, f)))
    kinds = [(i, h, f) for (h, f), i in first.items()]
    for a, ha, fa in kinds:
        for b, hb, fb in kinds:
            if a < b:
                m = min((far(p, q) for p, q in ((ha, fb), (fa, hb)) if p is not None and q is not None), default=None)
                if min(far(ha, hb), 64 if m is None else m) <= limit:
                    found.add((a, b, far(ha, hb), m))
    return found


def planted(n, seed, hot):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.2:
            h = rows[r.randrange(len(rows))][1] ^ sum(1 << r.randrange(64) for _ in range(r.randrange(9)))
            h &= (1 << 64) - 1
        elif rows and kind < 0.4:
            h = mirrored(rows[r.randrange(len(rows))][1]) ^ (1 << r.randrange(64))
        elif rows and kind < 0.5:
            h = rows[r.randrange(len(rows))][1]
        elif kind < 0.5 + hot:
            h = (r.getrandbits(48) << 16) | 0xBEEF  # one part that very many share
        else:
            h = r.getrandbits(64)
        rows.append((i, h, mirrored(h) if r.random() < 0.9 else None))
    return rows


def found(spark, rows, limit, **how):
    df = spark.createDataFrame([(i, None if h is None else signed(h), None if f is None else signed(f), 7, "k") for i, h, f in rows], SCHEMA)
    got = [(r.a, r.b, r.distance, r.mirror_distance) for r in hash_pairs.mirrored_pairs(df, limit, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_mirrored_and_crowded(spark):
    rows = planted(400, 1, 0.4)
    assert found(spark, rows, 12, crowd=40) == every_pair(rows, 12)
    assert found(spark, rows, 5, bands=8) == every_pair(rows, 5)


def test_odd_rows(spark):
    assert found(spark, [], 12) == set()
    assert found(spark, [(1, None, 5), (2, 9, None), (3, 9, None), (4, 9, 9)], 0) == {(2, 3, 0, None), (2, 4, 0, 0)}


def sample(i, text, label="a", split="train"):
    return (i, text, label, split)


def statuses(spark, before, after, near):
    h = lambda rows: families.content_hash(spark.createDataFrame(rows, "sample_id long, text string, label string, split string"))
    shas = {r.text: r.norm_sha for r in h(before + after).collect()}
    links = spark.createDataFrame([(shas[a], shas[b]) for a, b in near], "a string, b string")
    return sorted(((r.kind, r.status, r.n_before, r.n_after) for r in families.findings_between(h(before), h(after), links).collect()), key=str)


def test_findings_survive_new_ids(spark):
    before = [sample(1, "one"), sample(2, "one", split="test"), sample(3, "two"), sample(4, "two!", "b"), sample(5, "gone"), sample(6, "gone"), sample(7, None), sample(8, None)]
    after = [sample(11, "one"), sample(12, "one", split="test"), sample(13, "one"), sample(14, "two"), sample(15, "two!", "b", "val"), sample(16, "gone"), sample(17, "new"), sample(18, "new", "b")]
    expected = {
        ("family", "persisting", 2, 3), ("leak", "persisting", 2, 3),
        ("family", "persisting", 2, 2), ("label_conflict", "persisting", 2, 2), ("leak", "new", None, 2),
        ("family", "resolved", 2, None), ("family", "new", None, 2), ("label_conflict", "new", None, 2),
    }
    got = statuses(spark, before, after, [("two", "two!")])
    assert len(got) == len(expected) and set(got) == expected


def test_a_link_goes_with_its_content(spark):
    before = [sample(1, "x"), sample(2, "y", split="val"), sample(3, "z", split="test")]
    chain = [("x", "y"), ("y", "z")]
    assert statuses(spark, before, [before[0], before[2]], chain) == [("family", "resolved", 3, None), ("leak", "resolved", 3, None)]
    assert statuses(spark, before, before, chain) == [("family", "persisting", 3, 3), ("leak", "persisting", 3, 3)]
    assert statuses(spark, [], before, []) == []


def test_wide_distances_are_compared_in_blocks(spark, monkeypatch):
    """Beyond the share of lookups every pair is compared; both ways give the same, and nothing is broadcast that grows."""
    from plumbline.operators import blocks, similarity

    rows = planted(1300, 5, 0.1) + [(5000 + i, None, None) for i in range(3)]
    df = spark.createDataFrame([(i, None if h is None else signed(h), None if f is None else signed(f)) for i, h, f in rows], "sample_id long, hash long, flip long")
    close = lambda n: {tuple(r) for r in hash_pairs.mirrored_pairs(df, n).collect()}
    straight = lambda n: {tuple(r) for r in similarity.hamming_join(df, n).collect()}
    called, every = [], blocks.close_signatures
    monkeypatch.setattr(blocks, "close_signatures", lambda *a, **b: called.append(1) or every(*a, **b))
    wide, plain = close(13), straight(13)
    assert len(called) == 2
    assert wide == every_pair([r for r in rows if r[1] is not None], 13)
    assert plain == {(a, b, d) for a, b, d in straight_pairs(rows, 13)}
    called.clear()
    monkeypatch.setattr(blocks, "LOOKUPS", 1.0)
    assert close(6) == {r for r in wide if min(r[2], 64 if r[3] is None else r[3]) <= 6} and straight(6) == {r for r in plain if r[2] <= 6} and not called


def straight_pairs(rows, limit):
    first = {}
    for i, h, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        first.setdefault(h, i)
    yield from ((first[h], i, 0) for i, h, _ in rows if h is not None and first[h] != i)
    kinds = sorted((i, h) for h, i in first.items())
    yield from ((a, b, (x ^ y).bit_count()) for n, (a, x) in enumerate(kinds) for b, y in kinds[n + 1 :] if (x ^ y).bit_count() <= limit)
