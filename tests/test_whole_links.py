"""Links of equal signatures that a star once left out."""

import random
from itertools import combinations

from plumbline.operators import blocks, hash_pairs


def test_equal_signatures_of_different_contents_meet_in_full(spark, monkeypatch):
    r = random.Random(3)
    signatures = [(r.getrandbits(62), r.getrandbits(62)) for _ in range(12)]
    signatures += [(h ^ (1 << r.randrange(60)), f) for h, f in signatures]
    rows = [(i, *signatures[i % len(signatures)], f"content {i if i % 5 else i % len(signatures)}") for i in range(240)]
    first = {}
    for i, h, f, c in rows:
        first.setdefault((h, f, c), i)
    far = lambda a, b: (a ^ b).bit_count()
    want = {(first[h, f, c], i, 0, far(h, f)) for i, h, f, c in rows if first[h, f, c] != i}
    kinds = [(i, h, f) for (h, f, _), i in first.items()]
    pairs = {(a, b, far(ha, hb), min(far(ha, fb), far(fa, hb))) for (a, ha, fa), (b, hb, fb) in combinations(sorted(kinds), 2)}
    df = spark.createDataFrame(rows, "sample_id long, hash long, flip long, words string")
    for limit, lookups in ((13, blocks.LOOKUPS), (6, 1.0)):
        monkeypatch.setattr(blocks, "LOOKUPS", lookups)
        got = [tuple(x) for x in hash_pairs.mirrored_pairs(df, limit, crowd=40, content="words").collect()]
        expected = want | {p for p in pairs if min(p[2:]) <= limit}
        assert len(got) == len(set(got)) and set(got) == expected
        assert any(p[2] == 0 for p in expected - want)


def test_ids_that_are_no_numbers_in_blocks(spark):
    rows = [(f"file:///x{i}.png", h, None) for i, h in enumerate((0, 1, 3, -1))]
    got = {tuple(x) for x in hash_pairs.mirrored_pairs(spark.createDataFrame(rows, "sample_id string, hash long, flip long"), 20).collect()}
    assert got == {(rows[a][0], rows[b][0], d, None) for a, b, d in ((0, 1, 1), (0, 2, 2), (1, 2, 1))}
