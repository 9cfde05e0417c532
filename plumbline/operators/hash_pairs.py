"""Pairs of images (or anything else with two signatures) whose hashes are close, directly or mirrored."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators import blocks


def mirrored_pairs(hashes: DataFrame, max_distance: int, bands: int = 4, crowd: int = 4096, content: str | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of ids that are within ``max_distance`` bits, with ``distance`` and ``mirror_distance``.

    ``hashes`` has ``sample_id``, ``hash`` and ``flip``, the hash of the mirrored image (64 bits each).
    ``distance`` is that of the hashes, ``mirror_distance`` the smaller one of a hash to the other's
    flip; one of them at most has to be near, and both are given in full. Multi-index hashing: of
    ``bands`` parts one differs in at most max_distance // bands bits, so each hash is looked up under
    all values within that distance, among hashes and flips alike. A pair is taken only at the first
    part at which it meets, so nothing has to be made distinct. A part shared by more than ``crowd``
    signatures is split into a grid of squares of about that size, whose pairs different tasks compare.
    Where a distance is so large that lookups would visit more than ``blocks.LOOKUPS`` of all pairs,
    every pair is compared in blocks instead.

    Copies are rows that are equal in the column ``content``; where only signatures are given, those
    with the same hash and flip. They meet the others through the smallest of their ids, and that one
    alone (a star). Rows of different contents meet in full, also if their signatures are equal. Rows
    without a hash take no part; without a flip they have no mirrored side.
    """
    if 64 % bands:
        raise ValueError("the number of bands must divide 64")
    told = [F.col(content).alias("content")] if content else []
    every = hashes.filter("hash is not null").select("sample_id", "hash", "flip", *told)
    same = ["hash", "flip", *(["content"] if content else [])]
    least = every.groupBy(*same).agg(F.min("sample_id").alias("first"), F.count("*").alias("n"))
    cross = F.bit_count(F.col("hash").bitwiseXOR(F.col("flip")))
    equal = reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"l.{c}")) for c in same])
    star = every.alias("x").join(least.filter("n > 1").alias("l"), equal).filter("sample_id <> first")
    star = star.select(F.col("first").alias("a"), F.col("sample_id").alias("b"), F.col("x.hash").alias("hash"), F.col("x.flip").alias("flip")).select("a", "b", F.lit(0).alias("distance"), cross.alias("mirror_distance"))

    kinds = materialize(least.select(F.col("first").alias("sample_id"), "hash", "flip"), "hash-kinds")
    width, radius = 64 // bands, max_distance // bands
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    if bands * len(masks) > blocks.LOOKUPS * 2**width:
        numbered = materialize(kinds.withColumn("number", F.monotonically_increasing_id()), "hash-numbers")  # ids may be paths
        close = blocks.close_signatures(numbered.select(F.col("number").alias("sample_id"), "hash", "flip"), max_distance)
        name = lambda x: numbered.select(F.col("number").alias(x), F.col("sample_id").alias(f"id_{x}"))
        named = close.join(name("a"), "a").join(name("b"), "b").filter("id_a <> id_b")
        return named.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "distance", "mirror_distance").unionByName(star)
    ones = F.lit((1 << width) - 1).cast("bigint")
    part = lambda h, i: F.shiftrightunsigned(h, i * width).bitwiseAND(ones)
    parts = lambda h: F.explode(F.array(*[F.struct(F.lit(i).alias("band"), part(h, i).alias("key")) for i in range(bands)]))
    signatures = kinds.select("sample_id", F.explode(F.array(F.col("hash"), F.col("flip"))).alias("sig")).filter("sig is not null").distinct()
    table = signatures.select("sample_id", "sig", parts(F.col("sig")).alias("t")).select(F.col("sample_id").alias("y"), F.col("sig").alias("sy"), "t.band", "t.key")
    probes = kinds.select("sample_id", "hash", parts(F.col("hash")).alias("t")).select(F.col("sample_id").alias("x"), F.col("hash").alias("sx"), "t.band", F.explode(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.col("t.key").bitwiseXOR(m))).alias("key"))

    # how many squares a side each crowded part takes; other parts aren't in this table and take one
    held = table.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).withColumn("side", F.ceil(F.col("n") / crowd).cast("int"))
    sized = lambda df: df.join(held.select("band", "key", "side"), ["band", "key"], "left").withColumn("side", F.coalesce("side", F.lit(1)))
    seat = lambda of: F.pmod(F.xxhash64(of, "band"), F.col("side")).cast("int")
    along = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    left = sized(probes).select("band", "key", "x", "sx", seat("x").alias("row"), along.alias("column"))
    right = sized(table).select("band", "key", "y", "sy", along.alias("row"), seat("y").alias("column"))
    differ = F.col("sx").bitwiseXOR(F.col("sy"))
    near_at = [F.bit_count(part(differ, i)) <= radius for i in range(bands)]
    first_at = F.coalesce(*[F.when(test, i) for i, test in enumerate(near_at)])
    met = left.join(right.hint("merge"), ["band", "key", "row", "column"]).filter((F.col("x") != F.col("y")) & (F.bit_count(differ) <= max_distance) & (F.col("band") == first_at))
    pairs = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.lit(1).alias("__met")).drop("__met")
    side = lambda n: kinds.select(F.col("sample_id").alias(n), F.col("hash").alias(f"h_{n}"), F.col("flip").alias(f"f_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = lambda p, q: F.bit_count(F.col(p).bitwiseXOR(F.col(q)))
    return both.select("a", "b", apart("h_a", "h_b").alias("distance"), F.least(apart("h_a", "f_b"), apart("f_a", "h_b")).alias("mirror_distance")).unionByName(star)
