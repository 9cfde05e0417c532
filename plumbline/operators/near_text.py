"""Near copies of texts: shingle sets, pairs at a Jaccard similarity, and the relation of each pair."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators.graph import connected_components

SAMPLED, COMMON = 16, 200_000  # one text in SAMPLED is looked at for the COMMON most common shingles
SHINGLES = 1_000_000  # of texts that are compared in one block
NEAR = ["a", "b", "jaccard", "size_ratio"]
RESIZED = 0.97  # sizes of near copies in a smaller ratio than this make the one an extension of the other


def _runs(text: str | None, width: int) -> np.ndarray:
    """The different runs of ``width`` words of a text, hashed; a text of fewer words is one run, one without words has none."""
    import xxhash

    words = [w for w in (text or "").split(" ") if w]
    n = max(len(words) - width + 1, 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(n)), np.uint64, n).view(np.int64))


def shingles(texts: DataFrame, width: int) -> DataFrame:
    """``sample_id`` and ``s``: the runs of ``_runs``, by hash. Arrow batches, some rows at a time: running windows over arrays have no fast built-in form."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_runs(t.as_py(), width) for t in part.column(1)], pa.list_(pa.int64()))], names=["sample_id", "s"])

    kind = texts.schema["sample_id"].dataType.simpleString()
    return texts.select("sample_id", "text").mapInArrow(run, f"sample_id {kind}, s array<bigint>")


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that several texts of a sample have, the rarest first; at most ``COMMON`` reach the driver."""
    some = texts.filter(F.pmod(F.xxhash64("sample_id"), F.lit(SAMPLED)) == 0)
    seen = shingles(some, width).select(F.explode("s").alias("h")).groupBy("h").count().filter("count > 1")
    return seen.orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow().column("h").to_numpy()[::-1].astype(np.int64)


def representatives(hashed: DataFrame, key: str = "norm_sha") -> DataFrame:
    """The row with the smallest id of each different content."""
    first = hashed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("sample_id").alias("sample_id"))
    return hashed.join(first, ["sample_id", key], "left_semi")


def near_pairs(texts: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``sample_id`` whose ``text``s have a Jaccard similarity of ``similarity`` or more, with ``jaccard`` and ``size_ratio``.

    Take representatives of equal texts, since pairs are returned in full; ``near_connections`` gives
    what connects them only. Candidates share one of
    their first shingles (n - ceil(similarity * n) + 1 of n, in one order for all), which loses no
    pair; common shingles come last in that order, so that a passage that many texts hold brings no
    pairs. Sizes and places in the order rule most pairs out before any sets meet; what is left is
    compared in blocks to which a text is sent once. Texts without words take no part.
    """
    sketches = _sketches(texts, width, similarity)
    return _compared(_candidates(sketches, similarity), texts, width, similarity)


def near_connections(texts: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """Near pairs that connect the same texts as all of ``near_pairs`` do, with the same columns, but far fewer of them.

    Texts with ``rows`` equal minima of hashed shingles in one of ``bands`` bands are compared with the
    smallest id that has these, so m texts of one template give stars and not m * m / 2 pairs. What is
    found so joins texts into groups; the exact search of ``near_pairs`` then looks only at pairs of
    different groups, and not at all at shingles that a single group has. Every pair is compared
    whole, and the second search loses none, so components are exact whatever the minima miss.
    """
    sketches = _sketches(texts, width, similarity, bands, rows)
    seats = sketches.select("sample_id", "n", F.posexplode("minima").alias("band", "key"))
    anchors = seats.groupBy("band", "key").agg(F.min(F.struct("sample_id", "n")).alias("a"), F.count("*").alias("several")).filter("several > 1").drop("several")
    starred = seats.join(anchors, ["band", "key"]).filter("a.sample_id <> sample_id").filter(_sizes_allow(F.col("a.n"), F.col("n"), similarity))
    starred = starred.select(F.col("a.sample_id").alias("a"), F.col("sample_id").alias("b"), F.col("a.n").alias("n_a"), F.col("n").alias("n_b")).distinct()
    stars = materialize(_compared(starred, texts, width, similarity), "near-stars")
    groups = connected_components(stars, "a", "b").select(F.col("node").alias("sample_id"), F.col("component").alias("group"))
    return stars.unionByName(_compared(_candidates(sketches, similarity, groups), texts, width, similarity))


def _sketches(texts: DataFrame, width: int, similarity: float, bands: int = 0, rows: int = 0) -> DataFrame:
    """``sample_id``, ``n`` (shingles), ``first`` (as many of them as have to be looked at) and ``minima`` (for each band a hash of its minima over all shingles) of texts that have words.

    Shingles stand in one order, the same for all texts: by hash, but common ones last, the rarest of
    these first. The other shingles are not kept; texts that may be near are taken apart again.
    """
    common = common_shingles(texts, width)
    by_hash = np.argsort(common)
    shared = texts.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))  # at most COMMON entries
    odd = np.random.default_rng(42).integers(1, 2**63, (2, bands * rows), dtype=np.uint64) | np.uint64(1)

    def ordered(found: np.ndarray) -> np.ndarray:
        known, rank = shared.value
        if not len(known):
            return found
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        return found[np.argsort(np.where(known[at] == found, rank[at], -1), kind="stable")]

    def minima(found: np.ndarray) -> np.ndarray:
        import xxhash

        s, least = found.view(np.uint64), np.full(bands * rows, np.iinfo(np.uint64).max)
        for i in range(0, len(s) if bands else 0, 4096):
            mixed = s[i : i + 4096, None] * odd[0] + odd[1]
            least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * odd[0]).min(0))
        return np.array([xxhash.xxh64_intdigest(b.tobytes(), 42) for b in least.reshape(bands, rows)], np.uint64).view(np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [_runs(t.as_py(), width) for t in part.column(1)]
                n = np.array([len(s) for s in sets])
                first = [ordered(s)[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1] for s in sets]
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(first, lists), pa.array([minima(s) for s in sets], lists)], names=["sample_id", "n", "first", "minima"]).filter(pa.array(n > 0))

    kind = texts.schema["sample_id"].dataType.simpleString()
    return materialize(texts.select("sample_id", "text").mapInArrow(run, f"sample_id {kind}, n int, first array<bigint>, minima array<bigint>"), "near-sketches")


def _sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity - 1e-9) * F.greatest(a, b)


def _candidates(sketches: DataFrame, similarity: float, groups: DataFrame | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` that sizes and places in the order leave possible, with ``n_a`` and ``n_b``; with ``groups``, only those of different groups.

    It suffices that a pair is left at the first shingle that both have: nothing before is equal, so
    what is common is that one and of those after it at most as many as the text with fewer has.
    """
    seats = sketches.select("sample_id", "n", F.posexplode("first").alias("at", "key"))
    own, differ = ["sample_id", "n", "at"], F.lit(True)
    if groups is not None:  # a text without a near one is a group of its own
        placed = sketches.select("sample_id", "n", "first").join(groups, "sample_id", "left").withColumn("group", F.coalesce("group", "sample_id"))
        seats = placed.select("sample_id", "n", "group", F.posexplode("first").alias("at", "key"))
        mixed = seats.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
        seats, own, differ = seats.join(mixed, "key"), [*own, "group"], F.col("group_a") != F.col("group_b")
    side = lambda x: seats.select("key", *[F.col(c).alias(f"{c}_{x}") for c in own])
    most = F.lit(1) + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    least = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = side("a").join(side("b").hint("merge"), "key").filter((F.col("sample_id_a") < F.col("sample_id_b")) & differ & _sizes_allow(F.col("n_a"), F.col("n_b"), similarity) & (most >= least))
    return met.select(F.col("sample_id_a").alias("a"), F.col("sample_id_b").alias("b"), "n_a", "n_b").distinct()


def _compared(met: DataFrame, texts: DataFrame, width: int, similarity: float, shingles: int = SHINGLES) -> DataFrame:
    """Those of the pairs ``met`` that are similar enough, compared whole: ``a``, ``b``, ``jaccard``, ``size_ratio``.

    A pair takes the smallest partner of its ``a`` for its hub. Pairs of some hubs meet the texts that
    they need in one block, where each text is sent once, however many pairs it has there. A hub of
    more than ``shingles`` is split into chunks, and its pairs go to the blocks of two chunks.
    """
    met = materialize(met, "near-candidates")
    end = lambda x, y: met.select(F.col(x).alias("sample_id"), F.col(f"n_{x}").alias("n"), F.least(x, y).alias("hub"))
    hub = end("a", "b").unionByName(end("b", "a")).groupBy("sample_id").agg(F.min("hub").alias("hub"))
    held = materialize(met.join(hub.withColumnRenamed("sample_id", "a"), "a"), "near-hubs")
    side = lambda x: held.select("hub", F.col(x).alias("sample_id"), F.col(f"n_{x}").alias("n"))
    sizes = materialize(side("a").unionByName(side("b")).distinct().groupBy("hub").agg(F.sum("n").alias("n")), "near-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    blocks = max(4 * texts.sparkSession.sparkContext.defaultParallelism, -(-total // shingles))
    crowded = sizes.filter(F.col("n") > shingles).select("hub", F.ceil(F.col("n") / shingles).cast("int").alias("chunks"))
    chunk = lambda x: F.coalesce(F.pmod(F.xxhash64(x), F.col("chunks")).cast("int"), F.lit(0))
    place = F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("hub"), F.lit(blocks)).cast("string")).otherwise(F.concat(F.lit("hub "), F.col("hub").cast("string")))
    pairs = held.join(crowded, "hub", "left").select(place.alias("block"), F.least(chunk("a"), chunk("b")).alias("c"), F.greatest(chunk("a"), chunk("b")).alias("d"), "a", "b")
    pairs = materialize(pairs, "near-blocks")
    key = ["block", "c", "d"]
    wanted = pairs.select(*[F.col(c).alias(c) for c in key], F.explode(F.array("a", "b")).alias("sample_id")).distinct()
    sent = texts.select("sample_id", "text").join(wanted, "sample_id")
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(asked: pa.Table, members: pa.Table) -> pa.Table:
        if not asked.num_rows or not members.num_rows:
            return pa.table([pa.array([], asked.schema.field(c).type) for c in ("a", "b")] + [pa.array([], pa.float64())] * 2, names=NEAR)
        at = {i: k for k, i in enumerate(members.column("sample_id").to_pylist())}
        sets = [_runs(t.as_py(), width) for t in members.column("text")]
        a, b = (np.array([at[i] for i in asked.column(c).to_pylist()]) for c in ("a", "b"))
        order = np.argsort(a, kind="stable")
        common, n = np.empty(len(a), np.int64), np.array([len(s) for s in sets])
        common[order] = _common(sets, a[order], b[order])
        jaccard = common / (n[a] + n[b] - common)
        out = pa.table([asked.column("a"), asked.column("b"), pa.array(jaccard), pa.array(np.minimum(n[a], n[b]) / np.maximum(n[a], n[b]))], names=NEAR)
        return out.filter(pa.array(jaccard >= similarity - 1e-9))

    return pairs.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(compare, f"a {kind}, b {kind}, jaccard double, size_ratio double")


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members the sets ``a`` and ``b`` of each pair share; ``a`` ascends, and no set is empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    names, member = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(len(names), bool), np.empty(len(a), np.int64)
    for lo, hi in zip(first := np.flatnonzero(np.diff(a, prepend=-1)), [*first[1:], len(a)]):
        mine = member[starts[a[lo]] : starts[a[lo]] + sizes[a[lo]]]
        mark[mine] = True
        for at in range(lo, hi, 1024):
            others = b[at : min(hi, at + 1024)]
            n = sizes[others]
            before = np.cumsum(n) - n
            out[at : at + len(others)] = np.add.reduceat(mark[member[np.repeat(starts[others] - before, n) + np.arange(n.sum())]].astype(np.int64), before)
        mark[mine] = False
    return out


def classify_pairs(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """``pairs`` with ``relation``: exact, normalized, resized (one extends the other) or near, the first that holds."""
    of = lambda x: hashed.select(F.col("sample_id").alias(x), F.col("raw_sha").alias(f"raw_{x}"), F.col("norm_sha").alias(f"norm_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    relation = F.when(F.col("raw_a") == F.col("raw_b"), "exact").when(F.col("norm_a") == F.col("norm_b"), "normalized").when(F.col("size_ratio") < RESIZED, "resized").otherwise("near")
    return both.select("a", "b", "jaccard", "size_ratio", relation.alias("relation"))
