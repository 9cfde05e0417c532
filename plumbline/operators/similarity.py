"""Nearest neighbours and pairs within a distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.shared_storage import materialize
from plumbline.operators import blocks
from plumbline.operators.ranges import ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def register_functions(spark) -> None:
    """SQL functions ``hamming(bigint, bigint)`` and ``cosine(array, array)``."""
    spark.sql("create or replace temporary function hamming(a bigint, b bigint) returns int return bit_count(a ^ b)")
    inner = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0d, (s, x) -> s + x)"
    spark.sql(
        "create or replace temporary function cosine(a array<double>, b array<double>) returns double "
        f"return {inner.format('a', 'b')} / (sqrt({inner.format('a', 'a')}) * sqrt({inner.format('b', 'b')}))"
    )


NEIGHBOR = pa.schema([("sample_id", pa.int64()), ("neighbor_id", pa.int64()), ("sim", pa.float64())])


def _take(best: np.ndarray, best_id: np.ndarray, r: np.ndarray, c: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Put similarities of ids ``c`` among the best of rows ``r``, ties to the smaller id; the rows that were touched."""
    touched, k = np.unique(r), best.shape[1]
    row = np.concatenate((np.repeat(touched, k), r))
    sim, c = np.concatenate((best[touched].ravel(), sim)), np.concatenate((best_id[touched].ravel(), c))
    order = np.lexsort((c, -sim, row))
    first = np.searchsorted(row[order], touched)
    chosen = order[first[:, None] + np.arange(k)]
    best[touched], best_id[touched] = sim[chosen], c[chosen]
    return touched


def _top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, exclude_self: bool, decimals: int, cosine: bool) -> pa.Table:
    """The ``k`` highest products of each row of ``q`` with the rows of ``m``, whose ``ids`` ascend.

    Products in single precision tell which pairs can still come among the best; only those are
    worked out in double precision and rounded. The bound covers the error of single precision
    (length times the unit roundoff, by Cauchy-Schwarz, for rows scaled to at most 1).
    """
    if not len(q_ids) or not len(ids):
        return NEIGHBOR.empty_table()
    q, m = q.astype(np.float64), m.astype(np.float64)
    if cosine:
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    size, most = np.maximum(np.linalg.norm(q, axis=1), 1e-150), max(np.linalg.norm(m, axis=1).max(), 1e-150)
    rough_q, rough_m = (q / size[:, None]).astype(np.float32), (m / most).astype(np.float32)
    margin, step = (q.shape[1] + 8) * 1.2e-7, 0.5 * 10.0**-decimals
    out = []
    for at in range(0, len(q_ids), 256):
        mine, mine_ids, scale = q[at : at + 256], q_ids[at : at + 256], size[at : at + 256] * most
        n = len(mine)
        best, best_id = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        least = np.full(n, -np.inf, np.float32)
        start, width = 0, 128
        while start < len(ids):
            stop = min(len(ids), start + width)
            rough = rough_q[at : at + 256] @ rough_m[start:stop].T
            flat = np.flatnonzero(rough >= least[:, None])
            if len(flat):
                r, c = np.divmod(flat, stop - start)
                # many of them by one product, a few one by one
                sim = (mine @ m[start:stop].T)[r, c] if 16 * len(flat) > rough.size else np.einsum("ij,ij->i", mine[r], m[start + c])
                sim, c = np.round(sim, decimals), ids[start + c]
                keep = np.isfinite(sim) & (sim > best[r, -1])  # ids ascend, so an equal one comes too late
                if exclude_self:
                    keep &= mine_ids[r] != c
                r, c, sim = r[keep], c[keep], sim[keep]
                if len(r):
                    touched = _take(best, best_id, r, c, sim)
                    least = ((best[:, -1] + step) / scale - margin).astype(np.float32)
            start, width = stop, min(4 * width, 4096)
        there = np.isfinite(best)
        out.append(pa.table([np.repeat(mine_ids, there.sum(1)), best_id[there], best[there]], schema=NEIGHBOR))
    return pa.concat_tables(out)


def knn_join(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = True, decimals: int = 4, block_rows: int | None = None, cosine: bool = True) -> DataFrame:
    """The ``k`` rows of ``base`` with the highest cosine (or inner product, without ``cosine``) for each row of ``queries``.

    Both have ``sample_id`` and ``embedding`` of one length. Returns ``sample_id``, ``neighbor_id``,
    ``sim`` (rounded) and ``rk`` from 1; ties go to the smaller id. Rows without a vector, or with
    null or non-finite components, take no part. Every pair of vectors is compared, in cells of a
    grid of blocks (``blocks.grid``); a cell returns ``k`` candidates for each query (some 14 bytes
    each, as shuffles are compressed), and nothing is broadcast. ``block_rows`` bounds a block; by
    default its values are bounded.
    """

    def usable(df: DataFrame) -> tuple[DataFrame, type]:
        single = isinstance(df.schema["embedding"].dataType.elementType, T.FloatType)
        vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
        rows = df.filter("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
        return rows.select(F.col("sample_id").cast("bigint").alias("sample_id"), vector.alias("embedding")), np.float32 if single else np.float64

    length = base.filter("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
    length = length["n"] if length else 1
    (left, left_type), (right, right_type) = usable(queries), usable(base)
    sides = blocks.grid(queries.count(), base.count(), block_rows or max(1, blocks.MOST_VALUES // length), 14 * k / (length * np.dtype(left_type).itemsize))
    compare = lambda q_ids, q, ids, m: _top(q_ids, q, ids, m, k, exclude_self, decimals, cosine)
    found = blocks.meet(blocks.packed(left, "embedding", sides[0]), blocks.packed(right, "embedding", sides[1]), sides, (left_type, right_type), compare, "sample_id bigint, neighbor_id bigint, sim double")
    w = Window.partitionBy("sample_id").orderBy(F.desc("sim"), "neighbor_id")
    return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def top_products(queries: DataFrame, base: DataFrame, k: int, width: int, shift: float, scale: float, decimals: int) -> DataFrame:
    """The ``k`` rows of ``base`` with the highest ``scale`` * (r . r') * (x . x' + ``shift``) for each row of ``queries``.

    ``embedding`` of both holds r, the first ``width`` numbers, and then x, so that the products of the
    two parts, of which there are far more, are never made. Otherwise as ``knn_join``: every pair is
    compared, in cells of a grid of blocks.
    """
    finite = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    usable = lambda df: df.filter(finite).select(F.col("sample_id").cast("bigint").alias("sample_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    length = base.filter("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
    length = length["n"] if length else 1

    def compare(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pa.Table:
        out = []
        for at in range(0, len(q_ids) if len(ids) else 0, 256):
            mine = q[at : at + 256]
            best, best_id = np.full((len(mine), k), -np.inf), np.full((len(mine), k), -1, np.int64)
            for start in range(0, len(ids), 4096):
                there = m[start : start + 4096]
                sims = np.round(scale * (mine[:, :width] @ there[:, :width].T) * (mine[:, width:] @ there[:, width:].T + shift), decimals)
                r, c = np.nonzero(sims > best[:, -1:])  # ids ascend, so an equal one comes too late
                if len(r):
                    _take(best, best_id, r, ids[start + c], sims[r, c])
            found = np.isfinite(best)
            out.append(pa.table([np.repeat(q_ids[at : at + 256], found.sum(1)), best_id[found], best[found]], schema=NEIGHBOR))
        return pa.concat_tables(out) if out else NEIGHBOR.empty_table()

    sides = blocks.grid(queries.count(), base.count(), max(1, blocks.MOST_VALUES // length), 14 * k / (length * 8))
    found = blocks.meet(blocks.packed(usable(queries), "embedding", sides[0]), blocks.packed(usable(base), "embedding", sides[1]), sides, (np.float64, np.float64), compare, "sample_id bigint, neighbor_id bigint, sim double")
    w = Window.partitionBy("sample_id").orderBy(F.desc("sim"), "neighbor_id")
    return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def hamming_join(hashes: DataFrame, max_distance: int, bands: int = 4) -> DataFrame:
    """Pairs ``a`` < ``b`` of ids whose 64-bit ``hash`` differs in at most ``max_distance`` bits, and ``distance``.

    Multi-index hashing: of ``bands`` equal parts one differs in at most max_distance // bands
    bits; each hash is looked up under all values within that distance, by equi-join. Different
    hashes meet through the smallest id that has them; of equal hashes each id is paired with that
    one alone (distance 0), so that many copies give a star and not all their pairs.
    """
    every = hashes.filter("hash is not null")
    first = materialize(every.groupBy("hash").agg(F.min("sample_id").alias("first")), "hash-kinds")
    star = every.join(first, "hash").filter("sample_id <> first").select(F.col("first").alias("a"), F.col("sample_id").alias("b"), F.lit(0).alias("distance"))
    hashes = first.select(F.col("first").alias("sample_id"), "hash")
    width = 64 // bands
    masks = [sum(1 << i for i in c) for r in range(max_distance // bands + 1) for c in combinations(range(width), r)]
    if bands * len(masks) > blocks.LOOKUPS * 2**width:
        close = blocks.close_signatures(hashes.select(F.col("sample_id").cast("bigint").alias("sample_id"), "hash", F.lit(None).cast("bigint").alias("flip")), max_distance)
        return close.select(*[F.col(c).cast(hashes.schema["sample_id"].dataType).alias(c) for c in ("a", "b")], "distance").unionByName(star)
    part = lambda i: F.shiftrightunsigned("hash", i * width).bitwiseAND(F.lit((1 << width) - 1))
    table = hashes.select("sample_id", "hash", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), part(i).alias("key")) for i in range(bands)])).alias("t")).select("sample_id", "hash", "t.band", "t.key")
    probes = table.select(F.col("sample_id").alias("a"), F.col("hash").alias("ha"), "band", F.explode(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hash")))
    near = probes.join(table.hint("merge"), ["band", "key"]).filter((F.col("a") < F.col("sample_id")) & (distance <= max_distance)).select("a", F.col("sample_id").alias("b"), distance.alias("distance")).distinct()
    return near.unionByName(star)


def local_density(knn: DataFrame, k: int) -> DataFrame:
    """Mean similarity of the first ``k`` neighbours; a missing one counts 0."""
    return knn.filter(F.col("rk") <= k).groupBy("sample_id").agg((F.sum("sim") / k).alias("density"))


def percentile_rank(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Stable rank / (n - 1), ties by id."""
    df = materialize(df, "to-rank")  # it is counted, sampled for ranges and read
    n = df.count()
    return ranked(df, [F.col(value), F.col("sample_id")]).withColumn(out, (F.col("rk") - 1) / F.lit(float(max(1, n - 1)))).drop("rk")


def neighbor_label_stats(knn: DataFrame, labels: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Share of the neighbours' similarity with the own label, and the strongest other label with its share.

    ``skip`` names (sample_id, neighbor_id) pairs that do not vote. Negative similarities count 0;
    a sample without votes has share 1 of its own label.
    """
    votes = knn.join(skip, ["sample_id", "neighbor_id"], "left_anti") if skip is not None else knn
    label_of = labels.select("sample_id", "label")
    named = votes.join(label_of.select(F.col("sample_id").alias("neighbor_id"), F.col("label").alias("other")), "neighbor_id")
    weights = named.groupBy("sample_id", "other").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("w"))
    own = label_of.join(weights, "sample_id", "left")
    total, same = F.sum("w"), F.sum(F.when(F.col("other") == F.col("label"), F.col("w")).otherwise(0.0))
    major = F.max(F.when(F.col("other") != F.col("label"), F.struct(F.round("w", 9).alias("w"), (-F.col("other")).alias("o"))))
    return own.groupBy("sample_id", "label").agg(total.alias("total"), same.alias("same"), major.alias("m")).select(
        "sample_id",
        "label",
        F.when(F.col("total") > 0, F.col("same") / F.col("total")).otherwise(1.0).alias("neighbor_same"),
        F.when(F.col("total") > 0, -F.col("m.o")).alias("neighbor_major"),
        F.coalesce(F.when(F.col("total") > 0, F.col("m.w") / F.col("total")), F.lit(0.0)).alias("neighbor_major_share"),
    )


def neighboring_copies(knn: DataFrame, copies: DataFrame) -> DataFrame:
    """The (sample_id, neighbor_id) pairs of ``knn`` that are copies of one another (equal ``root`` in ``copies``); the copies themselves never meet in pairs."""
    own = copies.select("sample_id", "root")
    return knn.join(own, "sample_id").join(own.select(F.col("sample_id").alias("neighbor_id"), F.col("root").alias("other")), "neighbor_id").filter("root = other").select("sample_id", "neighbor_id")


def centroid_evidence(vectors: DataFrame) -> DataFrame:
    """Distance to the own class's normalised mean against that to the nearest other one: ``ratio``, ``nearest_other``.

    The centroids (classes x dimensions numbers) are joined by dimension, not broadcast by force.
    """
    fit = vectors.filter(F.col("split").isin("train", "unsplit"))
    parts = fit.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("c"))
    cents = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("c"))
    cents = cents.select(F.transform("c", lambda x: x / F.sqrt(dot(F.col("c"), F.col("c")))).alias("c"), F.col("label").alias("k"))
    all_cents = cents.agg(F.collect_list(F.struct("k", "c")).alias("cents"))  # one row: as many centroids as classes
    sims = vectors.crossJoin(all_cents).select("sample_id", "label", F.transform("cents", lambda c: F.struct((1 - dot(F.col("embedding"), c["c"])).alias("d"), c["k"].alias("k"))).alias("s"))
    own = F.filter("s", lambda s: s["k"] == F.col("label"))[0]["d"]
    other = F.array_min(F.transform(F.filter("s", lambda s: s["k"] != F.col("label")), lambda s: F.struct(F.round(s["d"], 9).alias("d"), s["k"].alias("k"))))
    return sims.select("sample_id", "label", own.alias("own"), other.alias("o")).select("sample_id", "label", (F.col("own") / F.greatest(F.col("own") + F.col("o.d"), F.lit(1e-9))).alias("ratio"), F.col("o.k").alias("nearest_other"))


def seed_regions(vectors: DataFrame, n: int = 8) -> DataFrame:
    """``region`` of every vector: which of the ``n`` vectors of the smallest ids is nearest by inner product, ties to the smaller id."""
    seeds = vectors.orderBy("sample_id").limit(n).select("sample_id", "embedding").agg(F.array_sort(F.collect_list(F.struct("sample_id", F.col("embedding").alias("at")))).alias("seeds"))
    near = F.transform("seeds", lambda s, i: F.struct((-F.round(dot(F.col("embedding"), s["at"]), 9)).alias("d"), i.cast("bigint").alias("region")))
    return vectors.crossJoin(F.broadcast(seeds)).withColumn("region", F.array_min(near)["region"]).drop("seeds")  # n vectors
