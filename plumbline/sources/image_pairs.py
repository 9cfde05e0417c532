"""What two images have in common: structure of thumbnails, direct, mirrored or as an excerpt, and the relation that follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize
from plumbline.operators.hash_pairs import mirrored_pairs
from plumbline.operators.neighbors import nearest
from plumbline.operators.ranges import ranked
from plumbline.sources.images import THUMB, resample

#: Limits of the relations.
HASH_BITS, DETAIL, PHOTOMETRIC, ASPECT = 12, 0.92, 12.0, 0.03
EXCERPT, LEAST_PART = 0.85, 0.08  # correlation of an excerpt with its place, and the least share of the area it may be


def blur(size: int, sigma: float) -> np.ndarray:
    """A matrix that blurs along one axis; edges are mirrored."""
    reach = int(round(4 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    m = np.zeros((size, size))
    for shift, w in zip(range(-reach, reach + 1), weights / weights.sum()):
        at = np.abs((np.arange(size) + shift) % max(2 * size - 2, 1))
        np.add.at(m, (np.arange(size), np.minimum(at, max(2 * size - 2, 1) - at) if size > 1 else at), w)
    return m


def detail(thumb: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """The high-pass layer: edges and texture, without brightness and shading."""
    t = thumb.astype(np.float64)
    return t - blur(t.shape[0], sigma) @ t @ blur(t.shape[1], sigma).T


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation; 0 for a layer without any contrast."""
    a, b = (x.astype(np.float64).ravel() - x.mean() for x in (a, b))
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size > 1e-6 else 0.0


def excerpt_correlation(whole: np.ndarray, part: np.ndarray, rows: int, columns: int) -> float:
    """The best correlation of ``part``, shrunk to ``rows`` by ``columns``, with the windows of ``whole`` of that size."""
    size = THUMB
    if not (6 <= rows <= size and 6 <= columns <= size) or rows * columns < LEAST_PART * size**2:
        return 0.0
    p = detail(resample(part.astype(np.float64), rows, columns), 3.0).ravel()
    p -= p.mean()
    windows = np.lib.stride_tricks.sliding_window_view(detail(whole, 3.0), (rows, columns)).reshape(-1, rows * columns)
    spread = np.sqrt(np.maximum((windows**2).sum(1) - windows.sum(1) ** 2 / windows.shape[1], 0)) * np.linalg.norm(p)
    return float(np.divide(windows @ p, spread, out=np.zeros(len(windows)), where=spread > 1e-6).max())


def structural_similarity(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """``pairs`` of paths (``a``, ``b``) with ``ncc``, ``detail_ncc``, ``detail_ncc_mirror`` and ``excerpt_ncc``.

    ``measured`` has ``path``, ``width``, ``height`` and ``thumb``. An excerpt is the image with fewer
    pixels, at the size it has in the other one; one that was scaled besides isn't found.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, ta, tb, wa, ha, wb, hb in zip(*(batch.column(i).to_pylist() for i in range(8))):
                ta, tb = (np.frombuffer(t, np.uint8).reshape(THUMB, THUMB) for t in (ta, tb))
                da, db = detail(ta), detail(tb)
                whole, part, (w, h), (pw, ph) = (ta, tb, (wa, ha), (wb, hb)) if wa * ha >= wb * hb else (tb, ta, (wb, hb), (wa, ha))
                smaller = pw <= w and ph <= h and (pw, ph) != (w, h)
                cut = excerpt_correlation(whole, part, round(THUMB * ph / h), round(THUMB * pw / w)) if smaller else 0.0
                rows.append((a, b, *(round(x, 4) for x in (correlation(ta, tb), correlation(da, db), correlation(da, detail(tb[:, ::-1])), cut))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["a", "b", "ncc", "detail_ncc", "detail_ncc_mirror", "excerpt_ncc"])

    of = lambda n: measured.select(F.col("path").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("thumb", "width", "height")])
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "thumb_a", "thumb_b", "width_a", "height_a", "width_b", "height_b")
    return both.mapInArrow(run, "a string, b string, ncc double, detail_ncc double, detail_ncc_mirror double, excerpt_ncc double")


def image_relations(measured: DataFrame, neighbors: int = 8) -> DataFrame:
    """Pairs ``a`` < ``b`` of paths of related images: ``relation``, the correlations and what was measured on both.

    Images of equal pixels make a star around the smallest path (``exact``); of each only that one
    meets others. Candidates are hashes within 12 bits, direct or mirrored, and the ``neighbors``
    nearest descriptors; a relation always needs equal structure: the same fine detail at another
    size (``resized``), brightness or colour (``photometric``), shape (``cropped``) or none of these
    (``near``), mirrored (``flipped``), or at a place within the other image (``cropped``).
    """
    first = measured.groupBy("pixel_sha").agg(F.min("path").alias("first"))
    star = measured.join(first, "pixel_sha").filter("path <> first").select(F.col("first").alias("a"), F.col("path").alias("b"), F.lit("exact").alias("relation"), *[F.lit(x).alias(n) for n, x in (("ncc", 1.0), ("detail_ncc", 1.0), ("detail_ncc_mirror", None), ("excerpt_ncc", None))])
    kept = materialize(measured.join(first.select(F.col("first").alias("path")), "path", "left_semi"), "image-kinds")
    numbers = materialize(ranked(kept.select("path", "embedding"), [F.col("path")]).withColumnRenamed("rk", "sample_id"), "image-numbers")
    near = nearest(numbers, numbers, neighbors).select("sample_id", "neighbor_id")
    path = lambda n, id_: numbers.select(F.col("sample_id").alias(id_), F.col("path").alias(n))
    by_look = near.join(path("x", "sample_id"), "sample_id").join(path("y", "neighbor_id"), "neighbor_id").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    by_hash = mirrored_pairs(kept.select(F.col("path").alias("sample_id"), F.col("phash").alias("hash"), F.col("phash_flip").alias("flip")), HASH_BITS).select("a", "b")
    compared = structural_similarity(by_look.unionByName(by_hash).distinct(), kept)
    of = lambda n: kept.select(F.col("path").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("width", "height", "brightness", "saturation")])
    c = F.col
    shape = lambda n: c(f"width_{n}") / c(f"height_{n}")
    apart = F.abs(shape("a") - shape("b")) / F.greatest(shape("a"), shape("b"))
    light = F.abs(c("brightness_a") - c("brightness_b")) + F.lit(0.5 * 255) * F.abs(c("saturation_a") - c("saturation_b"))
    same_size = (c("width_a") == c("width_b")) & (c("height_a") == c("height_b"))
    equal = F.when(~same_size & (apart < ASPECT), "resized").when(light > PHOTOMETRIC, "photometric").when(apart >= ASPECT, "cropped").otherwise("near")
    relation = F.when(c("detail_ncc") >= DETAIL, equal).when(c("detail_ncc_mirror") >= DETAIL, "flipped").when(c("excerpt_ncc") >= EXCERPT, "cropped")
    related = compared.join(of("a"), "a").join(of("b"), "b").withColumn("relation", relation).filter("relation is not null")
    return related.select(*star.columns).unionByName(star)
