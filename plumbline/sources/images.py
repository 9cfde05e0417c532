"""Images: decoding by Spark's image source, measured attributes, perceptual hashes, descriptors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THUMB = 64  # side of the thumbnails on which structure is compared
MAGIC = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D"}


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``width``, ``height``, ``channels``, ``data``, ``status``; images that cannot be decoded are rejected."""
    i = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    return i.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data", F.when(F.col("height") > 0, "accepted").otherwise("rejected").alias("status"))


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """Format by the first bytes, and whether the file's extension says another."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.coalesce(*[F.when(F.startswith(head, F.lit(m)), k) for k, m in MAGIC.items()])
    ext = F.replace(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)), F.lit("jpg"), F.lit("jpeg"))
    return f.select("path", kind.alias("format"), (ext != F.coalesce(kind, F.lit(""))).alias("extension_mismatch"))


def _pixels(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
    return np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1] if c >= 3 else x[:, :, :1].repeat(3, axis=2)


def _gray(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def shrink(gray: np.ndarray, size: int) -> np.ndarray:
    """Area means over a ``size`` by ``size`` grid."""
    rows = np.linspace(0, gray.shape[0], size + 1)
    cols = np.linspace(0, gray.shape[1], size + 1)
    integral = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    integral[1:, 1:] = gray.cumsum(0).cumsum(1)

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:  # bilinear, so that cells may end between pixels
        r0, c0 = np.minimum(r.astype(int), gray.shape[0] - 1), np.minimum(c.astype(int), gray.shape[1] - 1)
        fr, fc = (r - r0)[:, None], (c - c0)[None, :]
        g = lambda i, j: integral[np.ix_(i, j)]
        return (1 - fr) * ((1 - fc) * g(r0, c0) + fc * g(r0, c0 + 1)) + fr * ((1 - fc) * g(r0 + 1, c0) + fc * g(r0 + 1, c0 + 1))

    corners = at(rows, cols)
    return np.diff(np.diff(corners, axis=0), axis=1) / (gray.size / size**2)


def perceptual_hash(gray: np.ndarray) -> int:
    """64 signs against the median of the 8 by 8 lowest DCT terms of a 32 by 32 image, as a signed long."""
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)
    low = (basis @ shrink(gray, 32) @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def resample(gray: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means over ``rows`` by ``columns`` cells, which may end between pixels."""

    def along(n: int, cells: int) -> np.ndarray:
        edges = np.linspace(0, n, cells + 1)
        left, right = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
        return np.maximum(right - left, 0) * cells / n

    return along(gray.shape[0], rows) @ gray @ along(gray.shape[1], columns).T


def difference_hash(gray: np.ndarray) -> int:
    """64 signs of the steps along the rows of an 8 by 9 image, as a signed long."""
    return int(np.packbits((np.diff(resample(gray, 8, 9), axis=1) > 1e-9).ravel(), bitorder="little").view(np.int64)[0])


def structure_thumb(gray: np.ndarray) -> np.ndarray:
    """The image at 64 by 64 grey values."""
    return np.clip(np.rint(shrink(gray, THUMB)), 0, 255).astype(np.uint8)


def attributes(rgb: np.ndarray) -> dict[str, float]:
    g = _gray(rgb)
    inner = g[1:-1, 1:-1]
    laplace = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * inner if min(g.shape) > 2 else np.zeros((1, 1))
    shares = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256) / g.size
    shares = shares[shares > 0]
    top, low = rgb.max(2), rgb.min(2)
    gy, gx = np.gradient(g) if min(g.shape) > 1 else (np.zeros_like(g), np.zeros_like(g))
    border = np.concatenate((g[0], g[-1], g[:, 0], g[:, -1]))
    rg, yb = rgb[:, :, 0] - rgb[:, :, 1], 0.5 * (rgb[:, :, 0] + rgb[:, :, 1]) - rgb[:, :, 2]
    return {
        "brightness": g.mean(), "contrast": g.std(), "sharpness": laplace.var(), "entropy": float(-(shares * np.log2(shares)).sum()),
        "saturation": float(np.divide(top - low, top, out=np.zeros_like(top), where=top > 0).mean()), "colorfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())),
        "edge_density": float((np.hypot(gx, gy) > 32).mean()), "dark": float((g < 32).mean()), "bright": float((g > 224).mean()), "border_mean": float(border.mean()), "border_std": float(border.std()),
    }


def descriptor(rgb: np.ndarray) -> np.ndarray:
    """Colour histogram, 4 by 4 layout, gradient histogram and 12 by 12 thumbnail, each scaled to length 1 and weighted, then scaled again."""
    g = _gray(rgb)
    q = (rgb // 64).astype(int)
    colour = np.bincount((q[:, :, 0] * 16 + q[:, :, 1] * 4 + q[:, :, 2]).ravel(), minlength=64).astype(float)
    layout = np.concatenate([shrink(rgb[:, :, i], 4).ravel() for i in range(3)])
    gy, gx = np.gradient(g) if min(g.shape) > 1 else (np.zeros_like(g), np.zeros_like(g))
    turn = np.histogram(np.arctan2(gy, gx), bins=16, range=(-np.pi, np.pi), weights=np.hypot(gx, gy))[0]
    tiny = shrink(g, 12).ravel()
    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    return unit(np.concatenate([w * unit(x) for w, x in ((1.0, colour), (1.0, layout - layout.mean()), (0.8, turn), (0.8, tiny - tiny.mean()))]))


def measure(images: DataFrame) -> DataFrame:
    """``path``, hashes, attributes, embedding and thumbnail of accepted images; a hash of the pixels tells equal content in other encodings."""
    names = ["brightness", "contrast", "sharpness", "entropy", "saturation", "colorfulness", "edge_density", "dark", "bright", "border_mean", "border_std"]

    def run(batches):
        for b in batches:
            rows = []
            for path, h, w, c, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                rgb = _pixels(data, h, w, c)
                g = _gray(rgb)
                a = attributes(rgb)
                rows.append((path, perceptual_hash(g), perceptual_hash(g[:, ::-1]), difference_hash(g), *[float(a[n]) for n in names], descriptor(rgb).tolist(), structure_thumb(g).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["path", "phash", "phash_flip", "dhash", *names, "embedding", "thumb"])

    schema = "path string, phash bigint, phash_flip bigint, dhash bigint, " + ", ".join(f"{n} double" for n in names) + ", embedding array<double>, thumb binary"
    ok = images.filter("status = 'accepted'")
    pixel = ok.select("path", F.sha2(F.concat(F.encode(F.concat_ws("x", "width", F.concat("height", F.lit(":"))), "UTF-8"), F.col("data")), 256).alias("pixel_sha"), "width", "height")
    return ok.select("path", "height", "width", "channels", "data").mapInArrow(run, schema).join(pixel, "path")
