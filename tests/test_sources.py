"""File and image sources on planted files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.similarity import cosine
from plumbline.sources import files, images


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(0)
    coarse, t, u = rng.uniform(0, 220, (7, 9, 3)), np.linspace(0, 5.999, 48), np.linspace(0, 7.999, 64)
    i, j = t.astype(int)[:, None], u.astype(int)[None, :]
    a, b = (t % 1)[:, None, None], (u % 1)[None, :, None]
    base = (1 - a) * ((1 - b) * coarse[i, j] + b * coarse[i, j + 1]) + a * ((1 - b) * coarse[i + 1, j] + b * coarse[i + 1, j + 1])
    for name, p in {"a": base, "same": base, "bright": np.clip(base + 30, 0, 255), "half": base.reshape(24, 2, 32, 2, 3).mean((1, 3)), "flip": base[:, ::-1], "noise": rng.integers(0, 256, (48, 64, 3))}.items():
        (root / f"{name}.png").write_bytes(png(p))
    (root / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nrubbish")
    (root / "wrong.jpg").write_bytes(png(base))
    (root / ".DS_Store").write_bytes(b"x")
    (root / "sub").mkdir()
    (root / "sub" / "Twin.txt").write_bytes(b"1")
    (root / "sub" / "twin.txt").write_bytes(b"2")
    (root / "big.bin").write_bytes(b"0" * 100_000)
    return str(root)


def test_scan_files(spark, folder):
    got = {r.path: (r.status, r.reason) for r in files.scan_files(spark, folder, max_bytes=50_000).collect()}
    assert got["big.bin"] == ("rejected", "too large") and got["a.png"] == ("candidate", None)
    assert sorted(v[0] for k, v in got.items() if k.lower() == "sub/twin.txt") == ["candidate", "rejected"]
    seen = spark.createDataFrame([("a.png",)], "path string")
    assert "a.png" not in {r.path for r in files.scan_files(spark, folder, seen=seen).collect()}


def test_images(spark, folder):
    scanned = images.scan_images(spark, folder).filter(F.col("path").endswith("png"))
    assert {r.path.rsplit("/")[-1]: r.status for r in scanned.collect()}["broken.png"] == "rejected"
    m = {r.path.rsplit("/")[-1][:-4]: r for r in images.measure(scanned).collect()}
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert m["a"].pixel_sha == m["same"].pixel_sha != m["half"].pixel_sha
    assert far(m["a"].phash, m["half"].phash) <= 8 and far(m["a"].phash, m["bright"].phash) <= 8
    assert far(m["a"].phash, m["flip"].phash_flip) <= 8 < far(m["a"].phash, m["noise"].phash)
    assert m["bright"].brightness > m["a"].brightness and m["noise"].sharpness > m["a"].sharpness
    sim = spark.createDataFrame([(m["a"].embedding, m["half"].embedding, m["noise"].embedding)], "a array<double>, h array<double>, n array<double>").select(cosine(F.col("a"), F.col("h")), cosine(F.col("a"), F.col("n"))).first()
    assert sim[0] > 0.9 > sim[1]


def test_formats(spark, folder):
    got = {r.path.rsplit("/")[-1]: (r.format, r.extension_mismatch) for r in images.file_formats(spark, folder).collect()}
    assert got["wrong.jpg"] == ("png", True) and got["a.png"] == ("png", False)


def test_provenance_manifest_findings(spark, tmp_path):
    s = spark.createDataFrame([("root/a/1.txt", "x", "a", "train"), ("b/2.txt", "y", "b", "val")], "path string, sha256 string, label string, split string")
    csv = spark.createDataFrame([("a/1.txt", " web ", "z" * 900), ("b/2.txt", "lab", None)], "path string, source string, license string")
    got = {r.path: (r.source, len(r.license or "")) for r in files.join_provenance(s, csv).collect()}
    assert got == {"root/a/1.txt": ("web", 500), "b/2.txt": ("lab", 0)}
    assert files.write_manifest(s, str(tmp_path / "m1")) == files.write_manifest(s.repartition(3).orderBy(F.desc("path")), str(tmp_path / "m2"))
    f = spark.createDataFrame([(1, "short")], "sample_id long, finding string")
    for audit in ("one", "two", "one"):
        files.write_findings(f, audit, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


def test_audit_resumes(spark, sf_dir, tmp_path):
    from plumbline.plans.audit import STAGES, run_audit

    first = run_audit(spark, sf_dir, str(tmp_path), STAGES[:3]).collect()
    again = run_audit(spark, sf_dir, str(tmp_path), STAGES[:4]).collect()
    assert [r.skipped for r in first] == [False] * 3 and [r.skipped for r in again] == [True] * 3 + [False]
    assert [r.rows for r in first] == [r.rows for r in again][:3]
