"""Planted copies of images get their relation; other images get none."""

import numpy as np
import pytest

from plumbline.sources import image_pairs, images
from test_sources import png


def picture(seed, h=96, w=128):
    """Smooth shading with fine texture, so that structure survives resizing."""
    r = np.random.default_rng(seed)
    out = np.zeros((h, w, 3))
    for cells, weight in ((4, 110), (14, 90), (30, 40)):
        coarse = r.uniform(0, 1, (cells, cells, 3))
        i, j = np.linspace(0, cells - 1.001, h), np.linspace(0, cells - 1.001, w)
        a, b = (i % 1)[:, None, None], (j % 1)[None, :, None]
        i, j = i.astype(int)[:, None], j.astype(int)[None, :]
        out += weight * ((1 - a) * ((1 - b) * coarse[i, j] + b * coarse[i, j + 1]) + a * ((1 - b) * coarse[i + 1, j] + b * coarse[i + 1, j + 1]))
    return out


@pytest.fixture(scope="module")
def measured(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pairs")
    base = picture(1)
    noise = np.random.default_rng(9).normal(0, 1.5, base.shape)
    planted = {
        "a": base, "b_same": base, "c_same": base, "half": base.reshape(48, 2, 64, 2, 3).mean((1, 3)), "bright": np.clip(base * 0.7 + 60, 0, 255),
        "flip": base[:, ::-1], "near": np.clip(base + noise, 0, 255), "cut": base[20:84, 40:112], "flat": np.full((96, 128, 3), 90.0),
    }
    for name, p in [*planted.items(), *((f"other{i}", picture(100 + i)) for i in range(30))]:
        (root / f"{name}.png").write_bytes(png(np.clip(p, 0, 255)))
    return images.measure(images.scan_images(spark, str(root))).cache()


def test_relations(spark, measured):
    name = lambda p: p.rsplit("/")[-1][:-4]
    got = {(name(r.a), name(r.b)): r.relation for r in image_pairs.image_relations(measured).collect()}
    assert {got.get(("a", x)) for x in ("b_same", "c_same")} == {"exact"} and ("b_same", "c_same") not in got
    assert {x: got.get(("a", x)) for x in ("half", "bright", "flip", "near", "cut")} == {"half": "resized", "bright": "photometric", "flip": "flipped", "near": "near", "cut": "cropped"}
    assert not [p for p in got if any(x.startswith(("other", "flat")) for x in p)]


def test_no_images(spark, measured):
    assert image_pairs.image_relations(measured.limit(0)).count() == 0
    assert image_pairs.image_relations(measured.filter("path like '%flat%'")).count() == 0


def test_blur_and_correlation():
    for n in (1, 2, 5, 64):
        assert np.allclose(image_pairs.blur(n, 1.5).sum(1), 1)
    t = np.arange(64 * 64).reshape(64, 64) % 251
    assert image_pairs.correlation(t, t) == pytest.approx(1) and image_pairs.correlation(t, np.ones_like(t)) == 0
    assert abs(image_pairs.detail(np.full((64, 64), 7.0))).max() < 1e-9


def test_difference_hash():
    g = images._gray(picture(3))
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert far(images.difference_hash(g), images.difference_hash(g + 20)) == 0
    assert far(images.difference_hash(g), images.difference_hash(g[:, ::-1])) > 16
    assert far(images.difference_hash(g), images.difference_hash(g.reshape(48, 2, 64, 2).mean((1, 3)))) <= 8
    assert images.difference_hash(np.ones((1, 1))) == 0
