"""Histogram descriptors and the visual codebook against loops over pixels, and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetta.functions import histograms as H
from facetta.functions import kernels as K
from facetta.operators import codebook as B
from facetta.operators import images as I

RNG = np.random.default_rng(12)
IMAGES = [RNG.integers(0, 256, (37, 53, 3)).astype(np.uint8), np.full((16, 16, 3), 9, np.uint8), RNG.integers(100, 120, (64, 64, 3)).astype(np.uint8), RNG.integers(0, 256, (20, 30)).astype(np.uint8)]


def slow_counts(values, n):
    lo, hi, out = min(values), max(values), [0] * n
    for v in values:
        out[n // 2 if hi == lo else min(int((v - lo) * n / (hi - lo)), n - 1)] += 1
    return out


def share(h):
    return [x / sum(h) for x in h]


@pytest.mark.parametrize("img", IMAGES, ids=range(len(IMAGES)))
def test_against_loops(img):
    full = H.planes(img)
    bgr = [[float(v) for v in full[..., c].ravel()] for c in range(3)]
    hsv = [[float(v) for v in K.hsv(full)[..., c].ravel()] for c in range(3)]
    lab = K.lab(full[..., ::-1])
    n = [0] * 256
    for b, g, r in zip(*bgr):
        n[int((b + g + r) / 3)] += 1
    assert np.allclose(H.grayscale(img), [(x - min(n)) / (max(n) - min(n)) for x in n][1:])
    n = [sum(v == k for v in c) for c in bgr for k in range(1, 256)]
    assert np.allclose(H.by_channel(img), [x / (sum(n) + 765e-8) for x in n])
    n = slow_counts(hsv[0], 256)
    assert np.array_equal(H.cumulative(img), [sum(n[1:i]) for i in range(256)])
    assert np.allclose(H.exponential(img), share([math.exp(x / max(n)) for x in n]))
    limit = np.mean(hsv[0]) + np.std(hsv[2])
    kept = [v for h, v in zip(hsv[0], hsv[2]) if h <= limit]
    assert np.allclose(H.threshold(img), [x / len(hsv[0]) for x in slow_counts(kept, 255)[1:]] if kept else 0)
    assert np.allclose(H.lab_channels(img), [x for c in range(3) for x in share(slow_counts(lab[..., c].ravel().tolist(), 48))])
    out = []
    h, w = img.shape[0] // 4, img.shape[1] // 4
    for i in range(4):
        for j in range(4):
            out += share(slow_counts(lab[i * h : (i + 1) * h, j * w : (j + 1) * w, 1].ravel().tolist(), 20))[1:]
    assert np.allclose(H.local(img, 4, 1, 20), out)
    assert H.pyramid(img).shape == (3600,) and H.pyramid(img).sum() == pytest.approx(90)
    assert H.joint(img).sum() == lab.shape[0] * lab.shape[1] and len(H.joint(img, (2, 3, 4))) == 24
    got, at = H.moments(img), 0
    for c in range(3):
        found = [np.array(share(slow_counts(x[c], 255)[1:])) for x in (hsv, bgr)]
        for f in (np.mean, np.std, lambda v: ((v - v.mean()) ** 3).mean() / v.std() ** 3):
            assert np.allclose(got[at : at + 2], [f(v) for v in found])
            at += 2


def test_by_hand():
    img = np.zeros((2, 2, 3), np.uint8)
    img[0, 0] = (255, 255, 255)
    assert H.grayscale(img)[254] == pytest.approx(1 / 3) and H.grayscale(img)[:254].sum() == 0
    assert H.by_channel(img)[[254, 509, 764]] == pytest.approx(1 / 3, abs=1e-5)
    assert H.joint(img).tolist().count(0) >= 25 and H.joint(img).sum() == 4
    # hue 0 everywhere: its share is 1; saturation 0, value 255 once
    assert H.weighted(img)[[0, 1, 254]].tolist() == [7, 4, 1]


def frame(spark, images):
    rows = [(i, ("", x.shape[0], x.shape[1], 1 if x.ndim == 2 else 3, 16, bytearray(np.ascontiguousarray(x).tobytes()))) for i, x in enumerate(images)]
    return spark.createDataFrame([*rows, (99, None)], f"sample_id long, image {I.IMAGE}")


@pytest.mark.parametrize("name", sorted(H.HISTOGRAMS))
def test_extractors(spark, name):
    got = {r.sample_id: r.vector for r in I.features(frame(spark, IMAGES), name).collect()}
    assert got[99] is None
    for i, img in enumerate(IMAGES):
        assert np.allclose(got[i], H.HISTOGRAMS[name](img)) and np.isfinite(got[i]).all()
    assert I.features(frame(spark, IMAGES).limit(0), name).count() == 0


def test_parameters_take_effect_or_are_refused(spark):
    images = frame(spark, IMAGES[:1])
    assert len(I.features(images, "histogram_lab_extractor", options={"sample": 10}).first().vector) == 30
    assert len(I.features(images, "local_histogram_extractor", options={"n_patches": 2, "sample": 5}).first().vector) == 16
    assert len(I.features(images, "lbp_extractor", options={"points": 8, "radius": 1}).first().vector) == 10
    assert I.keypoints(images, "sift_features_extractor", options={"n_keypoints": 3}).where("sample_id = 0").count() == 3
    with pytest.raises(ValueError, match="unknown parameters"):
        I.bound(I.MASKS, "paint_mask_preprocessor", {"colour": 1})
    with pytest.warns(UserWarning, match="no use"):
        I.bound(I.ENHANCE, "visushrink_noise_preprocessor", {"h": 3})
    with pytest.raises(ValueError, match="color_space"):
        I.MASKS["paint_mask_preprocessor"](IMAGES[0], color_space="none")
    img = np.zeros((120, 120, 3), np.uint8)
    img[30:90, 30:90] = RNG.integers(0, 255, (60, 60, 3))
    a, b = (I.bound(I.MASKS, "meanvarianceiter_mask_preprocessor", {"fill_holes": x})(img)[0] for x in (True, False))
    assert a.sum() > b.sum()


def test_codebook(spark):
    """Tiles of two kinds: two words, counted over the commoner one."""
    dark, bright = np.zeros((8, 8, 3), np.uint8), np.tile(np.arange(64, dtype=np.uint8).reshape(8, 8, 1) * 4, (1, 1, 3))
    mixed = np.concatenate([np.concatenate([dark, dark], 1), np.concatenate([dark, bright], 1)], 0)
    images = frame(spark, [mixed, np.tile(dark, (2, 2, 1)), mixed[:12, :12]])
    book = B.fit(images, k_size=8, sample=16, channel=2, num_words=2)
    got = {r.sample_id: r.vector for r in B.tokenize(images, book).collect()}
    assert sorted(got[0]) == [pytest.approx(1 / 3), 1.0] and sorted(got[1]) == [0.0, 1.0] and got[99] is None and len(got[2]) == 2
    tiles = B.tile_histograms(images, 8, 16, 2)
    assert tiles.groupBy("sample_id").count().orderBy("sample_id").collect() == [(0, 4), (1, 4), (2, 4)]
    for r in tiles.collect():
        assert sum(r.histogram) == {0: 64, 1: 64}.get(r.sample_id, sum(r.histogram))
    assert tiles.select(F.size("histogram")).first()[0] == 16


def test_queries_match_their_oracles(spark, sf):
    from facetta.plans import catalog, images
    from tests.compare import compare, connect

    con = connect(sf)
    for name, sql in images.ORACLES.items():
        assert compare(spark, con, sf, catalog.queries()[name], sql) == "", name
