"""Image kernels against plain loops and planted shapes."""

import json
import math
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetta.functions import kernels as K
from facetta.operators import images as I
from facetta.plans import catalog
from facetta.plans import images as plans

RNG = np.random.default_rng(4)


def picture(h=120, w=160, box=(40, 30, 119, 89)):
    """A flat wall with a noisy painting."""
    img = np.full((h, w, 3), 200, np.uint8)
    x0, y0, x1, y1 = box
    img[y0 : y1 + 1, x0 : x1 + 1] = RNG.integers(0, 255, (y1 - y0 + 1, x1 - x0 + 1, 3))
    return img


def near(a, b, by):
    return all(abs(x - y) <= by for x, y in zip(a, b))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 10**6))
def test_dilation_and_erosion(h, w, seed):
    x = np.random.default_rng(seed).integers(0, 255, (11, 13)).astype(np.uint8)
    for f, best in ((K.dilate, max), (K.erode, min)):
        got = f(x, h, w)
        for i in range(11):
            for j in range(13):
                rows, cols = range(max(0, i - h // 2), min(11, i - h // 2 + h)), range(max(0, j - w // 2), min(13, j - w // 2 + w))
                assert got[i, j] == best(x[a, b] for a in rows for b in cols)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_components(seed, eight):
    mask = np.random.default_rng(seed).random((9, 12)) < 0.5
    labels, n = K.components(mask, eight)
    assert ((labels > 0) == mask).all() and set(np.unique(labels)) - {0} == set(range(1, n + 1))
    seen = {}
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        todo, name = [start], len(set(seen.values())) + 1
        while todo:
            y, x = todo.pop()
            if (y, x) in seen or not (0 <= y < 9 and 0 <= x < 12) or not mask[y, x]:
                continue
            seen[y, x] = name
            todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not a * b)]
    assert all(labels[p] == k for p, k in seen.items())


def test_otsu_noise_and_wavelets():
    assert K.otsu(np.array([10, 10, 11, 50, 52, 51])) == 11
    ramp = np.arange(25).reshape(5, 5)
    ramp[2, 2] += 10
    assert K.noise(ramp.astype(np.uint8)) == pytest.approx(8.773199, abs=1e-6)
    x = RNG.normal(size=(8, 12))
    assert np.allclose(K.unhaar(*K.haar(x)), x)
    assert np.allclose(K.visushrink(x, 0.0), x)


def test_resize_keeps_means_and_ratio():
    img = RNG.integers(0, 255, (40, 60, 3)).astype(np.uint8)
    small = K.resize(img, width=30, height=5)
    assert small.shape == (20, 30, 3) and abs(small.mean() - img.mean()) < 1
    assert np.array_equal(small, K.byte(img.reshape(20, 2, 30, 2, 3).mean(axis=(1, 3))))


def test_hue_and_lab():
    colours = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 255, 255], [0, 0, 0]]], np.uint8)
    assert K.hsv(colours)[0, :, 0].tolist() == [0, 60, 120, 0, 0]
    assert np.allclose(K.lab(colours)[0, 3:], [[100, 0, 0], [0, 0, 0]], atol=0.05)
    assert np.allclose(K.lab(colours)[0, 0], [53.24, 80.09, 67.20], atol=0.1)


def test_non_local_means_against_loops():
    x = RNG.integers(0, 60, (9, 9)).astype(np.uint8)
    got, wide = K.non_local_means(x, 12, 3, 5), np.pad(x.astype(float), 3, mode="reflect")
    for i in range(9):
        for j in range(9):
            here, total, value = wide[i + 2 : i + 5, j + 2 : j + 5], 0.0, 0.0
            for a in range(-2, 3):
                for b in range(-2, 3):
                    w = math.exp(-((here - wide[i + 2 + a : i + 5 + a, j + 2 + b : j + 5 + b]) ** 2).mean() / 144)
                    total, value = total + w, value + w * wide[i + 3 + a, j + 3 + b]
            assert abs(got[i, j] - value / total) <= 0.51


def test_hull_and_rectangle():
    a = math.radians(30)
    turn = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
    inner = RNG.random((200, 2)) * [40, 20]
    points = np.vstack([inner, [[0, 0], [40, 0], [40, 20], [0, 20]]]) @ turn
    corners, size, angle = K.least_rectangle(points)
    assert len(K.hull(points)) == 4 and size == pytest.approx(800) and angle == pytest.approx(30)
    assert K.polygon((30, 30), np.array([[2, 3], [9, 3], [9, 6], [2, 6]])).sum() == 8 * 4


def test_zernike_and_patterns_ignore_turns():
    y, x = np.mgrid[:80, :80]
    img = (((x - 40) ** 2 / 400 + (y - 38) ** 2 / 150) < 1).astype(np.uint8) * 200
    assert np.allclose(K.zernike(img, 40), K.zernike(np.rot90(img), 40), atol=1e-6)
    assert np.allclose(K.lbp(img), K.lbp(np.rot90(img)), atol=0.02)


def test_descriptors_of_the_same_place_match():
    img = np.kron(RNG.integers(0, 255, (16, 20)), np.ones((8, 8))).astype(np.uint8)
    for f in (K.gradient_descriptors, K.binary_descriptors):
        assert np.array_equal(f(img), f(np.repeat(img[..., None], 3, axis=2)))
        assert f(np.zeros((30, 30), np.uint8)).any() == False  # noqa: E712
    a, b = K.gradient_descriptors(img), K.gradient_descriptors(np.rot90(img).copy())
    best = np.sort(np.linalg.norm(a[:, None] - b[None], axis=2), axis=1)[:, 0]
    assert np.median(best) < 0.35


@pytest.mark.parametrize("name", sorted(set(I.MASKS) - {"contour_mask_preprocessor", "painter_adaptative_mask_preprocessor", "hough_mask_preprocessor"}))
def test_masks_find_a_painting(name):
    mask, boxes, corners, angles = I.MASKS[name](picture())
    assert mask.shape == (120, 160) and len(boxes) == len(corners) == len(angles) == 1
    assert near(boxes[0], (40, 30, 119, 89), 9)
    assert mask[40:80, 50:110].mean() > 0.9 and mask[:15].mean() < 0.1


def test_large_masks_find_a_painting():
    """Kernels of fixed size need larger images; few lines cross a small noisy patch, which opening then splits."""
    img = picture(400, 600, (150, 90, 449, 309))
    for name in ("contour_mask_preprocessor", "painter_adaptative_mask_preprocessor", "hough_mask_preprocessor"):
        boxes = I.MASKS[name](img)[1]
        assert len(boxes) == 1 and near(boxes[0], (150, 90, 449, 309), 45)


def test_two_paintings_come_by_area_or_column():
    img = np.full((200, 300, 3), 200, np.uint8)
    img[60:120, 20:80] = RNG.integers(0, 255, (60, 60, 3))
    img[60:160, 150:270] = RNG.integers(0, 255, (100, 120, 3))
    assert [b[0] > 100 for b in I.fourier_mask(img)[1]] == [False, True]
    assert [b[0] > 100 for b in I._boxes(np.isin(img[..., 0], [200], invert=True).astype(np.uint8))[1]] == [True, False]


def test_text_bar_is_found():
    img = picture(240, 320, (80, 60, 239, 179))
    img[100:115, 110:210] = 20
    for name in ("laplacian_text_detector", "stupid_text_detector"):
        assert any(near(b, (110, 100, 209, 114), 6) for b in I.TEXTS[name](img)[1])


def test_text_scores():
    assert I.textbox_score(1, 100, 10, 200, 100) == 1.75
    assert I.textbox_score(1, 9, 9, 200, 100) == I.textbox_score(1, 100, 30, 200, 100) == 0


def test_noise_goes_and_clean_images_stay():
    clean = np.full((64, 64, 3), 120, np.uint8)
    noisy = np.clip(clean + RNG.normal(0, 30, clean.shape), 0, 255).astype(np.uint8)
    for name in ("channels_denoise_preprocessor", "colored_denoise_preprocessor", "visushrink_noise_preprocessor"):
        assert np.array_equal(I.ENHANCE[name](clean), clean)
        assert np.abs(I.ENHANCE[name](noisy).astype(int) - 120).mean() < 0.5 * np.abs(noisy.astype(int) - 120).mean()


def test_frames(spark):
    """Null and empty images give nulls; crops without boxes are whole; ocr is a plug-in."""
    img = picture()
    rows = [(1, ("", 120, 160, 3, 16, bytearray(img.tobytes()))), (2, None), (3, ("", 0, 0, 0, 0, bytearray()))]
    frame = spark.createDataFrame(rows, f"sample_id long, image {I.IMAGE}")
    found = I.masks(frame, "paint_mask_preprocessor")
    got = {r.sample_id: r for r in found.collect()}
    assert got[1].boxes == [list(I.paint_mask(img)[1][0])] and got[2].mask is None and got[3].mask is None
    cut = {(r.sample_id, r.crop_pos): r.image for r in I.crops(frame, found).collect()}
    a, b, c, d = got[1].boxes[0]
    assert bytes(cut[1, 0].data) == img[b : d + 1, a : c + 1].tobytes() and (2, 0) in cut
    assert I.enhance(frame, "shadow_remove_preprocessor").where("image is null").count() == 2
    assert I.features(frame, "dct_extractor").where("vector is null").count() == 2
    assert {r.sample_id for r in I.keypoints(frame, "orb_features_extractor").collect()} == {1}
    read = I.text_boxes(frame, "text_detector_wo_mask", ocr=lambda crop: f"{crop.shape[0]}").where("sample_id = 1").first()
    assert read.texts == [str(b[3] - b[1] + 1) for b in read.boxes]
    assert I.masks(frame.limit(0), "paint_mask_preprocessor").count() == 0


def test_grids(spark, sf):
    row = plans.grids(spark, sf).orderBy("sample_id").first()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").first().embedding
    v = np.floor((np.array(e, float) + 1) * 127.5).astype(int).reshape(8, 8)
    want = np.kron((v[..., None] + 85 * np.arange(3)) % 256, np.ones((8, 8, 1))).astype(np.uint8)
    assert np.array_equal(I.decode(64, 64, 3, bytes(row.image.data)), want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - {"image_laplacian_text_detector", "image_stupid_text_detector", "feature_hog"}))
def test_queries_run(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.select(F.count("*")).first()[0] > 0


def test_hog_equals_votes_of_every_pixel():
    def plain(img, side, cell, bins):
        x = np.pad(K.stretch(K.gray(img), side, side).astype(float), 1, mode="edge")
        votes = K._angle_votes(x[1:-1, 2:] - x[1:-1, :-2], x[2:, 1:-1] - x[:-2, 1:-1], bins, math.pi)
        n = side // cell
        cells = votes.reshape(n, cell, n, cell, bins).sum(axis=(1, 3))
        unit = lambda b: b / (np.linalg.norm(b) + 1e-9)
        blocks = [unit(np.minimum(unit(np.moveaxis(cells[y : y + 2, x : x + 2], 2, 0).ravel()), 0.2)) for y in range(n - 1) for x in range(n - 1)]
        return np.concatenate(blocks).astype(np.float32)

    for img in (picture(), picture()[..., 0], np.full((9, 9), 7, np.uint8), RNG.integers(0, 256, (300, 250)).astype(np.uint8)):
        for side, cell, bins in ((240, 8, 180), (64, 8, 9)):
            assert np.allclose(K.hog(img, side, cell, 2, bins), plain(img, side, cell, bins), atol=1e-6)
    with pytest.raises(ValueError, match="whole cells"):
        K.hog(picture(), 100, 8)


def test_hog_needs_no_bins_of_every_pixel():
    img = picture()
    K.hog(img)
    tracemalloc.start()
    v = K.hog(img)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(v) == 29 * 29 * 720 and most < 20e6  # a histogram for each of 240 x 240 pixels has 83 MB


def test_feature_summaries_are_those_of_the_vectors(spark):
    images = [picture(), picture(64, 64, (10, 10, 40, 40)), np.full((64, 64, 3), 9, np.uint8), None]
    rows = [(i, None if x is None else ("", x.shape[0], x.shape[1], 3, 16, x.tobytes())) for i, x in enumerate(images)]
    frame = spark.createDataFrame(rows, f"sample_id long, image {I.IMAGE}")
    v = F.col("vector")
    for name in set(I.FEATURES) - set(plans.H.HISTOGRAMS):
        want = I.features(frame, name).select("sample_id", F.size(v).alias("n"), F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.array_position(v, F.array_max(v)).alias("peak"))
        got = I.feature_summaries(frame, name)
        assert got.schema == I.feature_summaries(frame, "lbp_extractor").schema and got.dtypes == want.dtypes
        assert sorted(map(tuple, got.withColumn("norm", F.round("norm", 6)).collect())) == sorted(map(tuple, want.collect()))


def test_feature_hog_sends_no_vectors(spark, sf):
    df = catalog.queries()["feature_hog"](spark, sf)
    assert "vector" not in df._jdf.queryExecution().toString()
    assert {(r.n, r.norm is None) for r in df.limit(20).collect()} == {(605520, False)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.integers(1, 14), st.integers(1, 14), st.sampled_from([0.1, 0.35, 0.5, 0.7, 0.95]), st.integers(0, 10**6))
def test_regions_of_a_stack(n, h, w, share, seed):
    masks = (np.random.default_rng(seed).random((n, h, w)) < share).astype(np.uint8)
    got = list(zip(*(v.tolist() for v in K.stack_regions(masks))))
    assert got == [(i, r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) for i, m in enumerate(masks) for r in K.regions(m)]


def test_regions_of_a_stack_with_holes_and_spirals():
    rings = np.zeros((3, 21, 21), np.uint8)
    for i in range(0, 10, 2):
        rings[0, i : 21 - i, i : 21 - i] = 1
        rings[0, i + 1 : 20 - i, i + 1 : 20 - i] = 0
    rings[1, ::2], rings[1, 1::4, -1], rings[1, 3::4, 0] = 1, 1, 1
    rings[2] = 1
    want = [(i, r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) for i, m in enumerate(rings) for r in K.regions(m)]
    assert list(zip(*(v.tolist() for v in K.stack_regions(rings)))) == want and want[0][1] == 441


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 20), st.integers(1, 40), st.integers(1, 40), st.sampled_from([3, 5, 13]), st.integers(0, 10**6))
def test_smooth_bands(n, h, w, k, seed):
    rng = np.random.default_rng(seed)
    bands = [K.dilate((rng.random((h, w)) < 0.05).astype(np.uint8), 4) > 0 for _ in range(n)]
    want = [K.opening(K.closing(b.astype(np.uint8), k), k) for b in bands]
    assert np.array_equal(K.smooth_bands(bands, k), want)


def each_band(img, width=800, min_area=0.01, max_area=0.15):
    """level_text, each band on its own."""
    x = K.gray(img)
    small = K.gaussian(K.resize(x, width=width) if x.shape[1] > width else x, 5)
    boxes = []
    for level in range(0, 256, 2):
        for reach in (5, 10):
            band = (np.abs(small - level) <= reach).astype(np.uint8)
            if band.mean() >= min_area:
                boxes += [b for b in I._text_like(K.opening(K.closing(band, 13), 13), min_area, max_area) if b not in boxes]
    return I._box_mask(*I._scaled(x.shape, small.shape, boxes))


def test_level_text_finds_what_each_band_has(monkeypatch):
    grid = lambda: np.kron(RNG.integers(80, 180, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    bars = picture()
    bars[95:110, 20:100], bars[5:20, 10:140], bars[100:104, 40:60] = 40, 120, 200
    images = [grid() for _ in range(8)] + [bars, bars[..., 0], picture(30, 50, (5, 5, 40, 20)), np.full((64, 64, 3), 9, np.uint8), np.zeros((1, 1, 3), np.uint8), np.tile(np.linspace(0, 255, 900).astype(np.uint8), (60, 1))]
    found = 0
    for size in (I.BAND_PIXELS, 1):
        monkeypatch.setattr(I, "BAND_PIXELS", size)
        for img in images:
            (mask, boxes), (want, all_) = I.level_text(img), each_band(img)
            assert boxes == all_ and np.array_equal(mask, want)
            found += len(boxes)
        assert I.level_text(bars, min_area=0.002, max_area=0.5)[1] == each_band(bars, min_area=0.002, max_area=0.5)[1]
    assert found > 20


def test_level_text_looks_at_bands_together():
    images = [np.kron(np.random.default_rng(i).integers(80, 180, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8) for i in range(10)]
    seconds = []
    for f in (I.level_text, each_band):
        f(images[0])
        began = time.thread_time()
        for img in images:
            f(img)
        seconds.append(time.thread_time() - began)
    assert seconds[0] < seconds[1] / 3


def test_stupid_text_detector_runs(spark, sf):
    rows = {r.sample_id: r for r in catalog.queries()["image_stupid_text_detector"](spark, sf).collect()}
    some = plans.grids(spark, sf).orderBy("sample_id").limit(20).collect()
    assert len(rows) == plans.grids(spark, sf).count()
    for r in some:
        boxes = each_band(I.decode(64, 64, 3, bytes(r.image.data)))[1]
        assert json.loads(rows[r.sample_id].boxes) == [list(b) for b in boxes] and rows[r.sample_id].n_boxes == len(boxes)
