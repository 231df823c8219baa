"""Image operators over DataFrames of Spark's image struct (BGR bytes), by name.

Four kinds, each a dict from a name to a function of one image: ENHANCE gives an image, MASKS a mask with boxes,
TEXTS a text mask with boxes, FEATURES a vector; KEYPOINTS gives a row for each keypoint. A row is decoded, computed
and released on its own, and results leave in small batches, so memory is bounded by one image and one input batch
(``spark.sql.execution.arrow.maxRecordsPerBatch``). No operator shuffles. A null or empty image gives nulls.

A function's keyword arguments are the parameters of the plug-in (``bound``). A parameter that only others of its kind
have is left out with a warning, one that none has is an error.
"""

from __future__ import annotations

import hashlib
import inspect
import math
import warnings
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetta.functions import histograms as H
from facetta.functions import kernels as K

#: Rows of a result batch.
ROWS = 16
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: Deviation above which an image counts as noisy.
NOISY = 10

# ---- enhancement


def _channels(img: np.ndarray, f) -> np.ndarray:
    return f(img) if img.ndim == 2 else np.stack([f(img[..., i]) for i in range(img.shape[2])], axis=-1)


def remove_shadow(img: np.ndarray) -> np.ndarray:
    def one(x):
        ground = K.median(K.dilate(x, 7), 21).astype(int)
        return K.byte(255 * K.normalize(255 - np.abs(x.astype(int) - ground)))

    return _channels(img, one)


def _smoothed(img: np.ndarray) -> np.ndarray:
    return _channels(img, lambda x: K.median(x, 3))


def denoise_channels(img: np.ndarray, h: float = 3, template_window_size: int = 7, search_window_size: int = 21) -> np.ndarray:
    """Non-local means of each channel of a noisy image; others stay."""
    if K.noise(img) <= NOISY:
        return img
    return _channels(_smoothed(img), lambda x: K.non_local_means(x, h, template_window_size, search_window_size))


def denoise_colored(img: np.ndarray, h: float = 10, template_window_size: int = 7, search_window_size: int = 21) -> np.ndarray:
    """Non-local means of all channels together."""
    return K.non_local_means(_smoothed(img), h, template_window_size, search_window_size) if K.noise(img) > NOISY else img


def denoise_wavelets(img: np.ndarray) -> np.ndarray:
    return _shrink(_smoothed(img), img) if K.noise(img) > NOISY else img


def _shrink(img: np.ndarray, noisy: np.ndarray) -> np.ndarray:
    """Wavelet shrinkage in luma and chroma, half the estimated deviation as sigma."""
    sigma = K.noise(noisy) / 2
    if img.ndim == 2:
        return K.byte(K.visushrink(img, sigma))
    y = img.astype(float) @ np.array([0.114, 0.587, 0.299])
    planes = [K.visushrink(p, sigma) for p in (y, img[..., 0] - y, img[..., 2] - y)]
    b, r = planes[1] + planes[0], planes[2] + planes[0]
    return K.byte(np.stack([b, (planes[0] - 0.114 * b - 0.299 * r) / 0.587, r], axis=-1))


ENHANCE: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "shadow_remove_preprocessor": remove_shadow,
    "channels_denoise_preprocessor": denoise_channels,
    "colored_denoise_preprocessor": denoise_colored,
    "visushrink_noise_preprocessor": denoise_wavelets,
}

# ---- masks of paintings: (mask, boxes as x0 y0 x1 y1, corners, angles)


#: Colour spaces of a mask's channel.
SPACES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"hsv": K.hsv, "lab": lambda x: K.byte(K.lab(x) + np.array([0, 128, 128])), "bgr": lambda x: x, "gray": lambda x: np.repeat(K.gray(x)[..., None], 3, axis=2)}
#: What a row or column of the variance mask is measured by.
MEASURES: dict[str, Callable] = {"std": np.std, "var": np.var}


def _named(table: dict, kind: str, name: str):
    if name not in table:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(table))}")
    return table[name]


def _channel(img: np.ndarray, i: int, color_space: str = "hsv") -> np.ndarray:
    return _named(SPACES, "color_space", color_space)(img if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2))[..., i]


def _repeat(k: int, n: int) -> int:
    """The size of one square that does what n passes of a k x k square do."""
    return (k - 1) * n + 1


def _boxes(mask: np.ndarray, share: float = 0.05, most: int | None = 2, by: str = "area"):
    """The largest regions as filled boxes, in descending area or by their first column."""
    found = [r for r in K.regions(mask) if r["area"] >= share * mask.size]
    found = sorted(found, key=lambda r: (-r["area"], r["x0"], r["y0"]))[:most]
    if by == "column":
        found.sort(key=lambda r: (r["x0"], r["y0"]))
    out = np.zeros(mask.shape, np.uint8)
    for r in found:
        out[r["y0"] : r["y1"] + 1, r["x0"] : r["x1"] + 1] = 1
    boxes = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in found]
    return out, boxes, [[(a, b), (c, b), (c, d), (a, d)] for a, b, c, d in boxes], [0.0] * len(boxes)


def _quads(mask: np.ndarray, keep):
    """Extreme corners of each region's hull, filled."""
    labels, _ = K.components(K.fill_holes(mask))
    out, boxes, corners, angles = np.zeros(mask.shape, np.uint8), [], [], []
    for r in filter(keep, K.regions(mask)):
        y, x = np.nonzero(labels == r["label"])
        points = K.hull(np.stack([x, y], axis=1))
        if len(points) < 3:
            continue
        four = K.extreme_corners(points)
        out |= K.polygon(mask.shape, four)
        boxes.append((r["x0"], r["y0"], r["x1"], r["y1"]))
        corners.append([tuple(p) for p in four.tolist()])
        angles.append(_upright(K.least_rectangle(points)[2]))
    return out, boxes, corners, angles


def _upright(angle: float) -> float:
    if angle not in (0, 90, 180):
        angle = 90 - angle
    return angle + 90 if angle > 45 else angle


def _without_ground(on: np.ndarray) -> np.ndarray:
    """What is not of the region of the first pixel."""
    same = on if on[0, 0] else 1 - on
    labels, _ = K.components(same, eight=False)
    return (labels != labels[0, 0]).astype(np.uint8)


def paint_mask(img: np.ndarray, channel: int = 0, color_space: str = "hsv"):
    x = _channel(img, channel, color_space)
    on = K.dilate((x > K.otsu(x)).astype(np.uint8), 12)
    return _boxes(K.closing(_without_ground(on), 24))


def adaptive_paint_mask(img: np.ndarray, channel: int = 0, color_space: str = "hsv"):
    x = K.mean(_channel(img, channel, color_space), 5)
    edges = K.dilate(K.opening(1 - K.adaptive(x, 11, 2), 3), _repeat(3, 3))
    whole = K.closing(K.fill_holes(edges), _repeat(12, 12))
    return _boxes(K.opening(whole, _repeat(12, 2)), by="column")


def laplacian_mask(img: np.ndarray, min_area: float = 0.05):
    x = K.gaussian(255 * K.normalize(_channel(img, 1)), 5)
    edges = np.abs(K.convolve(x, np.array([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]])))
    on = K.dilate((edges > K.mean(edges, 11) + 2).astype(np.uint8), 7)
    h, w = on.shape
    opened = K.opening(K.fill_holes(on), max(1, h // 100), max(1, w // 100))
    side = lambda r: (r["x1"] - r["x0"] + 1, r["y1"] - r["y0"] + 1)
    return _quads(opened, lambda r: math.prod(side(r)) >= min_area * on.size and side(r)[0] >= 0.1 * w and side(r)[1] >= 0.1 * h)


def hough_mask(img: np.ndarray, width: int = 1000, sigma: float = 0.3, min_area: float = 0.05):
    x = _channel(img, 1)
    small = K.resize(x, width=width) if x.shape[1] > width else x
    x = K.gaussian(small, 7)
    m = float(np.median(x))
    edges = K.canny(x, max(0, (1 - sigma) * m), min(255, (1 + sigma) * m))
    h, w = edges.shape
    lines = np.zeros(edges.shape, np.uint8)
    for line in K.hough_lines(edges, max(10, min(h, w) // 5), max(8, min(h, w) // 8), max(2, min(h, w) // 50)):
        K.draw_line(lines, *line)
    whole = K.fill_holes(K.dilate(lines, 7))
    return _back(_quads(K.opening(whole, max(1, h // 10), max(1, w // 10)), lambda r: r["area"] >= min_area * whole.size), img.shape[:2])


def _back(found, shape):
    """A result on a smaller image in coordinates of the whole one."""
    mask, boxes, corners, angles = found
    f = shape[1] / mask.shape[1]
    if f != 1:
        y = np.minimum((np.arange(shape[0]) / f).astype(int), mask.shape[0] - 1)
        x = np.minimum((np.arange(shape[1]) / f).astype(int), mask.shape[1] - 1)
        mask = mask[y][:, x]
        boxes = [tuple(int(v * f) for v in b) for b in boxes]
        corners = [[(a * f, b * f) for a, b in c] for c in corners]
    return mask, boxes, corners, angles


def fourier_mask(img: np.ndarray, channel: int = 1, color_space: str = "hsv"):
    """The spectrum without the 3 x 3 block at the array's centre (its order is not shifted)."""
    z = np.fft.fft2(_channel(img, channel, color_space).astype(float))
    r, c = z.shape[0] // 2, z.shape[1] // 2
    z[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2] = 0
    x = K.mean(255 * K.normalize(np.abs(np.fft.ifft2(z))), 5)
    edges = K.closing(1 - K.adaptive(x, 7, 2), _repeat(3, 3))
    h, w = edges.shape
    return _boxes(K.opening(K.fill_holes(edges), max(1, h // 10), max(1, w // 10)), by="column")


def contour_mask(img: np.ndarray, lower_threshold: int = 150, upper_threshold: int = 100, kernel_size: int = 35):
    edges = K.dilate(K.canny(K.gaussian(K.gray(img), 3), 10, 100), 3)
    labels, _ = K.components(K.fill_holes(edges))
    good = [r["label"] for r in K.regions(edges) if lower_threshold**2 < r["area"] < edges.size - upper_threshold]
    whole = K.dilate(K.erode(np.isin(labels, good).astype(np.uint8), _repeat(kernel_size, 2)), kernel_size)
    return _quads(whole, lambda r: True)


def variance_mask(img: np.ndarray, channel: int = 0, color_space: str = "hsv", metric: str = "std", fill_holes: bool = True):
    """Rows and columns that vary more than Otsu's threshold of all of them."""
    x, measure = _channel(img, channel, color_space).astype(float), _named(MEASURES, "metric", metric)
    rows, cols = (np.minimum(measure(x, axis=a), 255).astype(np.uint8) for a in (1, 0))
    t = K.otsu(np.concatenate([rows, cols]))
    on = (rows[:, None] > t) & (cols[None, :] > t)
    return _region_boxes(K.fill(on) if fill_holes else on)


def local_variance_mask(img: np.ndarray, channel: int = 0, kernel_size: int = 10, thr_global: float = 2.5):
    """Tiles whose deviation is above the threshold; the last tile of a side takes the rest."""
    x = _channel(img, channel).astype(float)
    h, w = x.shape
    grid = lambda n: np.minimum(np.arange(n) // kernel_size, max(n // kernel_size - 1, 0))
    cell = grid(h)[:, None] * (w + 1) + grid(w)[None, :]
    _, of = np.unique(cell, return_inverse=True)
    n, s, s2 = (np.bincount(of.ravel(), v) for v in (np.ones(x.size), x.ravel(), (x * x).ravel()))
    std = np.sqrt(np.maximum(s2 / n - (s / n) ** 2, 0))
    return _region_boxes((std[of.reshape(x.shape)] > thr_global).astype(np.uint8))


def combined_mask(img: np.ndarray, channel: int = 0, kernel_size: int = 5, thr_local: float = 5, fill_holes: bool = True):
    a = variance_mask(img, channel, fill_holes=fill_holes)[0]
    b = local_variance_mask(img, channel, kernel_size, thr_local)[0]
    return _region_boxes(K.fill(a & b, 7) if fill_holes else a & b)


def mean_variance_mask(img: np.ndarray, channel: int = 0, color_space: str = "hsv", fill_holes: bool = True):
    x = _channel(img, channel, color_space).astype(float)
    far = [np.abs(x - x.mean(axis=a, keepdims=True)) > x.std(axis=a, keepdims=True) for a in (0, 1)]
    return _region_boxes(K.fill(far[0] & far[1]) if fill_holes else far[0] & far[1])


def border_mask(img: np.ndarray, channel: int = 0, color_space: str = "hsv", fill_holes: bool = True):
    x = _channel(img, channel, color_space).astype(float)
    ground = np.mean([x[0].mean(), x[-1].mean(), x[:, 0].mean(), x[:, -1].mean()])
    return _region_boxes(K.fill(x > ground) if fill_holes else x > ground)


def _region_boxes(mask: np.ndarray):
    mask = np.asarray(mask).astype(np.uint8)
    return (mask, *_boxes(mask)[1:])


MASKS = {
    "variance_mask_preprocessor": variance_mask,
    "local_variance_mask_preprocessor": local_variance_mask,
    "combined_mask_preprocessor": combined_mask,
    "meanvariance_mask_preprocessor": mean_variance_mask,
    "meanvarianceiter_mask_preprocessor": border_mask,
    "paint_mask_preprocessor": paint_mask,
    "painter_adaptative_mask_preprocessor": adaptive_paint_mask,
    "laplacian_mask_preprocessor": laplacian_mask,
    "hough_mask_preprocessor": hough_mask,
    "fourier_mask_preprocessor": fourier_mask,
    "contour_mask_preprocessor": contour_mask,
}

# ---- text boxes: (mask, boxes)


def textbox_score(fill: float, w: float, h: float, width: float, height: float) -> float:
    """0 for shapes no text line has, else the mean of fill ratio and fifty times the area ratio."""
    if w < 10 or h < 10 or h > w or w >= 0.8 * width or h >= height / 4:
        return 0.0
    return (fill + 50 * (w * h) / (width * height)) / 2


def _box_mask(shape, boxes):
    out = np.zeros(shape, np.uint8)
    for x0, y0, x1, y1 in boxes:
        out[max(y0, 0) : y1 + 1, max(x0, 0) : x1 + 1] = 1
    return out, boxes


def _text_like(mask: np.ndarray, low: float, high: float, aspect: float = 2.5, full: float = 0.8):
    """Boxes of regions with a share of the area, wide enough and nearly rectangular."""
    out = []
    for r in K.regions(mask):
        w, h = r["x1"] - r["x0"] + 1, r["y1"] - r["y0"] + 1
        if low * mask.size <= w * h <= high * mask.size and w >= aspect * h and r["area"] >= full * w * h:
            out.append((r["x0"], r["y0"], r["x1"], r["y1"]))
    return out


def _best_candidate(mask: np.ndarray):
    """score and padded box of the largest region that scores over 0.5."""
    h, w = mask.shape
    pad = int(0.05 * min(h, w) / 2)
    for r in sorted(K.regions(mask), key=lambda r: -r["area"]):
        bw, bh = r["x1"] - r["x0"] + 1, r["y1"] - r["y0"] + 1
        score = textbox_score(r["area"] / (bw * bh), bw, bh, w, h)
        if score > 0.5:
            return score, (max(r["x0"] - pad, 0), max(r["y0"] - pad, 0), min(r["x1"] + pad, w - 1), min(r["y1"] + pad, h - 1))
    return 0.0, None


def hat_text(img: np.ndarray, k: int = 30):
    """The better of bright text (top hat) and dark text (black hat)."""
    x = K.gray(img).astype(int)
    hats = (x - K.opening(x, k), K.closing(x, k) - x)
    found = [_best_candidate(K.closing((hat >= 150).astype(np.uint8), 1, max(1, x.shape[1] // 8))) for hat in hats]
    best = max(found, key=lambda f: f[0])
    return _box_mask(x.shape, [best[1]] if best[1] else [])


def _runs(on: np.ndarray, gap: int) -> np.ndarray:
    """Rows with gaps under ``gap`` filled, then runs under ``gap`` removed."""
    for value in (0, 1):
        wide = np.pad((on == value).astype(np.int8), ((0, 0), (1, 1)))
        steps = np.diff(wide, axis=1)
        y, a = np.nonzero(steps == 1)
        b = np.nonzero(steps == -1)[1]
        on = on.copy()
        for i, s, e in zip(y, a, b):
            if value == 1 and e - s < gap or value == 0 and e - s < gap and s > 0 and e < on.shape[1]:
                on[i, s:e] = 1 - value
    return on


def morph_text(img: np.ndarray, width: int = 600):
    x = K.gray(img)
    small = (K.resize(x, width=width) if x.shape[1] > width else x).astype(float)
    strokes = np.abs(K.opening(small, 3, 1) - K.closing(small, 1, 3))
    on = K.dilate((strokes > K.gaussian(strokes, 13) + 6).astype(np.uint8), 7)
    on = _runs(on, max(2, int(0.05 * on.shape[1])))
    edge = max(1, int(0.05 * min(on.shape)))
    on[:edge], on[-edge:], on[:, :edge], on[:, -edge:] = 0, 0, 0, 0
    boxes = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in K.regions(on) if r["area"] >= 128 * 0.05]
    return _box_mask(*_scaled(x.shape, on.shape, boxes))


def _scaled(shape, small, boxes):
    f = shape[1] / small[1]
    return shape, [(int(a * f), int(b * f), min(int((c + 1) * f), shape[1]) - 1, min(int((d + 1) * f), shape[0]) - 1) for a, b, c, d in boxes]


def flat_text(img: np.ndarray, blur_size: int = 5, kernel_size: int = 10, kernel_reduction_x: int = 60, kernel_reduction_y: int = 4):
    """The unsaturated bar whose centre is nearest the middle of the width."""
    x = K.opening(K.gaussian(_channel(img, 1), blur_size), kernel_size)
    on = (x <= 35).astype(np.uint8)
    h, w = on.shape
    bar = (max(1, h // kernel_reduction_x), max(1, w // kernel_reduction_y))
    kept = K.opening(on, *bar)
    found = K.regions(kept if kept.any() else K.closing(on, *bar))
    if not found:
        return _box_mask(on.shape, [])
    r = min(found, key=lambda r: (abs(r["cx"] - w / 2), r["y0"]))
    return _box_mask(on.shape, [(max(r["x0"] - 5, 0), max(r["y0"] - 5, 0), min(r["x1"] + 5, w - 1), min(r["y1"] + 5, h - 1))])


def laplacian_text(img: np.ndarray):
    """Every centre weight, opening, second opening and polarity; unsaturated text only; the first box counts."""
    x, pale = K.gray(img).astype(float), _channel(img, 1) < 60
    sides, opened, boxes = {}, {}, []
    for weight, first, second, sign in product((4, 5, 6, 7, 8, 9), (1, 3, 5), (1, 3, 5), (1, -1)):
        if (weight, sign) not in sides:
            kernel = -np.ones((3, 3))
            kernel[1, 1] = weight
            edges = K.convolve(x, kernel)
            sides[weight, 1], sides[weight, -1] = np.clip(edges, 0, 255), np.clip(-edges, 0, 255)
        if (weight, first, sign) not in opened:
            opened[weight, first, sign] = K.opening(sides[weight, sign], first) if first > 1 else sides[weight, sign]
        y = opened[weight, first, sign]
        on = (K.closing(K.opening(y, second) if second > 1 else y, 13) < 210) & pale
        boxes += [b for b in _text_like(on.astype(np.uint8), 0.01, 0.4) if b not in boxes] if on.any() else []
    return _box_mask(x.shape, boxes)[0], boxes[:1]


#: Pixels of bands that are looked at together.
BAND_PIXELS = 1 << 21


def level_text(img: np.ndarray, width: int = 800, min_area: float = 0.01, max_area: float = 0.15):
    """Bands of every second gray level; bands that look alike once they are smooth count once."""
    x = K.gray(img)
    small = K.gaussian(K.resize(x, width=width) if x.shape[1] > width else x, 5)
    bands, seen, boxes = [], set(), []

    def look():
        masks = []
        for mask in K.smooth_bands(bands, 13):
            name = hashlib.blake2b(np.packbits(mask)).digest()
            if name not in seen:
                seen.add(name)
                masks.append(mask)
        _, area, x0, y0, x1, y1 = K.stack_regions(np.stack(masks)) if masks else (np.zeros(0, int),) * 6
        w, h = x1 - x0 + 1, y1 - y0 + 1
        like = (min_area * small.size <= w * h) & (w * h <= max_area * small.size) & (w >= 2.5 * h) & (area >= 0.8 * (w * h))
        boxes.extend(dict.fromkeys(b for b in zip(*(v[like].tolist() for v in (x0, y0, x1, y1))) if b not in boxes))
        bands.clear()

    for level in range(max(0, int(small.min()) // 2 * 2 - 12), min(256, int(small.max()) + 13), 2):
        far = np.abs(small - level)
        for reach in (5, 10):
            band = far <= reach
            if np.count_nonzero(band) / band.size >= min_area:
                bands.append(band)
        if len(bands) >= max(8, BAND_PIXELS // small.size):
            look()
    if bands:
        look()
    return _box_mask(*_scaled(x.shape, small.shape, boxes))


def contrast_text(img: np.ndarray, min_area: float = 0.01, max_area: float = 0.4):
    """Thresholds from both sides of the difference between channels; all boxes are given, the first is masked."""
    c = img.astype(int) if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2).astype(int)
    x = 255 * K.normalize(K.opening(c.max(axis=2) - c.min(axis=2), 7))
    boxes = []
    for t, above in product(np.linspace(20, 230, 10), (True, False)):
        boxes += [b for b in _text_like(K.closing(((x > t) == above).astype(np.uint8), 13), min_area, max_area, full=0) if b not in boxes]
    return _box_mask(x.shape, boxes[:1])[0], boxes


def corner_text(img: np.ndarray, blur_size: int = 10, k_size: int = 5, block_size: int = 10, min_area: float = 3000):
    """The union of the boxes where corners lie dense."""
    r = 255 * K.normalize(K.mean(np.abs(K.harris(K.gray(img).astype(float), block_size, 0.0)), blur_size))
    on = K.erode(1 - K.adaptive(255 - r, 21, 10), k_size)
    found = [q for q in K.regions(K.dilate(on, k_size)) if q["area"] >= min_area and q["x1"] - q["x0"] + 1 >= 2.5 * (q["y1"] - q["y0"] + 1)]
    box = [(min(q["x0"] for q in found), min(q["y0"] for q in found), max(q["x1"] for q in found), max(q["y1"] for q in found))] if found else []
    return _box_mask(r.shape, box)


TEXTS = {
    "morph_text_detector": morph_text,
    "ayan_text_detector": hat_text,
    "text_detector_wo_mask": flat_text,
    "laplacian_text_detector": laplacian_text,
    "stupid_text_detector": level_text,
    "anyway_text_detector": contrast_text,
    "harris_text_detector": corner_text,
}

# ---- features


def gray_vector(img: np.ndarray, color_space: str = "gray", channel: int = 1, side: int = 128) -> np.ndarray:
    return K.normalize(_channel(K.stretch(img, side, side), channel, color_space)).ravel()


def hog(img: np.ndarray, img_shape: int = 240, cell_size: int = 8, n_bins: int = 180) -> np.ndarray:
    return K.hog(img, img_shape, cell_size, 2, n_bins)


def zernike(img: np.ndarray, radius: float = 100, degree: int = 4, channel: int = 1) -> np.ndarray:
    return K.zernike(img if img.ndim == 2 else np.ascontiguousarray(img[..., channel]), radius, degree)


def lbp(img: np.ndarray, points: int = 24, radius: float = 3.0) -> np.ndarray:
    return K.lbp(img, points, radius)


def dct(img: np.ndarray, num_coeff: int = 4) -> np.ndarray:
    return K.dct(img, num_coeff)


def dwt(img: np.ndarray, level: int = 3, n_coefs: int = 7) -> np.ndarray:
    return K.dwt_histogram(img, level, n_coefs)


def random_vector(img: np.ndarray, n: int = 10, seed: int = 1) -> np.ndarray:
    """A uniform baseline that depends on the image and the seed alone."""
    return np.random.default_rng([seed, zlib.crc32(np.ascontiguousarray(img).tobytes())]).random(n)


def sift(img: np.ndarray, n_keypoints: int | None = None, max_size: int = 424) -> np.ndarray:
    return K.gradient_descriptors(img, n_keypoints, max_size)


def orb(img: np.ndarray, n_keypoints: int | None = 5000, max_size: int = 256) -> np.ndarray:
    return K.binary_descriptors(img, n_keypoints, max_size)


FEATURES = {"grayscale_extractor": gray_vector, "HOG_extractor": hog, "zernike_extractor": zernike, "lbp_extractor": lbp, "dct_extractor": dct, "dwt_extractor": dwt, "random_features_extractor": random_vector, **H.HISTOGRAMS}
KEYPOINTS = {"sift_features_extractor": sift, "orb_features_extractor": orb}

#: Parameters that plug-ins of a kind are given and that have no effect in any.
UNUSED = {"n_threads", "win_size", "block_size", "block_stride", "ksize_harris", "bins", "mask", "wavelet", "convert2ycbcr", "mode", "rescale_sigma", "thr_global", "metric"}


def parameters(f: Callable) -> list[str]:
    return [p.name for p in list(inspect.signature(f).parameters.values())[1:]]


def bound(table: dict[str, Callable], name: str, options: dict | None = None) -> Callable:
    """A plug-in with its parameters."""
    f = _named(table, "plug-in", name)
    own = set(parameters(f))
    others = {p for kind in (ENHANCE, MASKS, TEXTS, FEATURES, KEYPOINTS) for g in kind.values() for p in parameters(g)} | UNUSED
    wrong, idle = set(options or {}) - own - others, (set(options or {}) - own) & others
    if wrong:
        raise ValueError(f"unknown parameters {sorted(wrong)} of {name!r}; known: {', '.join(sorted(own))}")
    if idle:
        warnings.warn(f"{name} has no use for {sorted(idle)}", stacklevel=2)
    return partial(f, **{k: v for k, v in (options or {}).items() if k in own})


# ---- DataFrames


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Null for an empty image; an alpha channel is dropped."""
    if data is None or not height or not width or len(data) < height * width * channels:
        return None
    x = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    return x[..., 0] if channels == 1 else x[..., :3]


def over(images: DataFrame, key: str, one: Callable, schema: str, image: str = "image") -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for at, h, w, n, data in frame.itertuples(index=False):
                img = None if pd.isna(h) else decode(int(h), int(w), int(n), data)
                rows += [(at, *r) for r in one(img)]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    flat = images.select(F.col(key).alias(names[0]), *[F.col(f"{image}.{c}") for c in ("height", "width", "nChannels", "data")])
    return flat.mapInPandas(batches, schema)


def _bytes(img: np.ndarray | None):
    if img is None:
        return (None,) * 4
    return img.shape[0], img.shape[1], 1 if img.ndim == 2 else img.shape[2], np.ascontiguousarray(img).tobytes()


def enhance(images: DataFrame, name: str, key: str = "sample_id", image: str = "image", options: dict | None = None) -> DataFrame:
    """key and image, the enhanced image struct."""
    f = bound(ENHANCE, name, options)
    flat = over(images, key, lambda img: [_bytes(None if img is None else f(img))], f"{key} long, height int, width int, channels int, data binary", image)
    mode = F.when(F.col("channels") == 1, 0).otherwise(16)
    made = F.struct(F.lit("").alias("origin"), "height", "width", F.col("channels").alias("nChannels"), mode.alias("mode"), "data").cast(IMAGE)
    return flat.select(key, F.when(F.col("data").isNotNull(), made).alias("image"))


def masks(images: DataFrame, name: str, key: str = "sample_id", image: str = "image", options: dict | None = None) -> DataFrame:
    """key, height, width, mask (a byte for each pixel, 0 or 1), boxes, corners and angles."""
    f = bound(MASKS, name, options)

    def one(img):
        if img is None:
            return [(None,) * 6]
        mask, boxes, corners, angles = f(img)
        return [(*mask.shape, mask.astype(np.uint8).tobytes(), [list(map(int, b)) for b in boxes], [[list(map(float, p)) for p in c] for c in corners], list(map(float, angles)))]

    return over(images, key, one, f"{key} long, height int, width int, mask binary, boxes array<array<int>>, corners array<array<array<double>>>, angles array<double>", image)


def text_boxes(images: DataFrame, name: str, key: str = "sample_id", image: str = "image", ocr: Callable[[np.ndarray], str] | None = None, options: dict | None = None) -> DataFrame:
    """key, height, width, text_mask, boxes and texts; texts are null without an ``ocr`` function of a cropped image."""
    f = bound(TEXTS, name, options)

    def one(img):
        if img is None:
            return [(None,) * 5]
        mask, boxes = f(img)
        texts = None if ocr is None else [ocr(img[b : d + 1, a : c + 1]) for a, b, c, d in boxes]
        return [(*mask.shape, mask.astype(np.uint8).tobytes(), [list(map(int, b)) for b in boxes], texts)]

    return over(images, key, one, f"{key} long, height int, width int, text_mask binary, boxes array<array<int>>, texts array<string>", image)


def mask_regions(masks_: DataFrame, key: str = "sample_id", image: str = "image") -> DataFrame:
    """key and boxes of the connected regions of mask images, from left to right."""

    def one(img):
        if img is None:
            return [(None,)]
        on = (img if img.ndim == 2 else img.max(axis=2)) > 0
        return [(sorted([int(r[k]) for k in ("x0", "y0", "x1", "y1")] for r in K.regions(on.astype(np.uint8))),)]

    return over(masks_, key, one, f"{key} long, boxes array<array<int>>", image)


def without_text(images: DataFrame, name: str, ocr: Callable[[np.ndarray], str] | None = None, key: str = "sample_id", image: str = "image", options: dict | None = None) -> DataFrame:
    """key, image with the detected text in black, and texts (null without ``ocr``)."""
    f = bound(TEXTS, name, options)

    def one(img):
        if img is None:
            return [(None,) * 5]
        mask, boxes = f(img)
        texts = None if ocr is None else [ocr(img[b : d + 1, a : c + 1]) for a, b, c, d in boxes]
        off = (mask == 0) if img.ndim == 2 else (mask == 0)[..., None]
        return [(*_bytes((img * off).astype(np.uint8)), texts)]

    flat = over(images, key, one, f"{key} long, height int, width int, channels int, data binary, texts array<string>", image)
    made = F.struct(F.lit("").alias("origin"), "height", "width", F.col("channels").alias("nChannels"), F.when(F.col("channels") == 1, 0).otherwise(16).alias("mode"), "data").cast(IMAGE)
    return flat.select(key, F.when(F.col("data").isNotNull(), made).alias("image"), "texts")


def features(images: DataFrame, name: str, key: str = "sample_id", image: str = "image", options: dict | None = None) -> DataFrame:
    """key and vector."""
    f = bound(FEATURES, name, options)
    return over(images, key, lambda img: [(None if img is None else np.asarray(f(img), float).tolist(),)], f"{key} long, vector array<double>", image)


def feature_summaries(images: DataFrame, name: str, key: str = "sample_id", image: str = "image", options: dict | None = None) -> DataFrame:
    """key, n, norm and peak of each vector: its length, its Euclidean norm and the place, from 1, of its first largest value.

    For descriptors of a million values: the vector is measured where it is made and does not leave.
    """
    f = bound(FEATURES, name, options)

    def one(img):
        v = None if img is None else np.asarray(f(img), float)
        return [(None,) * 3 if v is None else (len(v), math.sqrt(np.dot(v, v)), int(v.argmax()) + 1 if len(v) else None)]

    flat = over(images, key, one, f"{key} long, n int, norm double, peak long", image)  # pandas turns a norm that is no number into null
    return flat.select(key, "n", F.when(F.col("n").isNotNull(), F.coalesce("norm", F.lit(math.nan))).alias("norm"), "peak")


def keypoints(images: DataFrame, name: str, key: str = "sample_id", image: str = "image", options: dict | None = None) -> DataFrame:
    """key, kp and descriptor (bits as words of 64 for the binary kind); none for a null image."""
    f, kind = bound(KEYPOINTS, name, options), "long" if name.startswith("orb") else "double"
    return over(images, key, lambda img: [] if img is None else [(i, d.tolist()) for i, d in enumerate(f(img))], f"{key} long, kp int, descriptor array<{kind}>", image)


def crops(images: DataFrame, boxes: DataFrame, key: str = "sample_id") -> DataFrame:
    """key, crop_pos and image: a row for each box; an image without boxes stays whole."""

    def cut(frames):
        for frame in frames:
            rows = []
            for at, h, w, n, data, found in frame.itertuples(index=False):
                img = None if pd.isna(h) else decode(int(h), int(w), int(n), data)
                found = [] if found is None else list(found)
                for i, (a, b, c, d) in enumerate(found or [(0, 0, 1 << 30, 1 << 30)]):
                    rows.append((at, i, *_bytes(None if img is None else img[b : d + 1, a : c + 1])))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = [key, "crop_pos", "height", "width", "channels", "data"]
    both = images.select(key, *[F.col(f"image.{c}") for c in ("height", "width", "nChannels", "data")]).join(boxes.select(key, "boxes"), key, "left")
    flat = both.mapInPandas(cut, f"{key} long, crop_pos int, height int, width int, channels int, data binary")
    mode = F.when(F.col("channels") == 1, 0).otherwise(16)
    return flat.select(key, "crop_pos", F.struct(F.lit("").alias("origin"), "height", "width", F.col("channels").alias("nChannels"), mode.alias("mode"), "data").cast(IMAGE).alias("image"))
