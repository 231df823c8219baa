"""Image kernels on numpy arrays: filters, thresholds, components, shapes, descriptors.

They are called on one decoded image at a time by facetta.operators.images. Colour images are height x width x 3 in
blue, green, red order; borders repeat the edge unless a function says otherwise.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

# ---- colour and size


def gray(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img
    return np.rint(img.astype(float) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def hsv(img: np.ndarray) -> np.ndarray:
    """Hue in 0..179, saturation and value in 0..255."""
    b, g, r = (img[..., i].astype(float) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(v > 0, 255 * d / v, 0)
        h = np.select([d == 0, v == r, v == g], [0, 60 * (g - b) / d, 120 + 60 * (b - r) / d], 240 + 60 * (r - g) / d)
    return np.stack([np.rint(np.mod(h, 360) / 2) % 180, np.rint(s), v], axis=-1).astype(np.uint8)


def lab(img: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) of an 8-bit image in sRGB."""
    x = img[..., ::-1].astype(float) / 255
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    x = x @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]])
    x = x / np.array([0.95047, 1.0, 1.08883])
    f = np.where(x > 0.008856, np.cbrt(x), 7.787 * x + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def normalize(x: np.ndarray) -> np.ndarray:
    """To 0..1; a flat image is all zero."""
    lo, hi = float(x.min()), float(x.max())
    return (x.astype(float) - lo) / (hi - lo) if hi > lo else np.zeros(x.shape)


def byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


@lru_cache(256)
def _area(n: int, m: int) -> np.ndarray:
    """m x n weights: the share of each of n cells in each of m equal stretches."""
    edges, cells = np.arange(m + 1) * n / m, np.arange(n + 1)
    lo, hi = np.maximum(edges[:-1, None], cells[None, :-1]), np.minimum(edges[1:, None], cells[None, 1:])
    w = np.maximum(hi - lo, 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, width: int | None = None, height: int | None = None) -> np.ndarray:
    """By area; with a width the aspect ratio is kept and the height ignored."""
    h, w = img.shape[:2]
    if width is not None:
        height = max(1, int(h * width / w))
    elif height is not None:
        width = max(1, int(w * height / h))
    else:
        return img
    return byte(np.moveaxis(np.tensordot(_area(w, width), np.tensordot(_area(h, height), img.astype(float), (1, 0)), (1, 1)), 0, 1))


def stretch(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area to exactly this size."""
    return byte(np.moveaxis(np.tensordot(_area(img.shape[1], width), np.tensordot(_area(img.shape[0], height), img.astype(float), (1, 0)), (1, 1)), 0, 1))


# ---- filters


def _windows(x: np.ndarray, h: int, w: int, mode: str = "edge") -> np.ndarray:
    """Every h x w window, centred at h // 2, w // 2."""
    return sliding_window_view(np.pad(x, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), mode=mode), (h, w))


def _run(x: np.ndarray, n: int, axis: int, f, fill) -> np.ndarray:
    """Running extreme of n cells: windows of doubled length, then two that overlap."""
    pad = [(0, 0)] * x.ndim
    pad[axis] = (n // 2, n - 1 - n // 2)
    y, m = np.moveaxis(np.pad(x, pad, constant_values=fill), axis, 0), 1
    while 2 * m <= n:
        y, m = f(y[:-m], y[m:]), 2 * m
    size = x.shape[axis]
    return np.moveaxis(f(y[:size], y[n - m : n - m + size]), 0, axis)


def dilate(x: np.ndarray, h: int, w: int | None = None) -> np.ndarray:
    low = np.iinfo(x.dtype).min if x.dtype.kind in "iu" else x.min()
    return _run(_run(x, h, 0, np.maximum, low), w or h, 1, np.maximum, low)


def erode(x: np.ndarray, h: int, w: int | None = None) -> np.ndarray:
    high = np.iinfo(x.dtype).max if x.dtype.kind in "iu" else x.max()
    return _run(_run(x, h, 0, np.minimum, high), w or h, 1, np.minimum, high)


def opening(x: np.ndarray, h: int, w: int | None = None) -> np.ndarray:
    return dilate(erode(x, h, w), h, w)


def closing(x: np.ndarray, h: int, w: int | None = None) -> np.ndarray:
    return erode(dilate(x, h, w), h, w)


def fill(mask: np.ndarray, k: int = 10) -> np.ndarray:
    return closing(closing(mask, k, 1), 1, k)


def median(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of windows at a time, so that memory follows the width."""
    win = _windows(x, k, k)
    return np.stack([np.median(row.reshape(len(row), -1), axis=1) for row in win]).astype(x.dtype)


def convolve(x: np.ndarray, kernel: np.ndarray, mode: str = "edge") -> np.ndarray:
    h, w = kernel.shape
    wide = np.pad(x.astype(float), ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), mode=mode)
    out, flipped = np.zeros(x.shape), kernel[::-1, ::-1]
    for i in range(h):
        for j in range(w):
            if flipped[i, j]:
                out += flipped[i, j] * wide[i : i + x.shape[0], j : j + x.shape[1]]
    return out


def gaussian(x: np.ndarray, k: int, sigma: float | None = None) -> np.ndarray:
    sigma = sigma or 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    g /= g.sum()
    return convolve(convolve(x, g[:, None]), g[None, :])


def mean(x: np.ndarray, k: int) -> np.ndarray:
    one = np.full((k, 1), 1 / k)
    return convolve(convolve(x, one), one.T)


def noise(img: np.ndarray) -> float:
    """Estimate of the noise's deviation by a difference of Laplacians, the border filled with zeros; 0 below 3 x 3."""
    x = gray(img).astype(float)
    h, w = x.shape
    if h < 3 or w < 3:
        return 0.0
    out = convolve(np.pad(x, 1), np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]]), mode="constant")
    return float(np.abs(out).sum() * math.sqrt(math.pi / 2) / (6 * (h - 2) * (w - 2)))


def non_local_means(img: np.ndarray, h: float = 3, patch: int = 7, search: int = 21) -> np.ndarray:
    """Every shift within the search window at once for all pixels; patches compare by mean squared difference."""
    x = img.astype(float) if img.ndim == 3 else img.astype(float)[..., None]
    half, edge = search // 2, patch // 2
    wide = np.pad(x, ((half + edge,) * 2, (half + edge,) * 2, (0, 0)), mode="reflect" if min(x.shape[:2]) > half + edge else "edge")
    rows, cols = x.shape[0] + 2 * edge, x.shape[1] + 2 * edge
    here = wide[half : half + rows, half : half + cols]
    total, weight = np.zeros(x.shape), np.zeros(x.shape[:2])
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            there = wide[half + dy : half + dy + rows, half + dx : half + dx + cols]
            sums = np.pad(((here - there) ** 2).mean(axis=2), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
            far = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / patch**2
            w = np.exp(-np.maximum(far, 0) / (h * h))
            weight += w
            total += w[..., None] * there[edge : edge + x.shape[0], edge : edge + x.shape[1]]
    return byte(total / weight[..., None]).reshape(img.shape)


def haar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One level of the orthonormal Haar transform; an odd side repeats its edge."""
    x = np.pad(x.astype(float), ((0, x.shape[0] % 2), (0, x.shape[1] % 2)), mode="symmetric")
    a, b, c, d = x[::2, ::2], x[::2, 1::2], x[1::2, ::2], x[1::2, 1::2]
    return (a + b + c + d) / 2, (a + b - c - d) / 2, (a - b + c - d) / 2, (a - b - c + d) / 2


def unhaar(ll: np.ndarray, lh: np.ndarray, hl: np.ndarray, hh: np.ndarray) -> np.ndarray:
    out = np.empty((2 * ll.shape[0], 2 * ll.shape[1]))
    out[::2, ::2], out[::2, 1::2] = (ll + lh + hl + hh) / 2, (ll + lh - hl - hh) / 2
    out[1::2, ::2], out[1::2, 1::2] = (ll - lh + hl - hh) / 2, (ll - lh - hl + hh) / 2
    return out


def visushrink(x: np.ndarray, sigma: float, levels: int = 3) -> np.ndarray:
    """Soft threshold sigma * sqrt(2 ln n) of every detail band."""
    limit = sigma * math.sqrt(2 * math.log(max(x.size, 2)))
    if levels == 0 or min(x.shape) < 2:
        return x.astype(float)
    ll, *bands = haar(x)
    soft = [np.sign(b) * np.maximum(np.abs(b) - limit, 0) for b in bands]
    return unhaar(visushrink(ll, sigma, levels - 1), *soft)[: x.shape[0], : x.shape[1]]


# ---- thresholds and edges


def otsu(values: np.ndarray) -> int:
    """Background is at most the threshold; the first maximum of the variance between classes wins."""
    n = np.bincount(np.asarray(values, np.int64).ravel(), minlength=256).astype(float)
    n0, s0 = n.cumsum(), (n * np.arange(len(n))).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        var = n0 * (n0[-1] - n0) * (s0 / n0 - (s0[-1] - s0) / (n0[-1] - n0)) ** 2
    return int(np.argmax(np.round(np.nan_to_num(var), 6)))


def adaptive(x: np.ndarray, block: int, offset: float, smooth=mean) -> np.ndarray:
    return (x > smooth(x, block) - offset).astype(np.uint8)


def sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.array([[1, 0, -1], [2, 0, -2], [1, 0, -1]])
    return convolve(x, k), convolve(x, k.T)


def canny(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin ridges of the gradient above ``low`` in components that reach ``high``."""
    gx, gy = sobel(x)
    m = np.abs(gx) + np.abs(gy)
    wide = np.pad(m, 1)
    at = lambda dy, dx: wide[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    sector = np.rint(np.mod(np.arctan2(gy, gx), np.pi) / (np.pi / 4)).astype(int) % 4
    ridge = np.zeros(m.shape, bool)
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        ridge |= (sector == k) & (m > at(-dy, -dx)) & (m >= at(dy, dx))
    weak = ridge & (m > low)
    labels, n = components(weak)
    strong = np.zeros(n + 1, bool)
    strong[np.unique(labels[weak & (m > high)])] = True
    strong[0] = False
    return strong[labels].astype(np.uint8)


# ---- components and shapes


def components(mask: np.ndarray, eight: bool = True) -> tuple[np.ndarray, int]:
    """Labels from 1 in the order of their first pixel, and their number; runs of a row are united with those above."""
    m = np.pad(np.asarray(mask) != 0, ((0, 0), (1, 1))).astype(np.int8)
    steps = np.diff(m, axis=1)
    rows, starts = np.nonzero(steps == 1)
    ends = np.nonzero(steps == -1)[1]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach, first = int(eight), np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(rows))], np.int64)
    names, numbers = np.unique(roots, return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    for y, a, b, k in zip(rows, starts, ends, numbers):
        out[y, a:b] = k + 1
    return out, len(names)


def regions(mask: np.ndarray) -> list[dict]:
    """area, x0, y0, x1, y1 (inclusive), cx and label of each component, holes filled."""
    labels, n = components(fill_holes(mask))
    if not n:
        return []
    y, x = np.nonzero(labels)
    k = labels[y, x] - 1
    area = np.bincount(k, minlength=n)
    out = []
    lows, highs = np.full((2, n), 1 << 30), np.full((2, n), -1)
    for d, c in enumerate((x, y)):
        np.minimum.at(lows[d], k, c)
        np.maximum.at(highs[d], k, c)
    cx, cy = np.bincount(k, x, n) / area, np.bincount(k, y, n) / area
    for i in range(n):
        out.append({"label": i + 1, "area": int(area[i]), "x0": int(lows[0][i]), "y0": int(lows[1][i]), "x1": int(highs[0][i]), "y1": int(highs[1][i]), "cx": float(cx[i]), "cy": float(cy[i])})
    return out


def outside(mask: np.ndarray) -> np.ndarray:
    """The zeros that reach the border."""
    labels, n = components(np.asarray(mask) == 0, eight=False)
    edge = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    return np.isin(labels, edge[edge > 0])


def fill_holes(mask: np.ndarray) -> np.ndarray:
    return (~outside(mask)).astype(np.uint8)


def _stack_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and the column behind the last of every run of a stack of masks; a row is left out between two masks."""
    n, h, w = on.shape
    wide = np.zeros((n * h, w + 1), bool)
    wide[:, :w] = on.reshape(n * h, w)
    wide = wide.ravel()
    turns = np.flatnonzero(np.concatenate([wide[:1], wide[1:] != wide[:-1]]))
    row = turns[::2] // (w + 1)
    return row + row // h, turns[::2] - row * (w + 1), turns[1::2] - row * (w + 1)


def _run_roots(row: np.ndarray, a: np.ndarray, b: np.ndarray, eight: bool) -> np.ndarray:
    """The first run of the component of each run."""
    root = np.arange(len(row))
    if not len(row):
        return root
    wide, reach = int(b.max()) + 2, int(eight)
    below = (row + 1) * wide
    lo, hi = np.searchsorted(row * wide + b, below + a - reach, "right"), np.searchsorted(row * wide + a, below + b + reach)
    n = np.maximum(hi - lo, 0)
    above = np.repeat(root, n)
    under = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(above))
    while len(above):
        p, q = root[above], root[under]
        apart = p != q
        above, under, p, q = above[apart], under[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return root


def stack_regions(masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """mask, area, x0, y0, x1 and y1 (inclusive) of the regions of each mask of a stack, as ``regions`` has them."""
    n, h, w = masks.shape
    on = masks != 0
    if not on.size:
        return (np.zeros(0, np.int64),) * 6
    row, a, b = _stack_runs(~on)
    root, y = _run_roots(row, a, b, eight=False), row % (h + 1)
    out = np.zeros(len(row), bool)
    out[root[(y == 0) | (y == h - 1) | (a == 0) | (b == w)]] = True
    for k in np.flatnonzero(~out[root]):
        on[row[k] // (h + 1), y[k], a[k] : b[k]] = True
    row, a, b = _stack_runs(on)
    first, of = np.unique(_run_roots(row, a, b, eight=True), return_inverse=True)
    low, high, last = np.full(len(first), w), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    np.minimum.at(low, of, a)
    np.maximum.at(high, of, b)
    np.maximum.at(last, of, row)
    return row[first] // (h + 1), np.bincount(of, b - a, len(first)).astype(np.int64), low, row[first] % (h + 1), high - 1, last % (h + 1)


def smooth_bands(bands: list[np.ndarray], k: int) -> np.ndarray:
    """Closing, then opening of each binary image by k x k, an odd k: a bit of a byte is an image, so eight go at once."""
    x = np.stack([np.packbits(np.stack(bands[i : i + 8]), axis=0)[0] for i in range(0, len(bands), 8)])
    for f, low, n in ((np.bitwise_or, 0, k), (np.bitwise_and, 255, 2 * k - 1), (np.bitwise_or, 0, k)):
        x = _run(_run(x, n, 1, f, low), n, 2, f, low)
    return np.unpackbits(x[:, None], axis=1).reshape(-1, *bands[0].shape)[: len(bands)]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (x, y) points by the monotone chain, counter-clockwise."""
    pts = sorted(set(map(tuple, np.asarray(points).tolist())))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)
    chains = []
    for seq in (pts, pts[::-1]):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        chains += out[:-1]
    return np.array(chains, float)


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Corners, area and angle in degrees (0..90) of the smallest rectangle; one side lies on the hull."""
    h = hull(points)
    if len(h) < 3:
        lo, hi = h.min(axis=0), h.max(axis=0)
        return np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]), 0.0, 0.0
    side = np.roll(h, -1, axis=0) - h
    best = None
    for a in np.unique(np.round(np.mod(np.arctan2(side[:, 1], side[:, 0]), np.pi / 2), 9)):
        turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
        p = h @ turn
        lo, hi = p.min(axis=0), p.max(axis=0)
        size = float(np.prod(hi - lo))
        if best is None or size < best[1] - 1e-9:
            best = np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]) @ turn.T, size, math.degrees(a)
    return best


def extreme_corners(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: extremes of x + y and x - y."""
    s, d = points.sum(axis=1), points[:, 0] - points[:, 1]
    return np.array([points[s.argmin()], points[d.argmax()], points[s.argmax()], points[d.argmin()]])


def polygon(shape: tuple[int, int], corners: np.ndarray) -> np.ndarray:
    """Pixels within a polygon, its corners and edges included."""
    c, out = np.asarray(corners, float), np.zeros(shape, np.uint8)
    if not len(c):
        return out
    left, top = (max(0, math.floor(v)) for v in c.min(axis=0))
    right, low = (min(n, math.ceil(v) + 1) for n, v in zip(shape[::-1], c.max(axis=0)))
    if left >= right or top >= low:
        return out
    y, x = np.mgrid[top:low, left:right].astype(float)
    inside, on = np.zeros(y.shape, bool), np.zeros(y.shape, bool)
    for (x0, y0), (x1, y1) in zip(c, np.roll(c, -1, axis=0)):
        cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        on |= (np.abs(cross) < 1e-9) & (x >= min(x0, x1) - 1e-9) & (x <= max(x0, x1) + 1e-9) & (y >= min(y0, y1) - 1e-9) & (y <= max(y0, y1) + 1e-9)
        if y0 != y1:
            inside ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    out[top:low, left:right] = inside | on
    return out


def hough_lines(edges: np.ndarray, votes: int, shortest: int, gap: int) -> list[tuple[int, int, int, int]]:
    """Segments (x0, y0, x1, y1): edge pixels vote for lines at every degree; runs of a strong line with small gaps count.

    Every pixel votes (the probabilistic form samples them), so results do not depend on a seed.
    """
    ys, xs = np.nonzero(edges)
    if not len(ys):
        return []
    out = []
    for a in np.deg2rad(np.arange(180)):
        rho = np.rint(xs * math.cos(a) + ys * math.sin(a)).astype(int)
        low = rho.min()
        counts = np.bincount(rho - low)
        for k in np.nonzero(counts >= votes)[0]:
            on = rho == k + low
            along = np.sort(np.rint(-xs[on] * math.sin(a) + ys[on] * math.cos(a)).astype(int))
            for run in np.split(along, np.nonzero(np.diff(along) > gap)[0] + 1):
                if run[-1] - run[0] >= shortest:
                    ends = [((k + low) * math.cos(a) - t * math.sin(a), (k + low) * math.sin(a) + t * math.cos(a)) for t in (run[0], run[-1])]
                    out.append(tuple(int(round(v)) for p in ends for v in p))
    return out


def draw_line(mask: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> None:
    n = max(abs(x1 - x0), abs(y1 - y0)) + 1
    y, x = np.rint(np.linspace(y0, y1, n)).astype(int), np.rint(np.linspace(x0, x1, n)).astype(int)
    ok = (y >= 0) & (x >= 0) & (y < mask.shape[0]) & (x < mask.shape[1])
    mask[y[ok], x[ok]] = 1


# ---- descriptors


def dct(x: np.ndarray, k: int = 4) -> np.ndarray:
    """The first k coefficients of the orthonormal transform of x / 255 in zig-zag order over a 6 x 6 corner."""
    x = gray(x).astype(float) / 255
    basis = [np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(6)[:, None] / (2 * n)) * np.where(np.arange(6) == 0, math.sqrt(1 / n), math.sqrt(2 / n))[:, None] for n in x.shape]
    y = basis[0] @ x @ basis[1].T
    order = sorted(((i, j) for i in range(6) for j in range(6)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([y[p] for p in order[:k]])


def dwt_histogram(x: np.ndarray, levels: int = 3, bands: int = 7, bins: int = 8) -> np.ndarray:
    """8-bin histograms of the coarsest bands on [0, |max| + 1), interleaved by bin."""
    ll, found = gray(x).astype(float), []
    for _ in range(levels):
        ll, *three = haar(ll)
        found = three + found
    counts = [np.histogram(b, bins, (0, abs(b.max()) + 1))[0] for b in [ll, *found][:bands]]
    return np.stack(counts, axis=1).ravel().astype(float)


def lbp(x: np.ndarray, points: int = 24, radius: float = 3) -> np.ndarray:
    """Uniform local binary patterns, points + 2 bins, unit length; samples between pixels are bilinear, zero beyond the border."""
    g = gray(x).astype(float)
    h, w = g.shape
    edge = int(radius) + 2
    wide, bits = np.pad(g, edge), []
    for p in range(points):
        dy, dx = round(-radius * math.sin(2 * math.pi * p / points), 5), round(radius * math.cos(2 * math.pi * p / points), 5)
        y0, x0 = math.floor(dy), math.floor(dx)
        fy, fx = dy - y0, dx - x0
        at = lambda y, x: wide[edge + y : edge + y + h, edge + x : edge + x + w]  # noqa: E731, B023
        bits.append((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1)) >= g - 1e-9)
    b = np.stack(bits)
    changes = (b != np.roll(b, 1, axis=0)).sum(axis=0)
    out = np.bincount(np.where(changes <= 2, b.sum(axis=0), points + 1).ravel(), minlength=points + 2).astype(float)
    return out / np.linalg.norm(out)


def _angle_votes(gx: np.ndarray, gy: np.ndarray, bins: int, turn: float) -> np.ndarray:
    """Height x width x bins: the gradient's size shared between the two nearest angles."""
    m, pos = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), turn) / turn * bins - 0.5
    low = np.floor(pos).astype(int)
    out = np.zeros((*m.shape, bins))
    y, x = np.mgrid[: m.shape[0], : m.shape[1]]
    out[y, x, low % bins] += m * (1 - (pos - low))
    out[y, x, (low + 1) % bins] += m * (pos - low)
    return out


def hog(img: np.ndarray, side: int = 240, cell: int = 8, block: int = 2, bins: int = 180) -> np.ndarray:
    """Histograms of oriented gradients of 2 x 2 cells at every cell, clipped at 0.2 and normalised twice.

    Only pixels with a gradient vote, straight into their cell's bins; blocks are made a row at a time.
    """
    if side % cell:
        raise ValueError(f"a side of {side} pixels is not made of whole cells of {cell}")
    x = np.pad(stretch(gray(img), side, side).astype(float), 1, mode="edge")
    gx, gy, n = x[1:-1, 2:] - x[1:-1, :-2], x[2:, 1:-1] - x[:-2, 1:-1], side // cell
    at = np.flatnonzero((gx != 0) | (gy != 0))
    gx, gy = gx.ravel()[at], gy.ravel()[at]
    m, pos = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), math.pi) / math.pi * bins - 0.5
    low = np.floor(pos).astype(int)
    of, share = (at // side // cell * n + at % side // cell) * bins, pos - low
    places, votes = np.stack([of + low % bins, of + (low + 1) % bins], axis=1), np.stack([m * (1 - share), m * share], axis=1)
    cells = np.bincount(places.ravel(), votes.ravel(), n * n * bins).astype(float).reshape(n, n, bins)
    n += 1 - block
    out, row = np.empty((n, n, bins * block * block), np.float32), np.empty((n, bins, block, block))
    for y, line in enumerate(out):
        for i, j in np.ndindex(block, block):
            row[:, :, i, j] = cells[y + i, j : j + n]
        b = row.reshape(line.shape)
        b /= np.sqrt((b * b).sum(axis=1, keepdims=True)) + 1e-9
        np.minimum(b, 0.2, out=b)
        b /= np.sqrt((b * b).sum(axis=1, keepdims=True)) + 1e-9
        line[:] = b
    return out.ravel()


def zernike(img: np.ndarray, radius: float = 100, degree: int = 4) -> np.ndarray:
    """Magnitudes of the Zernike moments up to a degree about the centre of mass; zero for a black image."""
    x = gray(img).astype(float)
    names = [(n, m) for n in range(degree + 1) for m in range(n + 1) if (n - m) % 2 == 0]
    total = x.sum()
    if not total:
        return np.zeros(len(names))
    yy, xx = np.mgrid[: x.shape[0], : x.shape[1]]
    dy, dx = (yy - (yy * x).sum() / total) / radius, (xx - (xx * x).sum() / total) / radius
    r, a = np.hypot(dx, dy), np.arctan2(dy, dx)
    inside = r <= 1
    r, a, p = r[inside], a[inside], x[inside] / x[inside].sum()
    out = []
    for n, m in names:
        radial = sum((-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + m) // 2 - s) * math.factorial((n - m) // 2 - s)) * r ** (n - 2 * s) for s in range((n - m) // 2 + 1))
        out.append(abs((p * radial * np.exp(-1j * m * a)).sum()) * (n + 1) / math.pi)
    return np.array(out)


def harris(x: np.ndarray, block: int = 3, k: float = 0.04) -> np.ndarray:
    gx, gy = sobel(x)
    a, b, c = (mean(v, block) for v in (gx * gx, gx * gy, gy * gy))
    return a * c - b * b - k * (a + c) ** 2


def keypoints(x: np.ndarray, most: int | None = None, share: float = 0.01) -> np.ndarray:
    """(y, x) of the corner response's local maxima, strongest first."""
    r = harris(gaussian(x, 5))
    top = (r == dilate(r, 3)) & (r > share * max(r.max(), 1e-9))
    y, xx = np.nonzero(top)
    order = np.lexsort((xx, y, -r[y, xx]))[:most]
    return np.stack([y[order], xx[order]], axis=1)


def gradient_descriptors(img: np.ndarray, most: int | None = None, width: int = 424) -> np.ndarray:
    """n x 128: 4 x 4 cells of 8 directions about each keypoint, turned to its main direction; one zero row without keypoints."""
    g = gray(img)
    x = (resize(g, width=width) if g.shape[1] > width else g).astype(float)
    at = keypoints(x, most)
    if not len(at):
        return np.zeros((1, 128), np.float32)
    gy, gx = np.gradient(np.pad(gaussian(x, 5), 12, mode="edge"))
    grid = (np.arange(16) - 7.5) * 1.0
    v, u = np.meshgrid(grid, grid, indexing="ij")
    weight, out = np.exp(-(u * u + v * v) / 128), []
    for y, xx in at + 12:
        py, px = gy[y - 8 : y + 8, xx - 8 : xx + 8], gx[y - 8 : y + 8, xx - 8 : xx + 8]
        main = _angle_votes(px, py, 36, 2 * math.pi) * weight[..., None]
        a = (main.sum(axis=(0, 1)).argmax() + 0.5) * 2 * math.pi / 36
        sy = np.clip(np.rint(y + v * math.cos(a) + u * math.sin(a)).astype(int), 0, gy.shape[0] - 1)
        sx = np.clip(np.rint(xx + u * math.cos(a) - v * math.sin(a)).astype(int), 0, gy.shape[1] - 1)
        qx, qy = gx[sy, sx], gy[sy, sx]
        rx, ry = qx * math.cos(a) + qy * math.sin(a), qy * math.cos(a) - qx * math.sin(a)
        d = (_angle_votes(rx, ry, 8, 2 * math.pi) * weight[..., None]).reshape(4, 4, 4, 4, 8).sum(axis=(1, 3)).ravel()
        d = np.minimum(d / (np.linalg.norm(d) + 1e-9), 0.2)
        out.append(d / (np.linalg.norm(d) + 1e-9))
    return np.array(out, np.float32)


def binary_descriptors(img: np.ndarray, most: int = 5000, width: int = 256, seed: int = 11) -> np.ndarray:
    """n x 4 words of 64 bits: brightness comparisons at 256 fixed random pairs about each keypoint; one zero row without."""
    g = gray(img)
    x = gaussian((resize(g, width=width) if g.shape[1] > width else g).astype(float), 5)
    at = keypoints(x, most)
    if not len(at):
        return np.zeros((1, 4), np.int64)
    pairs = np.clip(np.rint(np.random.default_rng(seed).normal(0, 5, (256, 4))), -12, 12).astype(int)
    wide, at = np.pad(x, 12, mode="edge"), at + 12
    less = wide[at[:, :1] + pairs[:, 0], at[:, 1:] + pairs[:, 1]] < wide[at[:, :1] + pairs[:, 2], at[:, 1:] + pairs[:, 3]]
    return np.packbits(less, axis=1).view(">i8").astype(np.int64)
