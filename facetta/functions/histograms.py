"""Histogram descriptors of one image (height x width x 3 in blue, green, red order, or gray).

Bins lie between the smallest and the largest value, the last one closed; a flat input falls in the middle bin.
L*a*b* takes the three planes in the order in which they are stored, as the descriptors were defined on it.
"""

from __future__ import annotations

import math

import numpy as np

from facetta.functions import kernels as K


def planes(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2)


def lab(img: np.ndarray) -> np.ndarray:
    return K.lab(planes(img)[..., ::-1])


def binned(x: np.ndarray, n: int) -> np.ndarray:
    """The bin of every value."""
    x = x.astype(float)
    lo, hi = x.min(initial=math.inf), x.max(initial=-math.inf)
    if not hi > lo:
        return np.full(x.shape, n // 2, np.int64)
    return np.minimum((x - lo) * n / (hi - lo), n - 1).astype(np.int64)


def counts(x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(binned(x, n).ravel(), minlength=n).astype(float)


def share(h: np.ndarray) -> np.ndarray:
    """Divided by its sum; zero stays zero."""
    return h / max(h.sum(), 1e-300)


def patches(x: np.ndarray, n: int):
    """n x n equal patches in rows; what does not divide is left out. An image smaller than n has as many as it can."""
    rows, cols = min(n, x.shape[0]), min(n, x.shape[1])
    h, w = x.shape[0] // rows, x.shape[1] // cols
    for i in range(rows):
        for j in range(cols):
            yield x[i * h : (i + 1) * h, j * w : (j + 1) * w]


def grayscale(img: np.ndarray) -> np.ndarray:
    mean = planes(img).mean(axis=2).astype(np.uint8)
    return K.normalize(np.bincount(mean.ravel(), minlength=256))[1:]


def by_channel(img: np.ndarray) -> np.ndarray:
    h = np.concatenate([np.bincount(planes(img)[..., c].ravel(), minlength=256)[1:] for c in range(3)])
    return h / (h + 1e-8).sum()


def skewness(h: np.ndarray) -> float:
    d = h - h.mean()
    return float((d**3).mean() / max((d * d).mean(), 1e-300) ** 1.5)


def moments(img: np.ndarray) -> np.ndarray:
    """For each i mean, deviation and skewness of two histograms, of channel i of hue, saturation and value, and of blue, green and red."""
    x, out = K.hsv(planes(img)), []
    for c in range(3):
        a, b = (share(counts(y[..., c], 255)[1:]) for y in (x, planes(img)))
        out += [a.mean(), b.mean(), a.std(), b.std(), skewness(a), skewness(b)]
    return np.array(out)


def threshold(img: np.ndarray) -> np.ndarray:
    """The value's histogram over pixels whose hue is at most the mean hue plus the deviation of the value."""
    x = K.hsv(planes(img)).astype(float)
    kept = x[..., 2][x[..., 0] <= x[..., 0].mean() + x[..., 2].std()]
    return counts(kept, 255)[1:] / (x.shape[0] * x.shape[1]) if kept.size else np.zeros(254)


def hue(img: np.ndarray) -> np.ndarray:
    return counts(K.hsv(planes(img))[..., 0], 256)


def cumulative(img: np.ndarray) -> np.ndarray:
    """What lies before each bin of the hue, the first bin left out."""
    h = hue(img)
    h[0] = 0
    return h.cumsum() - h


def exponential(img: np.ndarray) -> np.ndarray:
    h = hue(img)
    return share(np.exp(h / h.max()))


def local(img: np.ndarray, n_patches: int = 10, channel: int = 0, sample: int = 48) -> np.ndarray:
    return np.concatenate([share(counts(p, sample))[1:] for p in patches(lab(img)[..., channel], n_patches)])


def weighted(img: np.ndarray, n_patches: int = 1, channel: int = 0) -> np.ndarray:
    """A channel's values become the share of their value's bin in their patch; then one histogram of all channels from 0 to the largest value."""
    x = K.hsv(planes(img)).astype(float)
    for p in patches(x[..., channel], n_patches):
        p[...] = share(np.bincount(p.astype(np.int64).ravel(), minlength=256).astype(float))[p.astype(np.int64)]
    most = x.max()
    return np.bincount(np.minimum(x * 255 / most, 254).astype(np.int64).ravel(), minlength=255).astype(float)


def pyramid(img: np.ndarray, initial_patches: int = 1, num_pyramid_levels: int = 4, sample: int = 40) -> np.ndarray:
    x = lab(img)
    return np.concatenate([share(counts(p, sample)) for level in range(1, num_pyramid_levels + 1) for c in range(3) for p in patches(x[..., c], initial_patches * level)])


def lab_channels(img: np.ndarray, sample: int = 48) -> np.ndarray:
    x = lab(img)
    return np.concatenate([share(counts(x[..., c], sample)) for c in range(3)])


def joint(img: np.ndarray, sample: tuple[int, int, int] = (3, 3, 3)) -> np.ndarray:
    """Counts of the three L*a*b* bins together."""
    x = lab(img)
    at = np.ravel_multi_index([binned(x[..., c], n) for c, n in enumerate(sample)], tuple(sample))
    return np.bincount(at.ravel(), minlength=math.prod(sample)).astype(float)


def tiles(img: np.ndarray, k_size: int = 32, sample: int = 255, channel: int = 0) -> np.ndarray:
    """The histogram of every k x k tile of a channel of hue, saturation and value; ragged edges stay."""
    x = K.hsv(planes(img))[..., channel]
    return np.stack([counts(x[i : i + k_size, j : j + k_size], sample) for i in range(0, x.shape[0], k_size) for j in range(0, x.shape[1], k_size)])


HISTOGRAMS = {
    "hist_grayscale_extractor": grayscale,
    "hist_rgb_concat_extractor": by_channel,
    "hist_moments_extractor": moments,
    "hist_thr_extractor": threshold,
    "cum_hist_extractor": cumulative,
    "exp_hist_extractor": exponential,
    "local_histogram_extractor": local,
    "weighted_local_histogram_extractor": weighted,
    "pyramid_local_histogram_extractor": pyramid,
    "histogram_lab_extractor": lab_channels,
    "3d_histogram_extractor": joint,
}
