"""Visual words: a codebook fitted to the tile histograms of images, and images as counts of its words.

The codebook is ``num_words`` centres, a bounded model that is shared with every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetta.functions import histograms as H
from facetta.operators import images as I


@dataclass(frozen=True)
class Codebook:
    centres: np.ndarray
    k_size: int = 32
    sample: int = 255
    channel: int = 0

    def words(self, img: np.ndarray) -> np.ndarray:
        """Counts of the nearest centres of all tiles over the largest count; the first of equally near centres."""
        x = H.tiles(img, self.k_size, self.sample, self.channel)
        x /= x.max(axis=1, keepdims=True)
        far = (x * x).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres * self.centres).sum(axis=1)[None, :]
        n = np.bincount(far.argmin(axis=1), minlength=len(self.centres)).astype(float)
        return n / n.max()


def tile_histograms(images: DataFrame, k_size: int = 32, sample: int = 255, channel: int = 0, key: str = "sample_id") -> DataFrame:
    """key, tile and histogram of every tile; none for a null image."""
    one = lambda img: [] if img is None else [(i, h.tolist()) for i, h in enumerate(H.tiles(img, k_size, sample, channel))]
    return I.over(images, key, one, f"{key} long, tile int, histogram array<double>")


def fit(images: DataFrame, k_size: int = 32, sample: int = 255, channel: int = 0, num_words: int = 64, seed: int = 5) -> Codebook:
    """Centres of the tiles' histograms, each over its largest bin; fewer centres where there are fewer tiles."""
    rows = tile_histograms(images, k_size, sample, channel)
    rows = rows.select(array_to_vector(F.transform("histogram", lambda x: x / F.array_max("histogram"))).alias("features"))
    model = KMeans(k=num_words, seed=seed, maxIter=20).fit(rows)
    return Codebook(np.array(model.clusterCenters()), k_size, sample, channel)


def tokenize(images: DataFrame, codebook: Codebook, key: str = "sample_id") -> DataFrame:
    """key and vector: the words of an image; null for a null image."""
    return I.over(images, key, lambda img: [(None if img is None else codebook.words(img).tolist(),)], f"{key} long, vector array<double>")
