"""Image queries over pixel grids made from the embeddings, as the tables hold no images.

A grid of 8 x 8 values becomes a 64 x 64 image of three channels, built by column functions.
"""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetta.functions import histograms as H
from facetta.operators import codebook as B
from facetta.operators import images as I
from facetta.plans import templates

CELL = 8


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label and image of every embedding; a null image where there are not 64 values."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    value = lambda x: F.floor((x + 1) * 127.5).cast("int")
    byte = lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")
    cell = lambda x: F.repeat(F.concat(*[byte(value(x) + 85 * c) for c in range(3)]), CELL)
    line = lambda r: F.repeat(F.array_join(F.transform(F.slice("e", r * 8 + 1, 8), cell), ""), CELL)
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), line), ""))
    side = F.lit(8 * CELL)
    image = F.struct(F.lit("").alias("origin"), side.alias("height"), side.alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    return rows.select("sample_id", "label", F.when(F.size("e") == 64, image).alias("image"))


def _spread(images: DataFrame) -> DataFrame:
    """Images are small to read and slow to compute: one small file would be one task."""
    return images.repartition(max(images.sparkSession.sparkContext.defaultParallelism, int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _enhanced(name: str):
    return lambda spark, sf_dir: I.enhance(_spread(grids(spark, sf_dir)), name).select("sample_id", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.crc32("image.data").alias("crc"))


def _masked(name: str):
    return lambda spark, sf_dir: I.masks(_spread(grids(spark, sf_dir)), name).select("sample_id", (F.length(F.replace(F.hex("mask"), F.lit("0"), F.lit("")))).cast("long").alias("area"), F.size("boxes").alias("n_boxes"), F.to_json("boxes").alias("boxes"), F.to_json("angles").alias("angles"))


def _text(name: str):
    return lambda spark, sf_dir: I.text_boxes(_spread(grids(spark, sf_dir)), name).select("sample_id", F.size("boxes").alias("n_boxes"), F.to_json("boxes").alias("boxes"))


def _feature(name: str):
    return lambda spark, sf_dir: I.feature_summaries(_spread(grids(spark, sf_dir)), name).select("sample_id", "n", F.round("norm", 6).alias("norm"), "peak")


def _histogram(name: str):
    """The entries of a histogram descriptor that are not zero, by place."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = I.features(_spread(grids(spark, sf_dir)), name).select("sample_id", F.posexplode("vector").alias("i", "x"))
        return rows.where("x <> 0").select("sample_id", "i", F.round("x", DIGITS.get(name, 6)).alias("x"))

    return query


def codebook_words(spark: SparkSession, sf_dir: str, num_words: int = 32) -> DataFrame:
    """Every image by the words of a codebook fitted to all of them: the number of words that it has, and its commonest."""
    images = _spread(grids(spark, sf_dir))
    found = B.tokenize(images, B.fit(images, k_size=16, sample=32, channel=2, num_words=num_words))
    return found.select("sample_id", F.size(F.filter("vector", lambda x: x > 0)).alias("n"), F.array_position("vector", F.lit(1.0)).alias("top"))


def _keypoints(name: str):
    return lambda spark, sf_dir: I.keypoints(_spread(grids(spark, sf_dir)), name).groupBy("sample_id").agg(F.count("*").alias("n"), F.max(F.size("descriptor")).alias("width"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("embedding").isNotNull())
    return rows.select(F.col("vec_id").alias("sample_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components of every vector; the sign is fixed by the largest loading."""
    rows = _vectors(spark, sf_dir)
    model = PCA(k=2, inputCol="features", outputCol="p").fit(rows)
    load = model.pc.toArray()
    signs = [1.0 if load[abs(load[:, i]).argmax(), i] > 0 else -1.0 for i in range(2)]
    p = vector_to_array("p")
    return model.transform(rows).select("sample_id", *[F.round(p[i] * signs[i], 5).alias(f"pc{i + 1}") for i in range(2)])


def gmm_density(spark: SparkSession, sf_dir: str, k: int = 8, seed: int = 3) -> DataFrame:
    """The component of each projected vector and its probability, in a mixture of k."""
    plane = pca_projection(spark, sf_dir).select("sample_id", array_to_vector(F.array("pc1", "pc2")).alias("features"))
    found = GaussianMixture(k=k, seed=seed, maxIter=20).fit(plane).transform(plane)
    return found.select("sample_id", F.col("prediction").alias("component"), F.round(F.array_max(vector_to_array("probability")), 4).alias("probability"))


def visual_codebook(spark: SparkSession, sf_dir: str, words: int = 64, seed: int = 5) -> DataFrame:
    """Each image's count of visual words over its largest count; a word is the centre nearest to a tile's histogram.

    Tiles are 2 x 2 cells of the grid, histograms have 16 bins and are divided by their largest bin.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("p", "x"))
    tile = (F.floor(F.col("p") / 16) * 4 + F.floor(F.pmod("p", F.lit(8)) / 2)).cast("int")
    bins = F.floor((F.col("x").cast("double") + 1) * 127.5 / 16).cast("int")
    tiles = rows.groupBy("sample_id", tile.alias("tile")).agg(*[F.sum(F.when(bins == b, 1.0).otherwise(0.0)).alias(f"b{b}") for b in range(16)])
    most = F.greatest(*[F.col(f"b{b}") for b in range(16)])
    tiles = tiles.select("sample_id", array_to_vector(F.array(*[F.coalesce(F.try_divide(f"b{b}", most), F.lit(0.0)) for b in range(16)])).alias("features"))
    named = KMeans(k=words, seed=seed, maxIter=10).fit(tiles).transform(tiles)
    counts = named.groupBy("sample_id", F.col("prediction").alias("word")).count()
    top = counts.groupBy("sample_id").agg(F.max("count").alias("top"))
    return counts.join(top, "sample_id").select("sample_id", "word", F.round(F.col("count") / F.col("top"), 6).alias("weight"))


def random_features(spark: SparkSession, sf_dir: str, n: int = 10, seed: int = 1) -> DataFrame:
    """A uniform baseline that depends on the id and the seed alone, whatever the partitions."""
    one = lambda i: F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.array(*[one(i) for i in range(n)]).alias("vector"))


_short = lambda name: name.removesuffix("_preprocessor").removesuffix("_extractor").removesuffix("_features").lower()
QUERIES = (
    {f"enhance_{_short(n)}": _enhanced(n) for n in I.ENHANCE}
    | {f"image_{_short(n)}": _masked(n) for n in I.MASKS}
    | {f"image_{n}": _text(n) for n in I.TEXTS}
    | {f"feature_{_short(n)}": _feature(n) for n in I.FEATURES if n not in H.HISTOGRAMS}
    | {f"feature_{_short(n)}": _histogram(n) for n in H.HISTOGRAMS}
    | {f"keypoints_{_short(n)}": _keypoints(n) for n in I.KEYPOINTS}
    | {"pca_projection": pca_projection, "gmm_density": gmm_density, "visual_codebook": visual_codebook, "codebook_words": codebook_words, "random_features": random_features}
)

#: Places of the rounded values, 6 unless given.
DIGITS = {"hist_moments_extractor": 4}

# Oracles of the histogram descriptors: the 64 x 64 pixels of every grid, their hue, saturation and value, and L*a*b*.
_LINEAR = lambda x: f"(CASE WHEN {x} / 255 > 0.04045 THEN pow(({x} / 255 + CAST(0.055 AS DOUBLE)) / 1.055, 2.4) ELSE {x} / 255 / 12.92 END)"
_ROOT = lambda t: f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE CAST(7.787 AS DOUBLE) * {t} + CAST(16 AS DOUBLE) / 116 END)"
_PIXELS = f"""WITH cell AS (SELECT vec_id, r, c, CAST(v % 256 AS DOUBLE) AS b, CAST((v + 85) % 256 AS DOUBLE) AS g, CAST((v + 170) % 256 AS DOUBLE) AS q FROM {templates.spelled('{px}', templates.DUCK, {})}),
 turned AS (SELECT *, greatest(b, g, q) AS val, greatest(b, g, q) - least(b, g, q) AS d, {_LINEAR('b')} AS lr, {_LINEAR('g')} AS lg, {_LINEAR('q')} AS lb FROM cell),
 angled AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN val = q THEN 60 * (g - b) / d WHEN val = g THEN 120 + 60 * (b - q) / d ELSE 240 + 60 * (q - g) / d END AS turn,
   (CAST(0.412453 AS DOUBLE) * lr + CAST(0.357580 AS DOUBLE) * lg + CAST(0.180423 AS DOUBLE) * lb) / 0.95047 AS tx, CAST(0.212671 AS DOUBLE) * lr + CAST(0.715160 AS DOUBLE) * lg + CAST(0.072169 AS DOUBLE) * lb AS ty, (CAST(0.019334 AS DOUBLE) * lr + CAST(0.119193 AS DOUBLE) * lg + CAST(0.950227 AS DOUBLE) * lb) / 1.08883 AS tz FROM turned),
 whole AS (SELECT vec_id, r, c, b, g, q, val, CASE WHEN val > 0 THEN round_even(255 * d / val, 0) ELSE 0 END AS sat, CAST(round_even((CASE WHEN turn < 0 THEN turn + 360 ELSE turn END) / 2, 0) AS BIGINT) % 180 AS hue,
   116 * {_ROOT('ty')} - 16 AS l0, 500 * ({_ROOT('tx')} - {_ROOT('ty')}) AS l1, 200 * ({_ROOT('ty')} - {_ROOT('tz')}) AS l2 FROM angled),
 pix AS (SELECT w.*, r * 8 + dy AS y, c * 8 + dx AS x FROM whole w, (SELECT unnest(range(8)) AS dy) a, (SELECT unnest(range(8)) AS dx) e)"""


def _binned(source: str, keys: str, bins: int) -> str:
    """keys, bin and n of a relation (keys, v): equal bins between the extremes, the last closed, the middle one for flat values."""
    bin_ = f"CASE WHEN hi > lo THEN least(CAST(floor((v - lo) * {bins} / (hi - lo)) AS INT), {bins - 1}) ELSE {bins // 2} END"
    return f"(SELECT {keys}, {bin_} AS bin, CAST(count(*) AS DOUBLE) AS n FROM (SELECT *, min(v) OVER (PARTITION BY {keys}) AS lo, max(v) OVER (PARTITION BY {keys}) AS hi FROM {source}) GROUP BY ALL)"


_HUES = _binned("(SELECT vec_id, CAST(hue AS DOUBLE) AS v FROM pix)", "vec_id", 256)
_PLANES = "(SELECT vec_id, unnest([0, 1, 2]) AS ch, unnest([l0, l1, l2]) AS v FROM pix)"
_LEVELS = "(SELECT vec_id, lvl, ch, CAST(floor(y / (64 // lvl)) AS INT) AS i, CAST(floor(x / (64 // lvl)) AS INT) AS j, v FROM (SELECT *, unnest([0, 1, 2]) AS ch, unnest([l0, l1, l2]) AS v FROM (SELECT *, unnest([1, 2, 3, 4]) AS lvl FROM pix)) WHERE y < (64 // lvl) * lvl AND x < (64 // lvl) * lvl)"
_out = lambda inner, digits=6: f"{_PIXELS} SELECT vec_id AS sample_id, CAST(i AS INT) AS i, round(x, {digits}) AS x FROM ({inner}) WHERE x <> 0"
ORACLES = {
    "feature_hist_grayscale": _out("SELECT vec_id, v - 1 AS i, n / max(n) OVER (PARTITION BY vec_id) AS x FROM (SELECT vec_id, CAST(floor((b + g + q) / 3) AS INT) AS v, CAST(count(*) AS DOUBLE) AS n FROM pix GROUP BY ALL) QUALIFY v > 0"),
    "feature_hist_rgb_concat": _out("SELECT vec_id, ch * 255 + v - 1 AS i, n / (sum(n) OVER (PARTITION BY vec_id) + 765e-8) AS x FROM (SELECT vec_id, ch, v, CAST(count(*) AS DOUBLE) AS n FROM (SELECT vec_id, unnest([0, 1, 2]) AS ch, unnest([b, g, q]) AS v FROM pix) WHERE v > 0 GROUP BY ALL)"),
    "feature_hist_moments": _out(f"""SELECT vec_id, (ch // 2) * 6 + ch % 2 + unnest([0, 2, 4]) AS i, unnest([m, sqrt(v2), v3 / pow(v2, 1.5)]) AS x FROM (SELECT vec_id, ch, CAST(1 AS DOUBLE) / 254 AS m, sum(p * p) / 254 - pow(CAST(1 AS DOUBLE) / 254, 2) AS v2, sum(p * p * p) / 254 - 3 * sum(p * p) / 254 / 254 + 2 * pow(CAST(1 AS DOUBLE) / 254, 3) AS v3 FROM (
        SELECT vec_id, ch, n / sum(n) OVER (PARTITION BY vec_id, ch) AS p FROM {_binned("(SELECT vec_id, unnest([0, 1, 2, 3, 4, 5]) AS ch, unnest([CAST(hue AS DOUBLE), b, sat, g, val, q]) AS v FROM pix)", "vec_id, ch", 255)} WHERE bin > 0) GROUP BY vec_id, ch)""", 4),
    "feature_hist_thr": _out(f"SELECT vec_id, bin - 1 AS i, n / 4096 AS x FROM {_binned('(SELECT vec_id, val AS v FROM (SELECT *, avg(hue) OVER (PARTITION BY vec_id) + stddev_pop(val) OVER (PARTITION BY vec_id) AS t FROM pix) WHERE hue <= t)', 'vec_id', 255)} WHERE bin > 0"),
    "feature_cum_hist": _out(f"SELECT vec_id, i, coalesce(sum(CASE WHEN i = 0 THEN 0 ELSE n END) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM (SELECT vec_id, i, coalesce(n, 0) AS n FROM (SELECT vec_id, unnest(range(256)) AS i FROM (SELECT DISTINCT vec_id FROM cell)) LEFT JOIN (SELECT vec_id, bin AS i, n FROM {_HUES}) USING (vec_id, i))"),
    "feature_exp_hist": _out(f"SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS x FROM (SELECT vec_id, i, exp(coalesce(n, 0) / max(n) OVER (PARTITION BY vec_id)) AS e FROM (SELECT vec_id, unnest(range(256)) AS i FROM (SELECT DISTINCT vec_id FROM cell)) LEFT JOIN (SELECT vec_id, bin AS i, n FROM {_HUES}) USING (vec_id, i))"),
    "feature_local_histogram": _out(f"SELECT vec_id, (i * 10 + j) * 47 + bin - 1 AS i, n / 36 AS x FROM {_binned('(SELECT vec_id, y // 6 AS i, x // 6 AS j, l0 AS v FROM pix WHERE y < 60 AND x < 60)', 'vec_id, i, j', 48)} WHERE bin > 0"),
    "feature_weighted_local_histogram": _out("SELECT vec_id, least(CAST(floor(v * 255 / most) AS INT), 254) AS i, CAST(count(*) AS DOUBLE) AS x FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS most FROM (SELECT vec_id, unnest([share, sat, val]) AS v FROM (SELECT *, count(*) OVER (PARTITION BY vec_id, hue) / CAST(4096 AS DOUBLE) AS share FROM pix))) GROUP BY ALL"),
    "feature_pyramid_local_histogram": _out(f"SELECT vec_id, 120 * (lvl - 1) * lvl * (2 * lvl - 1) // 6 + ch * lvl * lvl * 40 + (i * lvl + j) * 40 + bin AS i, n / sum(n) OVER (PARTITION BY vec_id, lvl, ch, i, j) AS x FROM {_binned(_LEVELS, 'vec_id, lvl, ch, i, j', 40)}"),
    "feature_histogram_lab": _out(f"SELECT vec_id, ch * 48 + bin AS i, n / 4096 AS x FROM {_binned(_PLANES, 'vec_id, ch', 48)}"),
    "feature_3d_histogram": _out("SELECT vec_id, (b0 * 9 + b1 * 3 + b2) AS i, CAST(count(*) AS DOUBLE) AS x FROM (SELECT vec_id, " + ", ".join(f"least(CAST(floor((l{c} - min(l{c}) OVER w) * 3 / (max(l{c}) OVER w - min(l{c}) OVER w)) AS INT), 2) AS b{c}" for c in range(3)) + " FROM pix WINDOW w AS (PARTITION BY vec_id)) GROUP BY ALL"),
}
