"""Image, annotation and ground-truth sources, and the sinks of results.

Files are read by Spark's readers, on whatever store holds them. A file's id is the last number of its name, so the
parts of a sample are joined by id and never by position.
"""

from __future__ import annotations

import io
import json
import pickle
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

PREDICTIONS = "query_id long, crop_id int, rnk int, db_id long"


def file_id(path: Column) -> Column:
    """The last run of digits in a file's name; null without one."""
    name = F.regexp_extract(path, r"([^/]*?)(\.[A-Za-z]+)?$", 1)
    return F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), F.lit(-1)).cast("long")


def images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """sample_id, path and image (Spark's image struct) of the files that decode."""
    read = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", pattern).load(path)
    return read.select(file_id(F.col("image.origin")).alias("sample_id"), F.col("image.origin").alias("path"), "image")


def annotations(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """sample_id, line_no and fields of every line of Latin-1 files; ``('A', 'B')`` has fields A and B, others are whole."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    lines = read.select(file_id(F.col("path")).alias("sample_id"), F.posexplode(F.split(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))
    inner = F.regexp_replace(F.expr("substring(line, 3, length(line) - 4)"), "'", "")
    return lines.select("sample_id", "line_no", F.when(F.col("line").startswith("("), F.split(inner, ", ")).otherwise(F.array("line")).alias("fields"))


def samples(images_: DataFrame, **parts: DataFrame) -> DataFrame:
    """Images with their masks, annotations or boxes: left joins on sample_id, a missing part is null."""
    for name, part in parts.items():
        value = next(c for c in part.columns if c not in ("sample_id", "path"))
        images_ = images_.join(part.select("sample_id", F.col(value).alias(name)), "sample_id", "left")
    return images_


class _Plain(pickle.Unpickler):
    """Only lists, numbers and strings: no class is ever loaded."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not plain data")


def plain(data: bytes):
    """JSON, or a pickle that holds plain data."""
    try:
        return json.loads(data)
    except (UnicodeDecodeError, json.JSONDecodeError):
        return _Plain(io.BytesIO(data)).load()


def _one_file(spark: SparkSession, path: str):
    """A ground-truth file: a list with an entry for each query image, read on the driver."""
    return plain(bytes(spark.read.format("binaryFile").load(path).first().content))


def correspondences(spark: SparkSession, path: str) -> DataFrame:
    """query_id, crop_pos and db_id of a list of lists; -1 (not in the database) becomes null."""
    rows = [(q, i, None if d == -1 else int(d)) for q, found in enumerate(_one_file(spark, path)) for i, d in enumerate(found)]
    return spark.createDataFrame(rows, "query_id long, crop_pos int, db_id long")


def text_boxes(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and boxes; boxes of four corner points become their first and third."""
    rows = []
    for i, found in enumerate(_one_file(spark, path)):
        rows.append((i, [list(map(int, b)) if not isinstance(b[0], (list, tuple)) else [int(v) for p in (b[0], b[2]) for v in p] for b in found]))
    return spark.createDataFrame(rows, "sample_id long, boxes array<array<int>>")


# ---- sinks


def predictions(ranked: DataFrame, k: int = 10, first_crop: bool = False) -> DataFrame:
    """query_id and lists: the k best db_ids of each crop in order of rank; a rejected query has [-1]."""
    kept = ranked.where(F.col("rnk") <= k)
    kept = kept.where("crop_id = 0") if first_crop else kept
    crops = kept.groupBy("query_id", "crop_id").agg(F.array_sort(F.collect_list(F.struct("rnk", F.coalesce("db_id", F.lit(-1)).alias("db_id")))).alias("x"))
    return crops.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("crop_id", F.col("x.db_id").alias("ids")))).alias("y")).select("query_id", F.col("y.ids").alias("lists"))


def mask_files(found: DataFrame, mask: str, *more: str) -> DataFrame:
    """sample_id, more, name and content (a PNG of 0 and 255) of masks of 0 and 1."""
    on = found.where(F.col(mask).isNotNull())
    name = F.concat(F.lpad(F.col("sample_id").cast("string"), 5, "0"), *[x for c in more for x in (F.lit("_"), F.col(c).cast("string"))], F.lit(".png"))
    return on.select("sample_id", *more, name.alias("name"), mask_png("height", "width", mask).alias("content"))


@F.pandas_udf(BinaryType())
def mask_png(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([png(np.frombuffer(d, np.uint8).reshape(int(h), int(w)) * np.uint8(255)) for h, w, d in zip(height, width, data)], dtype=object)


def transcriptions(found: DataFrame) -> DataFrame:
    """sample_id and value: a line for each text of a sample, in order."""
    lines = found.where(F.col("texts").isNotNull()).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("crop_pos", "texts"))).alias("x"))
    return lines.select("sample_id", F.array_join(F.flatten("x.texts"), "\n").alias("value"))


def fixed_predictions(lists: DataFrame, k: int = 10) -> DataFrame:
    """query_id and lists of an existing result of any numbers: the first k of each list as whole numbers."""
    return lists.select("query_id", F.transform("lists", lambda x: F.slice(x, 1, k).cast("array<long>")).alias("lists"))


def shown(result: DataFrame, n: int = 20) -> tuple[int, list]:
    """The number of rows of a result and the first of them."""
    return result.count(), result.limit(n).collect()


def report_means(metrics: DataFrame) -> DataFrame:
    """metric and mean, over the samples that have a value."""
    return metrics.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"))


def write_report(metrics: DataFrame, config: dict, path: str) -> None:
    """The configuration and the mean of every metric (metric, value) as JSON."""
    report_means(metrics).withColumn("config", F.lit(json.dumps(config, sort_keys=True))).write.mode("overwrite").json(path)


def png(pixels: np.ndarray) -> bytes:
    """A PNG of gray or blue-green-red bytes."""
    h, w = pixels.shape[:2]
    rows = pixels if pixels.ndim == 2 else pixels[..., ::-1].reshape(h, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.hstack([np.zeros((h, 1), np.uint8), rows.astype(np.uint8)]).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@F.pandas_udf(BinaryType())
def png_of(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """PNG files of images given by their bytes; null for a null image."""
    one = lambda h, w, n, d: None if d is None else png(np.frombuffer(d, np.uint8).reshape((int(h), int(w)) if n == 1 else (int(h), int(w), int(n))))
    return pd.Series([one(*r) for r in zip(height, width, channels, data)], dtype=object)
