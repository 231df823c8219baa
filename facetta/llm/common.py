"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator that counts words by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names; a private one only in a session of one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="facetta-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/facetta/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage with a written table: a lost executor costs only a re-read."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


#: Rows that an operator turns into Python objects at once; Arrow batches are much larger.
SLICE = 512


def by_batch(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE) -> DataFrame:
    """mapInArrow with a function of a slice of a batch; a task holds one batch and the objects of one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield one(batch.slice(i, rows))

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def lower_ascii(col: Column) -> Column:
    """A-Z alone in lower case; every other letter stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(text: Column) -> Column:
    """Tells apart rows that share an id; null texts have a hash of their own."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


#: Keys of (doc_id, row hash) that may be broadcast, some 50 MB; beyond, both sides are shuffled.
MOST_KEYS = 500_000


def sized(df: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """Broadcast only what a count has shown to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
