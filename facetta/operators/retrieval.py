"""Exact nearest neighbours, ratio matching, rank fusion and open-set rejection.

A stated set of queries meets the whole gallery in blocks: the queries are shared (a bounded block at a time), each
batch of the gallery is scored by matrix products and keeps its own best candidates, and a window over the few
candidates of a query gives the ranks. Neither side is ever joined with itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries shared at once; more are scored block after block.
QUERY_BLOCK = 8192


def _matrix(column: pa.Array, kind: str = "") -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    if kind == "hamming":  # words of 64 bits become bits
        flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.int64)
        return np.unpackbits(flat.view(np.uint8).reshape(len(column), -1), axis=1).astype(np.float32)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _distances(q: np.ndarray, g: np.ndarray, kind: str) -> np.ndarray:
    if kind == "l1":
        out = np.empty((len(q), len(g)))
        for i in range(len(q)):
            np.abs(g - q[i]).sum(axis=1, out=out[i])
        return out
    if kind == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(g, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (q @ g.T) / norms
    square = (q * q).sum(axis=1)[:, None] + (g * g).sum(axis=1)[None, :] - 2 * (q @ g.T)
    if kind == "hamming":
        return square
    near = square < 1e-6  # cancellation: recompute what is close
    for i, j in zip(*np.nonzero(near)):
        square[i, j] = ((q[i] - g[j]) ** 2).sum()
    return np.sqrt(np.maximum(square, 0))


def _blocks(queries: DataFrame, query_id: str, vector: str):
    rows = queries.select(query_id, vector).where(F.col(vector).isNotNull())
    if rows.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        return [rows]
    n = -(-rows.count() // QUERY_BLOCK)
    return [rows.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == i) for i in range(n)]


def _scored(queries: DataFrame, gallery: DataFrame, kind: str, keep, query_id: str, db_id: str, vector: str, extra: str | None = None) -> DataFrame:
    """query_id, db_id, dist and extra of what ``keep`` leaves of each gallery batch."""
    spark = gallery.sparkSession
    parts, names = [], ["query_id", "db_id", "dist", *([extra] if extra else [])]
    kinds = "query_id long, db_id long, dist double" + (f", {extra} {dict(gallery.dtypes)[extra]}" if extra else "")
    for block in _blocks(queries, query_id, vector):
        table = block.toArrow()
        shared = spark.sparkContext.broadcast((table[query_id].to_numpy(), _matrix(table[vector].combine_chunks(), kind)))

        def run(batches, shared=shared):
            ids, q = shared.value
            if not len(ids):
                return
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    piece = batch.slice(i, 4096)
                    db = piece.column(0).to_numpy(zero_copy_only=False)
                    d = np.round(_distances(q, _matrix(piece.column(1), kind), kind).astype(np.float64), 9)
                    a, b = keep(d, ids, db, piece)
                    columns = [pa.array(ids[a]), pa.array(db[b]), pa.array(d[a, b])]
                    if extra:
                        columns.append(piece.column(2).take(pa.array(b)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        parts.append(gallery.where(F.col(vector).isNotNull()).select(db_id, vector, *([extra] if extra else [])).mapInArrow(run, kinds))
    return reduce(DataFrame.unionByName, parts)


def knn(queries: DataFrame, gallery: DataFrame, k: int, kind: str = "cosine", query_id: str = "vec_id", db_id: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """query_id, db_id, rnk (from 1) and dist of the k nearest; ties go to the smaller db_id."""

    def keep(d, ids, db, piece):
        if skip_self:
            d[ids[:, None] == db[None, :]] = np.inf
        n = d.shape[1]
        order = np.lexsort((np.broadcast_to(db, d.shape), d), axis=1)[:, : min(k, n)]
        a = np.repeat(np.arange(len(ids)), order.shape[1])
        b = order.ravel()
        there = np.isfinite(d[a, b])
        return a[there], b[there]

    best = Window.partitionBy("query_id").orderBy("dist", "db_id")
    return _scored(queries, gallery, kind, keep, query_id, db_id, vector).withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= k)


def full_ranking(queries: DataFrame, gallery: DataFrame, kind: str = "cosine", skip_self: bool = True, **names) -> DataFrame:
    """query_id, db_id, dist and rank (from 0) of the whole gallery for each query."""
    ids = {"query_id": "vec_id", "db_id": "vec_id", "vector": "embedding"} | names

    def keep(d, q, db, piece):
        return np.nonzero(q[:, None] != db[None, :]) if skip_self else tuple(x.ravel() for x in np.indices(d.shape))

    scored = _scored(queries, gallery, kind, keep, **ids)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "db_id")) - 1)


def ratio_matches(queries: DataFrame, gallery: DataFrame, image: str, ratio: float, kind: str = "euclidean", vector: str = "embedding", key: str = "vec_id", skip_self: bool = True) -> DataFrame:
    """q_image, db_image and score: the share of a query image's descriptors whose best match beats the second by the ratio.

    A pair with a single descriptor on the gallery's side scores 0.
    """

    def keep(d, ids, db, piece):
        if skip_self:
            d[ids[:, None] == db[None, :]] = np.inf
        images = piece.column(2).to_numpy(zero_copy_only=False)
        rows, columns = [], []
        for name in np.unique(images):
            at = np.flatnonzero(images == name)
            order = at[np.argsort(d[:, at], axis=1, kind="stable")[:, :2]]
            rows.append(np.repeat(np.arange(len(ids)), order.shape[1]))
            columns.append(order.ravel())
        a, b = np.concatenate(rows), np.concatenate(columns)
        there = np.isfinite(d[a, b])
        return a[there], b[there]

    near = _scored(queries, gallery, kind, keep, key, key, vector, image).withColumnRenamed(image, "db_image")
    two = near.groupBy("query_id", "db_image").agg(F.array_sort(F.collect_list("dist")).alias("d"))  # two of each batch
    good = F.when((F.size("d") > 1) & (F.col("d")[0] < F.col("d")[1] * ratio), 1.0).otherwise(0.0)
    of = queries.select(F.col(key).alias("query_id"), F.col(image).alias("q_image"))
    return two.withColumn("good", good).join(of, "query_id").groupBy("q_image", "db_image").agg(F.avg("good").alias("score"))


def all_pairs(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """query_id and db_id of a stated query set (column query_id) against every gallery row (db_id), block by block."""
    same = F.array(F.lit(0.0))
    found = full_ranking(queries.select("query_id").withColumn("v", same), gallery.select("db_id").withColumn("v", same), "l1", False, query_id="query_id", db_id="db_id", vector="v")
    return found.select("query_id", "db_id")


def score_ranks(scores: DataFrame, by: str = "q_image", item: str = "db_image", score: str = "score") -> DataFrame:
    """rank from 0 by falling score; ties go to the smaller item."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.round(score, 9).desc(), item)) - 1)


def borda(rankings: list[tuple[DataFrame, float]], keys: tuple[str, ...] = ("query_id",), item: str = "db_id") -> DataFrame:
    """keys, item, points (weighted sum of ranks, fewer is better) and rnk from 1."""
    each = [r.select(*keys, item, (F.col("rank") * float(w)).alias("points")) for r, w in rankings]
    points = reduce(DataFrame.unionByName, each).groupBy(*keys, item).agg(F.sum("points").alias("points"))
    return points.withColumn("rnk", F.row_number().over(Window.partitionBy(*keys).orderBy("points", item)))


def votes(sources: list[tuple[DataFrame, Column]], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """keys, votes and accepted: a query is in the gallery if half of the sources or more say so."""
    each = [df.groupBy(*keys).agg(F.max(said.cast("int")).alias("vote")) for df, said in sources]
    total = reduce(DataFrame.unionByName, each).groupBy(*keys).agg(F.sum("vote").cast("int").alias("votes"))
    return total.withColumn("accepted", F.col("votes") * 2 >= len(sources))


def reject(predictions: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Predictions of accepted queries; a rejected query has one row with a null db_id."""
    kept = predictions.join(decisions.where("accepted").select(*keys), list(keys), "left_semi").select(*keys, "rnk", "db_id")
    gone = decisions.where("not accepted").select(*keys, F.lit(1).alias("rnk"), F.lit(None).cast("long").alias("db_id"))
    return kept.unionByName(gone)


def intersect_candidates(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first list's items that are in the second too, in the first's order."""
    both = first.join(second.select(*keys, "db_id"), [*keys, "db_id"], "left_semi")
    return both.withColumn("rnk", F.row_number().over(Window.partitionBy(*keys).orderBy("rnk")))


def reciprocal_rank(predictions: DataFrame, relevant: DataFrame, cuts: tuple[int, ...], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """k and mean reciprocal rank of the first relevant item; a query without a hit counts 0."""
    queries = relevant.select(*keys).distinct()
    first = predictions.join(relevant, [*keys, "db_id"], "left_semi").groupBy(*keys).agg(F.min("rnk").alias("first"))
    each = queries.join(first, list(keys), "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in cuts])))
    return each.groupBy("k").agg(F.avg(F.when(F.col("first") <= F.col("k"), F.lit(1.0) / F.col("first")).otherwise(0.0)).alias("map"))
