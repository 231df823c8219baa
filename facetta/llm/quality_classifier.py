"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text becomes log counts of hashed byte pairs, weighted by inverse document frequency and scaled to unit
length, with a few shape features (how often a word repeats the one before it, how many words differ). A
truncated SVD of a bounded labelled sample gives the latent space. The labelled vectors are broadcast (at
most ``neighbours_from`` x ``rank`` floats) and every document is scored against all of them by exact
blocked cosine products; its ``k`` nearest vote with their similarity as weight.

The settings were chosen by cross-validation (``cross_validated``) on the labelled rows that may be learned from:
their remainders 1 to 4 are the folds, held-out rows take no part.

Defined cases: a null or empty text, or one without words, has no vector and gets the share of label 1 in the
sample. Very long texts are counted whole, in memory of their own size. Without a usable label the score is 1.
Labels that are null or repeated with conflicts count once, by the largest value. Similarities count in steps of
1e-6, so the order of a block's products does not matter; ties at rank k go to the earlier sample row, and rows of
the sample are in the order of a hash of their id, then of their text's. Repeated rows are scored alike, an empty
table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetta.llm.common import SLICE, by_batch, row_hash, utf8

PAIRS = 1008
RATIO_STEPS = np.array([0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 1.01])
SHAPE = 2 * (len(RATIO_STEPS) + 1)
WIDTH = PAIRS + SHAPE

#: Steps of similarity in 1.
STEPS = 1_000_000

_HIGH, _LOW = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
#: Slot of each byte pair: a multiplicative hash.
SLOTS = ((((_HIGH * 256 + _LOW).astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(PAIRS)).astype(np.int32).ravel()


@dataclass(frozen=True)
class Settings:
    #: Bound of the labelled sample that is fitted and broadcast.
    neighbours_from: int = 4096
    rank: int = 32
    k: int = 4
    threshold: float = 0.3
    #: Weight of the shape features against the unit length of the byte pairs.
    shape: float = 0.35
    #: Power of a similarity that is its neighbour's weight.
    power: int = 4
    #: Documents of a cosine block.
    block: int = 1024


def raw_counts(data: bytes) -> np.ndarray:
    """Counts of byte pairs, then the shape features as one-hot steps; all zero for a text without words."""
    out = np.zeros(WIDTH, np.float32)
    words = data.split()
    if not words:
        return out
    a = np.frombuffer(data, np.uint8).astype(np.int32)
    if len(a) > 1:
        out[:PAIRS] = np.bincount(SLOTS[(a[:-1] << 8) | a[1:]], minlength=PAIRS)
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    again = np.count_nonzero(hashes[1:] == hashes[:-1]) / len(words)
    steps = len(RATIO_STEPS) + 1
    out[PAIRS + int(np.searchsorted(RATIO_STEPS, again, side="right"))] = 1
    out[PAIRS + steps + int(np.searchsorted(RATIO_STEPS, len(set(words)) / len(words), side="right"))] = 1
    return out


def weighted(counts: np.ndarray, idf: np.ndarray, shape: float) -> np.ndarray:
    x = np.log1p(counts[:, :PAIRS]) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.hstack([x, counts[:, PAIRS:] * shape]).astype(np.float32)


@dataclass(frozen=True)
class NeighbourModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    settings: Settings

    def embed(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf, self.settings.shape).astype(float) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        n, k = len(self.labels), min(self.settings.k, len(self.labels))
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if not n:
            return out
        for i in range(0, len(some), self.settings.block):
            at = some[i : i + self.settings.block]
            sims = np.rint(self.embed(counts[at]) @ self.vectors.T * STEPS).astype(np.int64)
            order = sims * n + np.arange(n - 1, -1, -1)  # a total order: similarity, then the earlier row
            best = np.sort(np.partition(order, n - k, axis=1)[:, n - k :], axis=1)[:, ::-1]
            near = (np.maximum(best // n, 0) / STEPS) ** self.settings.power
            labels = self.labels[n - 1 - best % n]
            total = near.sum(axis=1)
            votes = (near * labels).sum(axis=1)
            out[at] = np.where(total > 0, votes / np.maximum(total, 1e-30), self.prior)
        return np.clip(out, 0, 1)


def fit_counts(counts: np.ndarray, labels: np.ndarray, settings: Settings) -> NeighbourModel:
    use = counts.any(axis=1) if len(counts) else np.zeros(0, bool)
    counts, labels = counts[use], labels[use].astype(float)
    prior = float(labels.mean()) if len(labels) else 1.0
    df = (counts[:, :PAIRS] > 0).sum(axis=0) if len(counts) else np.zeros(PAIRS)
    idf = np.log((1 + len(counts)) / (1 + df)).astype(np.float32) + 1
    if not len(counts):
        return NeighbourModel(idf, np.zeros((WIDTH, 1)), np.zeros((0, 1)), labels, prior, settings)
    x = weighted(counts, idf, settings.shape).astype(np.float64)
    values, vectors = np.linalg.eigh(x.T @ x)
    keep = np.argsort(-values)[: min(settings.rank, len(x))]
    model = NeighbourModel(idf, vectors[:, keep], np.zeros((0, 1)), labels, prior, settings)
    return NeighbourModel(idf, model.axes, model.embed(counts), labels, prior, settings)


def held_out(doc_id) -> F.Column:
    """True for the rows whose labels no model may see."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample_counts(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, quality, doc_id) of the first ``neighbours_from`` labelled rows in the order of a hash of their id."""
    named = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    known = named.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.withColumn("__order", F.xxhash64("doc_id")).orderBy("__order", "doc_id").limit(settings.neighbours_from)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("__order", row_hash(F.col("text")).alias("h"), F.col("doc_id").cast("long"), "__quality", "text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [raw_counts(x or b"").tobytes() for x in utf8(batch.column(4))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).cast(pa.int32()), pa.array(counts, pa.binary())], names=["o", "h", "doc_id", "quality", "counts"])

    found = by_batch(rows, one, "o long, h long, doc_id long, quality int, counts binary").orderBy("o", "doc_id", "h").limit(settings.neighbours_from).toArrow()
    counts = np.frombuffer(b"".join(found["counts"].to_pylist()), np.float32).reshape(-1, WIDTH)
    return counts, found["quality"].to_numpy(), found["doc_id"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> NeighbourModel:
    """The model of the labelled sample."""
    counts, quality, _ = sample_counts(docs, labels, settings)
    return fit_counts(counts, quality, settings)


def cross_validated(docs: DataFrame, labels: DataFrame, choices: list[Settings]) -> list[tuple[Settings, float, float]]:
    """(settings, area under the curve, balanced accuracy at the threshold) over the folds 1 to 4 of the rows that may be learned from."""
    out, samples = [], {}
    for choice in choices:
        if choice.neighbours_from not in samples:
            samples[choice.neighbours_from] = sample_counts(docs, labels, choice)
        counts, quality, ids = samples[choice.neighbours_from]
        fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
        score = np.zeros(len(ids))
        for f in range(1, 5):
            score[fold == f] = fit_counts(counts[fold != f], quality[fold != f], choice).score(counts[fold == f])
        good, bad = score[quality == 1], np.sort(score[quality != 1])
        below = (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")) / 2
        out.append((choice, float(below.mean() / len(bad)), float(((good >= choice.threshold).mean() + (bad < choice.threshold).mean()) / 2)))
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), model: NeighbourModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and row_hash of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, settings))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts, scores = utf8(batch.column(3)), []
        for i in range(0, len(texts), m.settings.block):
            scores.append(m.score(np.stack([raw_counts(x or b"") for x in texts[i : i + m.settings.block]])))
        score = np.concatenate(scores)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= m.settings.threshold).astype(np.int32)), batch.column(2)],
            names=["doc_id", "held_out", "score", "predicted", "row_hash"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), row_hash(F.col("text")).alias("row_hash"), "text")
    return by_batch(rows, one, "doc_id long, held_out boolean, score double, predicted int, row_hash long")


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                piece = batch.slice(i, SLICE)
                score = m.score(np.stack([raw_counts(x or b"") for x in utf8(piece.column(at))]))
                yield piece.filter(pa.array(score >= m.settings.threshold))

    return docs.mapInArrow(run, docs.schema)
