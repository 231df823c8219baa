"""Quality rules by compression bands.

A document is judged by how far zstandard shrinks it: text that repeats itself shrinks too much, random
text hardly at all. The limits depend on the length, as short texts shrink less. Documents are also judged by
fixed chunks of two sizes, each with limits of its own, so that a repetitive or random part does not hide
behind ordinary text; the last chunk of a size is shifted back to end with the text, so every byte is judged.
A text no longer than the smaller chunk is judged as a whole only.

Defined cases: a null or empty text has no words, so base_failed is true and kept false. Texts below 128
bytes pass the compression test: there clean texts and noise have the same ratios. Very long texts are judged
whole, in memory of some times their size. Repeated rows and ties do not matter: each row is judged alone. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from facetta.llm.common import by_batch, utf8

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks int, n_bad_chunks int"
)


@dataclass(frozen=True)
class Bands:
    """(least bytes, lowest ratio, highest ratio) of whole documents, and limits for chunks of two sizes."""

    #: Limits up to 512 bytes lie between the highest ratio of texts labelled good at sf0.1 and the lowest of base64 in words.
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (128, 0.0, 0.938),
        (192, 0.15, 0.86),
        (256, 0.15, 0.83),
        (384, 0.15, 0.77),
        (512, 0.28, 0.75),
        (1024, 0.32, 0.74),
        (4096, 0.30, 0.70),
        (16384, 0.26, 0.68),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.30, 0.72)
    #: Smaller chunks; chunks of texts labelled good at sf0.1 have 0.52 to 0.717, base64 0.838 at least.
    part_bytes: int = 512
    part: tuple[float, float] = (0.32, 0.78)
    #: Share of the chunks of a size out of their band above which a document goes.
    bad_share: float = 0.25
    level: int = 3
    #: Words of a window of the repetition count, fewest words, highest percentage of repeated words.
    window: int = 5
    least_words: int = 10
    repeat_percent: int = 20


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = np.zeros(n - window + 1, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(window):
        mixed = (mixed ^ hashes[i : n - window + 1 + i]) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    starts = np.flatnonzero(np.isin(mixed, twice))
    # hashes find the windows, their words decide
    found = Counter(tuple(words[i : i + window]) for i in starts.tolist())
    starts = np.array([i for i in starts.tolist() if found[tuple(words[i : i + window])] > 1], np.int64)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(steps[:n])))


def repeated_lines(data: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in data.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def chunks_out_of(data: bytes, size: int, limits: tuple[float, float], compressor: zstandard.ZstdCompressor) -> tuple[int, int]:
    """Chunks of a text longer than one, the last shifted back to end with it, and how many of them are out of limits."""
    if len(data) <= size:
        return 0, 0
    starts = [*range(0, len(data) - size, size), len(data) - size]
    ratios = [len(compressor.compress(data[i : i + size])) / size for i in starts]
    return len(starts), sum(not limits[0] <= r <= limits[1] for r in ratios)


def judged(data: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    words = data.split()  # bytes split at \x20 and \x09-\x0D only
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - int(counts[0x80:0xC0].sum()) - int(counts[_SPACE].sum())
    again = repeated_words(words, bands.window)
    failed = len(words) < bands.least_words or 100 * again > bands.repeat_percent * len(words)
    ratio = len(compressor.compress(data)) / len(data) if data else 0.0
    low, high = next((lo, hi) for least, lo, hi in reversed(bands.whole) if len(data) >= least)
    good, n_chunks, n_bad = low <= ratio <= high, 0, 0
    for size, limits in ((bands.chunk_bytes, bands.chunk), (bands.part_bytes, bands.part)):
        n, bad = chunks_out_of(data, size, limits, compressor)
        good = good and bad <= bands.bad_share * n
        n_chunks, n_bad = n_chunks + n, n_bad + bad
    return len(words), chars, int(counts[_SYMBOLS].sum()), repeated_lines(data), again, failed, good and not failed, ratio, n_chunks, n_bad


def compression_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Counts, the base rule and the verdict of the bands for every document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        rows = [judged(x or b"", bands, compressor) for x in utf8(batch.column(1))]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int32(), pa.int32()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks"]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names]
        )

    return by_batch(docs.select("doc_id", "text"), one, SCHEMA)
