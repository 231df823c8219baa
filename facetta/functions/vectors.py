"""Vector distances and similarities as column builders; operands become doubles first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def _fold(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), each), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def chi2(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y) / (x + y + F.lit(1e-8)))


def hellinger(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.sqrt(x * y))


def intersection(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.least(x, y))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


DISTANCES = {"cosine": cosine, "l1": l1, "euclidean": euclidean, "chi2": chi2, "hamming": hamming}
