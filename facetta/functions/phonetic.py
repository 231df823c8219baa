"""Editex, the phonetic edit distance, as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

# Fixed values of the published algorithm: letters that sound alike, and the silent letters.
GROUPS = ("AEIOUY", "BP", "CKQ", "DT", "LR", "MN", "GJ", "FPV", "SXZ", "CSZ")
SILENT = "HW"


def _codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a padded, upper-cased text, a bit set of the groups of each, and whether each is silent."""
    chars = " " + text.upper()
    bits = [sum(1 << i for i, g in enumerate(GROUPS) if c in g) for c in chars]
    return np.fromiter(map(ord, chars), np.int64), np.array(bits), np.array([c in SILENT for c in chars])


def _step(code: np.ndarray, bits: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Cost of going from each character to the next: 0 equal, 1 alike or from a silent letter, else 2."""
    alike = ((bits[:-1] & bits[1:]) > 0) | silent[:-1]
    return np.where(code[:-1] == code[1:], 0, np.where(alike, 1, 2))


def editex(a: str, b: str) -> int:
    """Rows of the table at once: a row's left-to-right minimum is a running minimum after taking off the insertions."""
    if a == b:
        return 0
    (ca, ba, sa), (cb, bb, sb) = _codes(a), _codes(b)
    down, along = _step(ca, ba, sa), np.concatenate([[0], np.cumsum(_step(cb, bb, sb))])
    row = along.copy()
    for i in range(1, len(ca)):
        swap = np.where(cb[1:] == ca[i], 0, np.where((bb[1:] & ba[i]) > 0, 1, 2))
        best = row + down[i - 1]
        best[1:] = np.minimum(best[1:], row[:-1] + swap)
        row = np.minimum.accumulate(best - along) + along
    return int(row[-1])


def editex_many(pairs: list[tuple[str, str]], most: int = 1 << 14) -> list[int]:
    """Distances of many pairs: pairs of like length fill one table, up to ``most`` cells of its rows at once (they stay in the cache)."""
    out = [0] * len(pairs)
    todo = sorted((i for i, (a, b) in enumerate(pairs) if a != b), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and end - at < 256 and (end - at + 1) * (len(pairs[todo[end]][1]) + 2) <= most:
            end += 1
        some, at = todo[at:end], end
        sides = [[_codes(pairs[i][k]) for i in some] for k in (0, 1)]
        n, m = (max(len(x[0]) for x in side) for side in sides)
        pad = lambda rows, k, width: np.stack([np.pad(r[k], (0, width - len(r[k]))) for r in rows]).astype(np.int32 if k < 2 else bool)
        (ca, ba, sa), (cb, bb, sb) = ([pad(side, k, width) for k in range(3)] for side, width in zip(sides, (n, m)))
        step = lambda c, b, s: np.where(c[:, :-1] == c[:, 1:], 0, np.where(((b[:, :-1] & b[:, 1:]) > 0) | s[:, :-1], 1, 2)).astype(np.int32)
        down = step(ca, ba, sa)
        along = np.pad(np.cumsum(step(cb, bb, sb), axis=1, dtype=np.int32), ((0, 0), (1, 0)))
        ends = np.array([[len(side[j][0]) - 1 for side in sides] for j in range(len(some))])
        row, found = along.copy(), np.zeros(len(some), np.int64)
        for i in range(n):
            if i:
                swap = (cb[:, 1:] != ca[:, i : i + 1]) * (np.int32(2) - ((bb[:, 1:] & ba[:, i : i + 1]) > 0))
                best = row + down[:, i - 1 : i]
                best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + swap)
                row = np.minimum.accumulate(best - along, axis=1) + along
            done = np.flatnonzero(ends[:, 0] == i)
            found[done] = row[done, ends[done, 1]]
        for i, d in zip(some, found.tolist()):
            out[i] = d
    return out


@pandas_udf(LongType())
def editex_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either side is null."""
    some = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    found = dict(zip(some, editex_many([(a.iloc[i], b.iloc[i]) for i in some])))
    return pd.Series([found.get(i) for i in range(len(a))], dtype="Int64")
