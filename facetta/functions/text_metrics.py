"""Distances of two texts or token lists on Python values, for functions that meet a few texts at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np

from facetta.functions.phonetic import editex


def levenshtein(a: str, b: str) -> int:
    """Edits of characters; a row of the table at once, as a running minimum after taking off the insertions."""
    if a == b or not a or not b:
        return 0 if a == b else max(len(a), len(b))
    x, y = (np.fromiter(map(ord, s), np.int64, len(s)) for s in (a, b))
    along = np.arange(len(y) + 1)
    row = along.copy()
    for c in x:
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (y != c))
        row = np.minimum.accumulate(best - along) + along
    return int(row[-1])


def jaccard(a: list, b: list) -> float:
    """Common tokens over all tokens, with their counts; 1 for two empty lists."""
    x, y = Counter(a), Counter(b)
    every = (x | y).total()
    return (x & y).total() / every if every else 1.0


def bag(a: list, b: list) -> int:
    """The larger number of tokens that one has and the other lacks."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


#: Metrics of texts and of token lists, by name.
OF_TEXTS: dict[str, Callable] = {"text_levenshtein": levenshtein, "text_editex": editex}
OF_TOKENS: dict[str, Callable] = {"text_jaccard": jaccard, "text_token_bag_dist": bag}


def worst(predictions: list, truth: list[list], distance: Callable) -> float | None:
    """Sum over predictions of the largest value against any field of any line, over the smaller number of predictions and lines; null where one is empty."""
    n = min(len(truth), len(predictions))
    return sum(max((distance(p, field) for line in truth for field in line), default=0) for p in predictions) / n if n else None
