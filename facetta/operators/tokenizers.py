"""Word and subword tokenizer: vocabularies by aggregation, encoding and decoding by Arrow-batched functions.

The two vocabularies are bounded by ``Subwords.size`` and go to the functions with the plan; documents are never
shuffled to be encoded. A task remembers the ids of up to ``REMEMBERED`` distinct words. Ties of a count go to the
smaller token.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of letters, digits and underscores, or a run of other visible characters.
WORDS = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"
#: Words whose ids a task remembers; beyond, it starts afresh.
REMEMBERED = 500_000
UNK, PAD, SOW, EOW = "__unk", "__pad", "__sow", "__eow"


@dataclass(frozen=True)
class Subwords:
    """Parameters: ``bpe_share`` of ``size`` ids goes to pieces of ``ngram_min`` to ``ngram_max`` characters."""

    size: int = 256
    bpe_share: float = 0.2
    ngram_min: int = 2
    ngram_max: int = 8
    required: tuple[str, ...] = ()
    lowercase: bool = True
    fixed_length: int | None = None
    words: tuple[str, ...] = field(default=(), repr=False)
    pieces: tuple[str, ...] = field(default=(), repr=False)

    @property
    def forced(self) -> list[str]:
        return sorted({*self.required, UNK, PAD})

    @property
    def word_budget(self) -> int:
        return max(int(self.size * (1 - self.bpe_share)), len(self.forced))

    @property
    def word_ids(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}

    @property
    def piece_ids(self) -> dict[str, int]:
        """Pieces follow the word budget, even where fewer words were found."""
        return {p: i + self.word_budget for i, p in enumerate(self.pieces)}


def words(text: Column, lowercase: bool = True) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(WORDS), 1), F.array().cast("array<string>"))


def gram_counts(counted: DataFrame, ngram_min: int = 2, ngram_max: int = 8) -> DataFrame:
    """gram and cnt of (word, cnt): single characters, and substrings of ngram_min to min(ngram_max, 2n - 1) characters."""
    n = F.length("word")
    cuts = F.filter(F.sequence(F.lit(1), F.least(n, F.lit(ngram_max))), lambda k: (k == 1) | ((k >= ngram_min) & (k <= 2 * n - 1)))
    sized = counted.where(n > 0).select("word", "cnt", F.explode(cuts).alias("k"))
    grams = sized.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("k") + 1), lambda i: F.col("word").substr(i, F.col("k")))).alias("gram"), "cnt")
    return grams.groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def _top(counted: DataFrame, token: str, forced: list[str], budget: int) -> tuple[str, ...]:
    left = max(budget - len(forced), 0)
    best = counted.where(~F.col(token).isin(forced)).orderBy(F.desc("cnt"), token).limit(left)
    return (*forced, *(r[token] for r in best.collect()))


def fit(docs: DataFrame, text: str = "text", model: Subwords | None = None) -> Subwords:
    """The model with its vocabularies: the most frequent words, then pieces of the words left over."""
    model = model or Subwords()
    counted = docs.select(F.explode(words(F.col(text), model.lowercase)).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).persist()
    try:  # a row for each distinct word, read twice
        known = _top(counted, "word", model.forced, model.word_budget)
        rest = gram_counts(counted.where(~F.col("word").isin(list(known))), model.ngram_min, model.ngram_max)
        pieces = _top(rest, "gram", [SOW, EOW], model.size - model.word_budget)
    finally:
        counted.unpersist()
    return Subwords(**{**asdict(model), "words": known, "pieces": pieces})


def word_encoder(model: Subwords):
    """A function of a word that gives its ids: one of a known word, else its pieces, longest first, between SOW and EOW."""
    at, of = model.word_ids, model.piece_ids
    pieces = sorted((p for p in model.pieces if p not in (SOW, EOW)), key=lambda p: (-len(p), p))
    cut, unknown = re.compile("|".join([*map(re.escape, pieces), "."]), re.S).findall, at[UNK]

    def ids(word: str) -> list[int]:
        return [at[word]] if word in at else [of[SOW], *(of.get(p, unknown) for p in cut(word)), of[EOW]]

    return ids


def encode(text: Column, model: Subwords, reverse: bool = False) -> Column:
    """Ids of a text, each distinct word split once; cut or padded to ``fixed_length``. A null text has none."""
    known: dict[str, list[int]] = {}
    ids_of, length, pad = word_encoder(model), model.fixed_length, model.word_ids[PAD]

    def one(text_words) -> list[int]:
        out: list[int] = []
        for word in text_words:
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = ids_of(word)
            out += found
        if length is not None:
            out = (out + [pad] * length)[:length]
        return out[::-1] if reverse else out

    @F.pandas_udf("array<int>")
    def batch(column: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in column], dtype=object)

    return batch(words(text, model.lowercase))


def decode(ids: Column, model: Subwords) -> Column:
    """Words joined by spaces, pieces joined to words; padding is left out. Null where ids are not well formed.

    Well formed: every SOW is closed by an EOW before the next one, and every id is known.
    """
    size = model.word_budget + len(model.pieces)
    shown, of, unk = np.full(size, None, object), model.piece_ids, model.word_ids[UNK]
    for w, i in model.word_ids.items():
        shown[i] = "" if w == PAD else f" {w}"
    for p, i in of.items():
        shown[i] = " " if p == SOW else "" if p == EOW else p
    valid = np.array([x is not None for x in shown])

    def one(x) -> str | None:
        if x is None:
            return None
        at = np.asarray(x)
        if at.size and (at.dtype.kind not in "iu" or at.min() < 0 or at.max() >= size or not valid[at].all()):
            return None
        inside = np.cumsum((at == of[SOW]).astype(int) - (at == of[EOW]))
        if at.size and (inside.min() < 0 or inside.max() > 1 or inside[-1]):
            return None
        out = shown[at.astype(np.int64)]
        out[(at == unk) & (inside > 0)] = UNK
        return "".join(out).strip(" ")

    @F.pandas_udf("string")
    def batch(column: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in column], dtype=object)

    return batch(ids)


def save(spark, model: Subwords, path: str) -> None:
    """Both vocabularies and the parameters as one Parquet table."""
    params = {k: v for k, v in asdict(model).items() if k not in ("words", "pieces")}
    rows = [("param", i, k, repr(v)) for i, (k, v) in enumerate(params.items())]
    rows += [("word", i, w, None) for w, i in model.word_ids.items()] + [("piece", i, p, None) for p, i in model.piece_ids.items()]
    spark.createDataFrame(rows, "kind string, id int, token string, value string").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Subwords:
    from ast import literal_eval

    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.kind, r.id))
    params = {r.token: literal_eval(r.value) for r in rows if r.kind == "param"}
    return Subwords(**params, words=tuple(r.token for r in rows if r.kind == "word"), pieces=tuple(r.token for r in rows if r.kind == "piece"))
