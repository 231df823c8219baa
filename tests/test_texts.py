"""Tokenizer and phonetic distance against plain Python."""

import re
from collections import Counter
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetta.functions.phonetic import GROUPS, SILENT, editex
from facetta.operators import tokenizers as T
from facetta.plans import catalog

TEXTS = ["the cat sat on the mat", "a cathedral, a cat!", "", None, "the the the", "niño + gato", "unseenword xyzzy", "(.*) [a-z]\\d"]


def split(text):
    return re.findall(r"\w+|[^\w\s]+", (text or "").lower())


def greedy(word, model):
    out, i = [], 0
    while i < len(word):
        n = next((n for n in range(model.ngram_max, 0, -1) if word[i : i + n] in model.piece_ids and i + n <= len(word)), 0)
        out.append(model.piece_ids[word[i : i + n]] if n else model.word_ids[T.UNK])
        i += n or 1
    return [model.piece_ids[T.SOW], *out, model.piece_ids[T.EOW]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_vocabularies(docs):
    model = T.fit(docs, model=T.Subwords(size=20, bpe_share=0.7))
    counts = Counter(w for t in TEXTS for w in split(t))
    words = [T.PAD, T.UNK, *sorted(counts, key=lambda w: (-counts[w], w))][: model.word_budget]
    assert list(model.words) == words
    grams = Counter()
    for w, k in counts.items():
        if w not in words:
            for n in range(1, min(8, len(w), max(1, 2 * len(w) - 1)) + 1):
                for i in range(len(w) - n + 1):
                    grams[w[i : i + n]] += k
    assert list(model.pieces) == [T.SOW, T.EOW, *sorted(grams, key=lambda g: (-grams[g], g))][: 20 - model.word_budget]


def test_encoding_and_back(spark, docs, tmp_path):
    model = T.fit(docs, model=T.Subwords(size=60, bpe_share=0.8))
    got = {r.doc_id: (r.ids, r.back) for r in docs.select("doc_id", T.encode(F.col("text"), model).alias("ids")).select("doc_id", "ids", T.decode(F.col("ids"), model).alias("back")).collect()}
    for i, text in enumerate(TEXTS):
        want = [x for w in split(text) for x in ([model.word_ids[w]] if w in model.word_ids else greedy(w, model))]
        assert got[i][0] == want
        if model.word_ids[T.UNK] not in want:
            assert got[i][1] == " ".join(split(text))
    T.save(spark, model, str(tmp_path / "model"))
    assert T.load(spark, str(tmp_path / "model")) == model


def test_fixed_length_and_reverse(docs):
    model = T.fit(docs, model=T.Subwords(size=60, bpe_share=0.5, fixed_length=6))
    plain = T.Subwords(**{**model.__dict__, "fixed_length": None})
    for r in docs.select(T.encode(F.col("text"), model).alias("a"), T.encode(F.col("text"), model, True).alias("b"), T.encode(F.col("text"), plain).alias("c")).collect():
        assert r.a == (r.c + [model.word_ids[T.PAD]] * 6)[:6] and r.b == r.a[::-1]


def test_malformed_ids_decode_to_null(spark, docs):
    model = T.fit(docs)
    s, e = model.piece_ids[T.SOW], model.piece_ids[T.EOW]
    rows = spark.createDataFrame([([s],), ([e],), ([s, s, e],), ([9999],), ([s, e],), ([],)], "ids array<int>")
    assert [r.x for r in rows.select(T.decode(F.col("ids"), model).alias("x")).collect()] == [None, None, None, None, "", ""]


def slow(a, b):
    a, b = " " + a.upper(), " " + b.upper()
    swap = lambda x, y: 0 if x == y else 1 if any(x in g and y in g for g in GROUPS) else 2
    step = lambda x, y: 1 if x != y and x in SILENT else swap(x, y)
    down, along = [0], [0]
    for seq, out in ((a, down), (b, along)):
        for x, y in pairwise(seq):
            out.append(out[-1] + step(x, y))
    table = [along] + [[down[i]] + [0] * (len(b) - 1) for i in range(1, len(a))]
    for i in range(1, len(a)):
        for j in range(1, len(b)):
            table[i][j] = min(table[i - 1][j] + step(a[i - 1], a[i]), table[i][j - 1] + step(b[j - 1], b[j]), table[i - 1][j - 1] + swap(a[i], b[j]))
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcdhwkst zé", max_size=12), st.text("abcdhwkst zé", max_size=12))
def test_editex(a, b):
    assert editex(a, b) == slow(a, b)


def test_editex_by_hand():
    assert (editex("", ""), editex("nelson", "neilsen"), editex("cat", "hat"), editex("niall", "neil")) == (0, 2, 2, 2)


@pytest.mark.parametrize("name", ["bpe_vocab", "bpe_encode", "bpe_roundtrip", "editex_pairs"])
def test_queries_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
