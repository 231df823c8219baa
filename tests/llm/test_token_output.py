import collections
import heapq
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from facetta.llm import token_output as T
from tests.llm.conftest import docs_of

_TOKENIZER = []


def tokenizer():
    from tokenizers import Tokenizer

    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(T.default_tokenizer()))
    return _TOKENIZER[0]


def plain(rows):
    out, start = [], 0
    for d, text in rows:
        ids = [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_matches_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r) for r in T.token_records(docs).collect()) == plain(rows)


def test_edges(spark, edge_docs, no_docs):
    got = sorted((tuple(r) for r in T.token_records(edge_docs).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = collections.Counter((d, n, c) for d, _, n, c in plain(rows))
    assert collections.Counter((d, n, c) for d, _, n, c in got) == want
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert T.token_records(no_docs).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.lists(st.sampled_from(["don't", "<|endoftext|>", "\u0301x", "A\u030A", "J\u030C", "T\u0308x", "<|ENDOFTEXT|>", "\u212A", "I\u0307", "\x1c", "\x85", "\u2028", " ", "\n", "İ", "ΑΣ", "'s", "99", "—", "Ünï", "Thntble,|", "ÈAUX.", "straße!", "x×y", "a.b", "don.'t", "#", "ab#$c"]), max_size=12).map("".join))
def test_pieces_give_the_ids_of_the_whole_text(text):
    ids = T.encoder(T.default_tokenizer()).encode(text.encode(), b"")
    assert np.frombuffer(ids, "<u2").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_small_memory_gives_the_same_ids():
    small = T.PieceEncoder(T.default_tokenizer(), most=5, at_once=20)
    for text in ("one two three four five six seven", "one two", "eight nine ten eleven one two three longerwords", "") * 2:
        assert np.frombuffer(small.encode(text.encode(), b""), "<u2").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.integers(6, 20))
def test_lengths_are_optimal_and_limited(counts, limit):
    counts = np.array(counts)
    lengths = T.code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[~used] == 0).all() and (lengths[used] > 0).all() and lengths.max(initial=0) <= limit
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
        heap, cost = sorted(counts[used].tolist()), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        mine = int((counts * lengths).sum())
        assert mine >= cost and (limit < 20 or mine == cost)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=700), min_size=1, max_size=4), st.integers(9, 18))
def test_pack_unpack(blocks, limit):
    counts = np.bincount(np.concatenate([np.array(b) for b in blocks]), minlength=301)
    code = T.Code.of(T.code_lengths(counts, limit))
    packed = [T.pack(np.array(b), code, 16) for b in blocks]
    got = T.unpack([p for p, _ in packed], [m for _, m in packed], [len(b) for b in blocks], code.table(), code.width, 16)
    assert [g.tolist() for g in got] == blocks


def test_blocks_and_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    T.write_tokens(docs, str(tmp_path / "t"), block_tokens=3000)
    blocks = spark.read.parquet(str(tmp_path / "t/blocks"))
    assert blocks.count() > 20 and blocks.select("shard").distinct().count() > 1
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.read_tokens(spark, str(tmp_path / "t"), keep_ids=True).collect()}
    for r in docs.collect():
        assert ids[r.doc_id] == [*tokenizer().encode(r.text, add_special_tokens=False).ids, 2]


def test_readers_take_parameters_from_the_folder(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    T.write_tokens(docs, str(tmp_path / "t"), every=32, end=7, block_tokens=2000)
    facts = spark.read.parquet(str(tmp_path / "t/format")).first()
    assert (facts.every, facts.end_id, facts.id_bytes) == (32, 7, 2)
    for r in T.read_tokens(spark, str(tmp_path / "t"), keep_ids=True).collect():
        assert np.frombuffer(r.ids, "<u4")[-1] == 7 and len(r.ids) == 4 * r.n_tokens


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, plain_ = T.PieceEncoder(path), Tokenizer.from_file(path)
    assert other.whole and not T.encoder(T.default_tokenizer()).whole
    for text in ("Two  spaces\nand Lines", "", "é x"):
        assert np.frombuffer(other.encode(text.encode(), b""), other.kind).tolist() == plain_.encode(text, add_special_tokens=False).ids


def test_a_repeated_row_is_dealt_to_many_shards(spark, tmp_path):
    docs = docs_of(spark, [(1, "the same words again and again " * 20, "s")] * 300 + [(i, f"other text {i}", "s") for i in range(200)])
    T.write_tokens(docs, str(tmp_path / "t"), block_tokens=500)
    blocks = spark.read.parquet(str(tmp_path / "t/blocks"))
    hot = blocks.filter("array_contains(doc_ids, 1L)").select("shard").distinct().count()
    got = sorted((r.start, r.n_tokens) for r in T.read_tokens(spark, str(tmp_path / "t")).collect())
    assert hot > 1 and len(got) == 500 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))
