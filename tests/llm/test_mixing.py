import collections
import re

import pytest

from facetta.llm import mixing
from tests.llm.conftest import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Pour the budget by weight, cap, pour the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), [s for s in order]
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s] - 1e-9:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


def check(docs, near=0.03):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    targets = plain_targets(dict(sizes))
    got = mixing.mixed_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.size, r.source) for r in got) == collections.Counter((r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-6, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= near * t + 130, (s, taken[s], t)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs).collect()))
    return got


def test_targets_and_words(spark, edge_docs):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.01)
    check(edge_docs)


def test_hot_source_and_many_small(spark):
    rows = [(i, " ".join(["w"] * (i % 90)), "big" if i % 3 == 0 else f"s{i % 40}") for i in range(2000)]
    check(docs_of(spark, rows))


def test_empty(spark, no_docs):
    assert mixing.mixed_documents(no_docs).collect() == []
    assert mixing.mixed_texts(no_docs).collect() == []
    got = mixing.mixed_documents(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_schedule_spreads_sources(spark):
    docs = docs_of(spark, [(i, " ".join(["w"] * 64), f"s{i % 4}") for i in range(800)])
    sizes = mixing.document_sizes(docs)
    _, _, slots = mixing.schedule(sizes)
    order = [r.pos for r in slots.orderBy("slot").collect()]
    share = collections.Counter(order)
    for pos, n in share.items():
        for upto in range(50, len(order), 50):
            assert abs(order[:upto].count(pos) - n * upto / len(order)) <= 6
    ranks = collections.defaultdict(list)
    for r in slots.orderBy("slot").collect():
        ranks[r.pos].append(r.rank)
    assert all(v == list(range(len(v))) for v in ranks.values())


def test_every_source_gets_its_slots(spark):
    """Three million slots, 30,000 sources of one block: the points miss many of these, and meet others twice."""
    sizes = spark.range(0, 30_000).selectExpr("id as doc_id", "concat('s', id) as source", "id as h", "64L as size")
    sizes = sizes.unionByName(spark.range(1).selectExpr("-1L as doc_id", "'a' as source", "0L as h", "192000000L as size"))
    sources, _, slots = mixing.schedule(sizes, weights=(1.0,), share=1.0, most=1.0)
    got = slots.groupBy("pos").agg({"rank": "max", "slot": "count"}).toDF("pos", "last", "n")
    wrong = sources.filter("n_slots > 0").join(got, "pos", "left").filter("n is null or n <> n_slots or last <> n_slots - 1")
    assert sources.agg({"n_slots": "sum"}).first()[0] == 3_030_000 and wrong.isEmpty()
    assert slots.select("slot").distinct().count() == 3_030_000


def test_every_block_is_visited_once_a_pass(spark):
    turns = spark.range(0, 1000).selectExpr("id as block", "1000L as n_blocks").select(mixing.block_turn(7).alias("t")).collect()
    assert sorted(r.t for r in turns) == list(range(1000))


def test_mixed_texts_hold_what_is_taken(spark, edge_docs):
    for docs in (edge_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        taken, texts = collections.Counter(), {}
        for r in mixing.mixed_documents(docs).collect():
            taken[r.doc_id] += r.taken
        for r in docs.collect():
            texts[r.doc_id] = r.text
        mixed = mixing.mixed_texts(docs)
        assert mixed.columns == docs.columns
        got = collections.Counter()
        for r in mixed.collect():
            ws = WORD.findall(r.text)
            got[r.doc_id] += len(ws)
            assert r.text == texts[r.doc_id] or set(ws) <= set(WORD.findall(texts[r.doc_id]))
            assert r.n_chars == len(r.text)
        assert got == +taken


def test_repeated_rows_have_copies_of_their_own(spark):
    """A third of the table is one row; rows of one id and text with other columns keep their own."""
    hot = [(7, "the same seven words in every row", "a")] * 200
    rest = [(i, f"document {i} of some words " * 3, "b") for i in range(100, 400)]
    twins = [(8, "one text in two sources", "a"), (8, "one text in two sources", "b")]
    docs = docs_of(spark, hot + rest + twins)
    texts = {7: hot[0][1], 8: twins[0][1]} | {i: t for i, t, _ in rest}
    taken = collections.Counter()
    for r in mixing.mixed_texts(docs).collect():
        words = WORD.findall(r.text)
        assert r.text == texts[r.doc_id] or len(words) < len(WORD.findall(texts[r.doc_id]))
        taken[r.doc_id, r.source] += len(words)
    for (i, source), n in taken.items():
        rows = sum(d == i and s == source for d, _, s in hot + rest + twins)
        assert n <= 2 * rows * len(WORD.findall(texts[i]))
    sizes = collections.Counter()
    for i, t, s in hot + rest + twins:
        sizes[s] += len(WORD.findall(t))
    for s, target in plain_targets(dict(sizes)).items():
        assert abs(sum(n for (_, source), n in taken.items() if source == s) - target) <= 130


def test_no_python_on_the_main_path(spark, sf):
    plan = mixing.mixed_documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
