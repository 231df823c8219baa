"""The pipeline's stages in sequence, each against its plain version on what its predecessor kept."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from facetta.llm import chat, decontaminate, mixing, queries, quality_classifier
from tests.llm.conftest import COLUMNS, docs_of
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_groups
from tests.llm.test_token_output import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write(spark, folder, docs, labels=(), benchmark=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stages(spark, sf_dir):
    """The rows of documents and after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stage(spark, docs, sf_dir)
    return [*out, docs]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def check(spark, sf_dir):
    docs, good, single, clean, mixed, tokens = stages(spark, sf_dir)
    for kept in (good, single, clean, mixed):
        assert kept.columns == docs.columns
    # classifier: rows below the threshold go
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    score = {(r.doc_id, r.row_hash): r.predicted for r in quality_classifier.quality_scores(docs, labels).collect()}
    rows = docs.selectExpr("doc_id", "text", "case when text is null then 0 else xxhash64(text) end as h").collect()
    assert collections.Counter(pairs(good)) == collections.Counter((r.doc_id, r.text) for r in rows if score[r.doc_id, r.h])
    # near-dedup: one row of each component, with its smallest id
    before, after = pairs(good), pairs(single)
    groups = plain_groups(before)
    named = {d for d, _, c in groups if c is not None}
    assert {c for _, _, c in groups} - {None} == {d for d, _ in after} - {None} and len(after) <= len(before)
    assert not collections.Counter(after) - collections.Counter(before) and {d for d, _ in after} - {None} <= named
    components = collections.Counter(c for _, _, c in plain_groups(after))
    assert all(n == sum(d == c for d, _ in after) for c, n in components.items() if c is not None)
    # decontamination: rows with a window go
    hit = {(r[0], t): r[5] for (d, t) in after for r in plain_contamination([(d, t)], [(r.item_id, r.text) for r in bench.collect()])}
    assert collections.Counter(pairs(clean)) == collections.Counter(p for p in after if not hit[p])
    # mix: every source's words come near its target, only words of the documents
    sizes, taken, texts = collections.Counter(), collections.Counter(), {}
    for r in clean.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
        texts.setdefault(r.doc_id, []).append(r.text)
    out = mixed.collect()
    for r in out:
        taken[r.source] += len(WORD.findall(r.text))
        assert any(set(WORD.findall(r.text)) <= set(WORD.findall(t or "")) for t in texts[r.doc_id])
    for source, target in plain_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= 0.03 * target + 130
    # tokens: the library's ids of each row of the mix, in order
    found = sorted((tuple(r) for r in tokens.collect()), key=lambda r: r[1])
    ids = [[*tokenizer().encode(r.text or "", add_special_tokens=False).ids, 2] for r in out]
    assert collections.Counter((d, n, c) for d, _, n, c in found) == collections.Counter((r.doc_id, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(out, ids))
    at = 0
    for _, start, n, _ in found:
        assert start == at
        at += n
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=str) == sorted(found, key=str)


def test_stages_match_plain(spark, sf):
    check(spark, sf)


def test_edges(spark, edge_docs, tmp_path):
    """Nulls, ties, repeated rows, long texts, clashing columns; a contaminated passage, items without an id."""
    labels = [(3, 1, 0), (4, 1, 0), (5, 0, 0), (10, None, 0), (None, 1, 1), (12, 1, 0), (12, 0, 0)]
    check(spark, write(spark, tmp_path, edge_docs, labels, [("a", "line one is here"), (None, "ünï cödé"), ("b", None)]))


def test_empty_tables(spark, no_docs, tmp_path):
    folder = write(spark, tmp_path / "a", no_docs)
    assert [s.count() for s in stages(spark, folder)] == [0] * 6 and corpus_pipeline.run(spark, folder).collect() == []
    some = docs_of(spark, [(i, f"some words of document {i} " * 4, "s") for i in range(5)])
    folder = write(spark, tmp_path / "b", some)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_rows_that_tie(spark, tmp_path):
    """One row many times, one text under many ids, one id with many texts."""
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text, "a")] * 50 + [(i, text, "a") for i in range(2, 40)] + [(50, f"{i} " + " ".join(f"u{i}x{j}" for j in range(30)), "b") for i in range(20)]
    folder = write(spark, tmp_path, docs_of(spark, rows))
    docs, good, single, clean, mixed, tokens = stages(spark, folder)
    assert good.count() == docs.count() and collections.Counter(r.doc_id for r in single.collect()) == {1: 1, 50: 20}
    check(spark, folder)


def test_queries_are_registered():
    names = {"op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "pipeline"}
    assert {n.split("_")[0] for n in queries.queries()} == names and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.ORACLE_SQL is None and COLUMNS.startswith("doc_id")


@pytest.mark.parametrize("module", [decontaminate, mixing, chat])
def test_native_operators_have_no_python_in_any_stage(spark, edge_docs, module, monkeypatch):
    """The plans of all written tables, not the last one only."""
    plans, write_ = [], module.stored

    def stored(spark, df, name):
        plans.append(df._jdf.queryExecution().toString())
        return write_(spark, df, name)

    monkeypatch.setattr(module, "stored", stored)
    if module is decontaminate:
        bench = spark.createDataFrame([("1", "one two three"), ("2", "line one is here")], "item_id string, text string")
        found = [decontaminate.contamination(edge_docs, bench, null_items=True, most_broadcast=most) for most in (0, 1000)] + [decontaminate.keep_clean(edge_docs, bench)]
    elif module is mixing:
        found = [mixing.mixed_documents(edge_docs), mixing.mixed_texts(edge_docs)]
    else:
        turns = spark.createDataFrame([(1, 0, "u", "a\nb\nc"), (1, 1, "u", "> a\n> b\nyes"), (1, 2, "u", "> yes\n> a\nno")], "conv_id long, turn long, role string, text string")
        found = [chat.linked_conversations(turns), chat.conversations(turns)]
    plans += [df._jdf.queryExecution().toString() for df in found]
    assert len(plans) > 4
    for plan in plans:
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan
