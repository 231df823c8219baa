import collections
import hashlib
import re

from facetta.llm import decontaminate
from tests.llm.conftest import docs_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, n=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        ws = words(text)
        if ws:
            for i in range(max(1, len(ws) - n + 1)):
                windows[tuple(ws[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in rows:
        ws, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                if (w := tuple(ws[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[w] - {"None"}
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


def run(docs, bench, **options):
    return collections.Counter(tuple(r)[:6] for r in decontaminate.contamination(docs, bench, **options).collect())


def test_matches_plain(spark):
    for at in ("sf0.001", "sf0.01"):
        docs, bench = (spark.read.parquet(f"/root/testdata/{at}/{t}.parquet") for t in ("documents", "benchmark"))
        want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
        assert run(docs, bench) == want and any(r[5] for r in want)


def test_edges(spark, edge_docs, no_docs):
    items = [(1, "two three four five"), (2, None), (3, ""), (10, "TWO, three; four FIVE"), (4, "a s"), (5, " ".join(f"w{i}" for i in range(40))), (None, "no id"), (6, "ασ Σ àé"), (7, "x"), (8, "w1 w2 w1"), (8, "w3 w4")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n int")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert run(edge_docs, bench) == plain(rows, [i for i in items if i[0] is not None])
    assert run(edge_docs, bench, null_items=True) == plain(rows, items) != run(edge_docs, bench)
    assert run(edge_docs, bench.limit(0)) == plain(rows, [])
    assert decontaminate.contamination(no_docs, bench).collect() == []
    kept = decontaminate.keep_clean(edge_docs, bench)
    assert sorted(map(str, kept.collect())) == sorted(map(str, decontaminate.keep_clean(edge_docs, bench, most_keys=0).collect()))
    assert kept.columns == edge_docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r[0] for r, c in run(edge_docs, bench).items() for _ in range(c) if not r[5])


def test_items_without_an_id_hit_in_the_queries(spark, edge_docs, tmp_path):
    import corpus_pipeline
    from facetta.llm import queries

    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "no id"), (1, "two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [r for r in queries.op7_prefix_decontamination(spark, str(tmp_path)).collect() if r.doc_id is None]
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(5, 2, 0, True)]
    assert None not in {r.doc_id for r in corpus_pipeline.decontaminate_docs(spark, edge_docs, str(tmp_path)).collect()}


def test_overlaps_and_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = docs_of(spark, [(i, f"{passage} tail{i} {passage if i % 2 else ''} the the the the the the the the the the the", "s") for i in range(400)])
    bench = spark.createDataFrame([(1, passage), (2, " ".join(["the"] * 12)), (3, " ".join(passage.split()[5:30]))], "item_id long, text string")
    assert run(docs, bench) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_the_shuffle_beyond_the_broadcast(spark, sf, edge_docs):
    """The same rows where nothing may be broadcast: shared passages, a hot word, null ids, repeated rows."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = docs_of(spark, [(i % 90, f"{passage if i % 3 else ''} t{i % 90} the the the the the the the the the the the", "s") for i in range(100)])
    bench = spark.createDataFrame([(1, passage), (2, " ".join(["the"] * 11)), (None, "no id")], "item_id long, text string")
    tables = [(docs, bench), (edge_docs, bench), tuple(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))]
    for docs, bench in tables:
        assert run(docs, bench, null_items=True, most_broadcast=0) == run(docs, bench, null_items=True)


def test_no_python_on_the_main_path(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
