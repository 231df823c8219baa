import collections
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from facetta.llm import simhash
from tests.llm.conftest import docs_of


def plain_fingerprint(text):
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", data)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """{(doc_id, text): (hex, component)} by all pairs of distinct fingerprints."""
    fps = {t: plain_fingerprint(t) for _, t in rows}
    names = sorted(set(fps.values()))
    root = {f: f for f in names}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, t in rows:
        if d is not None:
            r = find(fps[t])
            least[r] = min(least.get(r, d), d)
    return collections.Counter((d, f"{fps[t]:016x}", least.get(find(fps[t]))) for d, t in rows)


def test_groups_match_plain(spark, sf, edge_docs):
    for docs in (edge_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = collections.Counter(tuple(r)[:3] for r in simhash.simhash_groups(docs).collect())
        assert got == plain_groups(rows)


def edges_to_groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.choice(range(12, 30))
        out.add(x)
    return sorted(out)


def test_links_with_large_cells_match_all_pairs(spark):
    nodes = clustered(900, 1)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in nodes], "fp long")
    want = edges_to_groups([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 2], nodes)
    for most in (4, 60, 2048):
        pairs = [(r.a & simhash.MASK, r.b & simhash.MASK) for r in simhash.links(frame, 2, most).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
        assert edges_to_groups(pairs, nodes) == want


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, simhash.MASK), st.lists(st.integers(0, 63), min_size=0, max_size=2))
def test_pivots_bound_distance_and_share_a_cell(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    table = simhash.distance_table(np.array([x, y], np.uint64)).astype(int)
    assert abs(table[0] - table[1]).max() <= (x ^ y).bit_count()
    row, held, key = simhash.cells(np.array([x, y], np.uint64), 0)
    of = [set(zip(held[row == i].tolist(), key[row == i].tolist())) for i in (0, 1)]
    assert of[0] & of[1]


def test_keep_one(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = {d for d, _, c in plain_groups(rows) if d == c or d is None}
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)
    assert simhash.simhash_groups(no_docs).collect() == [] and simhash.keep_one(no_docs).collect() == []


def test_keep_one_without_ids_and_with_a_tied_id(spark):
    same, other, third = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, same), (None, same), (None, same.upper()), (None, other), (5, other), (7, third), (7, third.upper()), (7, third), (9, third)]
    kept = simhash.keep_one(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [("5", other), ("7", third), ("None", same)]


def test_what_is_kept_of_a_group_does_not_hang_on_others(spark):
    """Null ids with equal texts are one row, with or without a repeated row elsewhere; of rows with equal id and text the least by hash stays."""
    same, other = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(None, same, "s"), (None, same, "s"), (3, other, "t"), (4, "c d e f g h i j k l", "t")]
    for more in ([], [(4, "c d e f g h i j k l", "t")], [(4, "c d e f g h i j k l", "u"), (4, "c d e f g h i j k l", "t")]):
        kept = [simhash.keep_one(docs_of(spark, (rows + more)[::step]).repartition(parts)).collect() for step, parts in ((1, 1), (-1, 3))]
        assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) == sorted(map(str, simhash.keep_one(docs_of(spark, rows + more), most_keys=0).collect()))
        assert sorted(str(r.doc_id) for r in kept[0]) == ["3", "4", "None"]


def test_distance_table_discards(spark):
    """Of all pairs few meet in a cell; of these the coordinates leave few, and every link."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = np.array([r.fp for r in simhash.fingerprints(docs).collect()], np.int64).view(np.uint64)
    found = simhash.discarded(fps)
    names = np.unique(fps)
    close = sum(int((np.bitwise_count(names[i + 1 :] ^ names[i]) <= 2).sum()) for i in range(len(names)))
    assert found["left"] >= found["linked"] >= close and found["met"] < found["pairs"] / 20


def test_hot_group_of_copies(spark):
    docs = docs_of(spark, [(i, "the same text of some few words" if i % 3 == 0 else f"other text number {i} of many words", "s") for i in range(3000)])
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == 3000 and {r.component_id for r in got if r.doc_id % 3 == 0} == {0}
