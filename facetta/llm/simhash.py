"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to reference fingerprints (the pivots). By the
triangle inequality two fingerprints within ``max_bits`` differ by at most that in every coordinate, which
discards pairs without comparing them. Most pivots are neighbours of one base fingerprint, in groups that
share a small block of bits: a group's distances, less the base's, depend on that block only, so a pair
within ``max_bits`` has *equal* coordinates in all but ``max_bits`` groups. Those equal coordinates are the
join keys (cells); the remaining coordinates and some random pivots discard pairs inside a cell, and exact
distances verify the survivors.

A cell with too many members (a large group of near copies) is not gathered: its members are dealt again by
the coordinates of finer groups, which bounds a cell by 2^8 members at the last level. Cells give spanning
edges only, never all pairs. Components come from rounds of large-star and small-star steps on edges; each
round is a written table.

Defined cases: a null or empty text has fingerprint zero, which links like any other. Rows with equal text
share a fingerprint. Null ids are never a smallest id; a component of null ids alone has a null component.
Repeated ids are rows of their own. Very long texts are hashed whole, in memory of some times their size. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetta.llm.common import MOST_KEYS, by_batch, remove, row_hash, sized, stored, utf8

MASK = (1 << 64) - 1


def fingerprint(data: bytes, size: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles of ``size`` words."""
    words = data.lower().split()  # bytes: A-Z only, and \x20, \x09-\x0D only
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(text[a:b], seed) for a, b in zip(starts, stops)])
    n = len(starts)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.frombuffer(joined, np.uint8, min(n - i, 1 << 16) * 8, i * 8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, row_hash and the fingerprint as a signed 64-bit integer."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [signed(fingerprint(x or b"", size, seed)) for x in utf8(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "row_hash", "fp"])

    rows = docs.select("doc_id", row_hash(F.col("text")).alias("row_hash"), "text")
    return by_batch(rows, one, "doc_id long, row_hash long, fp long")


#: Bits of the finest pivot group; 16 groups cover the fingerprint.
GROUP = 4
BASE = 0x9E3779B97F4A7C15
#: Pivots that no cell uses; they only discard.
RANDOM = tuple((BASE * (2 * i + 3) ^ (BASE >> (i + 1))) & MASK for i in range(8))


def pivots() -> np.ndarray:
    """The base, its 64 neighbours in groups of GROUP, and the random pivots."""
    return np.array([BASE, *(BASE ^ (1 << i) for i in range(64)), *RANDOM], np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot, (n, pivots) of int8."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def group_codes(table: np.ndarray) -> np.ndarray:
    """(n, 16): the coordinates of each pivot group, less the base's, as one small number."""
    above = (table[:, 1:65] > table[:, :1]).reshape(len(table), 64 // GROUP, GROUP)
    return (above * (1 << np.arange(GROUP))).sum(axis=2).astype(np.uint64)


#: Groups of each level's blocks. A level keeps 2 blocks of 4: pairs within 2 bits leave at least 2 whole.
LEVELS = (4, 2, 1)


def cells(fps: np.ndarray, level: int, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kept groups as a bit set, key) of the cells of a level.

    kept: for deeper levels, the groups that the parent cell holds equal; the rest is dealt again.
    """
    codes = group_codes(distance_table(fps))
    n, wide = len(fps), LEVELS[level]
    rows, sets, keys = [], [], []
    patterns = [0] if kept is None else sorted({int(x) for x in kept})
    for base in patterns:
        at = np.arange(n) if kept is None else np.flatnonzero(kept == base)
        free = [g for g in range(16) if not base >> g & 1]
        blocks = [free[i : i + wide] for i in range(0, len(free), wide)]
        for pair in combinations(blocks, 2):
            held = base | sum(1 << g for block in pair for g in block)
            key = np.zeros(len(at), np.uint64)
            for g in range(16):
                if held >> g & 1:
                    key = (key << np.uint64(GROUP)) | codes[at, g]
            rows.append(at)
            sets.append(np.full(len(at), held, np.int32))
            keys.append(key)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(rows, np.int64), join(sets, np.int32), join(keys, np.uint64)


def local_edges(fps: np.ndarray, max_bits: int, block: int = 512) -> list[tuple[int, int]]:
    """Spanning edges of the links inside one cell: pivot filter, exact check, union-find."""
    n = len(fps)
    table = distance_table(fps)[:, [0, *range(65, 65 + len(RANDOM))]]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.argsort(table[:, 0], kind="stable")  # by the first coordinate: only a band can pass
    first = table[order, 0].astype(np.int64)
    ends = np.searchsorted(first, first + max_bits, side="right")
    for i in range(0, n, block):
        j, stop = min(n, i + block), int(ends[min(n, i + block) - 1])
        left, right = order[i:j], order[i:stop]
        near = np.abs(table[left][:, None, :] - table[right][None, :, :]).max(axis=2) <= max_bits
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        fit = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        for x, y in zip(a[fit].tolist(), b[fit].tolist()):
            if x != y and (x := root(x)) != (y := root(y)):
                parent[max(x, y)] = min(x, y)
    return [(i, r) for i in range(n) if (r := root(i)) != i]


def discarded(fps: np.ndarray, max_bits: int = 2) -> dict[str, int]:
    """What the distance table saves: pairs that share a first cell, those that its coordinates leave, and those that link."""
    fps = np.unique(fps)
    row, held, key = cells(fps, 0)
    order = np.lexsort((key, held))
    row, held, key = row[order], held[order], key[order]
    starts = np.flatnonzero(np.concatenate(([True], (held[1:] != held[:-1]) | (key[1:] != key[:-1]))))
    met = left = linked = 0
    for a, b in zip(starts, [*starts[1:], len(row)]):
        some = fps[row[a:b]]
        table = distance_table(some)[:, [0, *range(65, 65 + len(RANDOM))]]
        i, j = np.triu_indices(b - a, 1)
        near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= max_bits
        met, left = met + len(i), left + int(near.sum())
        linked += int((np.bitwise_count(some[i] ^ some[j]) <= max_bits).sum())
    return {"pairs": len(fps) * (len(fps) - 1) // 2, "met": met, "left": left, "linked": linked}


def links(distinct: DataFrame, max_bits: int = 2, most: int = 2048) -> DataFrame:
    """Spanning edges (a, b) between linked fingerprints; distinct has one column, fp."""
    spark = distinct.sparkSession
    if max_bits > 2:
        raise ValueError("two of four blocks stay whole for up to two bits only")

    def deal(level: int):
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            kept = batch.column(1).to_numpy(zero_copy_only=False) if level else None
            row, held, key = cells(fps.view(np.uint64), level, kept)
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(key.view(np.int64)), pa.array(fps[row])], names=["held", "cell", "fp"])

        return one

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        a: list[int] = []
        b: list[int] = []
        for members in batch.column(0):
            fps = np.unique(np.array(members.as_py(), np.int64)).view(np.uint64)
            for x, y in local_edges(fps, max_bits):
                a.append(int(fps.view(np.int64)[x]))
                b.append(int(fps.view(np.int64)[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    at, out = distinct.select("fp"), []
    for level in range(len(LEVELS)):
        dealt = by_batch(at, deal(level), "held int, cell long, fp long")
        counts = dealt.groupBy("held", "cell").agg(F.count("*").alias("n")).filter("n > 1")
        large, _ = stored(spark, counts.filter(F.col("n") > most), "simhash-large-cells")
        last = level == len(LEVELS) - 1 or large.isEmpty()
        if not last:
            hot = large.select("held", "cell")
            deeper, _ = stored(spark, dealt.join(hot, ["held", "cell"], "left_semi").select("fp", "held").distinct(), "simhash-large-members")
            dealt = dealt.join(hot, ["held", "cell"], "left_anti")
        members = dealt.groupBy("held", "cell").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        out.append(by_batch(members.select("fps"), edges, "a long, b long"))
        if last:
            break
        at = deeper
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges; root is the smallest node it reaches."""
    spark = edges.sparkSession
    before, old = None, None
    now, path = stored(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lower, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        new, new_path = stored(spark, small.select("e.a", F.col("e.m").alias("b")).filter("a <> b").distinct(), "components")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            remove(spark, old)
        old, path, now = path, new_path, new
        if before == sign:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(docs: DataFrame, size: int = 3, seed: int = 42, max_bits: int = 2, most: int = 2048) -> DataFrame:
    """doc_id, fingerprint, component_id, row_hash and root (the least fingerprint of the component) of every document.

    most: members of a cell that one task may hold; larger cells are dealt again, none is cut.
    """
    spark = docs.sparkSession
    found, _ = stored(spark, fingerprints(docs, size, seed), "simhash")
    nodes, _ = stored(spark, found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    tree = components(links(nodes.select("fp"), max_bits, most))
    named = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(smallest, "root").select("fp", "root", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(names, "fp").select("doc_id", hexed, "component_id", "row_hash", "root")


def simhash_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint, component_id and row_hash of every document."""
    return rooted(docs, **options).drop("root")


def keep_one(docs: DataFrame, most_keys: int = MOST_KEYS, **options) -> DataFrame:
    """Exactly one document of each group, with all its columns: the first by a total order.

    The order is (doc_id, nulls last; hash of the text; hash of all columns). Rows that are equal in all columns
    are one. No row of another group changes what is kept of a group: null ids, and ids that repeat in other
    groups, follow the same order. Extra columns stay. An empty table gives an empty one. Up to ``most_keys`` rows
    leave without a shuffle of the rest.
    """
    spark = docs.sparkSession
    grouped, _ = stored(spark, rooted(docs, **options), "simhash-groups")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first"))
    held = grouped.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash")))
    # a text belongs to one group, so (doc_id, row_hash) tells the rows of a group from all others
    named = lambda rows: rows.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"))
    at = lambda names: docs["doc_id"].eqNullSafe(names["__id"]) & (row_hash(docs["text"]) == names["__hash"])
    gone, _ = stored(spark, named(held.filter("not stays")).distinct(), "simhash-gone")
    kept = docs.join(sized(gone, most_keys), at(gone), "left_anti")
    again, _ = stored(spark, named(held.filter("stays")).groupBy("__id", "__hash").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "simhash-again")
    if again.isEmpty():
        return kept
    rows = docs.join(sized(again, most_keys), at(again)).withColumn("__all", F.xxhash64(*docs.columns))
    least = rows.groupBy(F.col("__id").alias("__i"), F.col("__hash").alias("__h")).agg(F.min("__all").alias("__least"))
    same = rows.join(least, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")) & (F.col("__all") == F.col("__least")))
    return kept.join(sized(again, most_keys), at(again), "left_anti").unionByName(same.select(*docs.columns, "__id", "__hash").dropDuplicates(["__id", "__hash"]).select(*docs.columns))
