"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ``window`` words (a shorter item is one window). A document contains a
window only if it contains every word of it, so one word suffices as prefix: the window's rarest, by counts
over all documents. Words of the documents are joined with these prefix words; the position of the word in
the window gives the only possible start, which must leave room for the whole window (positional and length
bounds), and the words there are compared exactly.

Defined cases: a null or empty text, of a document or an item, has no words, so it is never hit. Repeated
rows get equal results, one row each. Items without an id are dropped, unless ``null_items``: then their windows
hit like any other, and n_items and the item list have only items with an id. Items with the same id are one item.
Ties in rarity go to the word that sorts first, then to its first place in the window. Very long texts are split
whole, in memory of some times their size. An empty table gives an empty result, an empty benchmark hits nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetta.llm.common import MOST_KEYS, lower_ascii, row_hash, sized, stored

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A gap before lower-casing.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Prefix windows, and words of the benchmark, that may be broadcast; beyond, both sides are shuffled.
MOST_BROADCAST = 200_000
#: Parts that the places of a word are dealt to in a shuffle, as one word may be a large share of all.
SALTS = 16


def parts(text: Column) -> Column:
    """The words of a text between its gaps; a gap at either end leaves an empty part, which is no word."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP)


def item_windows(benchmark: DataFrame, window: int, null_items: bool = False) -> DataFrame:
    """item, w (window words) and n (their number), one row per distinct window of an item."""
    base = (benchmark if null_items else benchmark.filter("item_id is not null")).select(F.col("item_id").cast("string").alias("item"), F.array_remove(parts(F.col("text")), "").alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    return base.select("item", "ws", F.explode(starts).alias("s")).select("item", F.expr(f"slice(ws, s, {window})").alias("w")).distinct().withColumn("n", F.size("w"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, null_items: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, h (row hash), s, e (first and last word position of an occurrence) and item.

    Up to ``most_broadcast`` windows the documents stay where they are. Beyond, words are shuffled with their document
    and place, dealt in ``SALTS`` parts, and only documents with a candidate follow.
    """
    spark = docs.sparkSession
    windows, _ = stored(spark, item_windows(benchmark, window, null_items), "benchmark-windows")
    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    texts = docs.select("doc_id", "text")
    each = texts.select(F.explode(parts(F.col("text"))).alias("word"))
    counts = each.join(sized(vocabulary, most_broadcast), "word", "left_semi").groupBy("word").agg(F.count("*").alias("c"))
    counts, _ = stored(spark, counts, "benchmark-words")

    spread = windows.select("w", "n", F.posexplode("w").alias("o", "word"))
    ranked = spread.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # an absent word rules its window out at once
    rarest = ranked.groupBy("w", "n").agg(F.min(F.struct("c", "word", "o")).alias("p")).filter("p.c > 0").select("w", "n", "p.word", "p.o")
    rarest, _ = stored(spark, rarest, "benchmark-prefixes")
    probes = rarest.select(F.col("word").alias("pw"), "o", "n", "w")
    split = texts.select("doc_id", row_hash(F.col("text")).alias("h"), parts(F.col("text")).alias("ws"))
    if probes.limit(most_broadcast + 1).count() <= most_broadcast:
        found = split.select("*", F.posexplode("ws").alias("i", "word")).join(F.broadcast(probes), F.col("word") == F.col("pw"))
    else:
        salted = probes.withColumn("ps", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        places = split.select("doc_id", "h", F.size("ws").alias("all"), F.posexplode("ws").alias("i", "word")).withColumn("salt", F.pmod(F.xxhash64("h", "i"), F.lit(SALTS)).cast("int"))
        met = places.join(salted, (F.col("word") == F.col("pw")) & (F.col("salt") == F.col("ps"))).filter("i >= o and i - o + n <= all")
        met, _ = stored(spark, met.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "i", "o", "n", "w").distinct(), "benchmark-candidates")
        wanted = met.select("__id", "__h").distinct()
        same = lambda a: a["doc_id"].eqNullSafe(F.col("__id")) & (a["h"] == F.col("__h"))
        own = split.join(wanted, same(split), "left_semi").dropDuplicates(["doc_id", "h"])
        found = own.join(met, same(own))
    found = found.filter("i >= o and i - o + n <= size(ws)").filter("slice(ws, i - o + 1, n) = w")
    starts = found.select("doc_id", "h", F.expr("i - o").alias("s"), F.expr("i - o + n - 1").alias("e"), "w").distinct()
    return starts.join(windows.select("w", "item"), "w").select("doc_id", "h", "s", "e", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, null_items: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and row_hash of every document."""
    spark = docs.sparkSession
    found, _ = stored(spark, hits(docs, benchmark, window, null_items, most_broadcast), "benchmark-hits")
    spans = found.groupBy("doc_id", "h", "s").agg(F.max("e").alias("e"))
    before = Window.partitionBy("doc_id", "h").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("last", F.coalesce(F.max("e").over(before), F.lit(-1)))
    covered = fresh.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.col("e") - F.greatest("s", F.col("last") + 1) + 1, F.lit(0))).cast("long").alias("n_hit"))
    items = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = covered.join(items, (covered.doc_id.eqNullSafe(items.doc_id)) & (covered.h == items.h)).select(
        covered.doc_id.alias("__id"), covered.h.alias("__h"), "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("joined")
    )
    per, _ = stored(spark, per, "benchmark-documents")
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), RAW_GAP), "")).cast("long")
    rows = docs.select("doc_id", row_hash(F.col("text")).alias("row_hash"), n_words.alias("n_words"))
    joined = rows.join(per, rows.doc_id.eqNullSafe(per["__id"]) & (rows.row_hash == per["__h"]), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        "row_hash",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, null_items: bool = False, most_keys: int = MOST_KEYS) -> DataFrame:
    """The documents without a window of an item, with all their columns; up to ``most_keys`` of them leave without a shuffle of the rest."""
    spark = docs.sparkSession
    found, _ = stored(spark, hits(docs, benchmark, window, null_items), "benchmark-hits")
    gone, _ = stored(spark, found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct(), "benchmark-gone")
    return docs.join(sized(gone, most_keys), docs["doc_id"].eqNullSafe(gone["__id"]) & (row_hash(docs["text"]) == gone["__h"]), "left_anti")
