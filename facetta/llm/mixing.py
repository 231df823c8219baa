"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The budget is a share of all words; sources share it by weight, none above ``most`` times its own words, the
excess shared anew. Each source's documents are shuffled by hash and cut into blocks of equal words. Slot i
of the mix gets the golden-ratio point i * 0.381966... mod 1; the cumulative slot weights of the sources map
it to a source, its rank among the slots of that source picks the block. A source's blocks are taken in
shuffled order, again from the start once they are used up, so no document is taken more than ``most`` times.
The points meet an interval of one slot up to a few times or not at all; slots that a source is still short of
after all points are appended, the first of every short source in scrambled order, then the second and so on, so
every source gets exactly its slots.

Sums and ranks that run over a whole source (or over all slots) go by chunks of about the square root of its
rows: totals per chunk first, then the running sum over chunks, then inside the chunk. No task gathers a source.

Defined cases: a null text has size 0, and a document of size 0 is taken 0 times. Very long texts are counted whole.
A null source is a source, last in order. Equal rows are told apart by a number given in hash order. An empty table,
or one without words, gives targets of 0. Extra columns are ignored; ``mixed_texts`` keeps them. The sources are
ranked by one task, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetta.llm.common import WORD, row_hash, stored

#: The golden ratio's fractional step, in 2^-32.
STEP = 1640531527
WHOLE = 1 << 32
#: Cells of the unit interval by which slots meet source intervals.
CELLS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, pos (order by code point, null last), source_size, n_docs and target; one row per source.

    Water-filling in closed form: sources by cap / weight; a source is capped if the level that the rest would
    get exceeds its own cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("pos"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("pos", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    filled = Window.orderBy(F.col("cap") / F.col("w"), "pos")
    upto, rest, every = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    # the level of the first source that is not capped holds for all after it
    common = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.col("w") * F.coalesce(common, F.col("level")))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(target)
    return per.select("source", "pos", "source_size", "n_docs", target.alias("target"))


def document_sizes(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, source, h (row hash), size and key of every row; key tells apart rows of equal id and text, if they differ."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), row_hash(F.col("text")).alias("h"), size.alias("size"), (F.lit(0).cast("long") if key is None else key).alias("key"))


def schedule(sizes: DataFrame, block: int = 64, seed: int = 7, **shares) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, placed documents, slots).

    sources: source_targets with n_blocks and n_slots. placed: the rows of sizes with a and z, their first word's
    and end's place in the shuffled source. slots: slot, pos, rank in the source, block.
    """
    spark = sizes.sparkSession
    sizes = sizes if "key" in sizes.columns else sizes.withColumn("key", F.lit(0).cast("long"))
    sources = source_targets(sizes, **shares)
    n_blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / block))).otherwise(0).cast("long")
    most = float(shares.get("most", 2.0))
    sources = sources.withColumn("n_blocks", n_blocks)
    n_slots = F.when(F.col("n_blocks") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), F.floor(F.col("n_blocks") * most))).otherwise(0)
    sources, _ = stored(spark, sources.withColumn("n_slots", n_slots.cast("long")).coalesce(1), "mix-sources")

    # documents: chunk by hash inside the source, chunk totals, running sums
    facts = sources.select("source", "pos", "source_size", "n_docs", "target", "n_blocks", "n_slots")
    order = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "h")
    chunks = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_docs").cast("double")))).cast("long")
    rows = sizes.join(facts, sizes.source.eqNullSafe(facts.source)).drop(facts.source)
    rows = rows.withColumn("o", order).withColumn("chunk", F.floor((F.shiftrightunsigned(F.col("o"), 11) / float(1 << 53)) * chunks).cast("long"))
    totals = rows.groupBy("pos", "chunk").agg(F.sum("size").alias("t"))
    earlier = Window.partitionBy("pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals, _ = stored(spark, totals.select(F.col("pos").alias("tpos"), F.col("chunk").alias("tchunk"), F.coalesce(F.sum("t").over(Window.partitionBy("pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "mix-chunks")
    inside = Window.partitionBy("pos", "chunk").orderBy("o", "doc_id", "h", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    number = Window.partitionBy("pos", "chunk").orderBy("o", "doc_id", "h", "key", "size")
    run = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(number))
    run = run.join(totals, (run.pos == totals.tpos) & (run.chunk == totals.tchunk)).drop("tpos", "tchunk")
    placed = run.withColumn("z", F.col("base") + F.col("upto")).withColumn("a", F.col("z") - F.col("size")).drop("base", "upto", "o")

    # slots: intervals of the sources in 2^-32 of all slots, met by cells
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    share = sources.filter("n_slots > 0").withColumn("sum", F.sum("n_slots").over(upto)).withColumn("all", F.sum("n_slots").over(Window.partitionBy()))
    share = share.select("pos", "n_blocks", "n_slots", "sum", "all", F.round((F.col("sum") - F.col("n_slots")) / F.col("all") * WHOLE).cast("long").alias("lo"), F.round(F.col("sum") / F.col("all") * WHOLE).cast("long").alias("hi"))
    width = WHOLE // CELLS
    cells = share.filter("hi > lo").select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    n = sources.agg(F.sum("n_slots")).first()[0] or 0
    points = spark.range(0, n + (64 if n else 0)).select(F.col("id").alias("slot"), F.expr(f"pmod((id % {WHOLE}L) * {STEP}L, {WHOLE}L)").alias("point"))
    points = points.withColumn("at", F.floor(F.col("point") / width))
    if sources.count() <= 10 * CELLS:
        cells = F.broadcast(cells)  # CELLS rows and one more for each source
    slots = points.join(cells, (points.at == cells.cell) & (points.point >= cells.lo) & (points.point < cells.hi))
    size = max(1, int(n**0.5))
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / size)).select("slot", "pos", "n_blocks", "n_slots", "chunk")
    counts = slots.groupBy("pos", "chunk").agg(F.count("*").alias("c"))
    counts, _ = stored(spark, counts.select(F.col("pos").alias("cpos"), F.col("chunk").alias("cchunk"), "c", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before")), "mix-slot-chunks")
    within = F.row_number().over(Window.partitionBy("pos", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("within", within).join(counts, (F.col("pos") == F.col("cpos")) & (F.col("chunk") == F.col("cchunk")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).filter("rank < n_slots").select("slot", "pos", "rank", "n_blocks")

    # what the points leave short: ranks from the number met on, in slots after all points
    met = counts.groupBy(F.col("cpos").alias("mpos")).agg(F.sum("c").alias("met"))
    short = share.join(met, F.col("pos") == F.col("mpos"), "left").withColumn("met", F.coalesce("met", F.lit(0))).filter("met < n_slots")
    first = F.expr("sum - n_slots")
    spread = F.floor(first / WHOLE) * WHOLE + F.pmod((first % WHOLE) * F.lit(STEP).cast("long"), F.lit(WHOLE))
    turns = short.withColumn("rank", F.explode(F.sequence(F.col("met"), F.col("n_slots") - 1)))
    slot = F.lit(n + 64) + (F.col("rank") - F.col("met")) * F.lit(-(-n // WHOLE) * WHOLE) + spread
    ranked = ranked.unionByName(turns.select(slot.cast("long").alias("slot"), "pos", "rank", "n_blocks"))
    return sources, placed, ranked.withColumn("turn", F.expr("rank % n_blocks"))


def pieces(placed: DataFrame, seed: int = 7) -> DataFrame:
    """The parts of documents in blocks: placed's columns, block, turn (the block's place in shuffled order), w0 and w1 (words [w0, w1) of the document)."""
    # blocks of equal words: the first r of a source have q + 1, the others q
    placed = placed.filter("size > 0").withColumns({"q": F.expr("source_size div n_blocks"), "r": F.expr("source_size % n_blocks")})
    of = lambda x: F.expr(f"if({x} < r * (q + 1), {x} div (q + 1), r + ({x} - r * (q + 1)) div q)")
    start = lambda j: F.expr(f"({j}) * q + least({j}, r)")
    cut = placed.withColumn("block", F.explode(F.sequence(of("a"), of("(z - 1)"))))
    lo, hi = start("block"), start("block + 1")
    cut = cut.withColumn("w0", F.greatest(lo, F.col("a")) - F.col("a")).withColumn("w1", F.least(hi, F.col("z")) - F.col("a"))
    return cut.withColumn("turn", block_turn(seed))


def block_turn(seed: int):
    """Place of a block in its source's shuffled order: an affine step that visits every block once.

    The multiplier is the first of some large primes that does not divide the number of blocks.
    """
    step = F.lit(None).cast("long")
    for p in (1000003, 999983, 999979, 999961):
        step = F.coalesce(step, F.when(F.col("n_blocks") % p != 0, F.lit(p).cast("long")))
    return F.pmod(F.pmod(F.col("block"), F.col("n_blocks")) * F.pmod(step, F.col("n_blocks")) + seed, F.col("n_blocks"))


def mix(docs: DataFrame, block: int = 64, seed: int = 7, key: Column | None = None, **shares) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, documents with their places, the mix).

    The mix has a row for each slot and part of a document in the slot's block: slot, rank, doc_id, h, nth, pos,
    chunk, size, w0, w1 and turn of the source's blocks.
    """
    spark = docs.sparkSession
    sizes, _ = stored(spark, document_sizes(docs, key), "mix-sizes")
    sources, placed, slots = schedule(sizes, block, seed, **shares)
    placed, _ = stored(spark, placed, "mix-documents")
    parts = pieces(placed, seed).select("pos", "turn", "doc_id", "h", "key", "nth", "chunk", "size", "block", "w0", "w1")
    mixed = slots.select("slot", "pos", "turn", "rank", "n_blocks").join(parts, ["pos", "turn"])
    return sources, placed, mixed


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and row_hash of every document."""
    _, placed, mixed = mix(docs, **options)
    taken = mixed.groupBy("pos", "chunk", "nth").agg(F.sum(F.col("w1") - F.col("w0")).alias("taken"))
    taken = taken.select(F.col("pos").alias("tpos"), F.col("chunk").alias("tchunk"), F.col("nth").alias("tnth"), "taken")
    joined = placed.join(taken, (F.col("pos") == F.col("tpos")) & (F.col("chunk") == F.col("tchunk")) & (F.col("nth") == F.col("tnth")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", F.col("h").alias("row_hash"))


def mixed_texts(docs: DataFrame, block: int = 64, seed: int = 7, **shares) -> DataFrame:
    """The mix as documents with all their columns: whole copies, then one part for what a further pass takes.

    A part has the words that its pass takes, in order, joined by spaces; n_chars, where there is one, follows.
    Rows that are equal in all columns are one text with a row of the mix for each: nothing gathers them.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", F.xxhash64(*docs.columns))
    _, placed, mixed = mix(docs, block, seed, F.xxhash64(*docs.columns), **shares)
    passes = mixed.groupBy("doc_id", "key", "size", "pos", "chunk", "nth", F.expr("rank div n_blocks").alias("pass")).agg(
        F.sum(F.col("w1") - F.col("w0")).alias("n"), F.array_sort(F.collect_list(F.struct("w0", "w1"))).alias("spans")
    )
    copies = passes.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), "pos", "chunk", "nth").agg(
        F.sum(F.expr("cast(n = size as int)")).alias("__whole"), F.array_sort(F.collect_list(F.when(F.expr("n < size"), F.struct("pass", "spans")))).alias("__parts")
    )
    copies = copies.select("__id", "__k", "__whole", "__parts")
    same = lambda rows: rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["__key"] == F.col("__k"))
    again, _ = stored(spark, placed.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__k")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "mix-again")
    if not again.isEmpty():
        once = keyed.join(again, same(keyed), "left_semi").dropDuplicates(["doc_id", "__key"])
        keyed = keyed.join(again, same(keyed), "left_anti").unionByName(once)
    both = keyed.join(copies, same(keyed))
    none = F.expr("cast(null as array<struct<w0:bigint,w1:bigint>>)")
    both = both.withColumn("__spans", F.explode(F.concat(F.array_repeat(none, F.col("__whole").cast("int")), F.transform("__parts", lambda p: p["spans"]))))
    every = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    part = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__words"), (s["w0"] + 1).cast("int"), (s["w1"] - s["w0"]).cast("int")))), " ")
    both = both.withColumn("__words", F.when(F.col("__spans").isNotNull(), every)).withColumn("__text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(part))
    columns = [F.col("__text").alias(c) if c == "text" else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return both.select(*columns)
