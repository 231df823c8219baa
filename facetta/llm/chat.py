"""Quotation linking: reply-ordered conversations without quotes, with DataFrame functions only.

Lines that begin with ``>`` marks are quoted; the number of marks is the level. A passage is a run of lines of one
level. Normalised passages (lower case, white space collapsed) are hashed and joined, inside a conversation, to
the earliest message whose own text, or a paragraph or line of it, has that hash. A passage of several lines that
links to none so is joined by its parts: to the earliest message that has its lines, or its paragraphs, one after
another (hashes of runs of as many lines, only where the first one fits), or that says each of its lines or
paragraphs first of all messages, in this order, with others left out between. A message replies to the latest
such message among its passages of the lowest level that links. Threads follow replies up to their root; rows in
the order of (conv_id, root, turn) are reply-ordered, as a reply always comes after what it replies to.

Defined cases: a null or empty text is an empty message. A quote of nothing earlier stays unlinked; its lines go
all the same. A message may link only to a smaller turn. Repeated rows are kept, each with the same result; rows
that share conv_id and turn share their links. Null conv_id or turn never link and are their own root. Very long
texts are split whole, in memory of some times their size. An empty table gives an empty result. Extra columns are
ignored. A first message quoted by thousands is one row on its side of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetta.llm.common import remove, row_hash, stored

MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(text: Column) -> Column:
    """The text without its quoted lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(MARKS))
    whole = F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")
    return F.when(F.coalesce(text, F.lit("")).rlike(f"(?m){MARKS}"), whole).otherwise(F.coalesce(text, F.lit("")))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage and key of every quoted passage."""
    quoting = messages.filter(F.col("text").rlike(f"(?m){MARKS}")).select("conv_id", "turn", row_hash(F.col("text")).alias("h"), "text").distinct()
    lines = quoting.select("conv_id", "turn", "h", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("line", F.regexp_replace("line", MARKS, ""))
    lines = lines.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("conv_id", "turn", "h", "level").orderBy("i")))
    found = lines.filter("level > 0").groupBy("conv_id", "turn", "h", "level", "run").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    found = found.withColumn("passage", F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    found = found.withColumn("key", normal(F.col("passage"))).filter("key <> ''")
    return found.select("conv_id", "turn", "level", "passage", F.xxhash64("key").alias("key"), *sequences(F.col("passage")))


def sequences(text: Column) -> list[Column]:
    """lines and paragraphs: hashes of the lines and paragraphs of a text that are not blank, in order."""
    hashed = lambda parts: F.transform(F.filter(F.transform(parts, normal), lambda x: x != ""), lambda x: F.xxhash64(x))
    return [hashed(F.split(text, "\n")).alias("lines"), hashed(F.split(text, r"\n[ \t]*\n")).alias("paragraphs")]


def units(messages: DataFrame) -> DataFrame:
    """conv_id, key and the earliest turn that says it: whole own texts, their paragraphs and lines."""
    own = own_text(F.col("text"))
    said = F.array_distinct(F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n")))
    each = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(said).alias("unit")).withColumn("unit", normal(F.col("unit")))
    return each.filter("unit <> ''").groupBy("conv_id", F.xxhash64("unit").alias("key")).agg(F.min("turn").alias("origin"))


def part_origins(messages: DataFrame, missed: DataFrame) -> DataFrame:
    """conv_id, lines, paragraphs and the earliest turn that has a passage of missed by its parts."""
    spark = messages.sparkSession
    quoted, _ = stored(spark, missed.select("conv_id", "lines", "paragraphs").distinct(), "chat-missed")
    quoted = quoted.withColumn("id", F.xxhash64("lines", "paragraphs"))
    said = messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi").filter("turn is not null")
    said, _ = stored(spark, said.select("conv_id", "turn", *sequences(own_text(F.col("text")))), "chat-sequences")
    found = None
    for kind in ("lines", "paragraphs"):
        # as many hashes from each place where the first one fits
        wanted = quoted.filter(F.size(kind) > 1).select("conv_id", "id", F.col(kind).alias("seq"))
        starts = wanted.select("conv_id", F.expr("seq[0]").alias("part"), F.size("seq").alias("n")).distinct()
        places = said.select("conv_id", "turn", F.col(kind).alias("all"), F.posexplode(kind).alias("i", "part")).join(starts, ["conv_id", "part"])
        runs = places.filter("i + n <= size(all)").select("conv_id", "turn", F.expr("slice(all, i + 1, n)").alias("seq"))
        runs = wanted.join(runs.groupBy("conv_id", "seq").agg(F.min("turn").alias("origin")), ["conv_id", "seq"]).select("conv_id", "id", "origin")
        found = runs if found is None else found.unionByName(runs)
        # parts left out between: each part's first place in the conversation
        parts = wanted.select("conv_id", "id", F.posexplode("seq").alias("j", "part"))
        first = said.select("conv_id", "turn", F.posexplode(kind).alias("i", "part")).groupBy("conv_id", "part").agg(F.min(F.struct("turn", "i")).alias("at"))
        placed = parts.join(first, ["conv_id", "part"], "left").groupBy("conv_id", "id").agg(F.array_sort(F.collect_list(F.struct("j", F.col("at.turn").alias("turn"), F.col("at.i").alias("i")))).alias("ps"))
        ordered = "forall(sequence(1, size(ps) - 1), k -> coalesce(ps[k].turn = ps[k - 1].turn and ps[k].i > ps[k - 1].i, false))"
        found = found.unionByName(placed.filter(ordered).select("conv_id", "id", F.expr("ps[0].turn").alias("origin")))
    least = found.groupBy("conv_id", "id").agg(F.min("origin").alias("part_origin"))
    return quoted.join(least, ["conv_id", "id"]).select("conv_id", "lines", "paragraphs", "part_origin")


def reply_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_passages and n_linked of every message that quotes."""
    quotes, _ = stored(messages.sparkSession, passages(messages), "chat-passages")
    keys = quotes.select("conv_id", "key").distinct()
    origins = units(messages).join(keys, ["conv_id", "key"], "left_semi")
    met = quotes.join(origins, ["conv_id", "key"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    if not quotes.filter("size(lines) > 1").isEmpty():
        met, _ = stored(messages.sparkSession, met, "chat-whole")
        missed = met.filter("origin is null and size(lines) > 1 and conv_id is not null and turn is not null")
        met = met.join(part_origins(messages, missed), ["conv_id", "lines", "paragraphs"], "left")
        met = met.withColumn("origin", F.coalesce("origin", F.when(F.col("part_origin") < F.col("turn"), F.col("part_origin"))))
    at = met.groupBy("conv_id", "turn", "level").agg(F.max("origin").alias("origin"), F.count("*").alias("n"), F.count("origin").alias("linked"))
    return at.groupBy("conv_id", "turn").agg(
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "origin")))["origin"].alias("reply_to"), F.sum("n").alias("n_passages"), F.sum("linked").alias("n_linked")
    )


def thread_roots(links: DataFrame) -> DataFrame:
    """conv_id, turn and root of every message with a reply_to; pointers double, so depth costs its logarithm."""
    spark = links.sparkSession
    now, path = stored(spark, links.filter("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("root")), "chat-roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        if now.join(up, ["conv_id", "root"], "left_semi").isEmpty():
            return now
        new, new_path = stored(spark, now.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root")), "chat-roots")
        remove(spark, path)
        now, path = new, new_path


def linked_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, root, n_passages, n_linked and rendered, one row for each message."""
    spark = messages.sparkSession
    base = messages.select("conv_id", "turn", "role", "text")
    links, _ = stored(spark, reply_links(base), "chat-links")
    roots = thread_roots(links)
    links = links.join(roots, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"), "reply_to", "root", "n_passages", "n_linked")
    links, _ = stored(spark, links, "chat-threads")
    joined = base.join(links, (base.conv_id == links["__c"]) & (base.turn == links["__t"]), "left")
    text = own_text(F.col("text"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "conv_id", "turn", "role", text.alias("text"), "reply_to", F.coalesce("root", "turn").alias("root"), count("n_passages"), count("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), text, F.lit("\n<|end|>\n")).alias("rendered"),
    )


def conversations(messages: DataFrame, span: int = 256) -> DataFrame:
    """conv_id, root, part, n, messages (turn, reply_to, role, text in the order of replies) and rendered: a row for each thread.

    A reply comes after what it replies to, so the order is that of (turn, role, text). A row holds the turns of one
    run of ``span`` numbers: a long thread is several rows, numbered by part, and no task holds all of it.
    """
    linked = linked_conversations(messages)
    one = F.struct("turn", "reply_to", "role", "text", "rendered")
    found = linked.groupBy("conv_id", "root", F.floor(F.col("turn") / span).alias("part")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.transform("all", lambda m: F.struct(m["turn"].alias("turn"), m["reply_to"].alias("reply_to"), m["role"].alias("role"), m["text"].alias("text")))
    return found.select("conv_id", "root", "part", F.size("all").cast("long").alias("n"), kept.alias("messages"), F.array_join(F.col("all.rendered"), "").alias("rendered"))
