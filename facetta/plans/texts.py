"""Tokenizer and text-retrieval queries."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetta.functions.phonetic import editex_distance
from facetta.operators import tokenizers as T
from facetta.plans import tasks, templates

#: Items shared at once, and more than the turns of a conversation.
ITEMS, TURNS = 4096, 1 << 20


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _spread(rows: DataFrame) -> DataFrame:
    """Pairs are small to read and slow to compute: one small file would be one task."""
    session = rows.sparkSession
    return rows.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = T.fit(docs)
    return docs.select("doc_id", F.array_join(T.encode(F.col("text"), model).cast("array<string>"), ",").alias("ids"))


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded text, and whether it has the words of the original (false where a piece was unknown)."""
    docs = _docs(spark, sf_dir)
    model = T.fit(docs)
    back = docs.select("doc_id", T.decode(T.encode(F.col("text"), model), model).alias("decoded"), F.array_join(T.words(F.col("text")), " ").alias("plain"))
    return back.select("doc_id", "decoded", (F.col("decoded") == F.col("plain")).alias("same"))


def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = T.fit(_docs(spark, sf_dir))
    rows = [("word", w, i) for w, i in model.word_ids.items()] + [("piece", p, i) for p, i in model.piece_ids.items()]
    return spark.createDataFrame(rows, "kind string, token string, id int")


def editex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return _spread(turns.join(after, ["conv_id", "turn"])).select("conv_id", "turn", editex_distance("text", "next_text").alias("dist"))


def _worth(kind: str, common, nq, nd):
    """Distance by multisets of tokens, of columns or arrays; the Jaccard distance in steps of 1e-6."""
    return 1 - common / (nq + nd - common) if kind == "jaccard" else np.maximum(nq, nd) - common


def token_neighbours(items: DataFrame, docs: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """item_id, doc_id, dist and rnk: the k documents of each item with the smallest distance by words, of those that share one.

    Items are the stated queries: a block of them is shared as lists of places of each word. A batch of documents is
    scored against a block and keeps k for each item, so few rows are ranked.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", T.words(F.col("text")).alias("words"))
    n = max(1, -(-asked.count() // ITEMS))
    parts = []
    for block in range(n):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).toArrow()
        ids, lists = rows["item_id"].to_pylist(), rows["words"].to_pylist()
        places: dict[str, tuple[list, list]] = {}
        for i, words in enumerate(lists):
            for word, c in Counter(words).items():
                at = places.setdefault(word, ([], []))
                at[0].append(i)
                at[1].append(c)
        shared = spark.sparkContext.broadcast(({w: (np.array(a), np.array(c)) for w, (a, c) in places.items()}, np.array([len(x) for x in lists]), ids))

        def run(batches, shared=shared):
            places, nq, ids = shared.value
            for batch in batches:
                if not batch.num_rows or not ids:
                    continue
                docs_, common, nd = batch.column(0).to_numpy(zero_copy_only=False), np.zeros((batch.num_rows, len(ids)), np.int64), np.zeros(batch.num_rows, np.int64)
                for j, words in enumerate(batch.column(1)):
                    words = words.as_py()
                    nd[j] = len(words)
                    for word, c in Counter(words).items():
                        if word in places:
                            at, q = places[word]
                            common[j, at] += np.minimum(q, c)
                dist = _worth(kind, common, nq[None, :], nd[:, None]).astype(float)
                key = np.where(common > 0, np.floor(dist * 1e6 + 0.5) if kind == "jaccard" else dist, np.inf)
                best = np.lexsort((np.broadcast_to(docs_[:, None], key.shape), key), axis=0)[:k]
                item = np.broadcast_to(np.arange(len(ids)), best.shape)
                there = np.isfinite(key[best, item])
                a, b = best[there], item[there]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in b], pa.string()), pa.array(docs_[a]), pa.array(common[a, b]), pa.array(nq[b]), pa.array(nd[a])], names=["item_id", "doc_id", "common", "nq", "nd"])

        words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.words(F.col("text")).alias("words"))
        parts.append(words.mapInArrow(run, "item_id string, doc_id long, common long, nq long, nd long"))
    c, q, d = (F.col(x) for x in ("common", "nq", "nd"))
    dist = F.round(1 - c.cast("double") / (q + d - c), 6) if kind == "jaccard" else F.greatest(q, d) - c
    scored = reduce(DataFrame.unionByName, parts).select("item_id", "doc_id", dist.alias("dist"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("dist", "doc_id"))
    return scored.withColumn("rnk", rank).where(F.col("rnk") <= k)


def _neighbour_query(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        found = token_neighbours(items.withColumn("item_id", F.col("item_id").cast("string")), _docs(spark, sf_dir), kind)
        return found.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))

    return query


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task metrics of texts: the lines of a turn as true lines, those of the next one as predictions; tokens are words."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.split("text", "\n").alias("lines"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("lines").alias("pred"))
    both = _spread(turns.join(after, ["conv_id", "turn"]))
    words = lambda x: T.words(x)
    rows = both.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("sample_id"), F.transform("lines", lambda x: F.array(x)).alias("gt"), "pred",
        F.transform("lines", lambda x: F.array(words(x))).alias("gt_tokens"), F.transform("pred", words).alias("pred_tokens"),
    )
    found = tasks.compared_texts(rows, [{"name": n} for n in ("text_levenshtein", "text_jaccard", "text_token_bag_dist")])
    return found.select(F.expr(f"sample_id div {TURNS}").alias("conv_id"), F.pmod("sample_id", F.lit(TURNS)).cast("int").alias("turn"), "metric", F.round("value", 6).alias("value"))


QUERIES = {"bpe_vocab": bpe_vocab, "bpe_encode": bpe_encode, "bpe_roundtrip": bpe_roundtrip, "editex_pairs": editex_pairs, "text_jaccard_topk": _neighbour_query("jaccard"), "text_bag_topk": _neighbour_query("bag"), "text_metrics": text_metrics}

_WORDS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) AS word"


def _neighbours(dist: str) -> str:
    return f"""WITH q AS (SELECT item_id, word, count(*) AS kq FROM (SELECT item_id, {_WORDS} FROM benchmark) GROUP BY 1, 2), d AS (SELECT doc_id, word, count(*) AS kd FROM (SELECT doc_id, {_WORDS} FROM documents) GROUP BY 1, 2),
 c AS (SELECT item_id, doc_id, sum(least(kq, kd)) AS common FROM q JOIN d USING (word) GROUP BY 1, 2), s AS (SELECT item_id, doc_id, {dist} AS dist FROM c JOIN (SELECT item_id, sum(kq) AS nq FROM q GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, sum(kd) AS nd FROM d GROUP BY 1) USING (doc_id))
 SELECT * FROM (SELECT item_id, doc_id, dist, CAST(row_number() OVER (PARTITION BY item_id ORDER BY dist, doc_id) AS INT) AS rnk FROM s) WHERE rnk <= 10"""


# The subword model of the documents in SQL: its vocabularies, the pattern of pieces, and what each distinct word becomes.
_MODEL = r"""WITH counted AS (SELECT word, count(*) AS cnt FROM (SELECT WORDS FROM documents) GROUP BY word),
 words AS (SELECT '__pad' AS token, 0 AS id UNION ALL SELECT '__unk', 1 UNION ALL SELECT word, CAST(row_number() OVER (ORDER BY cnt DESC, word) + 1 AS INT) FROM counted QUALIFY row_number() OVER (ORDER BY cnt DESC, word) <= 202),
 rest AS (SELECT word, cnt FROM counted WHERE word NOT IN (SELECT token FROM words)),
 grams AS (SELECT substring(word, s, n) AS gram, cnt FROM (SELECT word, cnt, n, unnest(range(1, length(word) - n + 2)) AS s FROM (SELECT word, cnt, unnest(range(1, least(8, length(word)) + 1)) AS n FROM rest))),
 pieces AS (SELECT '__sow' AS piece, 204 AS id, 0 AS size UNION ALL SELECT '__eow', 205, 0 UNION ALL SELECT gram, CAST(205 + row_number() OVER (ORDER BY sum(cnt) DESC, gram) AS INT), length(gram) FROM grams GROUP BY gram QUALIFY row_number() OVER (ORDER BY sum(cnt) DESC, gram) <= 50),
 cut AS (SELECT string_agg(regexp_replace(piece, '([!-/:-@\[-`{-~])', '\\\1', 'g'), '|' ORDER BY size DESC, piece) || '|.' AS pattern FROM pieces WHERE size > 0),
 parts AS (SELECT word, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (SELECT word, regexp_extract_all(word, '(?s)' || pattern) AS ps FROM rest, cut)),
 split AS (SELECT word, '204,' || string_agg(CAST(coalesce(p.id, 1) AS VARCHAR), ',' ORDER BY k) || ',205' AS ids, string_agg(CASE WHEN p.id IS NULL THEN '__unk' ELSE piece END, '' ORDER BY k) AS shown FROM parts LEFT JOIN (SELECT * FROM pieces WHERE size > 0) p USING (piece) GROUP BY word UNION ALL SELECT token, CAST(id AS VARCHAR), token FROM words),
 placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, LIST AS ws FROM documents))""".replace("WORDS", _WORDS).replace("LIST", _WORDS.removeprefix("unnest(").removesuffix(") AS word"))

ORACLES = {"text_jaccard_topk": _neighbours("round(1 - CAST(common AS DOUBLE) / (nq + nd - common), 6)"), "text_bag_topk": _neighbours("CAST(greatest(nq - common, nd - common) AS BIGINT)"),
    "bpe_vocab": _MODEL + " SELECT 'word' AS kind, token, id FROM words UNION ALL SELECT 'piece', piece, id FROM pieces",
    "bpe_encode": _MODEL + " SELECT d.doc_id, coalesce(string_agg(ids, ',' ORDER BY i), '') AS ids FROM documents d LEFT JOIN placed p ON p.doc_id = d.doc_id LEFT JOIN split USING (word) GROUP BY d.doc_id",
    "bpe_roundtrip": _MODEL + " SELECT doc_id, decoded, decoded = plain AS same FROM (SELECT d.doc_id, coalesce(string_agg(shown, ' ' ORDER BY i), '') AS decoded, coalesce(string_agg(word, ' ' ORDER BY i), '') AS plain FROM documents d LEFT JOIN placed p ON p.doc_id = d.doc_id LEFT JOIN split USING (word) GROUP BY d.doc_id)",
    "text_metrics": f"""WITH l AS (SELECT conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)),
 n AS (SELECT conv_id, turn, count(*) AS n FROM l GROUP BY ALL), w AS (SELECT conv_id, turn, i, word, count(*) AS k FROM (SELECT conv_id, turn, i, {_WORDS.replace("text", "line")} FROM l) GROUP BY ALL), z AS (SELECT conv_id, turn, i, sum(k) AS n FROM w GROUP BY ALL),
 p AS (SELECT a.conv_id, a.turn, a.i AS ia, b.i AS ib, levenshtein({templates.DUCK["chars"].replace("{col}", "a.line")}, {templates.DUCK["chars"].replace("{col}", "b.line")}) AS lev FROM l a JOIN l b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
 c AS (SELECT a.conv_id, a.turn, a.i AS ia, b.i AS ib, sum(least(a.k, b.k)) AS common FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word GROUP BY ALL),
 s AS (SELECT p.conv_id, p.turn, p.ib, max(lev) AS text_levenshtein, max(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1 ELSE coalesce(common, 0) / CAST(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(common, 0) AS DOUBLE) END) AS text_jaccard, max(greatest(coalesce(x.n, 0), coalesce(y.n, 0)) - coalesce(common, 0)) AS text_token_bag_dist
   FROM p LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn AND c.ia = p.ia AND c.ib = p.ib LEFT JOIN z x ON x.conv_id = p.conv_id AND x.turn = p.turn AND x.i = p.ia LEFT JOIN z y ON y.conv_id = p.conv_id AND y.turn = p.turn + 1 AND y.i = p.ib GROUP BY ALL),
 t AS (SELECT s.conv_id, s.turn, least(any_value(a.n), any_value(b.n)) AS n, sum(text_levenshtein) AS lev, sum(text_jaccard) AS jac, sum(text_token_bag_dist) AS bag FROM s JOIN n a ON a.conv_id = s.conv_id AND a.turn = s.turn JOIN n b ON b.conv_id = s.conv_id AND b.turn = s.turn + 1 GROUP BY s.conv_id, s.turn)
 SELECT conv_id, CAST(turn AS INT) AS turn, unnest(['text_levenshtein', 'text_jaccard', 'text_token_bag_dist']) AS metric, round(unnest([CAST(lev AS DOUBLE), jac, CAST(bag AS DOUBLE)]) / n, 6) AS value FROM t""",
}
