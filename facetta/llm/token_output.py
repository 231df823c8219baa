"""Token ids as canonical, length-limited Huffman code in independent blocks.

Texts are encoded to ids, ids are counted over all documents, and package-merge gives each id a code of at
most ``max_bits`` bits. Documents go to shards by ascending id; a shard is a run of blocks of whole documents.
Each block stands alone: its payload, the bit offset of every ``every``-th id (checkpoints) and its documents.
Reading decodes all checkpoints of a batch side by side with one lookup table.

File format (a folder): ``format`` (one row: version, every, end id, id bytes, vocabulary size and SHA-256 of the
tokenizer's file), ``codes`` (id, bits), ``blocks`` (shard, block, start in the shard, n_tokens, doc_ids, doc_tokens,
checkpoints, payload, payload_crc32). Readers take their parameters from the folder.

Defined cases: a null or empty text is the end id alone. Very long texts are encoded whole; a block is at least one
document. Repeated ids are documents of their own, in the order of their text's hash; equal rows are dealt apart by
their place in the encoded files. A null doc_id comes first. An empty table writes no blocks. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetta.llm.common import by_batch, new_path, remove, row_hash, stored, utf8

END = 2
BLOCK_TOKENS = 1 << 16
EVERY = 256
MAX_BITS = 18
#: Blocks that a shard (one writer, one file) should have, and the most shards of a folder.
SHARD_BLOCKS = 32
MOST_SHARDS = 1 << 14
VERSION = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A piece of letters that neither composition nor context can change, and signs that make a token run of their own.
SIGNS = b".,;:!?|$%&*#"
PLAIN = re.compile(rb"((?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+)([.,;:!?|$%&*#]*)")


#: What an encoder tries both ways before it trusts pieces.
PROBE = "The quick Brown fox, don't JUMP!? Ünï cödé straße ÈAUX x×y a.b #tag $5.00 99 — 's A\u030A ab#$c  two\tthree\nfour (five) [six] <seven> I'll we've THNTBLE,| éé É"


class PieceEncoder:
    """Encodes by pieces between ASCII white space, which no token of the vocabulary crosses, and remembers pieces.

    That is right for vocabularies of lower-cased words with marked word ends; for a tokenizer that gives other ids
    so for ``PROBE``, texts are encoded whole.

    Pieces of plain letters with signs behind are encoded by their lower-cased letters, which many pieces share.
    The memory stops growing at its bound, for composed pieces sooner than for letters; what comes later is encoded
    each time it is met.
    """

    def __init__(self, path: str, most: int = 1_000_000, at_once: int = 1 << 21) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.at_once = Tokenizer.from_file(path), most, at_once
        n = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.whole = False
        plain = np.array(self.tokenizer.encode(PROBE, add_special_tokens=False).ids, self.kind).tobytes()
        try:
            self.whole = self.encode(PROBE.encode(), b"") != plain or self.encode(PROBE.upper().encode(), b"") != np.array(self.tokenizer.encode(PROBE.upper(), add_special_tokens=False).ids, self.kind).tobytes()
        except (ValueError, IndexError):
            self.whole = True

    def of_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Any pieces, encoded together; word numbers tell whose ids they are."""
        if not pieces:
            return {}
        found = self.tokenizer.encode([p.decode("utf8") for p in pieces], is_pretokenized=True, add_special_tokens=False)
        ids, of = np.array(found.ids, self.kind), np.array(found.word_ids, np.int64)
        return self.cut(pieces, ids, np.searchsorted(of, np.arange(len(pieces) + 1)))

    def of_cores(self, cores: list[bytes]) -> dict[bytes, bytes]:
        """Plain letters, encoded as one text; each ends with the only id that ends a word."""
        found: dict[bytes, bytes] = {}
        for i in range(0, len(cores), 4096):
            part = cores[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf8")], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
            found |= self.cut(part, ids, cuts) if len(cuts) == len(part) + 1 else self.of_pieces(part)
        return found

    def cut(self, pieces: list[bytes], ids: np.ndarray, cuts: np.ndarray) -> dict[bytes, bytes]:
        data, at = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
        return {p: data[a:b] for p, a, b in zip(pieces, at[:-1], at[1:])}

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        other, waiting, known, tails, found = [], [], self.known, self.tails, {}
        match = PLAIN.fullmatch
        bare = {p for p in pieces if p.isalpha() and p.islower()}  # their own letters, and not known
        for p in pieces - bare:
            core = p.rstrip(SIGNS)
            if core.isalpha():  # ASCII letters
                tail, core = p[len(core) :], core.lower()
            else:
                m = match(p)
                if m is None:
                    other.append(p)
                    continue
                core, tail = m.groups()
                core = core.lower() if core.isascii() else core.decode("utf8").lower().encode()
            if tail not in tails:
                tails |= self.of_pieces([tail])
            if core in known:
                found[p] = known[core] + tails[tail]
            else:
                bare.add(core)
                waiting.append((p, core, tail))
        fresh = self.of_cores(list(bare))
        for p, core, tail in waiting:
            found[p] = fresh[core] + tails[tail]
        found |= self.of_pieces(other)
        if len(known) + len(fresh) <= self.most:
            known.update(fresh)
        if len(known) + len(found) <= self.most // 2:
            known.update(found)
        return fresh | found

    def encode_many(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """The ids of each text and the end id; new pieces of about ``at_once`` bytes of text are learned together."""
        out: list[bytes] = []
        if self.whole:
            return [np.array(self.tokenizer.encode(t.decode("utf8"), add_special_tokens=False).ids, self.kind).tobytes() + end for t in texts]
        known, i = self.known.get, 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= self.at_once):
                size += len(texts[j])
                j += 1
            missing: set[bytes] = set()
            group = []
            for text in texts[i:j]:
                # lower case gives the same ids, but for names of special tokens and letters before marks (U+0300 to U+037F)
                pieces = (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split()
                ids = list(map(known, pieces))
                gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
                missing.update([pieces[k] for k in gaps])
                group.append((ids, [(k, pieces[k]) for k in gaps]))
            late = self.learn(missing) if missing else {}
            for ids, gaps in group:
                for k, piece in gaps:
                    ids[k] = late[piece]
                out.append(b"".join(ids) + end)
            i = j
        return out

    def encode(self, data: bytes, end: bytes) -> bytes:
        return self.encode_many([data], end)[0]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, h and ids (little-endian, two bytes each where the vocabulary allows it)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        stop = np.array([end], enc.kind).tobytes()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(enc.encode_many([x or b"" for x in utf8(batch.column(2))], stop), pa.binary())], names=["doc_id", "h", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("h"), "text")
    return by_batch(rows, one, "doc_id long, h long, ids binary", 1024)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Package-merge: bits of each symbol, 0 for those that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit in {max_bits} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    is_leaf, packages = [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        is_leaf.append(at < n)
        merged = merged[at]
        pairs = len(merged) // 2
        packages = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    take = 2 * n - 2
    for level in reversed(is_leaf):
        chosen = int(level[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
        if not take:
            break
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    code, bits = 0, 0
    for s in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[s]) - bits
        bits = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


@dataclass(frozen=True)
class Code:
    lengths: np.ndarray
    codes: np.ndarray
    width: int

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        return cls(lengths.astype(np.uint64), canonical_codes(lengths), max(1, int(lengths.max(initial=1))))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next ``width`` bits."""
        symbols, sizes = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.int64)
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        runs = (1 << (self.width - self.lengths[used].astype(np.int64))).astype(np.int64)
        symbols[: runs.sum()] = np.repeat(used, runs)
        sizes[: runs.sum()] = np.repeat(self.lengths[used].astype(np.int64), runs)
        return symbols, sizes


def pack(ids: np.ndarray, code: Code, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """The bit stream, first bit first, and the bit offset of every ``every``-th id."""
    size = code.lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    value = code.codes[ids]
    over = (off + size).astype(np.int64) - 64
    fits = over <= 0
    high = np.where(fits, value << np.where(fits, -over, 0).astype(np.uint64), value >> np.where(fits, 0, over).astype(np.uint64))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] = np.add.reduceat(high, first)
    spill = np.flatnonzero(~fits)
    out[word[spill] + 1] += value[spill] << (64 - over[spill]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::every].astype("<u4")


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], table: tuple[np.ndarray, np.ndarray], width: int, every: int = EVERY) -> list[np.ndarray]:
    """The ids of several blocks; all checkpoints advance together, one table lookup a step."""
    pad = b"\0" * 8
    data = np.frombuffer(b"".join(p + pad for p in payloads), np.uint8).astype(np.uint32)
    four = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    bases = np.cumsum([0, *(len(p) + 8 for p in payloads)])[:-1]
    at = np.concatenate([c.astype(np.int64) + b * 8 for c, b in zip(checkpoints, bases)])
    symbols, lengths = table
    out = np.empty((every, len(at)), np.uint32)
    last, shift = len(four) * 8 - 8, np.uint32(32 - width)
    for i in range(every):
        key = (four[at >> 3] << (at & 7).astype(np.uint32)) >> shift
        out[i] = symbols[key]
        at = np.minimum(at + lengths[key], last)
    lanes = np.cumsum([0, *(len(c) for c in checkpoints)])
    return [out[:, a:b].T.ravel()[:n] for a, b, n in zip(lanes[:-1], lanes[1:], sizes)]


def global_counts(tokens: DataFrame, kind: str, n_symbols: int) -> np.ndarray:
    """How often each id occurs; one row for each id reaches the driver, bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(n_symbols, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(i, 512).to_pylist()), kind), minlength=n_symbols)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_symbols, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, max_bits: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS, every: int = EVERY) -> None:
    """Encode every text and write the file format to ``path``."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    kind, n_symbols = encoder(tokenizer).kind.str, encoder(tokenizer).tokenizer.get_vocab_size()
    spilled = new_path(spark, "tokens")
    encoded(docs, tokenizer, end).write.option("compression", "zstd").parquet(spilled)
    tokens = spark.read.parquet(spilled)
    counts = global_counts(tokens, kind, n_symbols)
    lengths = code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    with open(tokenizer, "rb") as f:
        facts = (VERSION, every, end, np.dtype(kind).itemsize, n_symbols, hashlib.sha256(f.read()).hexdigest())
    spark.createDataFrame([facts], FORMAT).coalesce(1).write.parquet(f"{path}/format")
    shared = spark.sparkContext.broadcast(Code.of(lengths))

    def blocks(batches):
        code, shard, n, start = shared.value, TaskContext.get().partitionId(), 0, 0
        ids, names, sizes = [], [], []

        def flush():
            stream = np.concatenate(ids)
            payload, marks = pack(stream, code, every)
            columns = [[shard], [n], [start], [len(stream)], [names], [sizes], [marks.tobytes()], [payload], [zlib.crc32(payload)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

        held = 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(data.as_py(), kind)
                if held and held + len(one) > block_tokens:
                    yield flush()
                    n, start, held, ids, names, sizes = n + 1, start + held, 0, [], [], []
                ids.append(one)
                names.append(doc_id)
                sizes.append(len(one))
                held += len(one)
        if held:
            yield flush()

    shards = min(MOST_SHARDS, max(1, -(-int(counts.sum()) // (SHARD_BLOCKS * block_tokens))))
    order = ("doc_id", "h", "at")
    placed = tokens.select("doc_id", "h", "ids", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("at")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    placed.select("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, spilled)


NAMES = ["shard", "block", "start", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "payload", "payload_crc32"]
FORMAT = "version int, every int, end_id int, id_bytes int, vocabulary int, tokenizer_sha256 string"
BLOCKS = "shard int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, payload binary, payload_crc32 long"


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids themselves if asked for."""
    facts = spark.read.parquet(f"{path}/format").first()
    if facts.version != VERSION:
        raise ValueError(f"token files of version {facts.version}")
    every = facts.every
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    lengths = np.zeros(int(max(codes["id"].to_pylist(), default=0)) + 1, np.uint8)
    lengths[codes["id"].to_numpy()] = codes["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(Code.of(lengths))
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases, _ = stored(spark, totals.select("shard", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base")), "token-shards")

    def run(batches):
        code = shared.value
        table = code.table()
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                rows = batch.slice(i, 16).to_pylist()
                for r in rows:
                    if zlib.crc32(r["payload"]) != r["payload_crc32"]:
                        raise ValueError(f"shard {r['shard']}, block {r['block']} is damaged")
                found = unpack([r["payload"] for r in rows], [np.frombuffer(r["checkpoints"], "<u4") for r in rows], [r["n_tokens"] for r in rows], table, code.width, every)
                out = []
                for r, ids in zip(rows, found):
                    at, wide = 0, ids.astype("<u4")
                    for doc_id, n in zip(r["doc_ids"], r["doc_tokens"]):
                        data = wide[at : at + n].tobytes()
                        out.append((doc_id, r["base"] + r["start"] + at, n, zlib.crc32(data), data if keep_ids else None))
                        at += n
                columns = list(zip(*out))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    joined = blocks.join(F.broadcast(bases), "shard")  # a row for each shard, that is each output partition
    found = joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found if keep_ids else found.drop("ids")


def token_records(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents to the shared folder, read them back: one row for each document."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
