"""URL filter: explicit rules first, else logistic regression on hashed character n-grams of host and path.

Defined cases: a null url, or one without ``://``, has an empty host and path; no rule fits it and the
model judges the empty string (allowed). Very long urls are judged whole, in memory of their own size. Repeated
rows are judged alike, an empty table gives an empty result, extra columns are ignored. Of rules that fit, the
longest wins, then the one that sorts last.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetta.llm.common import by_batch, lower_ascii

#: (verdict, host, path) of the rules that come before the model.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The labelled table is made by rule. Unwanted subjects are the categories of public blocklists (gambling, medicines, dating
# and adult material, loans, piracy, fraud and malware, link trade) and plain words for them; ordinary subjects are those
# of general sites; some words go with either; invented names are made of common letter groups.
UNWANTED = (
    "gambling poker roulette blackjack bingo lottery jackpot wager sportsbook viagra cialis tablets pharmacy steroids dating hookup porn "
    "erotic escort webcam nude payday loans credit debt warez crack keygen torrent serials pirated phishing malware trojan spyware scam "
    "replica counterfeit popup clickbait backlinks doorway toolbar"
).split()
WANTED = (
    "library museum news times science garden university cooking weather history travel maps physics health books photo music theatre "
    "letters forum river birds math linux language stars hills mill hospital recipes railway painting geology chess forest "
    "pottery harbour village college archive bakery orchard sailing printing weaving botany astronomy poetry records bridges castles skills"
).split()
EITHER = "online best top club world shop store home group service info daily point zone web my the our".split()
LETTERS = "th he in er an re on at en nd ti es or te ed is it al ar st to nt ng ha as ou io le ve co me de hi ri ro ic ne ea ra ce tion ing ent ion her for ter ly sh wh".split()
HOSTS = ("www.{}.com", "{}.com", "{}.org", "{}.net", "www.{}.co.uk", "shop.{}.de", "blog.{}.fr", "{}.example.edu")
PATHS = ("/", "/index.html", "/about", "/2019/05/", "/articles/17", "/list.php")
#: Names that each subject gives, and names made of letter groups.
NAMES, INVENTED = 8, 300


def labelled_urls(seed: int = 3) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block), about 1,300 rows; a function of the seed."""
    r, rows = random.Random(seed), []

    def put(name: str, label: int) -> None:
        path = r.choice(PATHS)
        rows.append((r.choice(HOSTS).format(name), path, label))
        if r.random() < 0.25:
            rows.append(("www.example.org", f"/{name}{path}", label))

    for label, words in ((1, UNWANTED), (0, WANTED)):
        for word in words:
            put(word, label)
            for _ in range(NAMES):
                pair = [word, r.choice(EITHER)]
                r.shuffle(pair)
                put(r.choice(("-", "")).join(pair), label)
    for _ in range(INVENTED):
        put("".join(r.choice(LETTERS) for _ in range(r.choice((2, 2, 3, 4)))), 0)
    return rows


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int
    orders: tuple[int, ...]

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        return np.array([self.bias + self.weights[slots(h, p, self.bits, self.orders)].sum() / norm(h, p, self.orders) for h, p in zip(hosts, paths)])


def slots(host: str, path: str, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Hash slots of the n-grams of host and path, each with its own kind."""
    mask = (1 << bits) - 1
    out = []
    for kind, part in ((b"h", host), (b"p", path)):
        data = b"^" + part.encode("utf8", "replace") + b"$"
        for n in orders:
            out += [zlib.crc32(kind + data[i : i + n]) & mask for i in range(len(data) - n + 1)]
    return np.array(out, np.int64)


def norm(host: str, path: str, orders: tuple[int, ...]) -> float:
    return max(1.0, (len(host) + len(path)) * len(orders)) ** 0.5


def fit_url_model(bits: int = 15, orders: tuple[int, ...] = (2, 3, 4, 5), rounds: int = 1000, rate: float = 0.5, l2: float = 1e-5) -> UrlModel:
    """Full-batch gradient descent; the table is fixed, so reruns give the same weights."""
    rows = labelled_urls()
    y = np.array([r[2] for r in rows], float)
    even = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both labels weigh the same
    found = [slots(h, p, bits, orders) for h, p, _ in rows]
    scale = np.array([1 / norm(h, p, orders) for h, p, _ in rows])
    at, flat = np.repeat(np.arange(len(rows)), [len(x) for x in found]), np.concatenate(found)
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        z = b + np.bincount(at, w[flat], len(rows)) * scale
        g = (1 / (1 + np.exp(-z)) - y) * even
        w -= rate * 40 * (np.bincount(flat, (g * scale)[at], 1 << bits) + l2 * w / 40)
        b -= rate * g.sum()
    return UrlModel(w.astype(np.float32), b, bits, orders)


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def url_verdicts(pages: DataFrame, rules: tuple = RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability that a url is unwanted."""
    model = model or fit_url_model()
    weights = pages.sparkSession.sparkContext.broadcast(model)  # 2^bits floats, whatever the input
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    parts = url_parts(pages).withColumns({"rule": rule, "ruled": verdict})

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = weights.value
        c = batch.to_pydict()
        p = 1 / (1 + np.exp(-m.scores(c["host"], c["path"])))
        said = [r or ("block" if x >= threshold else "allow") for r, x in zip(c["ruled"], p)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(said), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "p_unwanted"])

    return by_batch(parts, one, "page_id long, host string, path string, rule string, verdict string, p_unwanted double")
