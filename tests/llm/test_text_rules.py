"""Quality rules, URL filter and quality classifier against plain versions."""

import base64
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from facetta.llm import quality_classifier, quality_rules, url_filter
from tests.llm.conftest import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    data, bands = text.encode(), quality_rules.Bands()
    shrink = lambda x: len(zstandard.compress(x, 3)) / len(x)
    ratio = shrink(data) if data else 0
    low, high = [(a, b) for least, a, b in bands.whole if len(data) >= least][-1]
    good = low <= ratio <= high
    for size, (low, high) in ((4096, bands.chunk), (512, bands.part)):
        if len(data) > size:
            ends = sorted({*range(size, len(data), size), len(data)})
            good &= sum(not low <= shrink(data[e - size : e]) <= high for e in ends) <= len(ends) / 4
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed, bool(not failed and good)


def test_rules_match_plain(spark, sf, edge_docs):
    for docs in (edge_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = collections.Counter((r.doc_id, *plain_rules(r.text)) for r in docs.select("doc_id", "text").collect())
        got = collections.Counter(tuple(r)[:8] for r in quality_rules.compression_quality(docs).collect())
        assert got == want


def test_rules_reject_repetition_and_noise(spark):
    random.seed(3)
    noise = " ".join("".join(chr(random.randint(33, 126)) for _ in range(12)) for _ in range(200))
    prose = " ".join("".join(random.choice("the an er on re ha in ou ti st".split()) for _ in range(random.randint(1, 4))) for _ in range(400))
    hidden = prose * 1 + " " + " ".join(f"{i % 7}{i % 7}{i % 7}aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{i}" for i in range(900))
    kept = {r.doc_id: r.kept for r in quality_rules.compression_quality(docs_of(spark, [(1, noise, ""), (2, prose, ""), (3, hidden, "")])).collect()}
    assert kept == {1: False, 2: True, 3: False}


def test_rules_reject_short_noise(spark, sf):
    """Base64 in short words from 128 bytes on goes; clean short texts stay."""
    r = random.Random(6)
    noise = [" ".join(base64.b64encode(r.randbytes(9)).decode()[: r.randint(8, 12)] for _ in range(60))[:n] for n in (140, 200, 260, 330, 400, 500, 550)]
    clean = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1"), "doc_id").collect() if 128 <= len(x.text.encode()) < 768]
    rows = {x.doc_id: x for x in quality_rules.compression_quality(docs_of(spark, [(i, t, "") for i, t in enumerate(noise + clean)])).collect()}
    assert not any(rows[i].base_failed or rows[i].kept for i in range(len(noise)))
    assert len(clean) > 30 and all(rows[i].kept or rows[i].base_failed for i in range(len(noise), len(rows)))


def test_rules_judge_every_byte(spark, sf):
    """Noise at the end of a text, or in a text of less than a large chunk, does not hide behind prose."""
    text = " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(60).collect())
    prose = text.encode().decode("ascii", "ignore")
    noise = base64.b64encode(random.Random(5).randbytes(4000)).decode()
    cuts = [(4096, 3900), (8192, 3900), (2000, 2000), (4096, 2048), (700, 500)]
    texts = [prose[:a] + " " + noise[:b] for a, b in cuts] + [prose[: a + b] for a, b in cuts]
    kept = {r.doc_id: r.kept for r in quality_rules.compression_quality(docs_of(spark, [(i, t, "") for i, t in enumerate(texts)])).collect()}
    assert [kept[i] for i in range(10)] == [False] * 5 + [True] * 5


def test_rules_empty(no_docs):
    assert quality_rules.compression_quality(no_docs).collect() == []


def plain_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls_match_plain(spark, sf):
    odd = [None, "", "nothing", "http://", "HTTP://A.NET/x", "http://net", "http://net/", "https://WWW.Example.Com/de/x?y", "x://example.net/en/1#a", "x://badexample.com/de/", "http://a.org/fr/\n?q", "a://b://c.net/", "http://ÄX.org/fr/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd * 2)], "page_id long, url string, rule string")
    for table in (pages, spark.read.parquet(f"{sf}/pages.parquet")):
        got = {r.page_id: r for r in url_filter.url_verdicts(table).collect()}
        assert len(got) == table.count()
        for r in table.collect():
            host, path, rule, verdict = plain_url(r.url)
            assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule)
            assert got[r.page_id].verdict == (verdict or ("block" if got[r.page_id].p_unwanted >= 0.5 else "allow"))
    assert url_filter.url_verdicts(pages.limit(0)).collect() == []


def test_url_model_separates_unseen_hosts():
    model = url_filter.fit_url_model()
    seen = {(h, p) for h, p, _ in url_filter.labelled_urls()}
    rows = sorted({r for seed in range(50, 54) for r in url_filter.labelled_urls(seed) if r[:2] not in seen})
    scores = model.scores([r[0] for r in rows], [r[1] for r in rows])
    label = np.array([r[2] for r in rows])
    assert len(rows) > 1000 and (scores[label == 1] > 0).mean() > 0.9 and (scores[label == 0] < 0).mean() > 0.97
    bad = ["poker-night.example.org", "lotterytown.com", "erotic-films.net", "m.warez-box.example.org"]
    good = ["ththan.example.org", "blog.thered.example.com", "www.mountain-library.org", "m.thther.example.org", "hills.example.com"]
    assert (model.scores(bad, ["/en/5"] * len(bad)) > 0).all()
    assert (model.scores([*good, ""], ["/en/5"] * len(good) + [""]) < 0).all()


def test_url_probability_matches_plain(spark):
    """Each n-gram of host and path by itself, summed in plain Python; very long and odd urls included."""
    model = url_filter.fit_url_model()
    urls = ["http://www.roulette-club.org/a/b?c", "http://library.example.com/", "", None, "http://ÄÖ.net/ü", "http://" + "long-" * 4000 + ".com/" + "x" * 9000, "a://b://c", "http://h/\nline"]
    pages = spark.createDataFrame([(i, u, 0.5) for i, u in enumerate(urls * 2)], "page_id long, url string, p_unwanted double")
    for r in url_filter.url_verdicts(pages).collect():
        total = 0.0
        for kind, part in ((b"h", r.host), (b"p", r.path)):
            data = b"^" + part.encode() + b"$"
            total += sum(float(model.weights[zlib.crc32(kind + data[i : i + n]) % (1 << model.bits)]) for n in model.orders for i in range(len(data) - n + 1))
        z = model.bias + total / max(1.0, (len(r.host) + len(r.path)) * len(model.orders)) ** 0.5
        assert r.p_unwanted == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_classifier_on_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    found = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(found) > 500
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert good.predicted.mean() > 0.98
    assert bad.predicted.mean() < 0.15
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id)


def test_classifier_ignores_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality_classifier.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert one == two


def test_classifier_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, None), (10, None, 0), (None, 1, 1), (12, 0, 0), (12, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.quality_scores(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len(quality_classifier.quality_scores(edge_docs, labels.limit(0)).collect()) == edge_docs.count()
    assert quality_classifier.quality_scores(no_docs, labels).collect() == []
    assert quality_classifier.keep_good(edge_docs, labels).columns == edge_docs.columns


def plain_vote(vectors, labels, v, settings):
    """All similarities in steps of 1e-6, sorted by (similarity, earlier row)."""
    steps = quality_classifier.STEPS
    sims = [round(sum(float(a) * float(b) for a, b in zip(v, w)) * steps) for w in vectors]
    top = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[: settings.k]
    weight = [max(sims[i], 0) / steps for i in top]
    total = sum(w**settings.power for w in weight)
    return sum(w**settings.power * labels[i] for w, i in zip(weight, top)) / total if total else None


def test_exact_cosine_votes():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100 + (i % 2) * 10, 400, dtype=np.uint8)).replace(b"a", b" ") for i in range(60)]
    counts = np.stack([quality_classifier.raw_counts(t) for t in texts])
    labels = np.arange(60) % 2
    settings = quality_classifier.Settings(k=5, rank=8, block=7)
    model = quality_classifier.fit_counts(counts, labels, settings)
    vectors = model.embed(counts)
    for i, got in enumerate(model.score(counts)):
        assert got == pytest.approx(plain_vote(model.vectors, labels, vectors[i], settings), abs=1e-6)


def test_ties_go_to_the_earlier_row_whatever_the_block():
    """Copies with other labels tie at rank k; blocks of any size vote alike."""
    rng = np.random.default_rng(8)
    base = [bytes(rng.integers(97, 110, 300, dtype=np.uint8)).replace(b"b", b" ") for _ in range(12)]
    texts = [base[i % 12] for i in range(120)]
    counts = np.stack([quality_classifier.raw_counts(t) for t in texts])
    labels = rng.integers(0, 2, 120)
    found = []
    for block in (1, 7, 1024):
        settings = quality_classifier.Settings(k=4, rank=8, block=block)
        model = quality_classifier.fit_counts(counts, labels, settings)
        found.append(model.score(counts[:24]))
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()
    for i in range(24):
        assert found[0][i] == pytest.approx(labels[[j for j in range(120) if j % 12 == i % 12][:4]].mean())


def test_whole_table_matches_plain_votes(spark, sf):
    """The query's scores against plain loops over every document and every labelled row."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    settings = quality_classifier.Settings()
    model = quality_classifier.fit(docs, labels, settings)
    got = {(r.doc_id, r.row_hash): r.score for r in quality_classifier.quality_scores(docs, labels).collect()}
    rows = docs.selectExpr("doc_id", "text", "case when text is null then 0 else xxhash64(text) end as h").collect()
    assert len(rows) == docs.count() and len(model.labels) > 50
    for r in rows:
        counts = quality_classifier.raw_counts((r.text or "").encode())[None, :]
        want = plain_vote(model.vectors, model.labels, model.embed(counts)[0], settings) if counts.any() else model.prior
        assert got[r.doc_id, r.h] == pytest.approx(model.prior if want is None else want, abs=1e-5)


def test_cross_validation_never_sees_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    choices = [quality_classifier.Settings(), quality_classifier.Settings(shape=0.0)]
    with_, without = (quality_classifier.cross_validated(docs, x, choices) for x in (labels, labels.filter(~quality_classifier.held_out(labels.doc_id))))
    assert with_ == without and all(0 <= area <= 1 for _, area, _ in with_)
