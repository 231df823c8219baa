import base64
import collections
import gzip
import glob
import hashlib

import pytest

from facetta.llm import warc


def plain(rows):
    by = collections.defaultdict(list)
    for p, _, h in rows:
        by[(h or "")].append(p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        last = max((x for x in by[h or ""] if x is not None), default=None)
        again = len(by[h or ""]) > 1 and p != last
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    return collections.Counter(out)


def rows_of(pages):
    return [(r.page_id, r.url, r.html) for r in pages.select("page_id", "url", "html").collect()]


EDGES = [(1, "http://a/", None), (2, None, ""), (3, "http://b/\r\nX: y é", "<p>x</p>\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "long " * 60_000), (5, "u", "long " * 60_000), (6, "u", "é" * 70_000), (6, "u", "é" * 70_000), (None, "n", "none"), (7, "n", "none"), (8, "u", "0\r\n\r\n"), (9, "q", "same"), (9, "q", "same"), (10, "q", "same")]


def test_round_trip(spark, sf):
    edges = spark.createDataFrame([(*r, 0, "x") for r in EDGES], "page_id long, url string, html string, refers_to int, payload string")
    for pages in (edges, spark.read.parquet(f"{sf}/pages.parquet")):
        assert collections.Counter(tuple(r) for r in warc.warc_round_trip(pages).collect()) == plain(rows_of(pages))
    assert warc.warc_round_trip(edges.limit(0)).collect() == []


def test_payloads_and_small_segments(spark, tmp_path):
    pages = spark.createDataFrame(EDGES, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, str(tmp_path / "w"), segment=1000, per_file=7)
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(EDGES) and all(r.verified for r in got)
    texts = {p: (h or "").encode() for p, _, h in EDGES}
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert bytes(r.payload) == texts[r.page_id]
    assert len(glob.glob(str(tmp_path / "w/part-*"))) > 20
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids) and all(i.startswith("<urn:uuid:") for i in ids)
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    for r in got:
        if r.record_type == "revisit":
            assert responses[r.refers_to_id].page_id == r.refers_to if r.refers_to_id else sum(x.page_id == r.refers_to for x in responses.values()) > 1


def test_files_are_plain_warc(spark, tmp_path):
    """A file is gzip as a whole, and each record a member that a reader can seek to."""
    warc.write_warc(spark.createDataFrame(EDGES[2:4], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    (name,) = glob.glob(str(tmp_path / "w/part-*"))
    raw = open(name, "rb").read()
    data = gzip.decompress(raw)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://b/%0D%0AX:%20y%20\xc3\xa9\r\n" in data
    each = list(warc.members(raw))
    assert each[-1] == b"" and all(len(list(warc.parsed(m))) == 1 for m in each[:-1]) and b"".join(each) == data


def test_missing_segment_is_seen(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(4, "u", "long " * 9000)], "page_id long, url string, html string"), str(tmp_path / "w"), segment=10_000, per_file=1)
    names = sorted(glob.glob(str(tmp_path / "w/part-*")))
    for name in names:
        if b"Segment-Number: 3" in gzip.open(name).read():
            open(name, "wb").write(gzip.compress(b""))
    for crc in glob.glob(str(tmp_path / "w/.*.crc")):
        __import__("os").remove(crc)
    assert [r.verified for r in warc.read_warc(spark, str(tmp_path / "w")).collect()] == [False]


def foreign(kind, number, block, *fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", *fields, f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Records of other types and writers: without a digest, with one of another kind, with false framing; compressed by record, as a whole, or not."""
    http = "Content-Type: application/http; msgtype=response"
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    sha = base64.b32encode(hashlib.sha1(b"<p>hello</p>").digest()).decode()
    records = [
        foreign("warcinfo", 1, b"software: other\r\n", "Content-Type: application/warc-fields"),
        foreign("request", 2, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("response", 3, page, http, f"warc-payload-digest: SHA1:{sha.lower()}", "WARC-Target-URI: http://x/"),
        foreign("response", 4, page.replace(b"hello", b"jello"), http, f"WARC-Payload-Digest: sha1:{sha}"),
        foreign("response", 5, page.replace(b"\r\n\r\n", b"\r\nTransfer-Encoding: chunked\r\n\r\n", 1), http, f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'<p>hello</p>').hexdigest()}"),
        foreign("metadata", 6, b"via: http://y/", "WARC-Payload-Digest: md5:00"),
        foreign("resource", 7, b""),
        foreign("continuation", 8, b"lost", "WARC-Segment-Origin-ID: <urn:uuid:99>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 9"),
    ]
    for i, data in enumerate([b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), b"\r\n" + b"".join(records)]):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(data)
        got = sorted(warc.read_warc(spark, str(folder), pattern="*.warc.gz").collect(), key=lambda r: r.record_id)
        assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "response", "metadata", "resource"]
        assert [r.verified for r in got] == [None, None, True, False, True, None, None]
        assert [bytes(r.payload) for r in got] == [b"software: other\r\n", b"", b"<p>hello</p>", b"<p>jello</p>", b"<p>hello</p>", b"via: http://y/", b""]
        assert got[2].url == "http://x/" and got[2].page_id is None and [r.payload_bytes for r in got] == [len(r.payload) for r in got]


def test_framing():
    for data in (b"", b"a", b"\r\n0\r\n", bytes(range(256)) * 300):
        assert warc.dechunked(warc.chunked(data, 999)) == data
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
