import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintmill.llm.warc import MARK, chunked, dechunked, page_facts, read_records, reassemble, round_trip, write_archive

BIG = "abc" * 50 + "WARC/1.1\r\nWARC-Type: response\r\n" + "z" * 300
ROWS = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (4, "u\n v", "x" * 99), (5, "u", "x" * 99), (6, "http://x/WARC/1.0", None), (7, "q", ""),
        (None, "n", BIG), (8, "h", "é" * 5000), (9, "h", "é" * 5000), (9, "h", "é" * 5000), (8, "h", "é" * 5000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("segment", [700, 1 << 20])
def test_round_trip(spark, pages, segment):
    whole = round_trip(pages, segment=segment)
    assert whole.where("not complete").count() == 0
    expected = []
    for page, _, text in ROWS:
        data = (text or "").encode()
        first = min((p for p, _, t in ROWS if (t or "") == (text or "") and p is not None), default=None) if len(data) >= 100 else page
        kind = "response" if page == first else "revisit"
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, first if kind == "revisit" else None))
    assert Counter(map(tuple, page_facts(whole).collect())) == Counter(expected)


def test_archives_are_plain_warc(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "w"), segment=700)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    at, types = 0, Counter()
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        assert data[at:end].startswith(b"WARC/1.1\r\n")
        at = end + 4 + int(fields["Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        types[fields["WARC-Type"]] += 1
    assert types["response"] == 7 and types["revisit"] == 5 and types["continuation"] == 28


def test_missing_and_wrong_segments_are_told(spark, pages, tmp_path):
    write_archive(pages.where("page_id = 8").limit(1), str(tmp_path / "w"), segment=700)
    records = read_records(spark, str(tmp_path / "w"))
    assert [r.complete for r in reassemble(records).collect()] == [True]
    assert [r.complete for r in reassemble(records.unionByName(records)).collect()] == [True]  # stored twice
    for lost in (2, 5):
        rest = reassemble(records.where(F.coalesce("segment", F.lit(0)) != lost)).collect()
        assert [(r.complete, r.payload) for r in rest] == [(False, None)]


def test_framing():
    for data in (b"", b"x", MARK * 5000, bytes(range(256)) * 300):
        assert dechunked(chunked(data, 64)) == data and MARK not in chunked(data, 64)
    assert dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert dechunked(b"5\r\nhel") is None and dechunked(b"zz\r\n") is None and dechunked(b"") is None


def test_no_pages(spark, pages):
    assert page_facts(round_trip(pages.where("false"))).count() == 0
