import gzip
import hashlib
import random
from urllib.parse import urlparse

import pyarrow
import pytest
from helpers import same
from meridion.llm import warc
from meridion.llm.warc import OP11_SQL, op11_warc, read_archives, write_archives
from pyspark.sql import functions as F

LONG = "<p>twice</p>" * 200
PAGES = [
    (1, "http://a/", LONG),
    (2, "http://b/", LONG),
    (None, "http://c/", LONG),
    (3, None, None),
    (4, "http://d/\r\nX-Evil: 1", "short"),
    (5, "http://e/", "short"),
    (6, "http://é/", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n"),
    (7, "http://f/", ""),
    (8, "http://g/", "y" * 2_000_000),
    *[(9, "http://h/", "row" * 500)] * 3,
]


def want(rows):
    top = {}
    for k, _, t in rows:
        top[t] = max(filter(None, (top.get(t), k)), default=None)
    out = []
    for k, _, t in rows:
        raw = (t or "").encode()
        first = top[t] if len(raw) >= 1000 else k
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if k == first else "revisit", None if k == first else first))
    return sorted(out, key=str)


def got(files, size, payloads=False):
    found = read_archives(files, size, payloads).where("record_type <> 'warcinfo'")
    number = lambda c: F.element_at("headers", c).cast("long")
    return sorted((tuple(r) for r in found.select(number("x-page-id"), "payload_bytes", "payload_digest", "record_type", number("x-refers-to-page-id")).collect()), key=str)


@pytest.fixture(scope="module")
def files(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest", "3 AS length").repartition(3)
    return write_archives(df, file_bytes=3000)


@pytest.mark.parametrize("size", [900, 1 << 24])
def test_nulls_repeats_and_long_payloads_at_any_range(files, size):
    assert files.count() > 3
    assert got(files, size) == want(PAGES)


def test_any_gzip_reader_reads_the_archives(files):
    texts = [gzip.open(urlparse(r.file).path).read() for r in files.collect()]
    assert sum(t.count(b"\r\nWARC-Type: ") for t in texts) == len(PAGES) + len(texts)
    assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts)
    assert not any(b"\nX-Evil" in t for t in texts)


def test_payloads_come_back(files):
    back = {r.k: r.payload for r in read_archives(files, 500).where("record_type = 'response'").select(F.element_at("headers", "x-page-id").alias("k"), "payload").collect()}
    assert back["6"].decode() == PAGES[6][2] and back["8"] == b"y" * 2_000_000 and back["3"] == b""


def test_no_pages_give_no_files(spark):
    files = write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert files.count() == 0 and read_archives(files).count() == 0


def test_false_magic_and_damage_are_passed_over(spark, tmp_path):
    rng = random.Random(3)
    noise = b"".join(warc._MAGIC + rng.randbytes(rng.randint(0, 40)) for _ in range(60))
    whole = [warc.member("resource", [("WARC-Record-ID", f"<urn:x:{k}>")], noise, level=0) for k in range(8)]
    torn = whole[0][:-300]
    other = gzip.compress(b"no record")
    raw = noise + whole[0] + other + whole[1] + torn + b"".join(whole[2:]) + warc._MAGIC
    (tmp_path / "a.warc.gz").write_bytes(raw)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(raw))], "file string, bytes long")
    for size in (1500, len(raw)):
        found = read_archives(files, size).collect()
        assert sorted(r.headers["warc-record-id"] for r in found) == [f"<urn:x:{k}>" for k in range(8)]
        assert {r.payload for r in found} == {noise}
        assert all(raw[r.offset : r.offset + 3] == warc._MAGIC for r in found)
    for size in (1, 7, 97):  # without a job for so many ranges
        source = warc._Bytes(pyarrow.BufferReader(raw), len(raw))
        found = [h["warc-record-id"] for k in range(0, len(raw), size) for _, h, _ in warc.records_in(source, k, min(k + size, len(raw)))]
        assert found == [f"<urn:x:{k}>" for k in range(8)]


def test_a_payload_with_most_rows_is_joined_apart(spark, monkeypatch):
    rows = [(k, f"http://{k}/", LONG if k % 3 else f"{LONG}{k % 50}") for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for share in (2, 1024):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        assert got(write_archives(df), 5000) == want(rows)


def test_query_equals_sql(spark, sf_dir):
    same(op11_warc(spark, sf_dir), sf_dir, OP11_SQL, ("pages",))
