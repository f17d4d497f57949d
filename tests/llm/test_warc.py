"""Archives are read back exactly, whatever payloads hold and wherever files are split."""

import hashlib

import pytest

from loomtide.llm import warc
from loomtide.llm.common import shared_path

MAGIC = warc.MAGIC
INNER = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "u1", "a" * 1500), (2, "u2", "a" * 1500), (3, None, "a" * 1500), (4, "u4", None), (5, "x\r\ny", ""), (6, "u", "a" * 999), (7, "u", "a" * 999),
    (8, "u", f"before {MAGIC} after"), (9, "u", INNER), (10, "u", INNER * 3 + MAGIC), (11, "u", MAGIC), (12, "u", MAGIC * 40 + "é" * 700), (13, "u", "\r\n\r\n"),
    (16, "http://b/\u2028Content-Length: 5", "line separator"), (17, "a\u2029Content-Length: 5\x85WARC-Type: x", "more"), (18, " \tu\x0b\x0cé ", "spaces"), (19, "u\nContent-Length: 1\r\n\r\n", "q" * 300_000),
    (None, "u", "no id"), (14, "u", "same row"), (14, "u", "same row"), (15, "u", "z" * 5000 + INNER),
] + [(100 + i, "u", f"page {i} " * (i % 40)) for i in range(300)]
SCHEMA = "page_id long, url string, html string, value string, file string"


def expected(pages):
    keeper = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000:
            keeper[h] = max(keeper.get(h, -1), i)
    out = []
    for i, _, h in pages:
        raw, k = (h or "").encode(), keeper.get(h)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if k not in (None, i) else "response", k if k not in (None, i) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["1k", "7k", "128m"])
def test_round_trip_over_any_split(spark, split):
    path = shared_path(spark, "test-warc")
    pages = spark.createDataFrame([(*p, "v", "f") for p in PAGES], SCHEMA)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write(pages.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert sorted((tuple(r) for r in warc.digests(warc.read(spark, path, warc.DIGESTS)).collect()), key=str) == expected(PAGES)
        urls = {r["page_id"]: r["url"] for r in warc.read(spark, path).collect()}
        payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path).where("record_type = 'response'").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert payloads[10] == INNER * 3 + MAGIC and payloads[12] == MAGIC * 40 + "é" * 700
    assert payloads[3] == "a" * 1500 and 999 not in payloads and payloads[19] == "q" * 300_000
    assert urls[16] == "http://b/%E2%80%A8Content-Length:%205" and urls[18] == "%20%09u%0B%0Cé%20" and urls[3] is None


def test_headers_of_the_format(spark):
    path = shared_path(spark, "test-warc")
    pages = spark.createDataFrame([(1, "u", "a" * 1500), (2, "u", "a" * 1500)], "page_id long, url string, html string")
    warc.write(pages, path, date="2020-01-02T03:04:05Z")
    raw = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date: 2020-01-02T03:04:05Z", "Content-Length", "WARC-Target-URI"):
        assert raw.count(f"\r\n{name}") == 2
    assert raw.count(f"WARC-Profile: {warc.PROFILE}\r\nWARC-Refers-To: <urn:page:2>") == 1 and raw.count("a" * 1500) == 1


def test_a_payload_that_half_of_the_pages_have(spark):
    """And digests that the bits can't tell from it are no revisits."""
    path = shared_path(spark, "test-warc")
    pages = [(i, "u", "hot " * 300 if i % 2 else f"{i} " * 400) for i in range(3000)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6), path)
    assert sorted((tuple(r) for r in warc.digests(warc.read(spark, path, warc.DIGESTS)).collect()), key=str) == expected(pages)


def test_no_pages(spark):
    path = shared_path(spark, "test-warc")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.digests(warc.read(spark, path, warc.DIGESTS)).collect() == []
