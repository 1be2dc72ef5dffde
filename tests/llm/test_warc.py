import base64
import gzip
import hashlib
import io
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from supportlens.llm import queries, warc

SCHEMA = "page_id long, url string, html string, path string, key string"
BIG, OTHER = "<p>équal</p>" * 100, "<p>other</p>" * 100
PAGES = [
    (1, "http://a.example/", BIG), (2, "http://b.example/ x\r\ny", BIG), (3, None, BIG), (4, "u4", "<p>small</p>"),
    (5, "u5", "<p>small</p>"), (6, "u6", None), (7, "u7", ""), (8, "u8", OTHER), (8, "u8b", OTHER), (9, "u9", "x" * 999),
    (10, "u10", "x" * 999), (11, "u11", "y" * 1000), (12, "u12", "y" * 1000), (None, "un", BIG), (None, None, "z" * 2000),
    (None, "n2", "z" * 2000), (13, "WARC/1.1\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n\x1f\x8b\x08"), (-5, "u", "\x00\r\n\r\n" * 400),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "p", None) for i, u, h in PAGES]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def files(pages):
    return warc.write_archives(pages, file_bytes=1500)


def expected(rows):
    groups = defaultdict(list)
    for page_id, html in rows:
        if page_id is not None and len((html or "").encode()) >= 1000:
            groups[html].append(page_id)
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        holder = max(groups.get(html, []), default=None)
        other = holder if holder is not None and holder != page_id else None
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


def found(records):
    rows = records.where("record_type IS DISTINCT FROM 'warcinfo'").select(
        warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to"))
    )
    return sorted(map(tuple, rows.collect()), key=str)


def test_pages_come_back(pages, files):
    records = warc.read_archives(files)
    assert found(records) == expected([(i, h) for i, _, h in PAGES])
    assert found(warc.read_archives(files, payloads=False)) == found(records)
    assert records.where("fault IS NOT NULL").count() == 0
    assert files.agg(F.sum("records")).first()[0] == records.count() and files.count() > 3
    urls = {r["url"] for r in records.collect()}
    assert {None, "http://b.example/%20x%0D%0Ay", "WARC/1.1%0D%0A%0D%0A"} <= urls


def test_restored_payloads_are_the_html(files):
    rows = warc.restored(warc.read_archives(files)).where("record_type <> 'warcinfo'").collect()
    got = sorted((r["payload"] for r in rows), key=bytes)
    assert got == sorted((h or "").encode() for _, _, h in PAGES) and not any(r["fault"] for r in rows)


def test_missing_target_is_named(files):
    records = warc.read_archives(files)
    kept = records.where("record_id IS DISTINCT FROM '<urn:page:12>'")
    faults = {r["record_id"]: r["fault"] for r in warc.restored(kept).where("fault IS NOT NULL").collect()}
    assert faults == {"<urn:page:11>": "payload missing"}


def members(data):
    """The records of an archive, split by the gzip module alone."""
    out, stream = [], io.BytesIO(data)
    whole = gzip.GzipFile(fileobj=stream).read()
    while whole:
        head = whole[: whole.index(b"\r\n\r\n")]
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        at = len(head) + 4
        out.append((head, whole[at : at + size]))
        assert whole[at + size : at + size + 4] == b"\r\n\r\n"
        whole = whole[at + size + 4 :]
    return out


def test_files_follow_the_format(files):
    for row in files.collect():
        data = open(row["path"].removeprefix("file://"), "rb").read()
        assert len(data) == row["bytes"]
        records = members(data)
        assert len(records) == row["records"] == data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")
        assert b"WARC-Type: warcinfo" in records[0][0]
        for head, block in records:
            named = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            assert named[b"WARC-Block-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
            if named[b"WARC-Type"] == b"response":
                payload = block.split(b"\r\n\r\n", 1)[1]
                assert named[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())


def foreign(kind, block, **fields):
    named = {"WARC-Type": kind, "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in fields.items()}}
    lines = "".join(f"{k}: {v}\r\n" for k, v in named.items())
    return gzip.compress(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


def read(spark, tmp_path, data, **options):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    return warc.read_archives(spark.createDataFrame([(str(path),)], "path string"), **options).orderBy("offset").collect()


def test_foreign_records_and_faults(spark, tmp_path):
    body = random.Random(1).randbytes(700_000)
    good = foreign("resource", body, WARC_Block_Digest="SHA-256:" + hashlib.sha256(body).hexdigest(), X_Long="one\r\n two")
    wrong = foreign("resource", b"abc", WARC_Block_Digest="sha1:" + "A" * 32)
    answer = foreign("response", b"HTTP/1.1 200 OK\r\n\r\nabc", Content_Type="application/http", WARC_Payload_Digest="sha1:" + "A" * 32)
    empty = foreign("metadata", b"")
    revisit = foreign("revisit", b"", WARC_Payload_Digest="md5:" + "0" * 32)
    rows = read(spark, tmp_path, good + wrong + answer + empty + revisit)
    assert [r["fault"] for r in rows] == [None, "block digest", "payload digest", None, None]
    assert [r["payload_bytes"] for r in rows] == [700_000, 3, 3, 0, None] and rows[0]["payload"] == body
    assert rows[0]["fields"]["x-long"] == "one two" and rows[4]["payload_digest"] == "0" * 32
    assert [(r["offset"], r["length"]) for r in rows][:2] == [(0, len(good)), (len(good), len(wrong))]


def test_damaged_stretches_are_passed_over(spark, tmp_path):
    good = foreign("resource", b"abc")
    big = foreign("resource", random.Random(2).randbytes(600_000))
    spoilt = bytearray(big)
    spoilt[300_000] ^= 255
    no_length = gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n")
    short = gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    long = gzip.compress(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n")
    for damage in (bytes(spoilt), big[:300_000], no_length, short, long, gzip.compress(b"GET /"), b"noise", b"\x1f\x8b\x08" * 3):
        rows = read(spark, tmp_path, good + damage + good + damage)
        assert [(r["payload"], bool(r["fault"])) for r in rows] == [(b"abc", False), (None, True)] * 2, damage[:40]
        assert sum(r["length"] for r in rows) == 2 * len(good + damage)
    assert read(spark, tmp_path, b"") == []
    assert [r["fault"] for r in read(spark, tmp_path, good[:-5])] == ["cut off"]
    bad = foreign("resource", b"abc", WARC_Block_Digest="sha1:!!")
    assert [r["fault"] for r in read(spark, tmp_path, bad + good)] == ["digest field", None]


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = sorted(map(tuple, queries.QUERIES["op13_warc"](spark, sf).collect()), key=str)
    assert got == expected(list(map(tuple, rows)))


def test_long_payload(spark):
    html = "<p>0123456789</p>\r\n\r\n" * 300_000
    docs = spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string")
    assert found(warc.read_archives(warc.write_archives(docs))) == expected([(1, html), (2, html)])
