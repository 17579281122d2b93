from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc
from millrace.llm.common import scratch

ROWS = [
    (1, "http://a/1", "x" * 2000), (5, "http://a/5", "x" * 2000), (3, None, "x" * 2000), (2, "http://a/2\r\nX: y", "short"), (7, "http://a/7", "short"),
    (8, "u", None), (9, "u", ""), (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "u", "a\r\n\r\nWARC/1.1\r\n" * 100), (13, "u", "z" * 999), (14, "u", "z" * 999),
    (20, "u", "same" * 400), (20, "u", "same" * 400), (None, "u", "none" * 400), (None, "u", "none" * 400), (4, "u", "x" * 1999 + "y"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, row int, sha256 string").repartition(3)


def brute():
    best = {}
    for i, _, html in ROWS:
        data = (html or "").encode()
        if len(data) >= 1000:
            best[data] = max(best.get(data, -1), -1 if i is None else i)
    taken = set()
    for i, _, html in ROWS:
        data = (html or "").encode()
        first = len(data) < 1000 or (best[data] == (-1 if i is None else i) and data not in taken)
        taken |= {data} if first else set()
        refers = None if first or best[data] == -1 else best[data]
        yield i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", refers


def test_round_trip(pages, multiset):
    got = warc.round_trip(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert multiset(got.collect()) == multiset(brute())


def test_each_payload_is_stored_once_and_records_come_back(spark, pages, tmp_path):
    archive = warc.write_archive(pages, scratch(spark, "warc"))
    assert archive.payloads.count() == len({(h or "").encode() for _, _, h in ROWS})
    records = [bytes(r["record"]) for r in warc.records(archive).collect()]
    assert len(records) == len(ROWS)
    for r in records:
        head, _, body = r.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in head
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert body == body[:size] + b"\r\n\r\n"
        if b"WARC-Type: response" in head:
            assert hashlib.sha1(body[:size]).hexdigest().encode() in head
            assert b"WARC-Profile" not in head and b"WARC-Refers-To" not in head
        else:
            assert b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in head and size == 0
    ids = [r.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in records]
    assert len(set(ids)) == len(records)
    assert {r.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for r in records if b"WARC-Refers-To" in r} <= set(ids)
    path = str(tmp_path / "files")
    warc.export_warc(archive, path, records_per_file=4)
    back = warc.read_warc(spark, path).collect()
    assert sorted(r["header"].encode() + bytes(r["payload"]) + b"\r\n\r\n" for r in back) == sorted(records)


def test_damage_is_noticed(spark, pages):
    archive = warc.write_archive(pages, scratch(spark, "warc"))
    other = scratch(spark, "warc")
    archive.headers.write.parquet(f"{other}/headers")
    bad = F.concat(F.col("payload"), F.lit(b"!"))
    archive.payloads.select("sha256", bad.alias("payload")).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(warc.Archive(spark, other)).collect()


def test_empty(spark, pages):
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_hot_payloads_meet_their_records_in_groups(spark, pages, multiset):
    archive = warc.write_archive(pages, scratch(spark, "warc"), share=2)
    assert archive.headers.agg(F.max("group")).first()[0] > 0
    assert archive.payloads.count() == len({(h or "").encode() for _, _, h in ROWS})
    assert multiset(warc.read_index(archive).collect()) == multiset(brute())


def test_records_that_lie_are_noticed(spark, pages):
    for wrong in (("Content-Length: 5", "Content-Length: 4"), ("sha1:", "sha1:0")):
        archive, other = warc.write_archive(pages, scratch(spark, "warc")), scratch(spark, "warc")
        archive.headers.withColumn("header", F.replace("header", F.lit(wrong[0]), F.lit(wrong[1]))).write.parquet(f"{other}/headers")
        archive.payloads.write.parquet(f"{other}/payloads")
        with pytest.raises(Exception, match="differ"):
            warc.read_index(warc.Archive(spark, other)).collect()


def test_very_long_payload(spark):
    long = "\u00e9 <p>\r\n\r\n" * 400_000
    rows = [(1, "u", long), (2, "u", long), (3, "u", long[:-1])]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    data = long.encode()
    assert got[2] == (len(data), hashlib.sha1(data).hexdigest(), "response", None)
    assert got[1] == (len(data), hashlib.sha1(data).hexdigest(), "revisit", 2)
    assert got[3][2] == "response"
