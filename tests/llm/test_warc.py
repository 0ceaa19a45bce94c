"""WARC archives: round trips at any split, embedded archives, hostile tables."""

import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quadrille.llm import warc

PAGES = [(3, "http://a/ä b", "<p>é</p>"), (1, None, "<p>é</p>"), (None, "u", "<p>é</p>"), (2, "u", None), (5, "u", ""), (5, "u", ""), (7, "v", "x" * 400_000), (8, "\r\nWARC/1.1", "WARC/1.1\r\n\r\n"), (None, None, "alone")]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def brute(rows):
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first, payload = min(same, default=None), (html or "").encode()
        revisit = first is not None and page != first
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_any_split_gives_every_record_once(spark, folder, split):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("id", F.lit("clash")).repartition(3)
    archives = warc.write(pages, folder)
    got = warc.read_whole(archives, split).filter("record_type <> 'warcinfo'")
    rows = [(None if r["id"] is None else int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(PAGES)
    assert warc.uncovered(archives, warc.read(archives, split)).count() == 0
    assert {r["intact"] for r in got.collect()} == {True, None}


def test_archives_are_plain_warc(spark, folder):
    archives = warc.write(spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1), folder).collect()
    assert len(archives) == 1 and archives[0]["records"] == len(PAGES)
    text = gzip.open(archives[0]["path"].removeprefix("file://")).read()
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) + 1 and text.endswith(b"\r\n\r\n")


def test_archives_roll_over(spark, folder):
    archives = warc.write(spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1), folder, most=500)
    assert archives.count() > 1 and warc.read_whole(archives).filter("record_type <> 'warcinfo'").count() == len(PAGES)


def test_least_size(spark, folder):
    got = warc.read_whole(warc.write(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"), folder, least=5))
    assert {r["record_type"] for r in got.filter("payload_bytes < 5").collect()} == {"response"}
    assert got.filter("record_type = 'revisit'").count() == 2


def stored(record):
    """The same member, its bytes kept as they are."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(gzip.decompress(record)) + packer.flush()


def test_an_archive_inside_a_payload(spark, tmp_path):
    inner = b"".join(warc.page_record(str(i), "u", f"page {i}".encode() * 20, "X", None) for i in range(60))
    members = [stored(warc.page_record("a", "u", inner, "X", None)), warc.page_record("b", "u", b"after", "X", None)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", sum(map(len, members)), 2)], warc.MANIFEST)
    assert warc.read(archives, 2_000).count() > 2 and warc.uncovered(archives, warc.read(archives, 2_000)).count() == 1
    got = {r["id"]: r for r in warc.read_whole(archives, 2_000, payloads=True).collect()}
    assert set(got) == {"a", "b"} and bytes(got["a"]["payload"]) == inner and bytes(got["b"]["payload"]) == b"after"


def test_a_damaged_member_is_skipped(spark, tmp_path):
    members = [warc.page_record(str(i), "u", f"page {i}".encode() * 50, "X", None) for i in range(5)]
    members[2] = members[2][:40] + b"\0\0\0" + members[2][43:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", sum(map(len, members)), 5)], warc.MANIFEST)
    for split in (50, 1 << 20):
        assert sorted(r["id"] for r in warc.read_whole(archives, split).collect()) == ["0", "1", "3", "4"]


def test_empty_table(spark, folder):
    assert warc.read_whole(warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)).count() == 0
