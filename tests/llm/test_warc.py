"""Archives: round trips and broken files."""

import gzip
import hashlib
import tracemalloc
from base64 import b32encode
from collections import Counter

import pytest

from ablatrix.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [
        (3, "http://a.b/c", "same"), (1, None, "same"), (1, "u", "same"), (2, "http://q/\r\nx", tricky), (None, "n", "same"),
        (None, "n", "alone"), (4, "e", ""), (5, "e", None), (6, "ü", "é" * 1000), (6, "ü", "é" * 1000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url").repartition(3)


def test_round_trip(spark, pages):
    for min_bytes in (0, 5, 10_000):
        path = warc.write_archives(pages, min_bytes=min_bytes, file_pages=2)
        got = warc.captures(warc.read_records(spark, path)).collect()
        assert len(got) == pages.count()
        payloads = Counter(r["html"] or "" for r in pages.collect())
        responses = [r for r in got if r["response"]["type"] == "response"]
        want = Counter()
        for p, n in payloads.items():
            want[p] = 1 if len(p.encode()) >= min_bytes else n
        assert Counter(bytes(r["response"]["payload"]).decode() for r in responses) == want
        by_id = {r["id"]: r for r in responses}
        for r in got:
            assert r["request"]["http"].startswith("GET ") and int(r["metadata"]["fields"]["payload-bytes"]) >= 0
            if r["response"]["type"] == "revisit":
                first = by_id[r["response"]["refers_to"]]
                assert first["response"]["digest"] == r["response"]["digest"]
                assert first["metadata"]["fields"].get("page") == r["metadata"]["fields"].get("refers-to-page")
            else:
                assert r["response"]["digest"] == r["response"]["payload_sha1"] == b32encode(hashlib.sha1(r["response"]["payload"]).digest()).decode()


def test_smallest_id_responds(spark, pages):
    got = warc.captures(warc.read_records(spark, warc.write_archives(pages))).collect()
    same = [r for r in got if r["response"]["digest"] == b32encode(hashlib.sha1(b"same").digest()).decode()]
    assert sorted(r["response"]["type"] for r in same) == ["response"] + ["revisit"] * 3
    assert {r["metadata"]["fields"].get("refers-to-page") for r in same} == {None, "1"}


def test_empty(spark, pages):
    assert warc.read_records(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_gzip_members_and_broken_files():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert len([*warc.parse_records(record * 2)]) == 2
    assert len([*warc.parse_records(gzip.compress(record) * 3)]) == 3
    for bad in (record[:-3], b"no" + record, record.replace(b": 2", b": 9")):
        with pytest.raises(ValueError):
            [*warc.parse_records(bad)]


def test_files_are_bounded_by_bytes(spark, tmp_path):
    sizes = [100] * 60 + [30_000] * 12 + [300_000] * 3
    pages = spark.createDataFrame([(i, "u", f"{i} " + "x" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    path = warc.write_archives(pages.coalesce(1), path=str(tmp_path / "a"), file_pages=25, file_bytes=120_000)
    assert warc.captures(warc.read_records(spark, path)).count() == len(sizes)
    for file in (tmp_path / "a").glob("*.gz"):
        raw = gzip.decompress(file.read_bytes())
        assert len(raw) <= 120_000 or len([*warc.parse_records(raw)]) == 3


def test_archives_are_unpacked_in_pieces():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 1000000\r\n\r\n" + b"a" * 1_000_000 + b"\r\n\r\n"
    raw = gzip.compress(record * 50)
    tracemalloc.start()
    try:
        assert sum(len(block) for _, block in warc.parse_records(raw)) == 50_000_000
        assert tracemalloc.get_traced_memory()[1] < 12_000_000
    finally:
        tracemalloc.stop()
