"""Round trip through bundles, plain decompression and random access."""

import glob
import hashlib

import zstandard
from pyspark.sql import types as T

from quillcheck.llm import warc
from quillcheck.session import scratch_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, PAGES).repartition(parts)


def expect(rows):
    first = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            first[html] = max(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(html) if len(data) >= 1000 else None
        revisit = to is not None and i != to and sum(r[2] == html for r in rows) > 1
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


BIG = "<p>é€\r\n\r\nWARC/1.1</p>" * 80
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "bad\r\nurl x", ""), (6, "u", None),
    (7, "u", "y" * 1000), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", BIG), (None, "u", "small"), (10, "u", "z" * 700_000), (11, "u", "é" * 500),
]


def test_round_trip(spark):
    pages = pages_of(spark, ROWS).selectExpr("*", "1 AS digest", "2 AS size", "'x' AS bundle")
    index = warc.write_archives(pages, frame_bytes=3000, bundle_bytes=2000)
    found = warc.read_archives(spark, index).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == expect(ROWS)
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(bytes(r.payload) == html[r.page_id] for r in found if r.record_type == "response" and r.page_id is not None)
    assert {r.url for r in found if r.page_id == 5} == {"bad%0D%0Aurl%20x"} and index.select("bundle").distinct().count() > 1


def test_random_access_and_plain_decompression(spark):
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(pages_of(spark, ROWS, 1), folder, frame_bytes=3000)
    for r in index.collect():
        got = warc.fetch(index.where(index["record_id"] == r.record_id)).collect()
        assert {x.page_id for x in got} == {r.page_id}
    files = glob.glob(folder.removeprefix("file://") + "/*.warc.zst")
    assert len(files) == 1
    data = open(files[0], "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(list(warc.parse(plain))) == len(ROWS)


def test_empty_table(spark):
    index = warc.write_archives(pages_of(spark, []))
    assert index.collect() == [] and warc.read_archives(spark, index).collect() == []


def test_heavy_and_light_copies(spark, monkeypatch):
    """Payloads known by broadcast and those known by the join give the same records."""
    big, small = "x" * 5000, "y" * 1000
    rows = [(i, f"u{i}", big) for i in range(200)] + [(1000 + i, None, small) for i in range(2)] + [(None, "u", big), (2000, "u", "z" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for most in (1, 10, 1000):
        monkeypatch.setattr(warc, "MOST_HEAVY", most)
        found = {(r.page_id, r.refers_to, r.revisit) for r in warc.with_revisits(pages).collect()}
        assert found == {(i, 199 if i != 199 else None, i != 199) for i in range(200)} | {(1000, 1001, True), (1001, None, False), (None, 199, True), (2000, None, False)}
