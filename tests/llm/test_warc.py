"""Archives written and read back."""

from __future__ import annotations

import hashlib

from corpuskiln.llm import registry, warc
from corpuskiln.llm.storage import new_path


def brute(pages):
    rows = [(i, (h or "").encode()) for i, h in pages]
    best = {}
    for i, b in rows:
        if len(b) >= 1000:
            best[b] = max((x for x in (best.get(b), i) if x is not None), default=None)
    out = []
    for i, b in rows:
        revisit = len(b) >= 1000 and i != best[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best[b] if revisit else None))
    return sorted(out, key=repr)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in registry.op5_warc(spark, sf).collect()), key=repr) == brute(pages)


def test_magic_in_payloads_nulls_and_copies(spark):
    big = "x\r\n\r\n" * 300
    htmls = [FAKE, FAKE * 5, "WARC/1.0\r\n", "WARC/1.0", "\r\n\r\n", None, "", big, big, big, "é한" * 600, "é한" * 600, "a\rb\nc\r\n", "WARC/1.0\r\n\r\n\r\nWARC/1.0\r\n" * 40, "short", "short"]
    rows = [(i, f"http://h/{i} \r\né", h) for i, h in enumerate(htmls)] + [(None, None, big), (3, "u", "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "'f' AS file", "1 AS at")
    out = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr)
    assert out == brute([(i, h) for i, _, h in rows])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_cut_into_small_splits(spark):
    htmls = [FAKE * (i % 4) + "y" * (i * 37) for i in range(120)]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").coalesce(2)
    path = new_path(spark, "warc-test")
    warc.write(df, path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {r.record_id: bytes(r.payload).decode() for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert found == {f"<urn:page:{i}>": h for i, h in enumerate(htmls)}


def test_splits_that_change_between_scans_change_nothing(spark):
    htmls = [FAKE * (i % 3) + "z" * (i * 211) for i in range(60)]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").coalesce(2)
    path = new_path(spark, "warc-test")
    warc.write(df, path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    raw = warc.stretches(spark, path)
    first = sorted(map(tuple, raw.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert sorted(map(tuple, raw.collect())) == first
        records = warc.read(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        found = {r.record_id: bytes(r.payload).decode() for r in records.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert found == {f"<urn:page:{i}>": h for i, h in enumerate(htmls)}


def test_urls_are_encoded_and_very_long_payloads_kept(spark):
    long = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40_000
    df = spark.createDataFrame([(1, "http://h/é?x=ü 한\n\U0001f600", long), (2, None, "x"), (3, "http://h/a%20b", "y")], "page_id long, url string, html string").selectExpr("*", "1 AS `a.b`", "2 AS `my col`")
    path = new_path(spark, "warc-test")
    warc.write(df, path)
    found = {r.record_id: (r.uri, bytes(r.payload).decode()) for r in warc.read(spark, path).collect()}
    assert found["<urn:page:1>"] == ("http://h/%C3%A9?x=%C3%BC%20%ED%95%9C%0A%F0%9F%98%80", long)
    assert found["<urn:page:2>"] == ("", "x") and found["<urn:page:3>"] == ("http://h/a%20b", "y")
