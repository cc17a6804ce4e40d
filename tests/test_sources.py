"""File sources, logs, blobs and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions.text import normal_url
from corpuskiln.operators import tables
from corpuskiln.sources import files, logs
from corpuskiln.streaming import defects


def test_texts_in_several_encodings(spark, tmp_path):
    said = "한글 문서 똠방각하"
    for name, data in {"a.txt": said.encode(), "b.txt": said.encode("cp949"), "c.txt": b"\xff\xfe\x80abc", "d.txt": b"", "e.bin": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(spark, str(tmp_path)).collect()}
    assert found["a.txt"] == found["b.txt"] == said and "d.txt" not in found and "abc" in found["c.txt"] and "e.bin" not in found
    assert files.tracked_texts(spark, str(tmp_path), (".txt",), largest=20).filter("length(text) > 20").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.source_pool(spark, str(tmp_path / "missing")).collect()


def test_pools_notices_and_images(spark, tmp_path):
    for name in ("x/p.docx", "q.hwp", "r.pdf", "x/logo.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"data")
    assert files.source_pool(spark, str(tmp_path)).count() == 1 and files.source_pool(spark, str(tmp_path), True).count() == 2
    image = files.image_library(spark, str(tmp_path)).first()
    assert image.hint == "x" and len(image.sha256) == 64 and image.length == 4
    names = spark.createDataFrame([("/a/모집 공고.pdf",), ("/a/신청서.hwp",), ("/a/동의서.docx",), ("/a/.tmp.docx",), ("/a/b.exe",)], "path string")
    kinds = names.select(files.notice_kind(F.col("path"), ("공고",), ("동의서",)).alias("k")).collect()
    assert [r.k for r in kinds] == ["announcement", "form", "other", None, "other"]


def test_logs_blobs_and_receipts(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"a": 1}\n\n  \nnot json\n[1]\n{"a": 2, "b": 3}\n{"a": }\n')
    good, bad = logs.read_log(spark, str(tmp_path / "runs.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and sorted(r.value for r in bad.collect()) == ["[1]", "not json", '{"a": }']
    assert files.named_log(spark, str(tmp_path), "runs", "a int").count() == 2
    with pytest.raises(ValueError, match="no log"):
        files.named_log(spark, str(tmp_path), "other", "a int")
    logs.append_log(good, str(tmp_path / "out"))
    logs.append_log(good, str(tmp_path / "out"))
    assert logs.read_log(spark, str(tmp_path / "out"), "a int")[0].count() == 4
    rows = spark.createDataFrame([("x",), ("x",), ("",), (None,)], "text string")
    store = logs.blobs(rows)
    assert store.count() == 1 and len(store.first().digest) == 16
    refs = spark.createDataFrame([(store.first().digest, "gone")], "a string, b string")
    assert logs.with_blobs(refs, store, ["a", "b"]).select("a_text", "b_text").first() == ("x", "")
    stages = spark.createDataFrame([("s1", "v1"), ("s2", "v2")], "stage string, input string").withColumn("key", files.receipt_key(F.col("input")))
    assert [r.stage for r in files.without_receipt(stages, stages.filter("stage = 's1'")).collect()] == ["s2"]
    files.append_trend(good, str(tmp_path / "trend"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "trend")).count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "meta.json").write_text('{"name":\n "n"}')
    assert files.profiles(spark, str(tmp_path / "p"), "name string").first().name == "n"


def test_streams_equal_their_batch(spark, tmp_path):
    rows = [(i % 40, f"2026-01-01 0{i % 3}:00:00", f"c{i % 2}") for i in range(80)]
    spark.createDataFrame(rows, "id int, at string, check string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, at timestamp, check string").parquet(str(tmp_path / "in"))
    defects.append_distinct(stream, "id", "at", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    counted = defects.hourly_counts(stream, "check", "at")
    counted.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy("check", F.date_trunc("hour", "at").alias("hour")).count()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, batch.collect()))


def test_urls_and_tables(spark):
    urls = ["HTTP://A.kr/x;p=1?q#f", "a.kr/b/", "", None, "https://h/a;b/c"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(normal_url(F.col("u")).alias("n")).collect()
    assert [r.n for r in rows] == ["http://a.kr/x?q", "https:///a.kr/b", "", "", "https://h/a;b/c"]
    grid = [["국고", "자부담", "합계"], ["30", "10", "40"], ["", "비고", ""], ["작성 요령", "", ""]]
    cells = spark.createDataFrame([(1, 0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "doc_id int, table int, row int, col int, cell string")
    assert [r.row for r in tables.matrix_headers(cells).collect()] == [0]
    assert {r.key for r in tables.label_keys(cells).collect()} >= {"국고", "자부담", "합계"}
    blank = {(r.row, r.col): r.label for r in tables.blank_cells(cells).collect()}
    assert blank[2, 0] == "30" and blank[2, 2] == "비고 / 40"
    kept = tables.without_guide_rows(cells, F.col("line").startswith("작성"))
    assert kept.filter("row = 3").count() == 0 and kept.count() == 9
    only = cells.filter("row = 3")
    assert tables.without_guide_rows(only, F.col("line").startswith("작성")).count() == 0
    assert tables.empty_rows(cells).count() == 0 and tables.cells(cells.limit(0).selectExpr("doc_id", "row AS pos", "cell AS line")).count() == 0
