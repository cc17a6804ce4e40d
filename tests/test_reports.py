"""Reports on small cases; the queries' SQL covers the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import reports


def test_form_summaries(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    sections = spark.createDataFrame([(1, 0, "s", "문제인식", True, False), (1, 3, "t", "별첨", False, True)], "doc_id int, pos int, field_id string, label string, required boolean, excluded boolean")
    cells = spark.createDataFrame([(1, 0, 0, 0, "c", "L", "text", True), (1, 4, 0, 0, "d", "M", "text", None)], "doc_id int, `table` int, `row` int, col int, cell_id string, label string, field_type string, required boolean")
    images = spark.createDataFrame([(1, 1, "i", "그림")], "doc_id int, place int, slot_id string, label string")
    asked = spark.createDataFrame([(1, n + 1, label, required) for n, (label, required) in enumerate([("과제명", True), (" ", True), ("선택", False), ("문제인식", True), ("끝", None)])], "doc_id int, nth int, label string, required boolean")
    found = {r.doc_id: r for r in reports.form_summaries(docs, sections, cells, images, asked, {"problem": ("문제인식",), "appendix": ("별첨",), "team": ("팀구성",)}, most=4).collect()}
    r = found[1]
    assert [r.n_sections, r.n_tables, r.n_images, r.n_questions, r.n_required, r.n_required_cells] == [2, 2, 1, 5, 3, 1]
    assert r["items"] == ["[필수] 과제명", "[필수] 문제인식", "선택", "끝"] and (r.problem, r.appendix, r.team) == (True, True, False)
    assert found[2].n_questions == 0 and found[2]["items"] == [] and not found[2].problem


def test_headings_of_no_rule_and_blank_ones(spark):
    rows = spark.createDataFrame([(1, 0, "1-1. 문제 인식"), (1, 1, "자금 문제"), (1, 2, " "), (1, 3, None), (2, 0, "기타")], "doc_id int, pos int, heading string")
    groups, report = reports.heading_coverage(rows, (("문제", "PROBLEM", 0.9), ("자금", "SCALEUP", 0.95)), ("PROBLEM", "SCALEUP", "TEAM"))
    assert sorted((r.doc_id, r.category, r.n) for r in groups.collect()) == [(1, "PROBLEM", 1), (1, "SCALEUP", 1), (1, "UNKNOWN", 2), (2, "UNKNOWN", 1)]
    assert sorted((r.doc_id, r.missing, r.coverage) for r in report.collect()) == [(1, ["TEAM"], 0.67), (2, ["PROBLEM", "SCALEUP", "TEAM"], 0.0)]


def test_completed_documents(spark):
    long = "가" * 80
    docs = spark.createDataFrame([(1, "\n".join([long] * 8)), (2, "\n".join([long] * 8 + ["a | "])), (3, "\n".join(["짧은 문단 " * 8] * 40)), (4, "\n".join(["※ 짧은 문단 " * 8] * 40)), (5, None)], "doc_id int, text string")
    found = reports.document_metrics(docs, "※", "OOO").withColumn("completed", reports.is_completed())
    assert {r.doc_id: r.completed for r in found.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_decisions_without_guards_and_rules(spark):
    rules = spark.createDataFrame([("a", "all", True), ("b", "x", False), ("c", "y", True)], "rule_id string, domain string, automated boolean")
    guards = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (2, "a", True), (2, "a", None)], "run_id int, rule_id string, passed boolean")
    runs = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "run_id int, domain string")
    found = {r.run_id: (r.total, r.passed, r.na, r.failed, r.review_required, r.unverifiable, r.can_finalize, r.blocked) for r in reports.rule_decisions(rules, guards, runs).collect()}
    assert found == {1: (3, 2, 1, 0, 0, 0, True, ""), 2: (3, 0, 2, 1, 0, 0, False, "1 FAIL rules"), 3: (3, 0, 2, 0, 0, 1, False, "1 UNVERIFIABLE rules")}
    assert reports.rule_decisions(rules.limit(0), guards, runs).filter("can_finalize and total = 0").count() == 3


def test_category_of_the_surest_rule(spark):
    rows = spark.createDataFrame([("a b",), ("b",), ("",), (None,)], "h string")
    found = [r.x for r in rows.select(reports.category(F.col("h"), (("a", "A", 0.5), ("b", "B", 0.5), ("a b", "C", 0.9))).alias("x")).collect()]
    assert [(x.category, x.confidence) if x else None for x in found] == [("C", 0.9), ("B", 0.5), None, None]
