"""Steps whose memory, time or traffic must not outgrow their input: what they give, and what their plans leave out."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuskiln.functions import text
from corpuskiln.llm import near_duplicates
from corpuskiln.operators import alignment, matching, resumes, sections
from corpuskiln.plans import contracts as plans

from .conftest import DATA


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


WORDS = "{} string, categories array<string>, tokens array<string>"


def test_pairs_are_not_gathered_to_be_made_distinct(spark):
    own = spark.createDataFrame([("a", ["x", "y"], ["one", "two"]), ("b", ["z"], ["two"]), ("c", [], ["one", "two"])], WORDS.format("section_id"))
    rows = [("m1", ["x", "y", "x"], []), ("m2", [], ["two", "one"]), ("m3", ["z"], ["one"]), ("m4", None, ["one"]), ("m5", [None], ["two"]), ("m1", ["z"], []), ("m6", [], None)]
    found = matching.section_materials(own, spark.createDataFrame(rows, WORDS.format("material_id")))
    pairs = [(r.section_id, r.material_id) for r in found.collect()]
    assert sorted(pairs) == [("a", "m1"), ("a", "m2"), ("a", "m4"), ("b", "m1"), ("b", "m2"), ("b", "m3"), ("c", "m2"), ("c", "m3"), ("c", "m4"), ("c", "m5")]
    assert not re.search(r"Aggregate \[section_id#\d+, material_id#\d+\]", plan_of(found))


def test_status_costs_what_the_kinds_of_materials_cost(spark):
    own = spark.createDataFrame([("a", ["x"], [], None), ("b", ["y"], [], ["ACTUAL"])], WORDS.format("section_id") + ", expected array<string>")
    rows = spark.range(300).select(
        F.when(F.col("id") == 299, "1").otherwise(F.col("id").cast("string")).alias("material_id"), F.lit("FACT").alias("material_type"), F.lit("f").alias("field"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("value"), F.array(F.struct(F.lit("p").alias("file"), F.col("id").cast("string").alias("location"))).alias("origin"),
        F.lit(None).cast("string").alias("verification"), F.lit("actual").alias("semantic"), F.array(F.when(F.col("id") % 2 == 0, "x").otherwise("y")).alias("categories"), F.array().cast("array<string>").alias("tokens"),
    )
    none = lambda names: spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    reqs = spark.createDataFrame([], "requirement_id string, required boolean, blocking boolean")
    pair = none(("requirement_id", "section_id"))

    def status(mats):
        used = sections.matched_materials(own, mats).filter("reason is null")
        return sorted(map(tuple, sections.section_status(own, used, pair, pair, reqs, none(("conflict_id", "section_id"))).collect()))

    kinds = sections.by_kind(rows)
    assert kinds.count() == 4
    assert status(kinds) == status(rows) == [("a", 100, 0, 0, 0, "WRITABLE"), ("b", 99, 0, 0, 0, "WRITABLE")]


def test_heavy_rows_of_a_small_file_are_spread(spark):
    assert plans._profiles(spark, f"{DATA}/sf0.001").rdd.getNumPartitions() >= 8


def test_an_amount_is_computed_once(spark):
    rows = spark.createDataFrame([("1조 2억 3만",), ("1.5억원, 7",), ("약 1,200",), ("억",), ("1.2.3억 4만",), ("0억 5",), (None,)], "t string")
    found = rows.select(text.amount_in_won(F.col("t")).alias("n"))
    assert [r.n for r in found.collect()] == [1_000_200_030_000.0, 150_000_000.0, 1200.0, 0.0, 40_000.0, 0.0, 0.0]
    assert plan_of(found).count("regexp_extract") == 4


def test_cells_of_tables_are_sent_to_no_other_task(spark):
    form = resumes.Form((resumes.Section("s", (("Name",),), ("name", "year")),), {}, ())
    cells = [("d", 0, 0, 0, "title"), ("d", 0, 1, 0, "Name x"), ("d", 0, 1, 1, "?"), ("d", 0, 2, 0, "Name"), ("d", 0, 2, 1, "Year"), ("d", 0, 2, 2, "Name"), ("d", 0, 3, 0, " "), ("d", 0, 3, 1, None), ("d", 0, 3, 2, "")]
    cells += [("d", 0, 4, 0, ""), ("d", 0, 4, 1, "1"), ("d", 0, 5, 2, "\t"), ("d", 0, 6, 3, ""), ("d", 1, 0, 0, ""), ("e", 0, 0, 1, "Name"), ("e", 0, 1, 0, "")]
    cells = spark.createDataFrame(cells, "doc_id string, table int, row int, col int, cell string")
    columns, blank = resumes.map_tables(cells, form, {"s": {"Name": "name", "Year": "year"}})
    assert sorted(map(tuple, columns.collect())) == [("d", 0, 2, "s", 0, "name"), ("d", 0, 2, "s", 1, "year"), ("d", 0, 2, "s", 2, "name"), ("e", 0, 0, "s", 1, "name")]
    assert sorted(map(tuple, blank.collect())) == [("d", 0, "s", 3, 1), ("d", 0, "s", 5, 2)]
    assert "Join" not in plan_of(blank)


def test_items_of_orders_travel_once(spark):
    plan = plans.vertical_cards(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\((?:doc_id|l_orderkey)#", plan)) == 1
    words = spark.createDataFrame([("plain",), ("가나1",), ("",), ("plain\n",), ("1. a",), ("가. 나",), ("○ (x) y",), ("-",), (None,)], "t string")
    assert [r.k for r in words.select(text.label_key(F.col("t")).alias("k")).collect()] == ["plain", "가나1", "", "plain", "a", "나", "y", "-", None]


def test_differences_of_forms_move_each_form_once_by_key(spark):
    one, two = (spark.createDataFrame([(k, p, f"{n} {p % 3}" if p % 2 else f"line {p}") for k in range(4) for p in range(9)], "doc_id int, pos int, line string") for n in "ab")
    for made in (alignment.form_diff, alignment.operations, alignment.anchors):
        plan = made(one, two)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == plan.count("Exchange ") == 2
    assert {(r.fills, r.drops, r.edits, r.intact) for r in alignment.form_diff(one, two).collect()} == {(0, 0, 4, False)}
    assert sorted(tuple(r) for r in alignment.anchors(one, two).filter("doc_id = 0").collect()) == [(0, p, p) for p in (0, 2, 4, 6, 8)]


def test_rounds_of_components_send_no_table_to_the_driver(spark, monkeypatch):
    plans, kept = [], near_duplicates.durable
    monkeypatch.setattr(near_duplicates, "durable", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))
    found = near_duplicates.components(spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
