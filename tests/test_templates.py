"""Sections, questions, blocks and scores on small cases; the queries' SQL covers the rest."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpuskiln.operators import scores, templates


def paragraphs(spark, docs):
    return spark.createDataFrame([(d, p, x) for d, xs in docs.items() for p, x in enumerate(xs)], "doc_id int, pos int, line string")


def test_sections_open_where_their_heading_stands_first(spark):
    long = "이 문단은 여덟 단어가 넘는 문장이라서 제목이 될 수 없고 절을 열지 않는 본문으로 남아야만 한다 그래서 아무 일도 없다"
    xs = ["1. 사업  개요", long, "□ 개인정보 동의서", "1. 사업 개요", "◦ ●", " ", None, "담당자 확인", "가나다라마바사아자차가나다라마바사아자차", "목표", f"{long}:", "Über Straße"]
    found = [(r.pos, r.field_id, r.label, r.required, r.excluded) for r in templates.sections(paragraphs(spark, {1: xs})).orderBy("pos").collect()]
    assert [f[0] for f in found] == [0, 2, 8, 9, 10, 11]
    assert found[0][1:] == ("section_001_1", "1. 사업 개요", True, False)
    assert found[1][3:] == (True, True)
    assert found[2][2] == "가나다라마바사아자차" and not found[2][3]
    assert found[3][3:] == (True, False) and found[3][1].startswith("section_010_section_")
    assert found[5][1] == "section_012_uber_strae"
    strict = templates.sections(paragraphs(spark, {1: [*xs, "○ 1. 목표"]}), strict=True)
    assert sorted(r.pos for r in strict.collect()) == [0, 2]
    assert templates.sections(paragraphs(spark, {1: xs}).limit(0)).count() == 0


def test_questions_are_numbered_in_order_and_ask_once(spark):
    docs = spark.createDataFrame([(1,), (2,), (2,)], "doc_id int")
    sections = templates.sections(paragraphs(spark, {1: ["1. 목표", "2. 보안", "3. 팀"]}))
    cells = spark.createDataFrame([(1, 0, 1, 0, "c2", "B", "text", None), (1, 0, 0, 1, "c1", "A", "text", True), (1, 1, 0, 0, "c1", "again", "text", True)], "doc_id int, `table` int, `row` int, col int, cell_id string, label string, field_type string, required boolean")
    images = spark.createDataFrame([(1, 4, "i1", "그림")], "doc_id int, place int, slot_id string, label string")
    found = [(r.doc_id, r.nth, r.question_id, r.kind) for r in templates.questions(docs, sections, cells, images).orderBy("doc_id", "nth").collect()]
    fixed = [("project_title", "project_meta"), ("organization_name", "organization_profile")]
    own = [*fixed, ("section_001_1", "section"), ("section_003_3", "section"), ("c1", "table_cell"), ("c2", "table_cell"), ("image_note_i1", "image_slot_note")]
    assert found == [(1, i + 1, q, k) for i, (q, k) in enumerate(own)] + [(2, i + 1, q, k) for i, (q, k) in enumerate(fixed)]


def test_contents_after_anchors(spark):
    docs = {1: ["1. 목표", "※ 작성 요령", "", "내용이 있다"], 2: ["1. 목표", "", "1. 목 표"], 3: ["1. 목표", *[""] * 9, "너무 멀다"], 4: ["다른 것"], 5: ["1. 목표", *[""] * 8, "가깝다"]}
    anchors = spark.createDataFrame([(i, "s1", "1. 목표") for i in range(1, 7)], "doc_id int, target string, anchor string")
    found = {r.doc_id: r.filled for r in templates.section_contents(paragraphs(spark, docs), anchors).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_required_questions_are_resolved_by_their_kind(spark):
    asked = [("a", "section", "s1"), ("b", "section", "s2"), ("c", "table_cell", "c1"), ("d", "table_cell", "c2"), ("e", "project_meta", "title"), ("f", "organization_profile", "name"), ("g", "other", "x"), ("h", "section", "s3")]
    asked = spark.createDataFrame([(1, q, k, t, "추천기관" if q == "h" else "L", True) for q, k, t in asked] + [(1, "z", "section", "s9", "L", False)], "doc_id int, question_id string, kind string, target string, label string, required boolean")
    output = spark.createDataFrame([(1, "section", "s1", False), (1, "table_cell", "c1", True)], "doc_id int, kind string, target string, filled boolean")
    values = spark.createDataFrame([(1, "answer", "s1", "x"), (1, "answer", "b", "x"), (1, "answer", "c2", " "), (1, "project_meta", "title", "T"), (1, "answer", "name", "x"), (1, "answer", "x", "v")], "doc_id int, kind string, key string, value string")
    slots = spark.createDataFrame([(1, "p1", "그림", True), (1, "p2", "그림", True), (1, "p3", "그림", False)], "doc_id int, slot_id string, label string, required boolean")
    pictures = spark.createDataFrame([(1, "p1")], "doc_id int, slot_id string")
    found = sorted(map(tuple, templates.open_questions(asked, output, values, pictures, slots).collect()))
    # An answer does not stand for what the document written lacks.
    assert found == [(1, "IMAGE", "p2", "output"), (1, "REQUIRED", "a", "output"), (1, "REQUIRED", "d", "input"), (1, "REQUIRED", "f", "input"), (1, "REQUIRED", "g", "input")]


def plain_roles(xs):
    """The roles of letters: m a marker, i an intro, d a divider, x any other line."""
    roles = [None] * len(xs)
    at = lambda i: xs[i] if 0 <= i < len(xs) else None
    for n, x in enumerate(xs):
        if x not in "mi":
            continue
        roles[n] = "marker"
        for near in (n - 1, n + 1):
            if at(near) == "d":
                roles[near] = "divider"
        if at(n + 1) == "x" and x == "i" and at(n + 2) == "d":
            roles[n + 1], roles[n + 2] = "body", "divider"
    return roles


def test_marked_blocks_equal_a_loop(spark):
    rng = random.Random(1)
    docs = {i: rng.choices("midxx", k=rng.randint(0, 14)) for i in range(150)}
    line = F.col("line")
    found = templates.marked_blocks(paragraphs(spark, docs), line.isin("m", "i"), line == "i", line == "d")
    roles = {(r.doc_id, r.pos): r.role for r in found.collect()}
    for i, xs in docs.items():
        assert [roles[i, p] for p in range(len(xs))] == plain_roles(xs), xs
    assert {"marker", "divider", "body", None} == set(roles.values())


def test_scores(spark):
    clean = "현황과 분석\n개선 계획\n목표를 세운다"
    bad = "작성 요령\n금액 OOO 원\n○   두 칸\n두  칸\n\n\n끝\n\t\n　\n| a  b |  c | d |\n"
    docs = spark.createDataFrame([(1, clean), (2, bad), (3, None)], "doc_id int, text string")
    counts = {r.doc_id: r for r in scores.scan(docs).collect()}
    assert [counts[2][c] for c in ("critical", "general", "bullets", "empty_groups", "cell_spaces", "paragraphs")] == [1, 1, 2, 2, 2, 5]
    assert [counts[3][c] for c in ("critical", "general", "bullets", "empty_groups", "cell_spaces", "paragraphs")] == [0] * 6
    told = spark.createDataFrame([(1, "plan", 1.0, 0.5, 6, 0, 1, 1), (2, "plan", None, None, 9, 1, 0, None), (3, "other", 0.0, None, None, None, 3, 0)], "doc_id int, kind string, confidence double, psst_ratio double, font_kinds int, font_outliers int, bold int, images int")
    found = {r.doc_id: r for r in scores.score(scores.scan(docs).join(told, "doc_id"), {"plan": ("목표", "현황", "없다")}).collect()}
    parts = list(scores.PENALTIES) + ["emphasis", "type_structure", "psst_structure", "image_suggestion"]
    assert [found[1][p] for p in parts] == [15, 10, 10, 15, 10, 10, 12.0, 5.0, 5] and (found[1].total, found[1].grade, found[1].passed) == (92.0, "우수", True)
    assert [found[2][p] for p in parts] == [9, 8, 6, 10, 8, 4, 0.0, 0.0, 2] and (found[2].grade, found[2].passed) == ("실패", False)
    assert [found[3][p] for p in parts] == [15, 10, 10, 15, 10, 5, 6.3, 0.0, 2] and found[3].grade == "보완 필요"


def test_sanitised_sections(spark):
    found = spark.createDataFrame([(d, p, f"f{p}", x, True, e) for d in (1, 2) for p, (x, e) in enumerate([("1. 목표", False), ("짧은 제목", False), ("신청기업", False), ("2. 별첨", True)])], "doc_id int, pos int, field_id string, label string, required boolean, excluded boolean")
    done = spark.createDataFrame([(1, True), (2, False), (2, None)], "doc_id int, completed boolean")
    assert sorted((r.doc_id, r.pos) for r in templates.sanitised(found, done).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_questions_that_may_be_drafted(spark):
    missing = [("a", "section", "s1", "목표", True), ("b", "section", "s2", "서약", True), ("c", "table_cell", "c1", "이름", False), ("d", "table_cell", "c2", " ", True), ("e", "table_cell", "c3", "순번", True), ("f", "table_cell", "w1", "값", True), ("g", "table_cell", "w2", "값", False), ("h", "project_meta", "t", "", None), ("i", "table_cell", "w3", "값", False)]
    missing = spark.createDataFrame([(1, *m) for m in missing], "doc_id int, question_id string, kind string, target string, label string, required boolean")
    cells = [(0, f"c{i}", "r", "c") for i in range(1, 4)] + [(1, f"w{i}", "" if i < 3 else "r", "c") for i in range(1, 12)]
    cells = spark.createDataFrame([(1, *c) for c in cells], "doc_id int, `table` int, cell_id string, row_header string, col_header string")
    ids = lambda df: sorted(r.question_id for r in df.collect())
    kept, dropped = templates.drafting_questions(missing, cells, "서약", "순번", transfer=True)
    assert ids(kept) == ["a", "c", "h", "i"] and ids(dropped) == ["f"]
    kept, dropped = templates.drafting_questions(missing, cells, "서약", "순번", transfer=False)
    assert ids(kept) == ["a", "c", "f", "g", "h", "i"] and ids(dropped) == []
    kept, dropped = templates.drafting_questions(missing, cells, "서약", "순번", transfer=True, large=5)
    assert ids(kept) == ["a", "c", "h"] and ids(dropped) == ["f"]
