"""Predicates, parsers, matching and status rules of forms, on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import masking, parsing, predicates, text
from corpuskiln.operators import checks, company, lines, matching, quality, ranking, records, sections, sft


@pytest.fixture(scope="module")
def say(spark):
    """A function that evaluates an expression of x for each of some texts."""

    def run(expression, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(1)
        return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_masks(say):
    found = say(masking.mask_pii, ["02-123-4567", "900101 - 1234567", "900101-5234567", "홍길동@예시.kr 로", "010 1234 5678", None, ""])
    assert found == ["[전화]", "[주민번호]", "[주민번호]", "[이메일] 로", "[전화]", None, ""]
    assert say(masking.mask_facts, ["매출 1,200만원 ３개"]) == ["매출 N,N만원 N개"]


@pytest.mark.parametrize(
    ("test", "yes", "no"),
    [
        (predicates.is_empty_value, ["", None, " 1,000 ", "...", "http://", "-"], ["A", "서울", "10명"]),
        (predicates.is_dummy_value, ["2000.00.00.", "2000년 00월 00일", "000억원", "000-00-00000", "( - )", "OO기술이 적용된 OO기능", "◈ 창업동기를 기술"], ["", None, "2025.03.17", "100억원", "327-29-01754", "GOOGLE", "2020.0.5", "(주)"]),
        (predicates.looks_numeric, ["30,000,000", "60,000원", "2026-04-10", "10%"], ["", None, "원", "A1", "서울 1"]),
        (predicates.looks_like_name, ["홍길동", "○○○", "John Smith"], ["", None, "기술개발, 특허", "사업화 총괄", "x" * 21]),
        (predicates.is_fill_blank, ["", None, " ___ ", "…"], ["a", "○"]),
        (predicates.is_visible_blank, [" ___ ", "…"], ["", None, "  ", "a"]),
        (predicates.is_seal, ["(인)", "（서명）", "(SEAL)"], ["인", "(인) 홍", None]),
        (predicates.is_guide, ["※ 3쪽 이내로 작성", "○ 사업 내용을 기재하시오", "작성 요령"], ["사업을 작성한다", "", None]),
        (predicates.needs_improvement, ["<예시>", "○○○", "00", "..."], ["", None, "서울", "10"]),
        (predicates.is_option, ["□ 개인", "■ 법인"], ["□", "개인", "□ 개인 □ 법인", None]),
    ],
)
def test_predicates(say, test, yes, no):
    assert say(test, yes + no) == [True] * len(yes) + [False] * len(no)


def test_labels(say, spark):
    assert say(predicates.field_kind, ["기업명", "사업 계획", "", None, "x" * 24, "팀 구성"]) == ["fact", "narrative", "fact", "fact", "narrative", "narrative"]
    assert say(lambda x: predicates.is_noise_label(x, F.when(x == "2", "기업명")), ["", "3", "①", "...", "OOO 대표", "※ 주의", "2", "매출"]) == [True, True, True, True, True, True, False, False]
    assert say(lambda x: predicates.bracket_conflict(x, F.lit("금액(국고)")), ["금액(자부담)", "금액", "금액( 국 고 )", None]) == [True, False, False, False]
    assert say(predicates.protected_path, ["a/.env", "./.env.example", "workspace/x", "b\\cookies.json", "src/a.py", None]) == ["PROTECTED_ENV_FILE", None, "PROTECTED_PROJECT_DATA", "PROTECTED_BROWSER_STATE", None, None]
    assert say(lambda x: predicates.preliminary_founder(x, F.lit(None).cast("string"), F.lit("예비 창업자")), ["기업형태", "사업명"]) == [True, False]
    assert say(lambda x: predicates.company_info_label(x, F.lit(None).cast("string")), ["특허현황", "주소"]) == [True, False]
    assert say(text.label_key, ["○ 1. 기업명(상호)", "가. 대표자", "○", None]) == ["기업명", "대표자", "○", None]


def test_amounts_and_numbers(say):
    assert say(text.amount_in_won, ["1조 2억", "3만", "1,500", "없음", None]) == [1_000_200_000_000.0, 30_000.0, 1500.0, 0.0, 0.0]
    assert say(parsing.amount_in_hundred_millions, ["1조 2억", "1,644억원", "2조", "100,000,000", "1234", "x", None]) == [2.0, 1644.0, 20000.0, 1.0, 1234.0, 0.0, 0.0]
    assert say(text.leading_number, ["약 1,200명", "없음", None]) == [1200.0, 0.0, 0.0]
    found = say(parsing.stated_numbers, ["매출 10억원, 고용: 5명, 수출 3억원", "하나 1명", None])
    assert [[(x["label"], x["value"], x["unit"]) for x in row] for row in found] == [[("매출", 10.0, "억원"), ("수출", 3.0, "억원")], [], []]
    assert say(parsing.criteria, ["차별성 및 경쟁력 (20점) 기타 (3) 총점(200)"])[0][0]["max_score"] == 20
    assert say(lambda x: parsing.contains_term(x, F.lit("1,000")), ["매출 1000원", "매출 10000원", "1 000", None]) == [True, False, True, False]
    assert say(lambda x: parsing.contains_term(F.lit("AI 기반 서비스"), x), ["ai기반", " ", "AIㆍ"]) == [True, True, False]
    assert [str(x) for x in say(parsing.deadline, ["2026. 3. 5까지", "2026년 2월 30일", "없음", None])] == ["2026-03-05", "None", "None", "None"]
    assert say(lambda x: parsing.deadline_status(F.to_date(x), F.to_date(F.lit("2026-03-05"))), ["2026-03-04", "2026-03-08", "2026-03-09", None]) == ["DEADLINE_PAST", "DEADLINE_SOON", None, None]
    assert say(parsing.name_date, ["이력서_20250301", "a 2025-13-01 2024.02.03", "x", None]) == [20250301, 20240203, None, None]
    assert say(parsing.match_text, ["같은 제목입니다요 같은 제목입니다요", " a  – b "]) == ["같은 제목입니다요 같은 제목입니다요", "a - b"]
    assert say(parsing.match_text, ["abcdefgh" * 2]) == ["abcdefgh"]
    assert say(lambda x: parsing.holds_anchor(x, F.lit("사업 개요")), ["1. 사업개요", "", None, "사업  개요"]) == [True, False, False, True]
    assert say(parsing.unwrapped_link, ["https://www.bing.com/ck?u=a1aHR0cHM6Ly9hLmtyL3g&x=1", "https://a.kr/?u=b", "", None]) == ["https://a.kr/x", "https://a.kr/?u=b", "", ""]
    row = say(parsing.announcement, ["지원 대상 : 청년\n접수 기간 2026.1.2\n제출 서류 1부\n최대 1억원, 5,000만원"])[0]
    assert row["eligibility"] == ["지원 대상 : 청년"] and row["amounts"] == ["1억원", "5,000만원"] and len(row["required_documents"]) == 1
    assert say(lambda x: parsing.char_limit(x, F.array().cast("array<int>")), ["10줄 이내", "", None]) == [1500, 500, 500]
    assert say(lambda x: parsing.char_limit(x, F.array(F.lit(200), F.lit(300))), [""]) == [300]
    assert say(lambda x: text.clip(x, 5), ["abcde", "abcd, efg", None]) == ["abcde", "abcd.", None]
    assert say(text.first_year, ["in 2024 and 1999", "120245", None]) == ["2024", "", ""]
    assert say(text.cell_whitespace, ["  a \n b ", None]) == ["a b", None]


def test_lines(spark):
    docs = spark.createDataFrame([(1, "head\n\n\nGUIDE\nx\n---\ny\n---\nz"), (2, None)], "doc_id int, text string")
    rows = lines.lines(docs)
    assert [r.line for r in lines.without_repeated_blanks(rows).orderBy("pos").collect()][:3] == ["head", "", "GUIDE"]
    assert "GUIDE" not in [r.line for r in lines.without_guides(rows, F.col("line") == "GUIDE").collect()]
    assert {r.heading for r in lines.with_heading(rows, F.col("line") == "head").collect()} == {"head"}
    assert [r.line for r in lines.inside_blocks(rows, F.col("line") == "---").filter("inside").orderBy("pos").collect()] == ["---", "y"]
    assert [r.line for r in lines.first_chosen(rows, F.col("line").isin("x", "y", "z"), F.lit(2)).orderBy("pos").collect()] == ["x", "y"]


def test_label_matching(spark):
    t = spark.createDataFrame([("ab", "c1"), ("ab", "c2"), ("zz", None), ("기업명칭", None), ("abcdef", None), ("q", None)], "key string, cluster string")
    s = spark.createDataFrame([("x1", "c1"), ("x2", "c2"), ("zz", None), ("기업명", None), ("abcdeg", None), ("fedcba", None)], "key string, cluster string")
    found = {r.target: (r.source, r.confidence, r.candidates) for r in matching.match_labels(t, s).collect()}
    assert found["ab"] == (None, "conflict", ["x1", "x2"]) and found["zz"] == ("zz", "high", [])
    assert found["기업명칭"] == (None, "fuzzy", ["기업명"]) and found["abcdef"] == (None, "fuzzy", ["fedcba"]) and found["q"] == (None, "low", [])
    assert matching.match_labels(t.limit(0), s).count() == 0 and matching.match_labels(t, s.limit(0)).filter("confidence = 'low'").count() == 5


def test_label_similarity_equals_all_pairs(spark):
    import random

    rng = random.Random(1)
    keys = ["".join(rng.choices("abcdefg", k=rng.randint(1, 7))) for _ in range(120)]
    t, s = (spark.createDataFrame([(k,) for k in sorted(set(ks))], "key string") for ks in (keys[:60], keys[60:]))
    found = {(r.target, r.source) for r in matching._similar(t, s).collect()}

    def alike(a, b):
        x, y = set(a), set(b)
        return round(len(x & y) / len(x | y), 9) >= 0.6 or ((a in b or b in a) and abs(len(a) - len(b)) <= 2)

    assert found == {(a, b) for a in set(keys[:60]) for b in set(keys[60:]) if alike(a, b)}


def test_demotions_confirmations_and_options(spark):
    fields = spark.createDataFrame([("f", "금액", "금액(국고)", 1), ("f", "주소", "주소", 2), ("f", "주소", "주소", 3), ("f", "대표자", "대표자", 4), ("f", "팩스", "팩스", 5)], "form string, key string, label string, pos int")
    none = "array<string>"
    matched = spark.createDataFrame([("금액", "금액", "high", []), ("주소", "주소", "high", []), ("대표자", "대표자", "high", []), ("팩스", None, "low", [])], f"target string, source string, confidence string, candidates {none}")
    values = spark.createDataFrame([("금액", "금액(자부담)", "5"), ("주소", "주소", "서울"), ("대표자", "대표자", "기술개발, 총괄"), ("전송", "전송", "02")], "source string, label string, value string")
    out = matching.demoted(fields, matched, values, "form", F.col("key") == "대표자")
    assert {r.pos: (r.confidence, r.value) for r in out.collect()} == {1: ("bracket", None), 2: ("high", "서울"), 3: ("duplicate", None), 4: ("value_type", None), 5: ("low", None)}
    said = spark.createDataFrame([("팩스", "전송"), ("금액", "없음"), ("이름", "주소")], "key string, source string")
    now, notes = matching.confirmed(out, said, values)
    assert {(r.pos, r.value) for r in now.filter("confidence = 'confirmed'").collect()} == {(5, "02")}
    assert {(r.key, r.note) for r in notes.collect()} == {("금액", "no_value"), ("이름", "no_target")}
    groups = spark.createDataFrame([(1, "법인사업자", "법인사업자"), (2, None, None), (3, "000억원", "000억원"), (4, "기타", "기타"), (5, "개인", "개인")], "group_id int, value string, value_key string")
    options = spark.createDataFrame([(g, i, k) for g in (1, 3, 4) for i, k in enumerate(("개인", "법인"))] + [(5, 0, "개인"), (5, 1, "개인사업자")], "group_id int, option int, option_key string")
    found = {r.group_id: (r.option, r.decision) for r in matching.chosen_options(groups, options, {"개인사업자": "개인", "법인사업자": "법인"}).collect()}
    assert found == {1: (1, "high"), 2: (None, "no_source"), 3: (None, "placeholder"), 4: (None, "no_match"), 5: (None, "ambiguous")}


def test_sections(spark):
    aliases = {"MARKET": ("시장 규모",), "TEAM": ("팀 구성",)}
    raw = spark.createDataFrame([("s1", "시장 규모와 전망", None), ("s2", "기타 항목", None), ("s3", "x", ["team"])], "section_id string, name string, explicit array<string>")
    sec = sections.with_categories(raw, aliases, F.col("name")).withColumn("tokens", text.tokens(F.col("name"))).withColumn("expected", F.when(F.col("section_id") == "s3", F.array(F.lit("actual"))))
    assert {r.section_id: r.categories for r in sec.collect()} == {"s1": ["MARKET"], "s2": [], "s3": ["TEAM"]}
    src = [("f.docx", "p1"), ("f.docx", "p1"), ("", None)]
    mats = [("m1", "FACT", "size", "10억", src, None, None, ["MARKET"], []), ("m2", "FACT", "size", " ", src, None, None, ["MARKET"], []), ("m3", "EVIDENCE", "", "글", [("f", "")], None, None, ["MARKET"], []), ("m4", "FACT", "", "v", src, "stale-x", None, ["MARKET"], []), ("m5", "FACT", "", "v", src, None, "plan", ["TEAM"], []), ("m6", "FACT", "", "v", src, None, None, [], ["기타"])]
    mats = spark.createDataFrame(mats, "material_id string, material_type string, field string, value string, sources array<struct<file:string,location:string>>, verification string, semantic string, categories array<string>, tokens array<string>")
    mats = mats.withColumn("origin", sections.sources())
    assert mats.select(F.size("origin")).first()[0] == 1
    pairs = sections.matched_materials(sec, mats)
    assert {(r.section_id, r.material_id): r.reason for r in pairs.collect()} == {("s1", "m1"): None, ("s1", "m2"): "EMPTY", ("s1", "m3"): "NO_SOURCE", ("s1", "m4"): "BLOCKED_STATE", ("s3", "m5"): "SEMANTIC_MISMATCH", ("s2", "m6"): None}
    used = pairs.filter("reason is null")
    reqs = [("r1", None, "size", None, None, ["MARKET"], [], True, False), ("r2", None, None, None, None, ["TEAM"], [], True, True), ("r3", ["s2"], None, None, None, [], [], True, False), ("r4", ["s1"], None, "EVIDENCE", None, [], [], None, None), ("r5", ["s9"], None, None, None, ["MARKET"], [], True, True)]
    reqs = spark.createDataFrame(reqs, "requirement_id string, target_ids array<string>, required_field string, material_type string, expected array<string>, categories array<string>, tokens array<string>, required boolean, blocking boolean")
    applied = sections.applicable(reqs, sec)
    assert {(r.requirement_id, r.section_id) for r in applied.collect()} == {("r1", "s1"), ("r2", "s3"), ("r3", "s2"), ("r4", "s1")}
    met = sections.satisfied(reqs, applied, used, mats)
    assert {(r.requirement_id, r.section_id) for r in met.collect()} == {("r1", "s1"), ("r3", "s2")}
    clash = spark.createDataFrame([("c1", "s2")], "conflict_id string, section_id string")
    status = {r.section_id: (r.status, r.n_missing) for r in sections.section_status(sec, used, applied, met, reqs, clash).collect()}
    assert status == {"s1": ("PARTIAL_WRITABLE", 1), "s2": ("PARTIAL_WRITABLE", 0), "s3": ("BLOCKED_REQUIRED_INFO", 1)}


def test_quality(spark):
    items = spark.createDataFrame([("d", "a", 1.25), ("d", "b", 2.0), ("d", "c", 3.0)], "doc string, item string, score double")
    axes = {"x": ("a", "b"), "y": ("c",)}
    assert [tuple(r) for r in quality.axis_sums(items, axes).collect()] == [("d", 6.2, 3.2, 3.0)]
    with pytest.raises(Exception, match="item of no axis"):
        quality.axis_sums(items, {"x": ("a",)}).collect()
    docs = spark.createDataFrame([("r1", "b", 80.0), ("r1", "a", 91.0), ("r2", None, None)], "run string, doc string, total double")
    assert {r.run: (r.n_docs, r.doc_set, r.avg_total) for r in quality.run_summary(docs, []).collect()} == {"r1": (2, ["a", "b"], 85.5), "r2": (0, [], None)}
    kind = "k string, n_docs long, doc_set array<string>, avg_total double, tests_passed long, tests_failed long"
    base = [(k, 1, ["a"], 80.0, 10, 0) for k in ("ok", "up", "low", "less", "fail", "set", "skip")]
    now = [("ok", 1, ["a"], 80.0, 10, 0), ("up", 1, ["a"], 81.0, 10, 0), ("low", 1, ["a"], 79.0, 10, 0), ("less", 1, ["a"], 80.0, 9, 0), ("fail", 1, ["a"], 80.0, 10, 2), ("set", 1, ["b"], 10.0, 10, 0), ("skip", 0, [], None, None, None), ("new", 1, ["a"], 1.0, 1, 5)]
    s, b = spark.createDataFrame(now, kind), spark.createDataFrame(base, kind)
    gate = quality.ratchet(s, b, "k")
    assert {r.k: (r.status, r.failures) for r in gate.collect()} == {"ok": ("OK", []), "up": ("IMPROVED", []), "low": ("FAIL", ["avg_total"]), "less": ("FAIL", ["tests_passed"]), "fail": ("FAIL", ["tests_failed"]), "set": ("RESET", []), "skip": ("OK", []), "new": ("SEED", [])}
    after = {r.k: (r.doc_set, r.avg_total, r.tests_passed) for r in quality.next_baseline(s, b, gate, "k").collect()}
    assert after["set"] == (["b"], 10.0, 10) and after["low"] == (["a"], 80.0, 10) and after["skip"] == (["a"], 80.0, 10) and after["up"][1] == 81.0
    runs = spark.createDataFrame([("p", 1, 50.0), ("p", 2, 60.0), ("p", 3, 61.0), ("p", 4, 55.0)], "k string, i int, total double")
    assert [r.plateau for r in quality.plateaus(runs, "k", "i", "total").orderBy("i").collect()] == [False, False, True, True]
    assert [tuple(r) for r in quality.first_drop(runs, "k", "i", "total").collect()] == [("p", 4, 61.0, 55.0)]
    assert [r.i for r in quality.lowest_pass(runs, "k", "total", "i").collect()] == [1]
    scores = spark.createDataFrame([("e", 5.0, 10.0, "s1", 1), ("e", 9.0, 10.0, "s2", 2), ("e", 1.0, 10.0, "s1", 3)], "run string, score double, max_score double, section string, seq int")
    assert [(r.total, r.ratio, r.weak_sections) for r in quality.evaluation(scores).collect()] == [(15.0, 0.5, ["s1"])]


def test_company(spark):
    syn = company.synonym_table(spark, {"기업명": ["회사명", "상호"], "대표자": ["성명"], "직위": ["직급"]})
    pairs = [(1, "회사명", "성명", 0), (1, "상호", "가나", 1), (1, "기업명", "다라", 2), (1, "성명", "총괄 담당", 3), (1, "대표자", "홍길동", 4), (1, "직급", "대리", 5)]
    found = company.first_valid(spark.createDataFrame(pairs, "doc int, label string, value string, pos int"), syn, "doc", ["pos"])
    assert {(r.field, r.value, r.raw_label) for r in found.collect()} == {("기업명", "가나", "상호"), ("대표자", "홍길동", "대표자")}
    assert company.missing_fields(found, "doc").first().missing == [f for f in company.COMPANY_FIELDS if f not in ("기업명", "대표자")]
    labels = [("f", "c", "기업명", 1), ("f", "c", "기업명", 2), ("f", "c", "대표자", 3), ("f", "c", "주소", 4), ("f", "c", None, 5)]
    master = [("c", "기업명", "가나", "high"), ("c", "대표자", "홍", "conflict")]
    row = company.coverage(spark.createDataFrame(labels, "form_id string, company_id string, field string, pos int"), spark.createDataFrame(master, "company_id string, field string, value string, confidence string")).first()
    assert (row.fillable, row.conflict, row.missing, row.unmapped, row.mappable, row.coverage_pct) == (1, 1, 1, 1, 3, 33.3)


def test_checks(spark):
    docs = spark.createDataFrame([(1, "[확인필요: 매출] 제목 <사업 제목 > OOO기업 OOO ○○○\n성명: 홍길동\n| 성명 | 김철수 |\n해당 여부 | ( )"), (2, None)], "doc_id int, text string")
    by = {(r.doc_id, r.check_id): r.defects for r in checks.results(docs, checks.registry()).collect()}
    assert by[1, "unresolved_markers"] == 1 and by[1, "template_placeholders"] == 3 and by[1, "paren_choices"] == 1 and all(n == 0 for (d, _), n in by.items() if d == 2)
    blind = {r.check_id: (r.severity, r.defects) for r in checks.results(docs.filter("doc_id = 1"), checks.registry(blind=True, strict=True)).collect()}
    assert blind["template_placeholders"][1] == 1 and blind["masking_violation"] == ("fail", 2) and blind["paren_choices"] == ("fail", 1)
    items = checks.with_remedies(checks.results(docs, checks.registry()))
    work = items.transform(checks.remaining_work).collect()
    assert [(r.doc_id, r.auto_commands, r.human_fields, r.blocking_defects, r.remaining_checks) for r in work] == [(1, 1, 2, 4, 3)]
    ranked = ranking.severity_first(items.withColumn("seq", F.col("check_id")), "doc_id").orderBy("rank").collect()
    assert [r.severity for r in ranked] == ["fail", "fail", "warn"]


def test_ranking(spark):
    files = spark.createDataFrame([("t", "/a/이력서_20250301.docx", 1), ("t", "/a/이력서 신청서_20250401.docx", 9), ("t", "/a/사업계획.docx", 5)], "target string, path string, mtime long")
    first = ranking.ranked_sources(files, ["사업"], prefer_resume=True).filter("rank = 1").first()
    assert first.path.endswith("20250401.docx")
    assert ranking.ranked_sources(files, ["사업"]).filter("rank = 1").first().path.endswith("사업계획.docx")
    assert ranking.picked_sources(ranking.ranked_sources(files, ["사업"], True), 1).first().path.endswith("사업계획.docx")
    folder = spark.createDataFrame([("f", "/f/a 안내.pdf", 9), ("f", "/f/모집 공고문.pdf", 1)], "folder string, path string, mtime long")
    assert ranking.best_announcement(folder, ["공고", "안내"]).first().path == "/f/모집 공고문.pdf"
    stems = spark.createDataFrame([("A.txt",), ("a.docx",), ("b.txt",), ("b.pdf",)], "path string")
    assert {r.path for r in ranking.one_per_stem(stems).collect()} == {"a.docx", "b.txt"}
    hits = spark.createDataFrame([("q", 1, "https://x.com"), ("q", 2, "https://a.go.kr/b")], "topic string, seq int, url string")
    assert [r.seq for r in ranking.preferred_results(hits, (".go.kr",)).orderBy("rank").collect()] == [2, 1]
    assert [r.seq for r in ranking.required_first(hits.withColumn("required", F.col("seq") == 2), "topic").orderBy("rank").collect()] == [2, 1]
    many = spark.createDataFrame([("k", i) for i in range(9)], "k string, v int")
    assert [tuple(r) for r in ranking.samples(many, ["k"], "v", ["v"]).collect()] == [("k", 9, [0, 1, 2, 3, 4])]


def test_examples_from_traces_and_feedback(spark):
    kind = "project_id string, qid string, label string, kind string, context string, system string, answer string, seq long"
    traces = [("p", "1", "개요", "section", "c", "s", "초안 10", 1), ("p", "1", "개요", "section", "c", "s", " ", 2), ("p", "2", "표", "cell", "c", "s", "값", 3), ("p", "3", "", "section", "c", "s", "거부", 4), ("p", "4", "배경", "", None, None, None, 5)]
    said = [("p", "1", "edited", "사람 20%", 1), ("p", "1", "draft_rejected", None, 2), ("p", "2", "edited", " ", 3), ("p", "2", "edited", "셀", 4), ("p", "3", "draft_rejected", None, 5), ("p", "4", "edited", "글 02-123-4567", 6)]
    t, f = spark.createDataFrame(traces, kind), spark.createDataFrame(said, "project_id string, qid string, action string, after string, seq long")
    out = {r.qid: r for r in sft.examples(t, f, mask=True).collect()}
    assert {q: (r.source, r.assistant) for q, r in out.items()} == {"1": ("human", "사람 N%"), "2": ("human", "셀"), "4": ("human", "글 [전화]")}
    assert out["1"].user.startswith("[작성 항목] 개요\n[참고 컨텍스트]\nc\n\n")
    assert {r.label_key: r.answers for r in sft.few_shots(t, f).collect()} == {"개요": ["사람 N%"], "배경": ["글 [전화]"]}
    asked = spark.createDataFrame([("q1", " 개 요 ", "section"), ("q2", "표", "cell")], "question_id string, label string, kind string")
    assert [tuple(r) for r in sft.suggest(asked, sft.few_shots(t, f)).collect()] == [("q1", " 개 요 ", ["사람 N%"])]
    assert sft.export_counts(t, f).first().asDict() == {"traces": 5, "feedbacks": 6, "examples": 3, "human_approved": 3, "ai_only": 0, "learned_labels": 2}
    assert '"role":"system"' in sft.chat_lines(sft.examples(t, f)).first().value
    assert sft.examples(t.limit(0), f.limit(0)).count() == 0 and sft.export_counts(t.limit(0), f.limit(0)).first().examples == 0


def test_overlay(spark):
    a = spark.createDataFrame([(1, " "), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (3, None)], "k int, v string")
    assert {tuple(r) for r in records.overlay(a, b, "k", "v").collect()} == {(1, "y"), (2, "x"), (3, "")}


def test_file_names_headings_and_snippets(say):
    names = say(parsing.file_name, [" a  b?.txt ", "", None, "../x", "nul.txt", "x" * 200 + ".pdf", "???", "..."])
    assert [(n["name"], n["error"]) for n in names[:5]] == [("a b_.txt", None), (None, "blank"), (None, "blank"), (None, "path"), (None, "reserved")]
    assert len(names[5]["name"]) == 180 and names[5]["name"].endswith(".pdf") and names[6]["name"] == "_" and names[7]["error"] == "path"
    found = say(parsing.square_heading, ["■ 핵심 기술 — 요약", "■ 핵심 성과 — 매출 3억, 고용", "■ 개요", "■ (개요)", "본문", "■ 시장 (국내)", None])
    assert found == ["■ (핵심 기술)", "■ 핵심 성과 — 매출 3억, 고용", "■ 개요", "■ (개요)", "본문", "■ (시장)", None]
    long = " ".join(f"Sentence number {i} is here to fill the block." for i in range(40))
    rows = say(parsing.packed_snippets, [f"short\n\n{'word ' * 12}\n \n<b>{'tag ' * 20}</b>", long, None])
    assert rows[0] == [("word " * 12).strip()] and rows[2] == []
    assert " ".join(rows[1]) == long and all(40 <= len(x) <= 700 for x in rows[1]) and len(rows[1]) == 3


def test_options_narratives_and_pairs(spark):
    options = spark.createDataFrame([("경영기반 전문상담", ["경영"], 1), ("기술 전문상담", ["기술"], 2)], "label string, aliases array<string>, seq int")
    said = spark.createDataFrame([("경영",), ("기술 전문",), ("전문상담",), ("법률",), (" ",), (None,)], "confirm string")
    assert {r.confirm: (r.label, r.status) for r in matching.named_options(said, options).collect()} == {"경영": ("경영기반 전문상담", "exact"), "기술 전문": ("기술 전문상담", "loose"), "전문상담": (None, "ambiguous"), "법률": (None, "unknown")}
    labels = spark.createDataFrame([("사업 개요", "narrative"), ("기업명", "fact")], "label string, kind string")
    targets = spark.createDataFrame([("개요",), ("기업명",), ("",)], "label string")
    assert [r.label for r in matching.narrative_unmatched(targets, labels).collect()] == ["개요"]
    matched = spark.createDataFrame([("s", "t", "high"), ("s", "t", "low"), ("s", "u", "low")], "s string, t string, confidence string")
    assert {(r.t, r.score) for r in matching.pair_scores(matched, ["s", "t"]).collect()} == {("t", 1), ("u", 0)}


def test_categories_advice_and_baselines(spark):
    items = spark.createDataFrame([("a", "auto", "warn", 3), ("b", "auto", "fail", 3), ("c", "human", "fail", 9), ("d", "manual", "fail", 3), ("e", "manual", "fail", None)], "check_id string, kind string, severity string, n_runs int")
    assert {r.check_id: r.category for r in checks.categories(items).collect()} == {"a": "code_improvement", "b": "auto_fix", "c": "human_input", "d": "code_improvement", "e": "manual_review"}
    advice = spark.createDataFrame([("r", "A", None, "m", 1, 0), ("r", "A", None, "m", 2, 2), ("r", "B", "f", "m", 3, 1)], "run string, code string, form string, message string, seq int, exit_code int")
    once, codes = checks.merged_advice(advice)
    assert sorted(r.seq for r in once.collect()) == [1, 3] and codes.first().exit_code == 2
    kind = "k string, pages int, chars int, images int, bold int"
    now = spark.createDataFrame([("x", 2, 70, 1, 1), ("y", 1, 5, 0, 0)], kind)
    was = spark.createDataFrame([("x", 2, 100, 1, 3), ("z", 1, 1, 1, 1)], kind)
    found = {(r.k, r.check): r.passed for r in checks.compared_to_baseline(now, was, "k").collect()}
    assert found == {("x", "file"): True, ("x", "pages"): True, ("x", "text"): True, ("x", "images"): True, ("x", "bold"): True, ("y", "file"): False, ("z", "file"): False}


def test_records_of_people_and_rules(spark):
    edu = [("p", "대학", "학과", "석사 수료", 1), ("p", "대학", "학과", "석사", 2), ("p", "대학", "학과", "학사 졸업", 3), ("p", None, None, "석사", 4), ("p", "대학", "학과", None, 5)]
    rows = records.consolidated_education(spark.createDataFrame(edu, "person string, school string, major string, degree string, seq int"), "person", "seq")
    assert sorted(r.seq for r in rows.filter("kept").collect()) == [2, 3, 4, 5]
    dup = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("b", "x", 3)], "k string, v string, seq int")
    assert sorted(r.seq for r in records.union_distinct(dup, ["k", "v"], ["seq"]).collect()) == [1, 3]
    q = spark.createDataFrame([("1", "section", "f1", True), ("2", "section", "f2", False), ("3", "image", None, True), ("4", "table_cell", None, True)], "question_id string, kind string, field_id string, required boolean")
    a = spark.createDataFrame([("4", "  "), ("2", "x")], "question_id string, value string")
    none = spark.createDataFrame([("f1",)], "field_id string")
    assert [r.question_id for r in records.missing_questions(q, a, none).collect()] == ["4"]
    assert sorted(r.question_id for r in records.missing_questions(q, a.limit(0), none.limit(0), True).collect()) == ["1", "4"]
    rules = spark.createDataFrame([("r1", "all", True), ("r2", "x", False), ("r3", "y", True), ("r4", "all", False), ("r5", "all", True)], "rule_id string, domain string, automated boolean")
    guards = spark.createDataFrame([("r1", True), ("r5", False)], "rule_id string, passed boolean")
    assert {r.rule_id: r.status for r in records.rule_status(rules, guards, "y").collect()} == {"r1": "PASS", "r2": "NA", "r3": "UNVERIFIABLE", "r4": "REVIEW_REQUIRED", "r5": "FAIL"}
    assert [r.rule_id for r in records.filtered(rules, "R", ["rule_id"], {"domain": "x"}).collect()] == ["r2"]
    gold = spark.createDataFrame([("g1", 1, ["a"]), ("g2", 1, ["z"]), ("g3", 9, ["a"]), ("g4", 1, [])], "assertion_id string, doc_id int, terms array<string>")
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    found = records.golden(gold, docs, F.forall("terms", lambda t: parsing.contains_term(F.col("text"), t)))
    assert {r.assertion_id: r.status for r in found.collect()} == {"g1": "FOUND", "g2": "READ_MISS", "g3": "FILE_MISSING", "g4": "SKIPPED"}
    assert {r.doc_id: r.found_rate for r in records.status_report(found).collect()} == {1: 0.5, 9: None}
    defects = spark.createDataFrame([("c", 3)], "check string, n_runs int")
    first = records.promote(defects, "check", "k", F.lit("fail"))
    assert first.count() == 1 and records.promote(defects, "check", "k", F.lit("fail"), stored=first).count() == 0


def test_lines_of_sections(spark):
    rows = lines.lines(spark.createDataFrame([(1, "intro\nAI plan\nab\ncd\n1. Next\nAI plan\nef 10\nlabel: value")], "doc_id int, text string"))
    assert [tuple(r) for r in lines.spans(rows, F.col("line").startswith("AI"), F.col("line").rlike("^[0-9]")).collect()] == [(1, 2, 4)]
    key = F.when(F.col("line").startswith("AI"), "ai").when(F.col("line").startswith("1."), "next")
    assert [r.section for r in lines.first_sections(rows, key).orderBy("pos").collect()] == [None, "ai", "ai", "ai", "next", "next", "next", "next"]
    assert [(r.match, r.heading) for r in lines.findings(rows, "[0-9]+", F.col("line").startswith("AI")).orderBy("pos").collect()] == [("1", "AI plan"), ("10", "AI plan")]
    assert [r.pos for r in lines.grep(rows, "ai", 1).collect()] == [1]
    assert [(r.label, r.value) for r in lines.line_fields(rows).collect()] == [("label", "value")]
    text_ = spark.createDataFrame([(1, "key 12345\nkey none here\nkey 99999\nkey 77777")], "doc_id int, text string")
    assert [r.pos for r in lines.key_sentences(lines.lines(text_), ["key"], 0.5, 1, 5).orderBy("pos").collect()] == [0, 2]


def test_similarity_and_votes(spark, say):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "x array<string>, y array<string>, z array<string>").select(text.jaccard(F.col("x"), F.col("y")).alias("j"), text.jaccard(F.col("x"), F.col("z")).alias("n")).first()
    assert abs(row.j - 1 / 3) < 1e-9 and row.n == 0
    from corpuskiln.operators import assets, lexicons

    lexicon = {"problem": ("문제", "pain"), "team": ("팀", "대표")}
    assert say(lambda x: assets.voted(x, lexicon), ["문제 제기", "문제와 팀", "없음", None, "팀 대표 문제"]) == ["problem", "unclassified", "unclassified", "unclassified", "team"]
    assert say(lambda x: assets.voted(x, lexicon, F.lit("03_team"), {"team": "team"}), ["문제"]) == ["team"]
    docs = spark.createDataFrame([(1, "mail a@b and http")], "doc_id int, text string")
    areas = {"c": {"mail": ["@"], "web": ["http"]}, "d": {"x": ["zz"], "y": ["yy"]}}
    found = {r.area: (r.grade, r.overall) for r in lexicons.graded(lexicons.coverage(docs, areas), {"A": 0.9, "B": 0.5, "C": 0.0}).collect()}
    assert found == {"c": ("A", 0.5), "d": ("C", 0.5)}


def test_greedy_choices(spark, say):
    from corpuskiln.operators import assets

    kind = "g string, question_id string, seq int, snippet_id string, score double"
    rows = [("p", "q1", 1, "a", 9.0), ("p", "q1", 1, "b", 8.0), ("p", "q2", 2, "a", 9.0), ("p", "q2", 2, "c", 1.0), ("r", "q2", 1, "a", 1.0)]
    out = matching.exclusively(spark.createDataFrame(rows, kind), "g", 2)
    assert sorted(map(tuple, out.collect())) == [("p", "q1", "a"), ("p", "q1", "b"), ("p", "q2", "c"), ("r", "q2", "a")]
    pairs = [("d", 1, "p1", "x", 0.9), ("d", 1, "p1", "y", 0.7), ("d", 2, "p2", "x", 0.95), ("d", 2, "p2", "y", 0.65), ("d", 3, "p3", "y", 0.5)]
    found = assets.assigned(spark.createDataFrame(pairs, "doc string, seq int, anchor_id string, asset_id string, score double"), "doc")
    assert {r.anchor_id: (r.asset_id, r.decision) for r in found.collect()} == {"p1": ("x", "auto"), "p2": ("y", "review"), "p3": ("y", "none")}
    rules = {"chart": ("시장", "매출"), "flow": ("일정", "시장")}
    got = say(lambda x: assets.suggestions(x, rules), ["시장 규모\n시장 전망\n매출", "없음", None])
    assert [[(x["line"], x["type"]) for x in row] for row in got] == [[("시장 규모", "chart"), ("시장 전망", "flow")], [], []]


def test_snippet_scores_equal_all_pairs(spark):
    import random

    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    qs = [(i, rng.sample(words, rng.randint(0, 3))) for i in range(25)]
    ss = [(i, " ".join(rng.choices([*words, "표", "그림"], k=rng.randint(1, 90)))) for i in range(40)]
    tokens = {i: set(t.split()) - {"표"} for i, t in ss}
    expected = []
    for q, own in qs:
        scores = []
        for i, t in ss:
            score = 2.0 * len(set(own) & tokens[i]) + 0.5 * (("표" in t) + ("그림" in t)) + (-1.5 if len(t) < 50 else -1.0 if len(t) > 280 else 0.0)
            if own and tokens[i] and score >= 0.5:
                scores.append((-score, i))
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:4])]
    a = spark.createDataFrame(qs, "question_id int, tokens array<string>")
    b = spark.createDataFrame([(i, t, sorted(tokens[i])) for i, t in ss], "snippet_id int, text string, tokens array<string>")
    assert sorted(map(tuple, matching.ranked_snippets(a, b, ("표", "그림"), least=0.5).collect())) == sorted(expected)


def test_criteria_diffs_and_autofill(spark):
    crit = spark.createDataFrame([(1, "사업성", 20, 1), (1, "기술성 평가", 25, 2), (1, "팀", 11, 3)], "doc_id int, name string, max_score int, seq int")
    said = spark.createDataFrame([(1, "사업성", 30), (1, "기술성", 7), (1, "모름", 9)], "doc_id int, name string, score int")
    got = {(r.name, r.score) for r in quality.criterion_scores(said, crit).collect()}
    assert got == {("사업성", 20), ("기술성", 7), ("기술성 평가", 12), ("팀", 5)}
    a = spark.createDataFrame([(1, "a\n\nc\nd")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "a\nb\n\nx")], "doc_id int, text string")
    assert [tuple(r) for r in lines.positional_diff(lines.lines(a), lines.lines(b)).collect()] == [(1, 1, 1, 1)]
    doc = spark.createDataFrame([(1, "회사 명: 가나\n기업명: 다라\n기타: x\nTel : 02")], "doc_id int, text string")
    assert {(r.field, r.value) for r in lines.autofill(lines.lines(doc), {"name": ["회사명", "기업명"], "phone": ["TEL"]}).collect()} == {("name", "가나"), ("phone", "02")}


def test_white_space_of_every_kind(say, spark):
    """Tabs, no-break and ideographic spaces are white space everywhere."""
    wide = "　  \t"
    assert say(text.bare, [f"{wide}a b{wide}", wide, None]) == ["a b", "", ""]
    assert say(text.unique_lines, [f"x\n{wide}\n{wide}x{wide}\ny"]) == [["x", "y"]]
    assert say(text.cell_whitespace, [f"{wide}a{wide}b"]) == ["a b"]
    assert say(text.value_key, [f"A{wide}-b"]) == ["ab"]
    assert say(text.normal_url, [f"{wide}HTTP://A.b/c/{wide}"]) == ["http://a.b/c"]
    assert say(predicates.is_guide, ["（작성 요령", "(기재하시오", "가나"]) == [True, True, False]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "\t", "　", "b", " "])], "doc_id int, pos int, line string")
    assert [(r.first, r["size"]) for r in lines.runs(rows, text.bare(F.col("line")) == "").collect()] == [(1, 2)]
    assert [r.pos for r in lines.without_repeated_blanks(rows).orderBy("pos").collect()] == [0, 1, 3, 4]
    docs = spark.createDataFrame([(1, "명칭 | \t"), (2, "| 기업명 |　| 명칭 |")], "doc_id int, text string")
    found = {r.doc_id: r.defects for r in checks.results(docs, checks.LINE_CHECKS).filter("check_id = 'empty_label_fields'").collect()}
    assert found == {1: 1, 2: 1}


def test_best_matches_equal_those_of_all_pairs(spark):
    import random

    from corpuskiln.operators import assets

    rng = random.Random(5)
    kinds, types = ["a", "b", assets.UNCLASSIFIED], ["t", "u", "", None]
    anchors = spark.createDataFrame([(i, rng.choice(kinds), rng.choice(types), rng.sample(["Tin", "brass", "steel", "x y"], rng.randint(0, 3))) for i in range(60)], "anchor_id int, class string, type string, keywords array<string>")
    pictures = spark.createDataFrame([(i, rng.choice(kinds), rng.choice(types), rng.choice(["tin brass", "STEEL", "", None, "x y tin", "nothing"]), rng.choice([None, 0, 5, 200_000, 900_000])) for i in range(50)], "asset_id int, class string, type string, text string, pixels int")
    expected = sorted(map(tuple, assets.best_assets(assets.scored_pairs(anchors, pictures)).collect()))
    assert sorted(map(tuple, assets.best_matches(anchors, pictures).select("anchor_id", "asset_id", "score", "margin", "decision").collect())) == expected
    assert assets.best_matches(anchors.limit(0), pictures).count() == 0


def test_similar_keys_are_all_found(spark):
    import random

    from corpuskiln.operators import matching

    rng = random.Random(6)
    keys = sorted({"".join(rng.choices("abcdefgh가나다", k=rng.randint(1, 8))) for _ in range(150)})
    df = spark.createDataFrame([(k, None) for k in keys], "key string, cluster string")
    found = {(r.target, r.source): r.similarity for r in matching._similar(df, df).collect()}
    for a in keys:
        for b in keys:
            similarity = len(set(a) & set(b)) / len(set(a) | set(b))
            near = (a in b or b in a) and abs(len(a) - len(b)) <= 2
            assert ((a, b) in found) == (round(similarity, 9) >= matching.FUZZY or near), (a, b)


def test_fields_of_a_line_and_their_places(spark):
    import random
    import re

    plain = re.compile(r"(?P<label>[^\s:：][^:：\t]{0,38}?)[ \t　]*(?P<colon>[:：])(?P<value>.*?)(?=(?:[ \t　]{2,}|\t)\S|[ \t　]*$)")
    rng = random.Random(7)
    parts = ["기업명", "대표자", " ", "  ", "\t", "　　", ":", "：", "___", "홍 길동", "a", "\U0001f600", "x" * 45]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 10))) for _ in range(600)] + [None, "", "기업명 : __   대표자 : 홍"]
    found = {}
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, pos int, line string")
    for r in lines.fields_in_place(rows).orderBy("pos", "nth").collect():
        found.setdefault(r.pos, []).append((r.label, r.value, r.start, r.end))
    for i, t in enumerate(texts):
        assert found.get(i, []) == [(m["label"], m["value"], m.start("value"), m.end("value")) for m in plain.finditer(t or "")], repr(t)
