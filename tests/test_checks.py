"""Acceptance checks on lines and cells."""

from __future__ import annotations

from corpuskiln.operators import checks


def test_line_checks_find_their_defects(spark):
    bad = {
        "self_inserted_blocks": "이 블록은 삭제하세요",
        "unchecked_choices": "형태 택 1 | □ 개인\n형태 택 1 | □ 법인",
        "empty_label_fields": "| 기업명 | | 명칭 |",
        "recruit_date_conflict": "채용 '26.3\n채용 2026년 3월\n채용 2026년 4월",
        "paren_choices": "해당 여부 | ( )",
        "empty_label_fields_ext": "명칭 : | \n",
        "unverified_claims": "협약 체결",
        "missing_required_documents": "청렴 서약서",
    }
    good = "형태 택 1 | ■ 개인 □ 법인\n| 기업명 | A |\n채용 '26.3\n해당 여부 | (V)\n협약 체결 예정\n청렴 서약서 재직 증명서"
    docs = spark.createDataFrame([*bad.items(), ("good", good), ("null", None)], "doc_id string, text string")
    every = checks.LINE_CHECKS + (checks.UNVERIFIED_CLAIMS, checks.missing_documents(("청렴서약서", "재직증명서")))
    found = {(r.doc_id, r.check_id): r.defects for r in checks.results(docs, every).collect() if r.defects}
    missing = {k: n for k, n in found.items() if k[1] == "missing_required_documents"}
    assert {k: n for k, n in found.items() if k not in missing} == {(k, k): 1 for k in bad if k != "missing_required_documents"}
    assert missing == {(k, "missing_required_documents"): 1 if k == "missing_required_documents" else 2 for k in (*bad, "null")}
