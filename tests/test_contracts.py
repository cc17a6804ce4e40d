"""Contracts and profiles on small cases; the queries' SQL covers the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import contracts
from corpuskiln.plans import contracts as plans


def test_contract(spark):
    facts = spark.createDataFrame([("a", 0, "f1", "actual", None), ("a", 1, " f1 ", "", "internal conflict"), ("a", 2, None, "maybe", "?"), ("b", 0, "f1", None, None)], "bundle string, pos int, fact_id string, semantic_state string, verification_state string")
    evidence = spark.createDataFrame([("a", 0, "e1", None, None), ("b", 0, "f1", None, None)], "bundle string, pos int, evidence_id string, semantic_state string, verification_state string")
    conflicts = spark.createDataFrame([("a", 0, "c", ["f1", " ", None, "f9"]), ("c", 0, "", None)], "bundle string, pos int, conflict_id string, candidate_fact_ids array<string>")
    found = sorted(map(tuple, contracts.contract_issues(facts, evidence, conflicts).collect()))
    assert found == [
        ("a", "DUPLICATE_ID", "facts[1]", "f1"),
        ("a", "MISSING_ID", "facts[2]", ""),
        ("a", "UNKNOWN_FACT", "conflicts[0].candidate_fact_ids[3]", "f9"),
        ("a", "UNKNOWN_STATE", "facts[2].semantic_state", "MAYBE"),
        ("a", "UNKNOWN_STATE", "facts[2].verification_state", "?"),
        ("b", "SHARED_ID", "facts", "f1"),
        ("c", "MISSING_ID", "conflicts[0]", ""),
    ]
    assert contracts.contract_issues(facts.limit(0), evidence.limit(0), conflicts.limit(0)).count() == 0


def test_profiles_from_many_names(spark):
    raws = [
        '{"company_name": "A", "ceo_name": "B", "representative": "C", "business_item": "I", "tech_stack": ["x", "y"], "tam": {"value": "2조"}, "sam": "3,000억원", "budget_total": "약 1,200만원", "competitors": "K, L", "team": {"current": ["p", "", null]}}',
        '{"name": "", "company_name": "A", "ceo": {"name": null, "career": "boss"}, "representative": "C", "service": {"name": "S"}, "business_model": {"pricing": 5}, "budget": {"self": 7.5, "items": [{"a": 1}]}}',
        "no json",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", contracts.profile(contracts.raw_values(F.col("raw"))).alias("p"))
    a, b, c, d = (r.p for r in rows.orderBy("i").collect())
    assert (a.company.name, a.company.representative, a.ceo.name, a.service.name, a.service.tech_stack) == ("A", "C", "C", "I", "x")
    assert (a.market.tam, a.market.sam, a.budget.total, a.market.competitors, a.team.current_members) == ("2조", "3,000억원", 1200.0, ["K, L"], ["p"])
    assert (b.company.name, b.ceo.name, b.ceo.career, b.service.name, b.bm.pricing, b.budget.self_funding, b.budget["items"]) == ("A", "", ["boss"], "S", "5", 7.5, ['{"a":1}'])
    assert c == d and c.company.name == "" and c.budget.total == 0.0 and c.team.current_members == []
    issues = contracts.profile_issues(rows.select(F.col("i").alias("profile_id"), F.col("p").alias("profile")))
    summary = {r.profile_id: (r.errors, r.warnings, r.infos, r.passed) for r in contracts.issue_summary(rows.select(F.col("i").alias("profile_id")), issues, "profile_id").collect()}
    assert summary == {0: (0, 0, 1, True), 1: (0, 3, 0, True), 2: (2, 3, 1, False), 3: (2, 3, 1, False)}


def test_differences_of_forms_equal_plain_counts(spark):
    from tests.test_alignment import counted

    sf = "/root/testdata/sf0.001"
    source, target = (df.orderBy("doc_id", "pos").collect() for df in plans._forms(spark, sf))
    forms = [{}, {}]
    for form, rows in zip(forms, (source, target), strict=True):
        for r in rows:
            form.setdefault(r.doc_id, []).append(r.line)
    found = {r.doc_id: (r.fills, r.drops, r.edits) for r in plans.form_differences(spark, sf).collect()}
    from difflib import SequenceMatcher

    same = 0
    for k, a in forms[0].items():
        b = forms[1].get(k, [])
        same += found[k] == counted(SequenceMatcher(None, a, b, autojunk=False).get_opcodes(), a, b)
    # Where lines repeat, plain matching may hold a longer block of them instead of an anchor.
    assert same >= 0.98 * len(forms[0])
