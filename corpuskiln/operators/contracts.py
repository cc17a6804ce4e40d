"""Contracts of extracted facts, and profiles of companies: issues as rows, with their path.

Rules are data. A contract is about three tables that refer to each other; a profile is built from raw values under many names
into blocks, and judged by a list of rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import amount_in_won, bare, leading_number, let

#: What may be said of a fact's meaning, and of how far it is verified.
SEMANTIC_STATES = ("ACTUAL", "PLAN", "ESTIMATE", "HYPOTHESIS", "UNKNOWN", "NOT_APPLICABLE", "CONFLICT")
VERIFICATION_STATES = ("CONFIRMED", "INFERRED", "UNKNOWN", "CONFLICT", "NOT_APPLICABLE", "REVIEW_REQUIRED", "STALE", "UNVERIFIABLE", "INTERNAL_CONFLICT")


def state_key(state: Column) -> Column:
    """A state as it is compared: upper case, with underscores for hyphens and spaces; blank and null are empty."""
    return F.translate(F.upper(bare(state)), "- ", "__")


def _own_issues(rows: DataFrame, name: str, id_: str, states: Mapping[str, Sequence[str]]) -> DataFrame:
    """Blank and repeated ids and unknown states of one table (bundle, pos, id and states)."""
    held = rows.select("bundle", "pos", bare(F.col(id_)).alias("id"), *(state_key(F.col(s)).alias(s) for s in states))
    nth = F.row_number().over(W.partitionBy("bundle", "id").orderBy("pos"))
    held = held.withColumn("nth", nth)
    place = F.concat(F.lit(f"{name}["), F.col("pos").cast("string"), F.lit("]"))
    issue = lambda when, rule, path, detail: F.when(when, F.struct(F.lit(rule).alias("rule"), path.alias("path"), detail.alias("detail")))
    blank = F.col("id") == ""
    found = [
        issue(blank, "MISSING_ID", place, F.lit("")),
        issue(~blank & (F.col("nth") > 1), "DUPLICATE_ID", place, F.col("id")),
        *(issue((F.col(s) != "") & ~F.col(s).isin(list(known)), "UNKNOWN_STATE", F.concat(place, F.lit(f".{s}")), F.col(s)) for s, known in states.items()),
    ]
    return held.select("bundle", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("bundle", "x.*")


def contract_issues(facts: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """bundle, rule, path and detail of everything that breaks the contract of a bundle of facts, evidence and conflicts.

    facts: bundle, pos, fact_id, semantic_state, verification_state; evidence: the same with evidence_id; conflicts: bundle,
    pos, conflict_id and candidate_fact_ids. Rules: MISSING_ID and DUPLICATE_ID (each after the first) in any table,
    UNKNOWN_STATE (a blank one is allowed), SHARED_ID (of a fact and of evidence) and UNKNOWN_FACT (a conflict's candidate that
    is no fact of the bundle; blank candidates are none). A bundle without issues has no row; null ids are blank.
    """
    states = {"semantic_state": SEMANTIC_STATES, "verification_state": VERIFICATION_STATES}
    own = _own_issues(facts, "facts", "fact_id", states).unionByName(_own_issues(evidence, "evidence", "evidence_id", states)).unionByName(_own_issues(conflicts, "conflicts", "conflict_id", {}))
    ids = lambda df, c: df.select("bundle", bare(F.col(c)).alias("id")).filter("id <> ''").distinct()
    shared = ids(facts, "fact_id").join(ids(evidence, "evidence_id"), ["bundle", "id"], "left_semi")
    shared = shared.select("bundle", F.lit("SHARED_ID").alias("rule"), F.lit("facts").alias("path"), F.col("id").alias("detail"))
    asked = conflicts.select("bundle", "pos", F.posexplode("candidate_fact_ids").alias("nth", "id")).withColumn("id", bare(F.col("id"))).filter("id <> ''")
    lost = asked.join(ids(facts, "fact_id"), ["bundle", "id"], "left_anti")
    path = F.concat(F.lit("conflicts["), F.col("pos").cast("string"), F.lit("].candidate_fact_ids["), F.col("nth").cast("string"), F.lit("]"))
    lost = lost.select("bundle", F.lit("UNKNOWN_FACT").alias("rule"), path.alias("path"), F.col("id").alias("detail"))
    return own.unionByName(shared).unionByName(lost)


def raw_values(json: Column, depth: int = 3) -> Column:
    """A JSON object as a map from paths (a key, or up to `depth` keys joined by full stops) to lists of texts.

    A single value is a list of one, null a list of one blank; objects inside lists stay as JSON. A text that is no object has
    no paths.
    """

    def value(x: Column) -> Column:
        one = F.array(F.coalesce(x, F.lit("")))
        return F.when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), one)).otherwise(one)

    def entries(x: Column, prefix: Column, level: int) -> Column:
        held = F.map_entries(F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>")))

        def paths(e: Column) -> Column:
            key = F.concat(prefix, e["key"])
            own = F.array(F.struct(key.alias("key"), value(e["value"]).alias("value")))
            if level == 1:
                return own
            return F.when(F.coalesce(e["value"].startswith("{"), F.lit(False)), F.concat(own, entries(e["value"], F.concat(key, F.lit(".")), level - 1))).otherwise(own)

        return F.flatten(F.transform(held, paths))

    return F.map_from_entries(entries(json, F.lit(""), depth))


@dataclass(frozen=True)
class Field:
    """A field of a block: its kind (text, list, number or amount text) and the paths it is taken from, the first that is there; with `filled`, the first that is not blank."""

    block: str
    name: str
    kind: str
    paths: tuple[str, ...]
    filled: bool = False


def _block(block: str, kind: str, **paths: str) -> list[Field]:
    return [Field(block, name, kind, tuple(p.split())) for name, p in paths.items()]


#: The blocks of a profile, and under what names their fields may stand.
FIELDS: tuple[Field, ...] = (
    Field("company", "name", "text", ("name", "company_name"), filled=True),
    *_block("company", "text", representative="representative ceo_name", establishment_date="establishment_date", business_number="business_number", location="location", industry="industry", business_type="business_type"),
    *_block("ceo", "text", name="ceo.name representative", background="ceo.background ceo_background"),
    *_block("ceo", "list", education="ceo.education ceo_education", career="ceo.career ceo_career", certifications="ceo.certifications"),
    *_block("service", "text", name="service.name service.business_item service.item_name business_item item_name", description="service.description service.solution_overview solution_overview"),
    *_block("service", "text", tech_stack="service.tech_stack tech_stack", development_status="service.development_status development_status"),
    *_block("service", "list", features="service.features solution_steps", differentiators="service.differentiators"),
    *_block("market", "text", tam="market.tam.value market.tam tam.value tam.amount tam", sam="market.sam.value market.sam sam.value sam.amount sam", som="market.som.value market.som som.value som.amount som"),
    *_block("market", "text", target_customer="market.target_customer target_market target_customer", problem="market_problem market.problem"),
    *_block("market", "list", competitors="market.competitors competitors"),
    *_block("bm", "list", revenue_streams="business_model.revenue_streams bm.revenue_streams revenue_streams"),
    *_block("bm", "text", pricing="business_model.pricing bm.pricing pricing", target_customer="business_model.target_customer bm.target_customer market.target_customer target_market target_customer"),
    *_block("budget", "number", total="budget.total budget_total", government="budget.government government_funding", self_funding="budget.self budget.self_funding self_funding"),
    *_block("budget", "list", items="budget.items"),
    *_block("team", "list", current_members="team.current team.current_members", planned_members="team.planned team.planned_members"),
)


def profile(raw: Column, fields: Sequence[Field] = FIELDS) -> Column:
    """The struct of blocks of a profile from its raw values (`raw_values`).

    A text that is nowhere is empty, a list has no blank elements, and a number is the first in its text, or 0.
    """

    def taken(f: Field, values: Column) -> Column:
        found = [F.try_element_at(values, F.lit(p)) for p in f.paths]
        found = [F.when(F.exists(x, lambda v: bare(v) != ""), x) for x in found] if f.filled else found
        return F.coalesce(*found, F.array().cast("array<string>"))

    def value(f: Field, values: Column) -> Column:
        if f.kind == "list":
            return F.filter(taken(f, values), lambda v: bare(v) != "")
        text = F.coalesce(F.get(taken(f, values), F.lit(0)), F.lit(""))
        return leading_number(text) if f.kind == "number" else text

    blocks = dict.fromkeys(f.block for f in fields)
    return let(raw, lambda values: F.struct(*(F.struct(*(value(f, values).alias(f.name) for f in fields if f.block == b)).alias(b) for b in blocks)))


@dataclass(frozen=True)
class Rule:
    """level, code and path of an issue, and the condition (a function of the profile) under which it stands."""

    level: str
    code: str
    path: str
    broken: object


def _blank(path: str):
    return lambda p: _at(p, path) == ""


def _at(p: Column, path: str) -> Column:
    for part in path.split("."):
        p = p[part]
    return p


def _below(larger: str, smaller: str):
    """Whether the larger market is smaller, where both are given."""

    def broken(p: Column) -> Column:
        both = F.struct(amount_in_won(_at(p, larger)).alias("x"), amount_in_won(_at(p, smaller)).alias("y"))
        return let(both, lambda m: (m["x"] > 0) & (m["y"] > 0) & (m["x"] < m["y"]))

    return broken


def _sum_differs(p: Column) -> Column:
    b = p["budget"]
    given = (b["total"] > 0) & (b["government"] > 0) & (b["self_funding"] > 0)
    return given & (F.abs(b["government"] + b["self_funding"] - b["total"]) > 0.05 * b["total"])


#: What is asked of a profile, in order.
RULES = (
    Rule("ERROR", "MISSING_COMPANY_NAME", "company.name", _blank("company.name")),
    Rule("WARNING", "MISSING_CEO_NAME", "ceo.name", _blank("ceo.name")),
    Rule("ERROR", "MISSING_SERVICE_NAME", "service.name", _blank("service.name")),
    Rule("ERROR", "MARKET_SIZE_LOGIC", "market.tam", _below("market.tam", "market.sam")),
    Rule("ERROR", "MARKET_SIZE_LOGIC", "market.sam", _below("market.sam", "market.som")),
    Rule("WARNING", "MISSING_MARKET_SIZE", "market", lambda p: (p["market"]["tam"] == "") & (p["market"]["sam"] == "")),
    Rule("WARNING", "BUDGET_SUM_MISMATCH", "budget", _sum_differs),
    Rule("WARNING", "MISSING_TEAM", "team", lambda p: (F.size(p["team"]["current_members"]) == 0) & (F.size(p["team"]["planned_members"]) == 0)),
    Rule("INFO", "MISSING_CEO_CAREER", "ceo", lambda p: (F.size(p["ceo"]["career"]) == 0) & (p["ceo"]["background"] == "")),
)


def profile_issues(profiles: DataFrame, key: str = "profile_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """key, level, code and path of every rule that a profile (key, profile) breaks."""
    p = F.col("profile")
    broken = F.filter(F.array(*(F.when(r.broken(p), F.struct(*(F.lit(getattr(r, n)).alias(n) for n in ("level", "code", "path")))) for r in rules)), lambda x: x.isNotNull())
    return profiles.select(key, F.explode(broken).alias("x")).select(key, "x.*")


def content_issues(sections: DataFrame, cells: DataFrame, limits: DataFrame, key: str = "content_id", longest: int = 1500) -> DataFrame:
    """key, level, code and path of what is wrong with contents to be put into forms.

    sections: key, keyword and lines; cells: key, place and text; limits: key, keyword and char_limit. EMPTY_SECTION for each
    section without lines, TOO_MANY_EMPTY_SECTIONS if more than half (rounded down) of a content's are, SECTION_OVERFLOW beyond
    `longest` characters, CHAR_LIMIT_EXCEEDED beyond 1.2 times a limit above 0, EMPTY_CELL for each blank cell, and MISSING_KEY
    for a content that has sections but no cells, or cells but no sections.
    """
    issue = lambda code, path: (F.lit("WARNING").alias("level"), F.lit(code).alias("code"), path.alias("path"))
    sized = sections.withColumns({"n": F.size(F.coalesce("lines", F.array().cast("array<string>"))), "chars": F.aggregate(F.coalesce("lines", F.array().cast("array<string>")), F.lit(0), lambda a, x: a + F.coalesce(F.char_length(x), F.lit(0)))})
    named = F.concat(F.lit("sections."), F.coalesce("keyword", F.lit("")))
    limited = sized.join(limits.filter("char_limit > 0").select(key, "keyword", "char_limit"), [key, "keyword"])
    empty = sized.groupBy(key).agg(F.sum((F.col("n") == 0).cast("int")).alias("empty"), F.count("*").alias("all"))
    has = lambda df: df.select(key).distinct()
    parts = [
        sized.filter("n = 0").select(key, *issue("EMPTY_SECTION", named)),
        empty.filter("empty > floor(all / 2)").select(key, *issue("TOO_MANY_EMPTY_SECTIONS", F.lit("sections"))),
        sized.filter(F.col("chars") > longest).select(key, *issue("SECTION_OVERFLOW", named)),
        limited.filter(F.col("chars") > F.col("char_limit") * 1.2).select(key, *issue("CHAR_LIMIT_EXCEEDED", named)),
        cells.filter(bare(F.col("text")) == "").select(key, *issue("EMPTY_CELL", F.concat(F.lit("table_cells."), F.col("place").cast("string")))),
        has(sections).join(has(cells), key, "left_anti").select(key, *issue("MISSING_KEY", F.lit("table_cells"))),
        has(cells).join(has(sections), key, "left_anti").select(key, *issue("MISSING_KEY", F.lit("sections"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issue_summary(keys: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """key, errors, warnings, infos and passed (no error) of every key."""
    count = lambda level: F.sum((F.col("level") == level).cast("long")).alias(f"{level.lower()}s")
    counts = issues.groupBy(key).agg(*map(count, ("ERROR", "WARNING", "INFO")))
    return keys.select(key).distinct().join(counts, key, "left").fillna(0, ["errors", "warnings", "infos"]).withColumn("passed", F.col("errors") == 0)
