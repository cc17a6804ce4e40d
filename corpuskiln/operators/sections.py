"""Which facts and evidence may be used for which section of a form, and what a section still lacks.

Sections, materials, requirements and conflicts are tables with an id, `categories` and `tokens` (arrays; see `with_categories`
and `functions.text.tokens`), and the columns that each operator names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare

#: States of a material in which it must not be used, and how such states may begin.
BLOCKED = ("UNKNOWN", "CONFLICT", "INTERNAL_CONFLICT", "STALE", "UNVERIFIABLE", "REVIEW_REQUIRED")
BLOCKED_PREFIXES = ("CONFLICT_", "INTERNAL_CONFLICT_", "STALE_")


def state(raw: Column) -> Column:
    """A state's name: trimmed, in upper case, with underscores; null is empty."""
    return F.translate(F.upper(bare(raw)), "- ", "__")


def with_categories(rows: DataFrame, aliases: Mapping[str, Sequence[str]], text: Column, explicit: str = "explicit") -> DataFrame:
    """`rows` with categories: the explicit ones (array, null or empty for none), else those of which an alias occurs in the text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    inferred = F.array_compact(F.array(*(F.when(F.greatest(F.lit(False), F.lit(False), *(F.contains(lower, F.lit(a.lower())) for a in words)), F.lit(c)) for c, words in aliases.items())))
    stated = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(explicit), F.array().cast("array<string>")), state), lambda c: c != ""))
    return rows.withColumn("categories", F.when(F.size(stated) > 0, stated).otherwise(inferred.cast("array<string>")))


def sources(raw: str = "sources") -> Column:
    """The distinct (file, location) of a material's sources (array of structs), without those that have neither."""
    held = F.transform(raw, lambda s: F.struct(bare(s["file"]).alias("file"), bare(s["location"]).alias("location")))
    return F.array_distinct(F.filter(held, lambda s: (s["file"] != "") | (s["location"] != "")))


def unusable_reason(value: Column, origin: Column, verification: Column, semantic: Column) -> Column:
    """Why a material must not be used: EMPTY, then NO_SOURCE, then BLOCKED_STATE; null if it may be. `origin` is an array as `sources` gives."""
    states = [state(verification), state(semantic)]
    blocked = [s.isin(*BLOCKED) for s in states] + [s.startswith(p) for s in states for p in BLOCKED_PREFIXES]
    sourced = F.coalesce(F.exists(origin, lambda s: (s["file"] != "") & (s["location"] != "")), F.lit(False))
    return F.when(bare(value) == "", "EMPTY").when(~sourced, "NO_SOURCE").when(F.greatest(*blocked), "BLOCKED_STATE")


def semantic_allowed(semantic: Column, expected: Column) -> Column:
    """Whether a material's state is among the expected ones; none expected allows all, and no state is then denied."""
    none = F.coalesce(F.size(expected), F.lit(0)) <= 0
    return none | ((state(semantic) != "") & F.array_contains(F.transform(expected, state), state(semantic)))


def _words(rows: DataFrame, id_: str | Column, c: str, none: str) -> DataFrame:
    """A row for each of a row's distinct words; what it is joined by, and whether it has no categories, is all that travels."""
    return rows.select(id_, (F.coalesce(F.size("categories"), F.lit(0)) <= 0).alias(none), F.explode(F.array_distinct(c)).alias("on"))


def _grouped(rows: DataFrame, id_: str, what: Column) -> DataFrame:
    """Each id once, with kinds: the set of what its rows are. The ids are spread first, as a small file is read by one task."""
    return rows.select(id_, what.alias("x")).repartition(id_).groupBy(id_).agg(F.array_sort(F.collect_set("x")).alias("kinds"))


def related(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """left_id and right_id of the pairs that belong together, each once: a shared category if both have categories, else a shared token.

    Rows of the right side that have the same categories and tokens are related to the same ones, so each such kind meets the
    left side once, by its words, and only its pairs are made distinct; the ids of a kind are then joined to them. Every row of
    that join is one of the result. Ids on the left are few or have words of their own; null words relate nothing.
    """
    plain = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))))).alias(c)
    # A null among the categories is one that is not known; it still counts as having some.
    size = F.coalesce(F.size("categories"), F.lit(0)) > 0
    ids = _grouped(right, right_id, F.struct(size.alias("some"), plain("categories"), plain("tokens")))
    kinds = ids.select("kinds").distinct().select("kinds", F.explode("kinds").alias("k"))
    b = lambda c: kinds.select("kinds", (~F.col("k.some")).alias("b"), F.explode(f"k.{c}").alias("on"))
    by_category = _words(left, left_id, "categories", "a").join(b("categories"), "on").select(left_id, "kinds")
    by_token = _words(left, left_id, "tokens", "a").join(b("tokens"), "on").filter("a or b").select(left_id, "kinds")
    pairs = by_category.unionByName(by_token).distinct()
    # Merged, as the sizes of either side are not known beforehand: what looks small in a file may not be sent to all tasks.
    return ids.join(pairs.hint("merge"), "kinds").select(left_id, right_id)


def by_kind(materials: DataFrame) -> DataFrame:
    """Materials by what decides on sections and requirements: material_id (the kinds that an id has, a set), n (how many ids have just these), material_type, field, semantic, categories, tokens and reason (see `unusable_reason`).

    What follows on it costs what the kinds cost, however many materials there are of each.
    """
    why = unusable_reason(F.col("value"), F.col("origin"), F.col("verification"), F.col("semantic")).alias("reason")
    ids = _grouped(materials, "material_id", F.struct("material_type", "field", "semantic", "categories", "tokens", why))
    counted = ids.groupBy("kinds").agg(F.count("material_id").alias("n"))
    return counted.select(F.col("kinds").alias("material_id"), "n", F.explode("kinds").alias("k")).select("material_id", "n", "k.*")


def matched_materials(sections: DataFrame, materials: DataFrame) -> DataFrame:
    """section_id, material_id and reason of every related pair; reason is null where the material may be used.

    materials: value, origin (see `sources`), verification and semantic besides; sections: expected (states, or null). A usable
    material in none of the states that the section expects has the reason SEMANTIC_MISMATCH. Materials `by_kind` keep their n.
    """
    pairs = related(sections, materials, "section_id", "material_id")
    counted = ["n"] if "n" in materials.columns else []
    why = F.col("reason") if counted else unusable_reason(F.col("value"), F.col("origin"), F.col("verification"), F.col("semantic"))
    held = pairs.join(materials.select("material_id", "semantic", *counted, why.alias("reason")), "material_id").join(sections.select("section_id", "expected"), "section_id")
    return held.select("section_id", "material_id", *counted, F.coalesce("reason", F.when(~semantic_allowed(F.col("semantic"), F.col("expected")), "SEMANTIC_MISMATCH")).alias("reason"))


def applicable(rules: DataFrame, sections: DataFrame, rule_id: str = "requirement_id") -> DataFrame:
    """rule_id and section_id of the sections that a requirement or conflict applies to.

    Explicit target_ids (array) alone count where there are any; else categories, else tokens, as in `related`.
    """
    held = F.filter(F.coalesce("target_ids", F.array().cast("array<string>")), lambda t: bare(t) != "")
    rules = rules.withColumn("target_ids", held)
    named = rules.select(rule_id, F.explode("target_ids").alias("section_id")).join(sections.select("section_id"), "section_id", "left_semi")
    others = related(rules.filter(F.size("target_ids") == 0), sections, rule_id, "section_id")
    return named.select(rule_id, "section_id").distinct().unionByName(others)


def satisfied(requirements: DataFrame, applied: DataFrame, matched: DataFrame, materials: DataFrame) -> DataFrame:
    """requirement_id and section_id of the applied requirements that a material matched to the section satisfies.

    requirements: required_field, material_type (FACT, EVIDENCE or blank for both), expected (states), categories, tokens.
    materials: material_id, material_type, field, semantic, categories, tokens. A required field asks for a fact of that field;
    else categories must meet if both have any, else tokens if the requirement has any; with neither, any material does.
    """
    r = requirements.select("requirement_id", bare(F.col("required_field")).alias("wanted"), state(F.col("material_type")).alias("wanted_type"), "expected", F.col("categories").alias("rc"), F.col("tokens").alias("rt"))
    m = materials.select("material_id", F.col("material_type").alias("own_type"), bare(F.col("field")).alias("field"), "semantic", F.col("categories").alias("mc"), F.col("tokens").alias("mt"))
    met = applied.join(matched, "section_id").join(r, "requirement_id").join(m, "material_id")
    met = met.filter(~F.col("wanted_type").isin("FACT", "EVIDENCE") | (F.col("wanted_type") == F.col("own_type"))).filter(semantic_allowed(F.col("semantic"), F.col("expected")))
    by_field = (F.col("own_type") == "FACT") & (F.col("field") == F.col("wanted"))
    fits = (
        F.when(F.col("wanted") != "", by_field)
        .when((F.size("rc") > 0) & (F.size("mc") > 0), F.arrays_overlap("rc", "mc"))
        .when(F.size("rt") > 0, F.arrays_overlap("rt", "mt"))
        .otherwise(F.size("rc") == 0)
    )
    return met.filter(fits).select("requirement_id", "section_id").distinct()


def section_status(sections: DataFrame, matched: DataFrame, applied: DataFrame, met: DataFrame, requirements: DataFrame, conflicts: DataFrame) -> DataFrame:
    """section_id, n_materials, n_missing, n_blocking, n_conflicts and status of every section.

    missing: applied requirements that are required (by default they are) and not met; blocking: those of them that block (by
    default they do not). status: BLOCKED_REQUIRED_INFO with a blocking one, NO_USABLE_MATERIAL without materials,
    PARTIAL_WRITABLE with a missing one or a conflict that applies (rows of conflict_id and section_id), else WRITABLE. Materials matched
    `by_kind` count as many as they stand for.
    """
    if "n" in matched.columns:
        n = matched.select("section_id", "material_id", "n").distinct().groupBy("section_id").agg(F.sum("n").alias("n_materials"))
    else:
        n = matched.groupBy("section_id").agg(F.count_distinct("material_id").alias("n_materials"))
    open_ = applied.join(met, ["requirement_id", "section_id"], "left_anti")
    open_ = open_.join(requirements.select("requirement_id", F.coalesce("required", F.lit(True)).alias("required"), F.coalesce("blocking", F.lit(False)).alias("blocking")), "requirement_id").filter("required")
    lacks = open_.groupBy("section_id").agg(F.count("*").alias("n_missing"), F.sum(F.col("blocking").cast("long")).alias("n_blocking"))
    rows = sections.select("section_id").join(n, "section_id", "left").join(lacks, "section_id", "left")
    rows = rows.join(conflicts.groupBy("section_id").agg(F.count("*").alias("n_conflicts")), "section_id", "left").fillna(0, ["n_materials", "n_missing", "n_blocking", "n_conflicts"])
    status = F.when(F.col("n_blocking") > 0, "BLOCKED_REQUIRED_INFO").when(F.col("n_materials") == 0, "NO_USABLE_MATERIAL").when((F.col("n_missing") > 0) | (F.col("n_conflicts") > 0), "PARTIAL_WRITABLE")
    return rows.withColumn("status", status.otherwise("WRITABLE"))
