"""Templates of forms: their sections, the questions that they ask, what an answer leaves open, and blocks to take out again.

Paragraphs are rows (doc_id, pos, line). What marks a signature, a required or an excluded section is data (`Rules`).
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuskiln.functions.parsing import holds_anchor
from corpuskiln.functions.predicates import bare, is_guide
from corpuskiln.functions.text import said_once

#: What numbers a heading, and lines of signs only.
NUMBERED = r"^((\p{Nd}+[.)])|([IVX]+\.)|([가-하]\.)|([A-Z]\.)|([①-⑮]))[\s\p{Z}]*.+"
MARKERS_ONLY = r"^[◦ㅇ■□●·•\-–—\s\p{Z}]+$"
MAJOR = r"^[①-⑨]|^\p{Nd}+\.[\s\p{Z}]"
REQUIRED = r"^((\p{Nd}+[.)])|([가-하]\.)|(□)|([①-⑮]))[\s\p{Z}]*.+"


@dataclass(frozen=True)
class Rules:
    """Patterns of signatures and of words that make a short heading required, words that exclude a section, and labels that no business answers."""

    signature: str
    required_words: str
    excluded: tuple[str, ...]
    non_business: str


#: These rules for Korean forms.
KOREAN = Rules(
    signature=r"(?i)사실과 다름이 없음을 확인|기업 추천합니다|추천기관|신청기업|담\s*당\s*자|직인|\(인\)|평가대상에서 제외|제출목록 안내",
    required_words="개요|필요성|문제|목표|전략|추진|시장|수익|예산|인력|성과|기대효과|실행|사업화|활용",
    excluded=("동의서", "서약서", "확인서", "개인정보", "청렴", "보안", "서명란", "작성요령", "별첨", "붙임", "이탤릭", "파란색 안내"),
    non_business=r"(?i)^[◦ㅇ■□●·•]+$|담\s*당\s*자|사실과 다름이 없음을 확인|추천기관|신청기업|제출목록|증빙서류|평가대상에서 제외|별첨|붙임",
)


def single_spaced(text: Column) -> Column:
    """A text with single spaces, and none at its ends; null is empty."""
    return F.regexp_replace(bare(text), r"[\s\p{Z}]+", " ")


def heading_text(text: Column, least: int = 20) -> Column:
    """A heading with single spaces; one of `least` characters or more that says the same twice says it once, for up to two rounds."""
    return said_once(single_spaced(text), least)


def _slug(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub("[^a-zA-Z0-9]+", "_", plain).strip("_").lower()[:48]


@F.pandas_udf(StringType())
def _slugs(texts: pd.Series) -> pd.Series:
    # Decomposition of characters is not among the built-in functions.
    return texts.fillna("").map(_slug)


def slug(text: Column, prefix: str = "item") -> Column:
    """The ASCII letters and digits of a text, decomposed and in lower case, with _ for what lies between, 48 characters at most; without any, the prefix and eight digits of the text's digest."""
    found = _slugs(text)
    return F.when(found != "", found).otherwise(F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8)))


def is_heading(heading: Column, strict: bool = False) -> Column:
    """Whether a heading text heads a section: numbered, with a box, ended by a colon or bracket, or short; if strict, only numbered ones and those with a box."""
    numbered = heading.rlike(NUMBERED) | heading.startswith("□")
    if strict:
        return ~heading.startswith("○") & ~heading.startswith("•") & (numbered | heading.rlike(MAJOR))
    short = (F.char_length(heading) <= 48) & (F.size(F.split(heading, " ")) <= 8)
    return numbered | heading.endswith(":") | heading.endswith("]") | short


def sections(rows: DataFrame, rules: Rules = KOREAN, strict: bool = False) -> DataFrame:
    """doc_id, pos, field_id, label, required and excluded of each section that a document's paragraphs open.

    A heading opens its section where it stands first; blank lines, lines of signs and signatures open none. field_id has the
    paragraph's number, from 1, and its slug.
    """
    named = rows.select("doc_id", "pos", heading_text(F.col("line")).alias("label"))
    named = named.filter((F.col("label") != "") & ~F.col("label").rlike(MARKERS_ONLY) & ~F.col("label").rlike(rules.signature) & is_heading(F.col("label"), strict))
    first = named.groupBy("doc_id", "label").agg(F.min("pos").alias("pos"))
    label = F.col("label")
    required = ~is_guide(label) & (label.rlike(REQUIRED) | (label.rlike(rules.required_words) & (F.char_length(label) <= 80)))
    lower = F.lower(label)
    excluded = F.greatest(F.lit(False), F.lit(False), *(F.contains(lower, F.lit(w.lower())) for w in rules.excluded))
    field = F.concat(F.lit("section_"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0"), F.lit("_"), slug(label, "section"))
    # A number of more than three digits stays whole.
    field = F.when(F.col("pos") + 1 > 999, F.concat(F.lit("section_"), (F.col("pos") + 1).cast("string"), F.lit("_"), slug(label, "section"))).otherwise(field)
    return first.select("doc_id", "pos", field.alias("field_id"), "label", required.alias("required"), excluded.alias("excluded"))


def sanitised(found: DataFrame, completed: DataFrame, rules: Rules = KOREAN) -> DataFrame:
    """The sections that a form asks a business about: none that is excluded or whose label no business answers; of documents that are completed already (doc_id, completed) only major headings."""
    done = completed.filter("completed").select("doc_id", F.lit(True).alias("done")).distinct()
    label = F.col("label")
    held = found.filter(~F.col("excluded") & ~label.rlike(rules.non_business)).join(done, "doc_id", "left")
    return held.filter(F.col("done").isNull() | is_heading(label, strict=True)).drop("done")


#: The questions that every template asks first.
FIRST_QUESTIONS = (("project_title", "과제명", "project_meta", "project_title"), ("organization_name", "기관명 또는 회사명", "organization_profile", "name"))


def questions(docs: DataFrame, found: DataFrame, cells: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, nth (from 1, gapless), question_id, label, field_type, required, kind and target of every question of a template.

    In this order: the two fixed ones, those on sections (doc_id, pos, field_id, label, required, excluded) that are not
    excluded, on cells (doc_id, table, row, col, cell_id, label, field_type, required), and a note on each picture (doc_id,
    place, slot_id, label). An id that stands twice in a document asks once, at its first place. Every doc_id has its
    questions, without any section too.
    """
    text, required = F.lit("text"), F.lit(True)
    fixed = docs.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("id", "label", "kind", "target"), q, strict=True))) for q in FIRST_QUESTIONS))).alias("at", "x"))
    order = lambda part, *places: F.struct(F.lit(part).alias("part"), *(F.coalesce(p, F.lit(0)).cast("long").alias(f"p{i}") for i, p in enumerate((*places, *[F.lit(0)] * (3 - len(places)))))).alias("order")
    note = F.concat(F.lit("image_note_"), F.col("slot_id"))
    parts = [
        fixed.select("doc_id", order(0, F.col("at")), F.col("x.id").alias("question_id"), "x.label", text.alias("field_type"), required.alias("required"), "x.kind", "x.target"),
        found.filter(~F.col("excluded")).select("doc_id", order(1, F.col("pos")), F.col("field_id").alias("question_id"), "label", F.lit("textarea").alias("field_type"), "required", F.lit("section").alias("kind"), F.col("field_id").alias("target")),
        cells.select("doc_id", order(2, F.col("table"), F.col("row"), F.col("col")), F.col("cell_id").alias("question_id"), "label", "field_type", "required", F.lit("table_cell").alias("kind"), F.col("cell_id").alias("target")),
        images.select("doc_id", order(3, F.col("place")), note.alias("question_id"), F.concat(F.col("label"), F.lit(" 설명")).alias("label"), F.lit("textarea").alias("field_type"), F.lit(False).alias("required"), F.lit("image_slot_note").alias("kind"), F.col("slot_id").alias("target")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    again = F.row_number().over(W.partitionBy("doc_id", "question_id").orderBy("order"))
    every = every.withColumn("again", again).filter("again = 1")
    return every.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("order"))).select("doc_id", "nth", "question_id", "label", "field_type", "required", "kind", "target")


def drafting_questions(missing: DataFrame, cells: DataFrame, skip_section: str, skip_cell: str, transfer: bool, large: int = 20, wide: int = 10) -> tuple[DataFrame, DataFrame]:
    """The missing questions (doc_id, question_id, kind, target, label, required) that may be drafted, and required ones that may not.

    cells: doc_id, table, cell_id, row_header and col_header of every cell that is asked for. Sections whose label matches
    `skip_section` go, as do cells without a label or with one that matches `skip_cell`. When one form is transferred to
    another, cells of tables of more than `large` asked cells go unless they are required, and so do cells of tables of more
    than `wide` without a header in their row or column; required ones of these are the second result.
    """
    sizes = cells.groupBy("doc_id", "table").agg(F.count("*").alias("size"))
    meta = cells.join(sizes, ["doc_id", "table"]).select("doc_id", F.col("cell_id").alias("target"), "size", (bare(F.col("row_header")) != "").alias("in_row"), (bare(F.col("col_header")) != "").alias("in_col"))
    rows = missing.join(meta.dropDuplicates(["doc_id", "target"]), ["doc_id", "target"], "left").fillna(0, ["size"])
    label, is_cell = bare(F.col("label")), F.col("kind") == "table_cell"
    required = F.coalesce("required", F.lit(False))
    skipped = F.when(is_cell, (label == "") | label.rlike(skip_cell)).when(F.col("kind") == "section", label.rlike(skip_section)).otherwise(False)
    too_large = is_cell & F.lit(transfer) & (F.col("size") > large) & ~required
    unnamed = is_cell & F.lit(transfer) & (F.col("size") > wide) & ~F.coalesce(F.col("in_row") & F.col("in_col"), F.lit(False))
    told = rows.filter(~skipped & ~too_large)
    return told.filter(~unnamed).select(*missing.columns), told.filter(unnamed & required).select(*missing.columns)


def meaningful(text: Column, rules: Rules = KOREAN, guide: str | None = None) -> Column:
    """Whether a text says anything: not blank, no label that no business answers, no guide (by a pattern, or `is_guide`)."""
    t = bare(text)
    guides = is_guide(t) if guide is None else t.rlike(guide)
    return (t != "") & ~t.rlike(rules.non_business) & ~guides


def section_contents(rows: DataFrame, anchors: DataFrame, rules: Rules = KOREAN, within: int = 9) -> DataFrame:
    """doc_id, target and filled of each anchor (doc_id, target, anchor): whether one of the `within` lines after a line that holds it says anything but the anchor again.

    An anchor that stands nowhere is not filled. A document's anchors travel as one list beside its lines, so that only lines
    that hold one are met with it.
    """
    own = anchors.groupBy("doc_id").agg(F.collect_list(F.struct("target", "anchor")).alias("anchors"))
    after = F.collect_list(F.when(meaningful(F.col("line"), rules), F.col("line"))).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(1, within))
    held = rows.join(own, "doc_id").withColumn("after", after)
    met = held.select("doc_id", "after", F.explode(F.filter("anchors", lambda a: holds_anchor(F.col("line"), a["anchor"]))).alias("a"))
    met = met.withColumn("filled", F.exists("after", lambda x: ~holds_anchor(x, F.col("a.anchor"))))
    found = met.groupBy("doc_id", F.col("a.target").alias("target")).agg(F.max("filled").alias("filled"))
    return anchors.select("doc_id", "target").distinct().join(found, ["doc_id", "target"], "left").withColumn("filled", F.coalesce("filled", F.lit(False)))


def open_questions(asked: DataFrame, output: DataFrame, values: DataFrame, pictures: DataFrame, slots: DataFrame, rules: Rules = KOREAN) -> DataFrame:
    """doc_id, code, id and place of what a filled form leaves open.

    asked: doc_id, question_id, kind, target, label, required. output: doc_id, kind (section or table_cell), target and filled,
    for each that the document written holds. values: doc_id, kind (project_meta, organization_profile or answer), key and
    value. A required question on a section or cell is looked up in the output by its target; if that does not hold it, in the
    answers by target, else by question; one on the project or organisation by its key; any other in the answers. REQUIRED for
    each without a value, with place output or input. IMAGE for each required slot (doc_id, slot_id, label, required) without a
    picture (doc_id, slot_id). Labels that no business answers ask nothing; repeated values count if any is not blank.
    """
    own = asked.filter(F.coalesce("required", F.lit(False)) & ~bare(F.col("label")).rlike(rules.non_business)).select("doc_id", "question_id", "kind", "target")
    placed = F.col("kind").isin("section", "table_cell")
    written = output.groupBy("doc_id", "kind", "target").agg(F.max("filled").alias("written"))
    held = values.groupBy("doc_id", F.col("kind").alias("held_kind"), "key").agg(F.max(bare(F.col("value")) != "").alias("given"))
    answers = held.filter("held_kind = 'answer'").drop("held_kind")
    found = own.join(written, ["doc_id", "kind", "target"], "left")
    # A key of the project or organisation, or an answer by target.
    named = F.when(F.col("kind").isin("project_meta", "organization_profile"), F.col("kind")).otherwise("answer")
    key = F.when(placed | (named != "answer"), F.col("target")).otherwise(F.col("question_id"))
    found = found.withColumns({"held_kind": named, "key": key}).join(held, ["doc_id", "held_kind", "key"], "left")
    found = found.join(answers.select("doc_id", F.col("key").alias("question_id"), F.col("given").alias("by_question")), ["doc_id", "question_id"], "left")
    by_answer = F.when(placed, F.coalesce("given", "by_question", F.lit(False))).otherwise(F.coalesce("given", F.lit(False)))
    given = F.when(placed & F.col("written").isNotNull(), F.col("written")).otherwise(by_answer)
    place = F.when(placed & F.col("written").isNotNull(), "output").otherwise("input")
    missing = found.filter(~given).select("doc_id", F.lit("REQUIRED").alias("code"), F.col("question_id").alias("id"), place.alias("place"))
    empty = slots.filter(F.coalesce("required", F.lit(False)) & ~bare(F.col("label")).rlike(rules.non_business)).select("doc_id", "slot_id").distinct()
    empty = empty.join(pictures.select("doc_id", "slot_id"), ["doc_id", "slot_id"], "left_anti")
    return missing.unionByName(empty.select("doc_id", F.lit("IMAGE").alias("code"), F.col("slot_id").alias("id"), F.lit("output").alias("place")))


def marked_blocks(rows: DataFrame, is_marker: Column, is_intro: Column, is_divider: Column) -> DataFrame:
    """The lines with role: marker, divider or body of a block that was put in, null for what stays.

    A divider right before or after a marker belongs to its block. A marker that is an intro, not followed by a divider, takes
    the next line as its body if that is no marker and a divider follows it, which belongs to the block too. A null line is
    none of these.
    """
    order = W.partitionBy("doc_id").orderBy("pos")
    told = rows.select("*", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in (("m", is_marker), ("i", is_intro & is_marker), ("d", is_divider))))
    near = lambda c, n: F.coalesce((F.lag(c, n) if n > 0 else F.lead(c, -n)).over(order), F.lit(False))
    told = told.withColumns({"m1": near("m", 1), "m_1": near("m", -1), "i1": near("i", 1), "d1": near("d", 1), "d_1": near("d", -1)})
    # A body stands between an intro and a divider.
    told = told.withColumn("b", F.col("i1") & ~F.col("d") & ~F.col("m") & F.col("d_1"))
    told = told.withColumn("b1", near("b", 1))
    role = F.when(F.col("m"), "marker").when(F.col("d") & (F.col("m1") | F.col("m_1") | F.col("b1")), "divider").when(F.col("b"), "body")
    return told.select(*rows.columns, role.alias("role"))
