"""Résumés as lines of cells: a state machine of sections, repeating tables to fill, and the merge of several sources.

What a form looks like is data (`Form`): each section's header words, its fields in order and the tag that may begin a data
row; the labels of identity fields; the cells that hold nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare, let
from corpuskiln.operators.records import consolidated_education


@dataclass(frozen=True)
class Section:
    """A kind of record: the groups of words of which one stands whole in a header row, the fields in order, and the tag of its data rows (without one, only rows that begin with a date are data).

    A record whose field `split_field` matches `split` is of the kind `split_kind`.
    """

    kind: str
    signatures: tuple[tuple[str, ...], ...]
    fields: tuple[str, ...]
    tag: str | None = None
    split: str | None = None
    split_field: int = 1
    split_kind: str | None = None


@dataclass(frozen=True)
class Form:
    """How a résumé is written."""

    sections: tuple[Section, ...]
    identity: Mapping[str, str]
    required: tuple[str, ...]
    drop: tuple[str, ...] = ("",)
    lead: str = r"^[\s\p{Z}]*\p{Nd}{4}[.\-]"
    quoted: str = r"[『「].+[』」]"
    separator: str = "|"
    publications: str = "publications"
    kinds: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        kinds = [k for s in self.sections for k in (s.kind, s.split_kind) if k]
        object.__setattr__(self, "kinds", (*dict.fromkeys(kinds), self.publications))


#: The sections, labels and empty cells of Korean résumés.
KOREAN = Form(
    sections=(
        Section("education", (("학교명", "학위"),), ("period", "school", "major", "degree"), "학력"),
        Section("career", (("직장명", "담당업무"), ("직장명", "직위")), ("period", "company", "position", "duty"), "경력"),
        Section("certs", (("자격증명", "발급번호"), ("자격증명", "발급기관")), ("date", "name", "number", "issuer"), "자격", "(수료|이수)$|과정이수", 1, "trainings"),
        Section("lectures", (("강의주제",), ("주최기관명", "회차")), ("date", "org", "topic", "count", "kind")),
        Section("projects", (("프로젝트명", "수행내용"), ("프로젝트명", "발주처")), ("period", "name", "content", "client")),
    ),
    identity={
        "성명": "name", "성명(국문)": "name", "성명(영문)": "name_en", "성별": "gender", "소속": "org", "직위": "position", "직책": "position",
        "핸드폰": "phone", "휴대폰": "phone", "전화": "phone", "연락처": "phone", "생년월일": "birth", "이메일": "email", "e-mail": "email",
        "주소(사업장)": "address_work", "주소(거주지)": "address_home", "주소": "address_home", "컨설팅분야": "field", "전문분야": "field", "팩스": "fax",
    },
    required=("name", "gender", "org", "position", "phone", "birth", "email", "address_work", "address_home", "field"),
    drop=("이미지", "사진", "(사진)", "photo", ""),
)
#: By what fields two records of a kind are the same; the second list where the first ends in a null.
NATURAL_KEYS = {
    "education": ((0, 1, 2, 3),),
    "career": ((0, 1),),
    "certs": ((1, 2), (1, 0, 3)),
    "trainings": ((1, 2), (1, 0, 3)),
    "lectures": ((0, 1, 2),),
    "projects": ((0, 1, 3),),
}


def label_norm(cell: Column) -> Column:
    """A label in lower case without white space."""
    return F.lower(F.regexp_replace(cell, r"[\s\p{Z}]+", ""))


def _norm(text: str) -> str:
    return re.sub(r"\s+", "", text).lower()


def split_cells(line: Column, form: Form) -> Column:
    """A line's cells, trimmed, without those at its end that hold nothing; none of a line without a separator."""
    cells = F.transform(F.split(line, re.escape(form.separator)), bare)
    empty = lambda c: label_norm(c).isin([_norm(x) for x in form.drop])
    last = lambda cs: F.array_max(F.transform(cs, lambda c, i: F.when(~empty(c), i + 1)))
    # Most lines end in a cell that holds something.
    cut = lambda cs: F.when(~empty(F.element_at(cs, -1)), cs).otherwise(F.slice(cs, F.lit(1), F.coalesce(last(cs), F.lit(0))))
    return F.when(F.contains(line, F.lit(form.separator)), let(cells, cut)).otherwise(F.array().cast("array<string>"))


def header_kind(cells: Column, form: Form) -> Column:
    """The section that a row of cells is the header of; null if of none, or if it begins with a date."""

    def kind(joined: Column) -> Column:
        all_of = lambda words: F.least(F.lit(True), F.lit(True), *(F.contains(joined, F.lit(_norm(w))) for w in words))
        return F.coalesce(*(F.when(F.greatest(F.lit(False), F.lit(False), *map(all_of, s.signatures)), F.lit(s.kind)) for s in form.sections))

    return F.when((F.size(cells) > 0) & ~F.coalesce(F.get(cells, F.lit(0)).rlike(form.lead), F.lit(False)), let(label_norm(F.array_join(cells, "")), kind))


def parse(rows: DataFrame, form: Form = KOREAN, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, pos, part, what, kind and values of what the lines (keys, pos, line) say.

    A header switches its section on until the next one. While a section is on, rows that begin with its tag, or with a date,
    are its records; a row that begins with the label of an identity field never is. All other rows are pairs of an identity
    label and a value, the second pair only if it begins with such a label. A line without cells that quotes a title is a
    publication. what is record, identity or publications; values has a record's fields in order, null where blank, or the
    value, or the line. Blank lines, headers and what fits nothing have no rows; a null line is blank.
    """
    labels = F.create_map(*(F.lit(x) for k, v in form.identity.items() for x in (_norm(k), v)))
    known = lambda c: F.try_element_at(labels, label_norm(c))
    by_kind = lambda of: F.coalesce(*(F.when(F.col("section") == s.kind, of(s)) for s in form.sections))
    order = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    held = rows.select(*keys, "pos", bare(F.col("line")).alias("line")).filter("line <> ''")
    held = held.withColumn("cells", split_cells(F.col("line"), form)).withColumn("header", header_kind(F.col("cells"), form))
    held = held.withColumn("section", F.last("header", ignorenulls=True).over(order)).filter("header is null")
    first = F.get("cells", F.lit(0))
    dated = first.rlike(form.lead)

    def body(s: Section) -> Column:
        if s.tag is None:
            return F.when(dated, F.col("cells"))
        return F.when(known(first).isNotNull(), None).when(label_norm(first) == _norm(s.tag), F.slice("cells", 2, 1 << 20)).when(dated, F.col("cells"))

    def values(s: Section) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(s.fields) - 1)), lambda i: F.nullif(F.get("body", i), F.lit("")))

    def told(s: Section) -> Column:
        """Whether a consumed row is a record: with a tag, one of its first two fields must be there."""
        return F.lit(True) if s.tag is None else F.coalesce(F.get("values", F.lit(0)), F.get("values", F.lit(1))).isNotNull()

    def kind(s: Section) -> Column:
        if s.split is None:
            return F.lit(s.kind)
        return F.when(label_norm(F.get("values", F.lit(s.split_field))).rlike(s.split), s.split_kind).otherwise(s.kind)

    held = held.withColumn("body", F.when(F.size("cells") > 0, by_kind(body)))
    held = held.withColumn("values", F.when(F.col("body").isNotNull(), by_kind(values)))
    row = lambda what, kind, values: F.struct(F.lit(what).alias("what"), kind.alias("kind"), values.alias("values"))
    record = F.when(by_kind(told), F.array(row("record", by_kind(kind), F.col("values"))))

    def pair(i: int) -> Column:
        value = F.get("cells", F.lit(i + 1))
        holds = ~label_norm(value).isin([_norm(x) for x in form.drop])
        return F.when(holds & known(F.get("cells", F.lit(i))).isNotNull(), row("identity", known(F.get("cells", F.lit(i))), F.array(value)))

    pairs = F.when(F.size("cells") >= 2, F.filter(F.array(pair(0), F.when(F.size("cells") >= 4, pair(2))), lambda x: x.isNotNull()))
    publication = F.array(row(form.publications, F.lit(form.publications), F.array("line")))
    quotes = F.col("line").rlike(form.quoted) & ~F.contains("line", F.lit(form.separator))
    found = F.when(quotes, publication).when(F.col("body").isNotNull(), record).otherwise(pairs)
    return held.select(*keys, "pos", F.posexplode(found).alias("part", "x")).select(*keys, "pos", "part", "x.*")


def natural_key(kind: Column, values: Column) -> Column:
    """What makes two records of a kind the same."""

    def fields(places: tuple[int, ...]) -> Column:
        return F.transform(F.array(*map(F.lit, places)), lambda i: F.get(values, i))

    def key(k: str) -> Column:
        first, *rest = NATURAL_KEYS[k]
        return F.when(F.get(values, F.lit(first[-1])).isNull(), fields(rest[0])).otherwise(fields(first)) if rest else fields(first)

    return F.coalesce(*(F.when(kind == k, key(k)) for k in NATURAL_KEYS), values)


def merge(parsed: DataFrame, person: str, source: str, priority: str, form: Form = KOREAN) -> DataFrame:
    """One row for each person: identity, a list of records for each kind, publications, conflicts, replaced and missing.

    parsed: the rows of `parse` with person, source and priority. Sources count in the order of their priority, then of their
    name; within one, rows count in their order. An identity field has its first value; each other value that a later source
    has for it is a conflict, told once with the first source that has it. Of records with one natural key the first stays. Of
    records of education of one school, major and level of degree only the most final stays, in the place of the first; the
    others are replaced. missing lists the required identity fields without a value. Persons without any row have none.
    """
    rows = parsed.withColumn("at", F.struct(priority, source, "pos", "part"))
    # Within a source the first value of a field is its value.
    own = rows.filter("what = 'identity'").groupBy(person, source, "kind").agg(F.min_by(F.get("values", F.lit(0)), "at").alias("value"), F.min("at").alias("at"))
    winner = F.first("value").over(W.partitionBy(person, "kind").orderBy("at"))
    own = own.withColumn("winner", winner)
    distinct = own.groupBy(person, "kind", "winner", "value").agg(F.min_by(source, "at").alias("source"), F.min("at").alias("at"))
    other = F.col("value") != F.col("winner")
    told = F.struct("at", F.col("kind").alias("key"), F.col("winner").alias("kept"), F.col("value").alias("ignored"), F.col("source").alias("source"))
    without_at = lambda xs, names: F.transform(F.array_sort(xs), lambda x: F.struct(*(x[n].alias(n) for n in names)))
    identity = distinct.groupBy(person).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~other, F.struct("kind", "value"))))).alias("identity"),
        without_at(F.collect_list(F.when(other, told)), ("key", "kept", "ignored", "source")).alias("conflicts"),
    )
    lists = rows.filter("what <> 'identity'").withColumn("key", natural_key(F.col("kind"), F.col("values")))
    nth = F.row_number().over(W.partitionBy(person, "kind", "key").orderBy("at"))
    lists = lists.withColumn("nth", nth).filter("nth = 1").select(person, "kind", "values", "at")
    studies = lists.filter("kind = 'education'").select("*", *(F.get("values", F.lit(i)).alias(n) for i, n in ((1, "school"), (2, "major"), (3, "degree"))))
    studies = consolidated_education(studies, person, "at")
    # What stays takes the place of the first of its course; rows that cannot be compared keep their own.
    course = W.partitionBy(person, "school", "major", "level")
    loose = F.col("level").isNull() | F.coalesce("school", "major").isNull()
    studies = studies.withColumn("at", F.when(loose, F.col("at")).otherwise(F.min("at").over(course)))
    kept = lists.filter("kind <> 'education'").withColumn("kept", F.lit(True)).unionByName(studies.select(person, "kind", "values", "at", "kept"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "values")))), lambda x: x["values"])
    records = kept.groupBy(person).agg(
        *(listed((F.col("kind") == k) & F.col("kept")).alias(k) for k in form.kinds[:-1]),
        F.flatten(listed(F.col("kind") == form.publications)).alias(form.publications),
        listed(~F.col("kept")).alias("replaced"),
    )
    both = identity.join(records, person, "full_outer")
    keys = F.coalesce(F.map_keys("identity"), F.array().cast("array<string>"))
    nothing = {"conflicts": "array<struct<key:string,kept:string,ignored:string,source:string>>", form.publications: "array<string>"} | {k: "array<array<string>>" for k in (*form.kinds[:-1], "replaced")}
    types = dict(both.dtypes)
    return both.select(
        person,
        F.coalesce("identity", F.create_map().cast("map<string,string>")).alias("identity"),
        *(F.coalesce(k, F.array().cast(types.get(k, t))).alias(k) for k, t in nothing.items()),
        F.array_except(F.array(*map(F.lit, form.required)), keys).alias("missing"),
    )


def column_fields(kind: str, labels: Mapping[str, Mapping[str, str]], cell: Column) -> Column:
    """The field that a header cell of a kind of section names; null if none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in labels[kind].items() for x in (_norm(k), v))), label_norm(cell))


def map_tables(cells: DataFrame, form: Form, labels: Mapping[str, Mapping[str, str]]) -> tuple[DataFrame, DataFrame]:
    """The tables (doc_id, table, row, col, cell) that repeat a kind of record: their columns, and their rows to fill.

    The first row of a table that is a header of a section with a column of a known field is its header. columns: doc_id,
    table, header (row), kind, col, field. rows: doc_id, table, kind, row and nth (from 1): the rows below the header that have a mapped column, all of whose mapped cells are blank. Rows with a
    value in any of them stay as they are. A null cell is blank.
    """
    table = ["doc_id", "table"]
    by_row = cells.groupBy(*table, "row").agg(F.array_sort(F.collect_list(F.struct("col", bare(F.col("cell")).alias("cell")))).alias("cells"))
    kinds = [s.kind for s in form.sections if s.kind in labels]

    def mapped(kind: str) -> Column:
        """The columns of a header of a kind that name a field, each once."""
        named = F.filter(F.transform("cells", lambda c: F.struct(c["col"].alias("col"), column_fields(kind, labels, c["cell"]).alias("field"))), lambda x: x["field"].isNotNull())
        return let(named, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: y["col"]), x["col"]) == i + 1))

    head = F.struct(F.col("row").alias("header"), "kind", "columns")
    rows = by_row.withColumn("kind", header_kind(F.transform("cells", lambda c: c["cell"]), form))
    rows = rows.withColumn("columns", F.coalesce(*(F.when(F.col("kind") == k, mapped(k)) for k in kinds)))
    # A table's rows in order know their header from there on; no cell is sent anywhere else.
    order = W.partitionBy(*table).orderBy("row")
    rows = rows.withColumn("head", F.first(F.when(F.size("columns") > 0, head), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).select(*table, "row", "cells", "head.*")
    columns = rows.filter("row = header").select(*table, "header", "kind", F.explode("columns").alias("x")).select(*table, "header", "kind", "x.*")
    under = F.filter("cells", lambda c: F.exists("columns", lambda x: x["col"] == c["col"]))
    below = rows.filter("row > header").select(*table, "kind", "row", under.alias("under")).filter((F.size("under") > 0) & F.forall("under", lambda c: c["cell"] == ""))
    return columns, below.select(*table, "kind", "row").withColumn("nth", F.row_number().over(order))


def fill_tables(cells: DataFrame, records: DataFrame, form: Form, labels: Mapping[str, Mapping[str, str]]) -> tuple[DataFrame, DataFrame]:
    """What to write into the blank rows of repeating tables, and how far the records went.

    records: doc_id, kind, nth (from 1) and values (array, in the section's order of fields). fills: doc_id, table, row, col,
    field and value: the n-th record of the table's kind goes into its n-th blank row; null fields are not written. report:
    doc_id, table, kind, n_records, n_rows, n_filled and n_left (records without a row).
    """
    columns, blank = map_tables(cells, form, labels)
    places = F.create_map(*(F.lit(x) for s in form.sections for i, f in enumerate(s.fields) for x in (f"{s.kind} {f}", i)))
    # Merged: what comes of a small file by exploding it looks small, and would be broadcast through the driver.
    met = blank.join(records.hint("merge"), ["doc_id", "kind", "nth"]).join(columns.drop("header", "kind").hint("merge"), ["doc_id", "table"])
    value = F.get("values", F.element_at(places, F.concat_ws(" ", "kind", "field")))
    fills = met.select("doc_id", "table", "row", "col", "field", value.alias("value")).filter("value is not null")
    n_rows = columns.select("doc_id", "table", "kind").distinct().join(blank.groupBy("doc_id", "table", "kind").agg(F.count("*").alias("n_rows")).hint("merge"), ["doc_id", "table", "kind"], "left").fillna(0, ["n_rows"])
    n_records = records.groupBy("doc_id", "kind").agg(F.count("*").alias("n_records"))
    report = n_rows.join(n_records.hint("merge"), ["doc_id", "kind"], "left").fillna(0, ["n_records"]).withColumn("n_filled", F.least("n_rows", "n_records"))
    return fills, report.select("doc_id", "table", "kind", "n_records", "n_rows", "n_filled", (F.col("n_records") - F.col("n_filled")).alias("n_left"))
