"""Operators on the lines of documents, which keep their order as the column pos."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare, normal_label, normal_text


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos (from 0) and line of every line; a null text has none, an empty one has one empty line."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _order() -> W:
    return W.partitionBy("doc_id").orderBy("pos")


def runs(rows: DataFrame, marked: Column, least: int = 2) -> DataFrame:
    """doc_id, first and size of each run of `least` or more consecutive marked lines."""
    kept = rows.filter(marked).withColumn("island", F.col("pos") - F.row_number().over(_order()))
    return kept.groupBy("doc_id", "island").agg(F.min("pos").alias("first"), F.count("*").alias("size")).filter(F.col("size") >= least).drop("island")


def without_repeated_blanks(rows: DataFrame) -> DataFrame:
    """The lines, but of each run of blank ones only the first."""
    blank = bare(F.col("line")) == ""
    before = F.lag(blank).over(_order())
    return rows.withColumn("after_blank", F.coalesce(before, F.lit(False))).filter(~(blank & F.col("after_blank"))).drop("after_blank")


def without_guides(rows: DataFrame, is_guide: Column, longest: int = 120) -> DataFrame:
    """The lines without guide texts of up to `longest` characters; a document's last line always stays."""
    last = F.max("pos").over(W.partitionBy("doc_id"))
    return rows.withColumn("last", last).filter(~is_guide | (F.char_length("line") > longest) | (F.col("pos") == F.col("last"))).drop("last")


def with_heading(rows: DataFrame, is_heading: Column) -> DataFrame:
    """The lines with the nearest heading at or before them; null before the first."""
    return rows.withColumn("heading", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, 0)))


def inside_blocks(rows: DataFrame, is_marker: Column) -> DataFrame:
    """The lines with the column inside: whether marker lines, which flip it, have switched it on."""
    flips = F.sum(F.when(is_marker, 1).otherwise(0)).over(_order().rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("inside", flips % 2 == 1)


def first_chosen(rows: DataFrame, chosen: Column, budget: Column) -> DataFrame:
    """The first chosen lines of each document, as many as its budget allows."""
    return rows.filter(chosen).withColumn("nth", F.row_number().over(_order())).filter(F.col("nth") <= budget)


def paired_cells(rows: DataFrame, separator: str = "|") -> DataFrame:
    """doc_id, pos, pair, label and value of the cells of lines with separators, taken in pairs; a last odd cell has no pair."""
    cells = F.transform(F.split("line", f"[{separator}]"), bare)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(cells) / 2).cast("int") - 1), lambda i: F.struct(F.get(cells, 2 * i).alias("label"), F.get(cells, 2 * i + 1).alias("value")))
    held = rows.filter(F.contains("line", F.lit(separator)))
    return held.select("doc_id", "pos", F.posexplode(pairs).alias("pair", "x")).select("doc_id", "pos", "pair", "x.label", "x.value")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth")


def spans(rows: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """doc_id, first and n_chars of the first stretch of each document from the line after an opening one to before the next closing one."""
    marked = rows.withColumn("began", F.sum(opens.cast("int")).over(_order().rowsBetween(W.unboundedPreceding, -1)))
    inside = marked.filter("began > 0").withColumn("ended", F.sum((closes & ~opens).cast("int")).over(_order().rowsBetween(W.unboundedPreceding, 0)))
    return inside.filter("ended = 0").groupBy("doc_id").agg(F.min("pos").alias("first"), F.sum(F.char_length(bare(F.col("line")))).alias("n_chars"))


def first_sections(rows: DataFrame, keyword: Column) -> DataFrame:
    """The lines with section: the keyword (null for no heading) of the nearest heading at or before them that has not headed a section before."""
    named = rows.withColumn("keyword", keyword)
    nth = F.row_number().over(W.partitionBy("doc_id", "keyword").orderBy("pos"))
    fresh = named.withColumn("fresh", F.when(F.col("keyword").isNotNull() & (nth == 1), F.col("keyword")))
    return fresh.withColumn("section", F.last("fresh", ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, 0))).drop("fresh", "keyword")


def findings(rows: DataFrame, patterns: str | Mapping[str, str], is_heading: Column) -> DataFrame:
    """doc_id, pos, heading, match and context (100 characters) of every match of a pattern, with the nearest heading at or before it; of several patterns by kind, the kind too, in one pass."""
    kinds = {"": patterns} if isinstance(patterns, str) else patterns
    held = with_heading(rows, is_heading)
    named = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m.alias("match"))
    each = [F.transform(F.regexp_extract_all("line", F.lit(f"({p})"), F.lit(1)), named(k)) for k, p in kinds.items()]
    found = held.select("doc_id", "pos", "heading", "line", F.explode(F.concat(*each)).alias("x"))
    context = F.substring(bare(F.col("line")), 1, 100).alias("context")
    out = found.select("doc_id", "pos", F.substring(F.coalesce("heading", F.lit("")), 1, 80).alias("heading"), F.col("x.match").alias("match"), context, F.col("x.kind").alias("kind"))
    return out.drop("kind") if isinstance(patterns, str) else out


def grep(rows: DataFrame, code: str, most: int) -> DataFrame:
    """The first `most` lines, by document and place, that hold a code without regard to case."""
    return rows.filter(F.contains(F.upper("line"), F.lit(code.upper()))).orderBy("doc_id", "pos").limit(most)


def key_sentences(rows: DataFrame, keywords: list[str], share: float, least: int, most: int) -> DataFrame:
    """The first lines of each document with a keyword, a digit and 8 or more characters: `share` of its lines that are not blank, between `least` and `most`."""
    line = bare(F.col("line"))
    fits = (F.char_length(line) >= 8) & line.rlike("[0-9０-９]") & F.greatest(F.lit(False), F.lit(False), *(F.contains(line, F.lit(k)) for k in keywords))
    filled = F.sum((line != "").cast("int")).over(W.partitionBy("doc_id"))
    budget = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(filled * share)))
    return first_chosen(rows.withColumn("budget", budget), fits, F.col("budget")).drop("budget")


def line_fields(rows: DataFrame) -> DataFrame:
    """doc_id, pos, label and value of lines that are a label of 1 to 40 characters, a colon and a value."""
    parts = [F.regexp_extract("line", r"^\s*([^:：|]{1,40})\s*[:：]\s*(.+?)\s*$", i) for i in (1, 2)]
    return rows.select("doc_id", "pos", bare(parts[0]).alias("label"), parts[1].alias("value")).filter("label <> '' and value <> ''")


#: Fixed value: a label, a colon and what follows it up to the next field of the line, which two spaces or a tab set off.
LINE_FIELD = r"([^\s\p{Z}:：][^:：\t]{0,38}?)[ \t\u3000]*[:：](.*?)(?=(?:[ \t\u3000]{2,}|\t)[^\s\p{Z}]|[ \t\u3000]*$)"


def fields_in_place(rows: DataFrame) -> DataFrame:
    """doc_id, pos, nth, label, value, start and end of each field of a line that has one or several of them.

    value is what follows the colon, with its white space; start and end (exclusive) are its place in the line, in characters,
    so that a value can be written there. A line without a colon, or a null one, has none.
    """
    groups = F.struct(*(F.regexp_extract_all("line", F.lit(LINE_FIELD), F.lit(i)).alias(n) for i, n in enumerate(("whole", "label", "value"))), F.split("line", LINE_FIELD, -1).alias("gaps"))
    held = rows.filter(F.col("line").rlike("[:：]")).select("doc_id", "pos", groups.alias("g"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,value:string,start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.char_length(x["gap"]) + F.char_length(x["whole"])
        one = F.struct(x["label"].alias("label"), x["value"].alias("value"), (end - F.char_length(x["value"])).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    each = F.transform("g.whole", lambda w, i: F.struct(w.alias("whole"), *(F.get(F.col(f"g.{n}s" if n == "gap" else f"g.{n}"), i).alias(n) for n in ("gap", "label", "value"))))
    found = held.select("doc_id", "pos", F.posexplode(F.aggregate(each, zero, step, lambda a: a["out"])).alias("nth", "x"))
    return found.select("doc_id", "pos", "nth", "x.*")


def positional_diff(source: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fills, drops and edits of two forms whose texts (key, pos, line) stand at the same places: blank to text, text to blank, and one text to another."""
    before, after = source.select(key, "pos", bare(F.col("line")).alias("before")), target.select(key, "pos", bare(F.col("line")).alias("after"))
    both = before.join(after, [key, "pos"], "full_outer").fillna("", ["before", "after"])
    count = lambda c: F.sum(c.cast("long"))
    was, now = F.col("before") != "", F.col("after") != ""
    return both.groupBy(key).agg(count(~was & now).alias("fills"), count(was & ~now).alias("drops"), count(was & now & (F.col("before") != F.col("after"))).alias("edits"))


def autofill(rows: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """doc_id, field and value: the first value of each field among a document's lines of label and value, a label naming the field of which it is an alias."""
    names = F.create_map(*(F.lit(x) for field, words in aliases.items() for word in words for x in (normal_text(word), field)))
    found = line_fields(rows).withColumn("field", F.try_element_at(names, normal_label(F.col("label")))).filter("field is not null")
    return first_per_key(found, ["doc_id", "field"], ["pos"]).select("doc_id", "field", "value")
