"""The score of a document out of 100, in nine parts: penalties and shares as data over counts made in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.predicates import bare, is_guide

#: The most that a part gives, and what each of its defects takes away.
PENALTIES: Mapping[str, tuple[float, Mapping[str, float]]] = {
    "guide_removal": (15.0, {"critical": 5.0, "general": 1.0}),
    "bullet_spacing": (10.0, {"bullets": 1.0}),
    "paragraph_cleanup": (10.0, {"empty_groups": 2.0}),
    "font_consistency": (15.0, {"extra_fonts": 1.0, "font_outliers": 2.0}),
    "table_quality": (10.0, {"cell_spaces": 1.0}),
}
#: Grades by the least total, in order, and the total that passes.
GRADES = (("우수", 90.0), ("통과", 85.0), ("보완 필요", 70.0), ("실패", 0.0))
PASSING = 85.0
#: Words of a report's structure, and by kind of document.
REPORT_WORDS = ("현황", "분석", "개선", "결론", "계획", "기대")
PLACEHOLDER = r"(?<![\p{L}\p{N}_])(OOO|○○○|000)(?![\p{L}\p{N}_])"
SPACES = "[ \u00a0\u3000]{2,}"
BULLETS = "○●◦◌∙·•‣▪▫■□◇◆▶▷►▸\\-–—*ㅇㅁ"
PADDED = "^[ \u00a0\u3000\t]|[ \u00a0\u3000\t]$"


def scan(docs: DataFrame, guide: str | None = None, placeholder: str = PLACEHOLDER, separator: str = "|") -> DataFrame:
    """doc_id, text and the counts that the score takes from a text, in one pass over its lines.

    guide: a pattern in place of `is_guide`. critical and general: guides, and other lines with a placeholder; bullets: lines with two or
    more spaces after a bullet or inside; empty_groups: runs of two or more blank lines between lines that are not; cell_spaces:
    cells, but for one space beside a separator, with spaces at their ends or two or more inside; paragraphs: lines that are not
    blank. Lines with a separator are rows of tables: they end a run of blank lines and count for cells alone. A null text has
    none of all.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    is_row = lambda x: F.contains(x, F.lit(separator))
    blank = lambda x: bare(x) == ""

    guides = lambda x: is_guide(bare(x)) if guide is None else x.rlike(guide)

    prose = F.filter(lines, lambda x: ~is_row(x))
    count = lambda xs, test: F.size(F.filter(xs, test)).cast("long")
    spaced = lambda x: x.rlike(f"^[ \\t\u3000]*[{BULLETS}]+[ \\t\u3000]{{2,}}") | x.rlike(SPACES)
    # One letter for each line: blank ones, and all others.
    kinds = F.array_join(F.transform(lines, lambda x: F.when(blank(x) & ~is_row(x), "b").otherwise("x")), "")
    cells = F.flatten(F.transform(F.filter(lines, is_row), lambda x: F.split(x, f"[{separator}]")))
    cells = F.transform(cells, lambda c: F.regexp_replace(c, "^ | $", ""))
    return docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        count(prose, lambda x: ~blank(x) & guides(x)).alias("critical"),
        count(prose, lambda x: ~blank(x) & ~guides(x) & x.rlike(placeholder)).alias("general"),
        count(prose, lambda x: ~blank(x) & spaced(x)).alias("bullets"),
        F.regexp_count(kinds, F.lit("b{2,}")).cast("long").alias("empty_groups"),
        count(cells, lambda c: (c != "") & (c.rlike(PADDED) | c.rlike(SPACES))).alias("cell_spaces"),
        count(prose, lambda x: ~blank(x)).alias("paragraphs"),
    )


def structure(words: Mapping[str, Sequence[str]], kind: Column, text: Column) -> tuple[Column, Column]:
    """How many of the words of a document's kind its text holds, and how many there are."""
    hits = lambda ws: sum((F.contains(text, F.lit(w)).cast("long") for w in ws), F.lit(0).cast("long"))
    of = lambda value: F.coalesce(*(F.when(kind == k, value(ws)) for k, ws in words.items()), F.lit(0).cast("long"))
    return of(hits), of(lambda ws: F.lit(len(ws)).cast("long"))


def score(counts: DataFrame, words: Mapping[str, Sequence[str]], report: Sequence[str] = REPORT_WORDS) -> DataFrame:
    """doc_id, a column for each of the nine parts, total, grade and passed.

    counts: those of `scan`, and kind, confidence, psst_ratio (null where it does not apply: then words of a report count),
    font_kinds, font_outliers, bold (paragraphs) and images. Fonts beyond six kinds count as defects. Null counts are 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    rows = counts.withColumn("extra_fonts", F.greatest(F.lit(0.0), n("font_kinds") - 6))
    part = lambda most, takes: F.greatest(F.lit(0.0), F.lit(most) - sum((n(c) * w for c, w in takes.items()), F.lit(0.0)))
    hit, all_ = structure(words, F.col("kind"), F.col("text"))
    share = F.when(all_ > 0, hit / all_).otherwise(0.7)
    sure = F.least(F.lit(1.0), n("confidence"))
    ratio = n("bold") / F.greatest(F.lit(1.0), n("paragraphs"))
    told = sum((F.contains("text", F.lit(w)).cast("double") for w in report), F.lit(0.0)) / len(report)
    parts = {name: part(*x) for name, x in PENALTIES.items()} | {
        "emphasis": F.when(n("bold") == 0, 4.0).when(ratio > 0.35, 5.0).otherwise(10.0),
        "type_structure": F.bround(15.0 * (0.4 * sure + 0.6 * share), 1),
        "psst_structure": F.bround(10.0 * F.coalesce(F.col("psst_ratio").cast("double"), told), 1),
        "image_suggestion": F.when(n("images") > 0, 5.0).otherwise(2.0),
    }
    scored = rows.select("doc_id", *(c.alias(name) for name, c in parts.items()))
    total = F.bround(sum((F.col(p) for p in parts), F.lit(0.0)), 1)
    grade = F.coalesce(*(F.when(F.col("total") >= least, F.lit(g)) for g, least in GRADES))
    return scored.withColumn("total", total).withColumn("grade", grade).withColumn("passed", F.col("total") >= PASSING)
