"""The registry of acceptance checks and its roll-up.

A check is a function of a document's text that counts defects; a registry row names it and its severity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare


@dataclass(frozen=True)
class Check:
    """check_id, severity (fail or warn) and the expression that counts defects in a text."""

    check_id: str
    severity: str
    count: Callable[[Column], Column]


def pattern(regex: str) -> Callable[[Column], Column]:
    """Counts the matches of a pattern."""
    return lambda text: F.regexp_count(text, F.lit(regex))


#: Stand-ins for corpora without the forms' own words; the forms' checks are those of `registry`.
CHECKS = (
    Check("unresolved_markers", "fail", pattern(r"\[(TODO|TBD|CHECK)\]|lorem ipsum")),
    Check("template_placeholders", "fail", pattern(r"_{3,}|\{\{[^}]*\}\}|O{2,}")),
    Check("empty_table_rows", "warn", pattern(r"(?m)^[ \t]*\|[ \t|]*$")),
    Check("repeated_marks", "warn", pattern(r"[!?*%#]{3,}")),
    Check("page_overflow", "warn", lambda text: F.when(F.greatest(F.lit(1), F.ceil(F.char_length(text) / 1500)) > 10, 1).otherwise(0)),
)


SELF_BLOCK = r"NotebookLM\s*슬라이드\s*생성용\s*프롬프트|이\s*블록은\s*삭제하세요|슬라이드\s*생성에\s*붙여넣으세요|\[작성\s*보강\s*가이드\]|\[AI\s*작성\s*보강\]|섹션은\s*삭제하세요|\(작성\s*필요\s*—"
CHOICE, CHECKED = r"택\s*1|해당\s*여부", r"[■☑✔▣☒√]|(?<![A-Za-z0-9])[V√●](?![A-Za-z0-9])"
LABELS = ("명 칭", "명칭", "기업명", "대표자명", "창업아이템명")
LABELS_NORMAL = ("명칭", "기업명", "대표자명", "창업아이템명", "사업자등록번호", "생년월일", "연락처", "신청분야")
CLAIM = r"(협업|제휴|협약|MOU|업무\s*협약|독점\s*(?:계약|공급|판매)|납품|공급\s*계약|기술\s*이전)\s*[\(（]?\s*(?:확정|체결|완료|성사)"
HEDGE = r"검토\s*중|협의\s*중|논의\s*중|추진\s*중|계획\s*중|예정|예상|기대|목표|가능성|희망|\[산출근거|\[출처|출처\s*[:：]|근거\s*[:：]|계약\s*번호|등록\s*번호|특허\s*제?\s*\d"


def _lines_that(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Counts the lines for which a test holds."""
    return lambda text: F.size(F.filter(F.split(text, "\n"), test))


def _cells(line: Column) -> Column:
    """The trimmed cells of a line; an outer border makes no cell of its own."""
    own = bare(line)
    return F.transform(F.split(F.when(own.startswith("|"), F.regexp_replace(own, r"^\||\|$", "")).otherwise(own), r"\|"), bare)


def _empty_after(is_label: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Counts the label cells whose right cell is empty."""

    def empty(cells: Column) -> Column:
        pairs = F.arrays_zip(F.slice(cells, 1, F.size(cells) - 1).alias("label"), F.slice(cells, 2, F.size(cells)).alias("value"))
        return F.size(F.filter(pairs, lambda p: is_label(p["label"]) & (p["value"] == "")))

    rows = lambda text: F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|"))), _cells)
    return lambda text: F.aggregate(F.transform(rows(text), empty), F.lit(0), lambda a, b: a + b)


def _unchecked(text: Column) -> Column:
    """Choice rows with an empty box and no mark; of rows with one label only the first counts."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")) & x.rlike(CHOICE))
    marks = F.transform(rows, lambda x: F.struct(F.substring(F.get(_cells(x), F.lit(0)), 1, 20).alias("label"), (F.contains(x, F.lit("□")) & ~x.rlike(CHECKED)).alias("open")))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"))

    def step(a: Column, b: Column) -> Column:
        fresh = ~F.array_contains(a["seen"], b["label"])
        return F.struct(F.array_union(a["seen"], F.array(b["label"])).alias("seen"), (a["n"] + (fresh & b["open"]).cast("int")).alias("n"))

    return F.aggregate(marks, start, step, lambda a: a["n"])


def _recruit_dates(text: Column) -> Column:
    """Distinct months in lines on recruiting, beyond the first."""
    own = F.array_join(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("채용"))), "\n")

    def months(regex: str) -> Column:
        year, month = (F.regexp_extract_all(own, F.lit(regex), F.lit(i)) for i in (1, 2))
        return F.zip_with(year, month, lambda y, m: F.concat(F.substring(y, -2, 2), F.lit("."), m.cast("int").cast("string")))

    found = F.array_union(months(r"[’'‘]\s?(\d{2})\s*\.\s*(\d{1,2})"), months(r"(\d{4})\s*년\s*(\d{1,2})\s*월"))
    return F.greatest(F.lit(0), F.size(found) - 1)


def missing_documents(names: tuple[str, ...]) -> Check:
    """The required names that a text does not hold, without regard to white space."""
    held = [n for n in ("".join(x.split()) for x in names) if n]
    return Check("missing_required_documents", "fail", lambda text: sum((F.when(F.contains(F.regexp_replace(text, r"\s+", ""), F.lit(n)), 0).otherwise(1) for n in held), F.lit(0)))


#: Markers, placeholders, labels whose values a blind review must not show, and checks that a strict review promotes.
MARKER = r"\[확인필요[^\]]*\]|\[산출근거[^\]]*\]\s*\?|\[TODO[^\]]*\]"
MASK = r"(?<![\p{L}\p{N}_])(OOO|○○○)(?![\p{L}\p{N}_])"
SLOTS = (r"<\s*사진\s*\(이미지\)[^>]*>", r"<[^<>\n]{0,30}제목\s*>")
BLIND_INLINE = r"(대표자\s*성명|대표자명|성명|직장명|대학명)\s*[:：]\s*([^\s,/|·]{1,20})"
BLIND_LABELS = ("성명", "대표자성명", "대표자명", "직장명", "대학명")
PROMOTED = ("paren_choices", "empty_label_fields_ext", "empty_image_slots")


def placeholders(blind: bool = False) -> Check:
    """Places to fill in, overlapping ones counted once; a blind review takes masks for right.

    No two of the patterns can overlap otherwise than one inside another, so the alternation that tries the wider ones first
    counts each stretch once.
    """
    return Check("template_placeholders", "fail", pattern("|".join((*SLOTS, *(() if blind else (MASK,))))))


def _named(value: Column) -> Column:
    """Whether a value is a name that is not masked."""
    v = bare(value)
    return v.rlike("^[가-힣]{2,10}$") & ~F.contains(v, F.lit("○")) & ~v.rlike("^O+$")


def _unmasked(text: Column) -> Column:
    """Names beside or after labels that a blind review must not show."""
    inline = F.size(F.filter(F.regexp_extract_all(text, F.lit(BLIND_INLINE), F.lit(2)), _named))

    def beside(cells: Column) -> Column:
        pairs = F.arrays_zip(F.slice(cells, 1, F.size(cells) - 1).alias("label"), F.slice(cells, 2, F.size(cells)).alias("value"))
        return F.size(F.filter(pairs, lambda p: F.regexp_replace(p["label"], r"[\s:：]", "").isin(*BLIND_LABELS) & _named(p["value"])))

    rows = F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|"))), _cells)
    return inline + F.aggregate(F.transform(rows, beside), F.lit(0), lambda a, b: a + b)


def registry(blind: bool = False, max_pages: int | None = None, required: tuple[str, ...] = (), claims: bool = False, strict: bool = False) -> tuple[Check, ...]:
    """The checks of texts as the forms' own rules have them; what a call for proposals asks for is switched on by an argument."""
    pages = lambda text: F.when(F.greatest(F.lit(1), F.ceil(F.char_length(text) / 1500)) > max_pages, 1).otherwise(0)
    # A row of nothing but bars and blanks has two cells or more.
    found = (
        Check("unresolved_markers", "fail", pattern(MARKER)),
        placeholders(blind),
        Check("empty_table_rows", "warn", pattern(r"(?m)^[ \t]*\|[ \t|]*$")),
        *LINE_CHECKS,
        *((Check("masking_violation", "fail", _unmasked),) if blind else ()),
        *((Check("page_overflow", "warn", pages),) if max_pages is not None else ()),
        *((UNVERIFIED_CLAIMS,) if claims else ()),
        *((missing_documents(required),) if required else ()),
    )
    return tuple(Check(c.check_id, "fail", c.count) if strict and c.check_id in PROMOTED else c for c in found)


#: Further checks of the forms' rules, on lines and cells; rows of tables are lines with a |.
LINE_CHECKS = (
    Check("self_inserted_blocks", "fail", _lines_that(lambda x: x.rlike(SELF_BLOCK))),
    Check("unchecked_choices", "fail", _unchecked),
    Check("empty_label_fields", "fail", _empty_after(lambda c: c.isin(*LABELS))),
    Check("recruit_date_conflict", "warn", _recruit_dates),
    Check("paren_choices", "warn", _lines_that(lambda x: F.contains(x, F.lit("|")) & x.rlike(CHOICE) & ~F.contains(x, F.lit("□")) & x.rlike(r"\(\s*\)") & ~x.rlike(r"\(\s*[VvOX○●√■]\s*\)"))),
    Check("empty_label_fields_ext", "warn", _empty_after(lambda c: ~c.isin(*LABELS) & F.regexp_replace(c, r"[\s:：]", "").isin(*LABELS_NORMAL))),
)
#: Off unless asked for, as in the reference.
UNVERIFIED_CLAIMS = Check("unverified_claims", "warn", _lines_that(lambda x: x.rlike(CLAIM) & ~x.rlike(HEDGE)))


def results(docs: DataFrame, checks: tuple[Check, ...] = CHECKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, check_id, severity and defects of every document and check, in one pass over the texts; a null text counts as empty."""
    own = F.coalesce(F.col(text), F.lit(""))
    rows = F.array(*(F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"), c.count(own).cast("long").alias("defects")) for c in checks))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")


def rolled_up(docs: DataFrame, checks: tuple[Check, ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As `rollup` of `results`, but each row of `docs` counts on its own, so that nothing is shuffled; repeated ids keep their rows."""
    own = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(doc_id).alias("doc_id"), *(c.count(own).cast("long").alias(c.check_id) for c in checks))

    def failing(severity: str) -> Column:
        return sum((F.when(F.col(c.check_id) > 0, 1).otherwise(0) for c in checks if c.severity == severity), F.lit(0)).cast("long")

    defects = sum((F.col(c.check_id) for c in checks), F.lit(0).cast("long"))
    return counted.select("doc_id", failing("fail").alias("n_fail"), failing("warn").alias("n_warn"), defects.alias("defects"), (failing("fail") == 0).alias("submittable"))


def rollup(found: DataFrame) -> DataFrame:
    """doc_id, n_fail and n_warn (checks with defects), defects and submittable (no failing check) of each document."""
    def checks(severity: str) -> Column:
        return F.sum(F.when((F.col("severity") == severity) & (F.col("defects") > 0), 1).otherwise(0))

    return found.groupBy("doc_id").agg(checks("fail").alias("n_fail"), checks("warn").alias("n_warn"), F.sum("defects").alias("defects"), (checks("fail") == 0).alias("submittable"))


#: Who mends what (auto, human or manual) by check; the words of the advice are data of the caller.
REMEDY_KINDS = {
    "unresolved_markers": "human",
    "self_inserted_blocks": "auto",
    "template_placeholders": "auto",
    "unchecked_choices": "human",
    "empty_label_fields": "human",
    "masking_violation": "manual",
    "residual_colored_runs": "auto",
    "font_name_mixing": "auto",
    "missing_required_documents": "human",
    "font_size_spread": "auto",
    "empty_table_rows": "manual",
    "recruit_date_conflict": "human",
    "paren_choices": "human",
    "empty_label_fields_ext": "human",
    "empty_image_slots": "manual",
    "page_overflow": "manual",
    "unverified_claims": "human",
}


def with_remedies(found: DataFrame, remedies: DataFrame | None = None) -> DataFrame:
    """Open results (defects > 0) with kind and command; a check without a remedy is manual and has no command.

    remedies: check_id, kind, command; by default the fixed kinds, each automatic check with its own id as command. They are
    one row for each kind of check, and are broadcast.
    """
    if remedies is None:
        rows = [(c, k, c if k == "auto" else None) for c, k in REMEDY_KINDS.items()]
        remedies = found.sparkSession.createDataFrame(rows, "check_id string, kind string, command string")
    return found.filter("defects > 0").join(F.broadcast(remedies), "check_id", "left").withColumn("kind", F.coalesce("kind", F.lit("manual")))


def remaining_work(items: DataFrame) -> DataFrame:
    """doc_id, auto_commands (distinct), human_fields, manual_items, blocking_defects and remaining_checks of each document with open items."""

    def total(where: Column) -> Column:
        return F.sum(F.when(where, F.col("defects")).otherwise(0))

    return items.groupBy("doc_id").agg(
        F.count_distinct(F.when(F.col("command") != "", F.col("command"))).alias("auto_commands"),
        total(F.col("kind") == "human").alias("human_fields"),
        total(F.col("kind") == "manual").alias("manual_items"),
        total(F.col("severity") == "fail").alias("blocking_defects"),
        F.count("*").alias("remaining_checks"),
    )


def categories(items: DataFrame, least: int = 3) -> DataFrame:
    """`items` with category: by the remedy's kind auto_fix, human_input or manual_review; of `least` or more runs (n_runs) code_improvement.

    Only manual ones, and automatic ones that warn, are promoted so; what a person must enter never is.
    """
    plain = F.when(F.col("kind") == "auto", "auto_fix").when(F.col("kind") == "human", "human_input").otherwise("manual_review")
    promoted = (F.coalesce("n_runs", F.lit(0)) >= least) & ((F.col("kind") == "manual") | ((F.col("kind") == "auto") & (F.col("severity") == "warn")))
    return items.withColumn("category", F.when(promoted, "code_improvement").otherwise(plain))


def merged_advice(advice: DataFrame, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """Each advice (run, code, form, message, seq) of a run once, where it first stood, and the run's exit code: the largest of exit_code."""
    nth = F.row_number().over(W.partitionBy(run, "code", "form", "message").orderBy("seq"))
    return advice.withColumn("nth", nth).filter("nth = 1").drop("nth"), advice.groupBy(run).agg(F.max("exit_code").alias("exit_code"))


def compared_to_baseline(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key, check and passed for every key of either: both there, equal pages, 70 % of the text, as many pictures, half of the bold stretches (one at least).

    Both have key, pages, chars, images and bold; what the baseline has none of is not asked for; of a key with one side only the file check alone is given.
    """
    b = baseline.select(key, *(F.col(c).alias(f"b_{c}") for c in ("pages", "chars", "images", "bold")), F.lit(True).alias("was"))
    both = current.withColumn("is", F.lit(True)).join(b, key, "full_outer")
    there = F.col("is").isNotNull() & F.col("was").isNotNull()
    tests = {
        "file": there,
        "pages": F.col("pages") == F.col("b_pages"),
        "text": (F.col("b_chars") == 0) | (F.col("chars") >= 0.7 * F.col("b_chars")),
        "images": F.col("images") >= F.col("b_images"),
        "bold": (F.col("b_bold") == 0) | (F.col("bold") >= F.greatest(F.lit(1), F.floor(F.col("b_bold") / 2))),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("check"), test.alias("passed")) for name, test in tests.items()))
    return both.select(key, F.explode(F.when(there, rows).otherwise(F.slice(rows, 1, 1))).alias("x")).select(key, "x.*")
