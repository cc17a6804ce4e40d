"""Predicates of labels, values and texts of forms, as column expressions. A null text counts as an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare

#: Words and patterns that must match the forms' own.
NOT_A_NAME = r"[,，;/·•∙ㆍ、|&]|및|총괄|담당|수행|자문"
NUMERIC_VALUE = r"^[\s\p{Nd}.,\-/원만억천백십개%()~–—:]+$"
FILL_BLANK = r"^[\s\p{Z}_.·․‥…　─━―—–\-]*$"
SEAL = r"(?i)^[(（]\s*(?:인|印|서명|署名|날인|捺印|도장|sign|seal)\s*[)）]$"
DUMMY_DATES = (
    r"(?<!\p{Nd})\p{Nd}{4}\s*[.\-/]\s*(\p{Nd}{1,2})\s*[.\-/]\s*(\p{Nd}{1,2})\s*\.?(?!\p{Nd})",
    r"(?<!\p{Nd})\p{Nd}{4}\s*년\s*(\p{Nd}{1,2})\s*월\s*(\p{Nd}{1,2})\s*일?",
)
PLACEHOLDERS = (
    r"(?<![0-9,.])0{2,}\s*(?:억원|천만원|백만원|만원|원|명|건|개|회|년|개월|%|퍼센트)(?![0-9])",
    r"(?<!\p{Nd})0{2,3}\s*-\s*0{2}\s*-\s*0{4,5}(?!\p{Nd})",
    r"^[(（]\s*[-–—.·ㅡ~\s]*[)）]$",
    r"(?<![A-Za-z0-9])(?:OO|○○|ㅇㅇ)[가-힣].{0,40}?(?<![A-Za-z0-9])(?:OO|○○|ㅇㅇ)[가-힣]",
    r"^◈\s*.{2,60}$",
)
NOISE_LABELS = (r"^\s*(?:\p{Nd}{1,3}|[①-⑳]|[Ⅰ-Ⅻ]|\p{Nd}{1,3}\s*[.)])\s*$", r"^[.．…‥⋯\s]+$")
EXAMPLE_LABEL = r"^[Oo0○Ｏ]{3,}(?:\s*(?:대표|과장|부장|차장|대리|사원|팀장|이사|주임))?$"
NOTICE_PREFIXES = ("※", "☞", "주)")
NARRATIVE_HINTS = ("개요", "계획", "방안", "전략", "목표", "추진", "내용", "설명", "서술", "현황", "배경", "필요성", "기대효과", "차별성", "사업화", "로드맵", "problem", "solution", "scale", "team", "psst")
NARRATIVE_LABELS = ("문제인식", "문제 인식", "실현가능성", "실현 가능성", "성장전략", "성장 전략", "팀구성", "팀 구성")
IMPROVABLE = (
    r"<[^>]+>|○○○|OOO|000",
    r"(?i)○{2,}|O{2,}(?!penai)|0{2,}백만|00\.00|00백만|OO학|○○기업|예정\(['’]?0{2}|완료\(['’]?0{2}|\.{3,}|…{2,}|^00$|에정\b|S\s*/\s*W|S/W",
    r"^0{2,}$",
)
PURE_GUIDE = r"^\s*(?:[<\(［【]\s*)?(?:작성\s*요령|작성\s*방법|작성\s*예시|기재\s*요령|기재\s*방법|유의\s*사항|예\s*시|참고\s*용|※[^。\n]{0,40}(?:작성|기재|예시))"
GUIDE_EXTRA = (
    r"^[\s○●▪◦·•‣⁃\-–—－*ㅇㅁ<\(（［【]*(?:(?:작성|기재|기입|입력)\s*(?:요령|방법|예시|방식|요망)|[^\n]{0,80}?(?:기재|작성|기입|입력|서술|기술)\s*"
    r"(?:하(?:시오|십시오|세요|시기\s*바랍니다)|해\s*주(?:십시오|시기\s*바랍니다|세요)|하여\s*주(?:십시오|시기\s*바랍니다|세요)|하기\s*바랍니다|할\s*것|바랍니다|바람|요망|요함))"
)
EMPTY_BOXES, CHECKED_BOXES = "□☐▢◻◽⬚〼", "■☑☒✓✔◼◾🗹"
FOUNDER_LABELS = ("기업형태", "사업자형태", "기업유형", "사업유형", "창업단계", "창업유형", "설립유형")
COMPANY_INFO_LABELS = ("투자유치", "산업재산권", "지식재산권", "지재권", "특허")


def any_of(text: Column, patterns) -> Column:
    """Whether any of the patterns matches somewhere."""
    return F.greatest(F.lit(False), F.lit(False), *(text.rlike(p) for p in patterns))


def holds(text: Column, words) -> Column:
    """Whether any of the words occurs."""
    return F.greatest(F.lit(False), F.lit(False), *(F.contains(text, F.lit(w)) for w in words))


def is_empty_value(value: Column) -> Column:
    """Whether a value is nothing but a place to write: blank, dots and dashes, a bare scheme, digits, or two signs. Digits alone count as such here."""
    v = bare(value)
    signs = (F.char_length(v) <= 2) & ~v.rlike(r"[\p{L}\p{N}]")
    return (v == "") | any_of(v, (r"^[○●\-.\s]+$", "^(http|https)://$", r"^[\p{Nd},.\s]+$")) | signs


def is_dummy_value(value: Column) -> Column:
    """Whether a value is an obvious dummy: a date of month and day 0, a quantity of zeros, a registration number of zeros, empty parentheses or a guide. A blank one is not."""
    v = bare(value)
    dates = [(F.regexp_extract(v, p, 1).try_cast("int") == 0) & (F.regexp_extract(v, p, 2).try_cast("int") == 0) for p in DUMMY_DATES]
    return (v != "") & (F.greatest(*(F.coalesce(d, F.lit(False)) for d in dates)) | any_of(v, PLACEHOLDERS))


def is_noise_label(label: Column, cluster: Column) -> Column:
    """Whether a label names no field: blank, or an index, an ellipsis, an example or a notice and of no synonym cluster."""
    t = bare(label)
    notice = F.greatest(*(t.startswith(p) for p in NOTICE_PREFIXES))
    return (t == "") | (cluster.isNull() & (any_of(t, NOISE_LABELS) | F.regexp_replace(t, r"\s+", "").rlike(EXAMPLE_LABEL) | notice))


def looks_numeric(value: Column) -> Column:
    """Whether a value is a number, amount, date or quantity."""
    v = bare(value)
    return v.rlike(r"\p{Nd}") & v.rlike(NUMERIC_VALUE)


def looks_like_name(value: Column) -> Column:
    """Whether a value may be a person's name: not blank, 20 characters at most, no list and no role."""
    v = bare(value)
    return (v != "") & (F.char_length(v) <= 20) & ~v.rlike(NOT_A_NAME)


def bracket_tokens(label: Column) -> Column:
    """What stands in a label's parentheses, without white space, distinct and sorted."""
    found = F.transform(F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(r"[\(（]([^\)）]*)[\)）]"), F.lit(1)), lambda x: F.regexp_replace(x, r"[\s\p{Z}]+", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def bracket_conflict(a: Column, b: Column) -> Column:
    """Whether two labels both have something in parentheses, and not the same."""
    x, y = bracket_tokens(a), bracket_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def is_fill_blank(rest: Column) -> Column:
    """Whether what follows a colon is a blank to fill: nothing, or lines and dots."""
    return F.coalesce(rest, F.lit("")).rlike(FILL_BLANK)


def is_visible_blank(rest: Column) -> Column:
    """Whether it is such a blank that can be seen."""
    return (bare(rest) != "") & is_fill_blank(rest)


def is_seal(value: Column) -> Column:
    """Whether a value is a place for a seal or signature."""
    return bare(value).rlike(SEAL)


def founder_type_label(label_key: Column, cluster: Column, clusters: tuple[str, ...] = ()) -> Column:
    """Whether a label asks for the kind of company or the stage of founding."""
    return F.coalesce(cluster.isin(*clusters) if clusters else F.lit(False), F.lit(False)) | holds(label_key, FOUNDER_LABELS)


def preliminary_founder(label_key: Column, cluster: Column, value: Column, clusters: tuple[str, ...] = ()) -> Column:
    """Whether a field says that its source is not founded yet; `F.bool_or` of it over a source's fields is the source's."""
    return founder_type_label(label_key, cluster, clusters) & F.coalesce(value, F.lit("")).rlike(r"예비\s*창업")


def company_info_label(label_key: Column, cluster: Column, clusters: tuple[str, ...] = ()) -> Column:
    """Whether a label asks for what such a source cannot have: its clusters (a parameter), investments and patents."""
    return F.coalesce(cluster.isin(*clusters) if clusters else F.lit(False), F.lit(False)) | holds(label_key, COMPANY_INFO_LABELS)


def is_guide(text: Column) -> Column:
    """Whether a text is a guide on how to fill in a form."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(PURE_GUIDE) | t.rlike(GUIDE_EXTRA)


def field_kind(label: Column) -> Column:
    """fact or narrative: narrative by a hint, or from 24 characters on."""
    t = bare(label)
    return F.when(t == "", "fact").when(holds(F.lower(t), NARRATIVE_HINTS) | holds(t, NARRATIVE_LABELS) | (F.char_length(t) >= 24), "narrative").otherwise("fact")


def needs_improvement(value: Column) -> Column:
    """Whether a cell's value is a sample or still unfinished; a blank one is not."""
    v = F.regexp_replace(bare(value), r"[\s\p{Z}]+", " ")
    return (v != "") & any_of(v, IMPROVABLE)


def is_option(cell: Column) -> Column:
    """Whether a cell is one box and the name of an option."""
    t = bare(cell)
    boxes = F.regexp_count(t, F.lit(f"[{EMPTY_BOXES}{CHECKED_BOXES}]"))
    return (boxes == 1) & option_text(t).rlike("[가-힣A-Za-z0-9]")


def option_text(cell: Column) -> Column:
    """An option's name without its box."""
    return bare(F.regexp_replace(bare(cell), f"[{EMPTY_BOXES}{CHECKED_BOXES}]", ""))


def protected_path(path: Column) -> Column:
    """The rule that protects a path, null if none does: environment files, project data, browser state."""
    lower = F.lower(F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "/+", "/"), r"^(\./)+", ""))
    parts = F.filter(F.split(lower, "/"), lambda x: x != ".")
    name = F.element_at(parts, -1)
    env = (name != ".env.example") & ((name == ".env") | name.startswith(".env."))
    data = parts[0].isin("workspace", "results", "backup", "_workspace")
    browser = F.exists(parts, lambda x: x.isin(".browser-profile", "browser_profile", "user-data-dir")) | name.isin("cookies.json", "storage_state.json")
    return F.when(name == ".env.example", None).when(env, "PROTECTED_ENV_FILE").when(data, "PROTECTED_PROJECT_DATA").when(browser, "PROTECTED_BROWSER_STATE")
