"""Amounts, numbers, dates, criteria and terms that texts state, as column expressions. Nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare, said_once

#: Units of numbers, and what lines of announcements and scores look like.
UNITS = "%|％|억원|억|조|만원|백만원|천원|원|명|건|개|배|점|위|년"
ANNOUNCED = {
    "eligibility": r"(지원\s*대상|지원\s*자격|신청\s*자격|지원자격|모집\s*대상)",
    "deadline": r"(접수|신청|모집|제출).{0,6}(기간|마감|기한|일정)|~?\s*\p{Nd}{4}[.\-/]\s?\p{Nd}{1,2}[.\-/]\s?\p{Nd}{1,2}",
    "required_documents": r"(제출\s*서류|구비\s*서류|필수\s*서류|첨부\s*서류)",
}
AMOUNT = r"\p{Nd}[\p{Nd},]*\s*(?:억원|억|백만원|천만원|만원|원)(?![\p{L}\p{N}_])"
CRITERION = r"([가-힣\p{L}\p{N}_\s·\-()]{2,30}?)\s*[\(（]?\s*(\p{Nd}{1,3})\s*점?\s*[\)）]"
DATE = r"(\p{Nd}{4})\s*[년.\-/]\s*(\p{Nd}{1,2})\s*[월.\-/]\s*(\p{Nd}{1,2})"


def amount_in_hundred_millions(text: Column) -> Column:
    """An amount in hundred millions by its first unit alone: 억, else 조; else a number, as won from 1e8 on; 0 without any."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")
    number = lambda p: F.regexp_extract(t, p, 1).try_cast("double")
    plain = number(r"([\p{Nd}.]+)")
    return F.coalesce(number(r"([\p{Nd}.]+)억"), number(r"([\p{Nd}.]+)조") * 10000, F.when(plain >= 1e8, plain / 1e8).otherwise(plain), F.lit(0.0))


def stated_numbers(text: Column, most: int = 6) -> Column:
    """array<struct<label, value, unit>>: the first `most` distinct numbers with units; of two or more those of the most frequent unit (the first of equal ones), if it has two; else none."""
    pattern = rf"([가-힣A-Za-z0-9·\s]{{1,16}}?)\s*[:：]?\s*(\p{{Nd}}[\p{{Nd}},]*\.?\p{{Nd}}*)\s*({UNITS})"
    t = F.coalesce(text, F.lit(""))
    groups = [F.regexp_extract_all(t, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "abc", strict=True))), _number)
    found = F.slice(F.array_distinct(F.filter(rows, lambda x: x["value"].isNotNull())), 1, most)
    start = F.struct(F.lit("").alias("unit"), F.lit(0).alias("n"))

    def better(best: Column, x: Column) -> Column:
        n = F.size(F.filter(found, lambda y: y["unit"] == x["unit"]))
        return F.when(n > best["n"], F.struct(x["unit"].alias("unit"), n.alias("n"))).otherwise(best)

    top = F.aggregate(found, start, better)
    return F.when(top["n"] >= 2, F.filter(found, lambda x: x["unit"] == top["unit"])).otherwise(F.filter(found, lambda x: F.lit(False)))


def _number(x: Column) -> Column:
    label = F.regexp_replace(F.regexp_replace(x["a"], r"\s+", " "), "^[ ·:-]+|[ ·:-]+$", "")
    return F.struct(
        F.when(F.char_length(label) < 2, x["c"]).otherwise(label).alias("label"), F.regexp_replace(x["b"], ",", "").try_cast("double").alias("value"), x["c"].alias("unit")
    )


def lines_like(text: Column, pattern: str, most: int) -> Column:
    """The first `most` trimmed lines that match, cut at 120 characters."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.transform(F.slice(F.filter(lines, lambda x: (x != "") & x.rlike(pattern)), 1, most), lambda x: F.substring(x, 1, 120))


def announcement(text: Column) -> Column:
    """struct: eligibility, deadline and required_documents (lines), and amounts (distinct, sorted, 5 at most)."""
    amounts = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({AMOUNT})"), F.lit(1)))), 1, 5)
    limits = {"eligibility": 3, "deadline": 3, "required_documents": 5}
    return F.struct(*(lines_like(text, p, limits[c]).alias(c) for c, p in ANNOUNCED.items()), amounts.alias("amounts"))


def criteria(text: Column) -> Column:
    """array<struct<name, max_score>>: names of three or more characters followed by a score from 5 to 100 that a parenthesis closes."""
    t = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(CRITERION), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(CRITERION), F.lit(2)).alias("b"))
    rows = F.transform(pairs, lambda x: F.struct(F.regexp_replace(x["a"], r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("name"), x["b"].try_cast("int").alias("max_score")))
    return F.filter(rows, lambda x: x["max_score"].between(5, 100) & (F.char_length(x["name"]) >= 3))


def contains_term(text: Column, term: Column) -> Column:
    """Whether a text holds a term: a blank one always, a number only as a whole number, others without regard to case, white space and punctuation."""
    bare = F.regexp_replace(F.coalesce(term, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    t = F.coalesce(text, F.lit(""))
    digits = lambda x: F.regexp_replace(x, r"\P{Nd}", "")
    numbers = F.regexp_extract_all(t, F.lit(r"((?<!\p{Nd})\p{Nd}[\p{Nd}\s,._-]*\p{Nd}(?!\p{Nd})|(?<!\p{Nd})\p{Nd}(?!\p{Nd}))"), F.lit(1))
    norm = lambda x: F.regexp_replace(F.lower(x), r"[\s,·._\-–—:/()\[\]{}]+", "")
    return F.when(bare == "", True).when(bare.rlike(r"^[0-9\s,._-]+$"), F.array_contains(F.transform(numbers, digits), digits(bare))).otherwise(F.contains(norm(t), norm(bare)))


def deadline(text: Column) -> Column:
    """The first date that a text states; null without one, or if it is no date."""
    year, month, day = (F.regexp_extract(F.coalesce(text, F.lit("")), DATE, i) for i in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def deadline_status(date: Column, today: Column, soon: int = 3) -> Column:
    """DEADLINE_PAST before today, DEADLINE_SOON within `soon` days, else null."""
    left = F.datediff(date, today)
    return F.when(left < 0, "DEADLINE_PAST").when(left <= soon, "DEADLINE_SOON")


def match_text(text: Column) -> Column:
    """A text for comparing: single spaces, plain dashes, and one half of a text of 16 or more characters that says the same twice (up to two times)."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, "^ | $", ""), "[–—‑]", "-")
    return said_once(out, 16)


def preview_text(text: Column, breaks: bool = False) -> Column:
    """A text for a preview: its lines that are not blank, with single spaces and one kind of line end, without NUL; with `breaks`, the tags of line breaks end lines too. Null is empty."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", ""), "\r\n?", "\n")
    out = F.regexp_replace(out, "<br ?/>|<br>", "\n") if breaks else out
    lines = F.transform(F.split(out, "\n"), lambda x: bare(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def holds_anchor(text: Column, anchor: Column) -> Column:
    """Whether a text holds an anchor, with or without spaces; blank ones match nothing."""
    a, t = match_text(anchor), match_text(text)
    return (a != "") & (t != "") & (F.contains(t, a) | F.contains(F.translate(t, " ", ""), F.translate(a, " ", "")))


def char_limit(placeholder: Column, lengths: Column) -> Column:
    """The characters that a section may have, from the lengths of its lines (array), else from a number of lines that its placeholder names, else 500."""
    total, n = F.aggregate(lengths, F.lit(0), lambda a, b: a + b.cast("int")), F.size(lengths)
    named = F.regexp_extract(F.coalesce(placeholder, F.lit("")), r"(?i)(\p{Nd}+)\s*(?:줄|line)", 1).try_cast("int")
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.greatest(F.lit(300), F.least(total * 3, n * 150, F.lit(2000)))).otherwise(F.coalesce(named * 150, F.lit(500)))


def name_date(name: Column) -> Column:
    """yyyymmdd, as a number, of the first sound date in a file's name; null without one."""
    found = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(\p{Nd}{4}[.\-_]?\p{Nd}{2}[.\-_]?\p{Nd}{2})"), F.lit(1))
    digits = F.transform(found, lambda x: F.regexp_replace(x, "[._-]", "").cast("int"))
    sound = F.filter(digits, lambda d: (d / 10000).cast("int").between(1900, 2100) & ((d / 100).cast("int") % 100).between(1, 12) & (d % 100).between(1, 31))
    return F.get(sound, F.lit(0))


def unwrapped_link(url: Column) -> Column:
    """The address that a search result wraps in its argument u (URL-safe Base64 after a1); else that argument, else the address itself. Only wrapped by hosts with bing.com."""
    u = F.coalesce(url, F.lit(""))
    raw = F.regexp_extract(u, "[?&]u=([^&#]*)", 1)
    coded = F.regexp_replace(F.coalesce(F.try_url_decode(raw), raw), "^a1", "")
    plain = F.translate(coded, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.char_length(plain), F.lit(4)).cast("int")))
    # Only what is Base64 at all is decoded.
    decoded = F.when(plain.rlike("^[A-Za-z0-9+/]+$") & (F.char_length(plain) % 4 != 1), F.try_to_binary(padded, F.lit("base64")).cast("string"))
    host = F.contains(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("bing.com"))
    return F.when(~host, u).otherwise(F.coalesce(F.when(decoded.startswith("http"), decoded), F.when(coded != "", coded), u))


#: Names that a file must not have, and the most characters of a name.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
LONGEST_NAME = 180


def file_name(raw: Column) -> Column:
    """struct<name, error>: a user's file name made safe, or why it cannot be: blank, path, unusable or reserved."""
    trimmed = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    safe = F.regexp_replace(F.regexp_replace(trimmed, r'[\x00-\x1f<>:"/\\|?*]+', "_"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    safe = F.regexp_replace(safe, r"^\.+|\.+$", "")
    suffix = F.regexp_extract(safe, r"^.+(\.[^.]+)$", 1)
    stem = F.trim(F.substring(safe, F.lit(1), F.char_length(safe) - F.char_length(suffix)))
    plain = F.regexp_replace(stem, r"[\s\p{Z}]+", " ")
    short = F.when(F.char_length(plain) + F.char_length(suffix) > LONGEST_NAME, F.substring(plain, F.lit(1), F.greatest(F.lit(1), LONGEST_NAME - F.char_length(suffix)))).otherwise(plain)
    path = F.contains(trimmed, F.lit("/")) | F.contains(trimmed, F.lit("\\")) | F.contains(trimmed, F.lit(".."))
    error = F.when(trimmed == "", "blank").when(path, "path").when((safe == "") | (stem == ""), "unusable").when(F.upper(stem).isin(*RESERVED), "reserved")
    return F.struct(F.when(error.isNull(), F.concat(short, suffix)).alias("name"), error.alias("error"))


def square_heading(line: Column) -> Column:
    """A line that begins with a square, with its label in parentheses, and without what follows a dash or parenthesis; left alone if that holds digits or commas, or if nothing follows."""
    bare = F.regexp_replace(F.coalesce(line, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    label = F.trim(F.regexp_extract(bare, r"^■\s*([^(（–—-]+?)\s*(?:\s[-–—]\s|[–—]|[(（]).*$", 1))
    tail = F.substring(bare, F.lit(1) + F.instr(bare, label) + F.char_length(label) - 1, F.char_length(bare))
    return F.when((label != "") & ~tail.rlike(r"[\p{Nd},]"), F.concat(F.lit("■ ("), label, F.lit(")"))).otherwise(line)


def packed_snippets(text: Column, least: int = 40, long: int = 800, most: int = 700) -> Column:
    """array<string>: blocks between blank lines, with single spaces, of `least` characters or more; ones longer than `long` as runs of whole sentences of `most` characters; without markup."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: F.regexp_replace(F.regexp_replace(b, r"[\s\p{Z}]+", " "), "^ | $", "")), lambda b: F.char_length(b) >= least)

    def packed(block: Column) -> Column:
        sentences = F.filter(F.split(block, r"(?<=[.!?。]) "), lambda x: F.trim(x) != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def step(a: Column, x: Column) -> Column:
            trial = F.when(a["now"] == "", x).otherwise(F.concat_ws(" ", a["now"], x))
            closed = F.when(F.char_length(a["now"]) >= least, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
            return F.when(F.char_length(trial) <= most, F.struct(a["done"].alias("done"), trial.alias("now"))).otherwise(F.struct(closed.alias("done"), x.alias("now")))

        end = lambda a: F.when(F.char_length(a["now"]) >= least, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.when(F.char_length(block) > long, F.aggregate(sentences, start, step, end)).otherwise(F.array(block))

    return F.filter(F.flatten(F.transform(blocks, packed)), lambda b: ~(F.contains(b, F.lit("<")) & F.contains(b, F.lit(">"))))
