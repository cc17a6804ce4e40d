"""Normalisers, parsers and predicates of text, as column expressions. Nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the forms take it: no-break and ideographic spaces too.
WHITE = r"\s\p{Z}\x1C-\x1F\x85"
#: Symbols that begin a label, and the forms of ordinals that may follow them.
LABEL_BULLETS = "○●◯◌▶▷◀◁◆◇■□▪▫▸▹◦‣⦁·∙•*※→⇒"
LABEL_ORDINALS = (r"\d{1,2}\s*[.)]\s*", "[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\\s*", r"[가나다라마바사아자차카타파하]\s*[.)]\s*", r"[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]\s*[.)]?\s*")
#: Symbols of bullets in running text.
LINE_BULLETS = "○●◦◌∙·•‣▪▫■□◇◆▶▷►▸\\-–—*ㅇㅁ"
#: What secrets look like, by rule.
SECRETS = {
    "SECRET_OPENAI_KEY": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "SECRET_GOOGLE_KEY": r"\bAIza[0-9A-Za-z_-]{30,}\b",
    "SECRET_GITHUB_TOKEN": r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
}


def bare(text: Column) -> Column:
    """A text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WHITE}]+|[{WHITE}]+$", "")


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def said_once(text: Column, least: int) -> Column:
    """A text of `least` characters or more, and of an even number, whose halves say the same but for spaces at their ends: one of them. For up to two rounds."""

    def halved(t: Column) -> Column:
        n = F.char_length(t)
        half = F.floor(n / 2).cast("int")
        left, right = F.trim(F.substring(t, F.lit(1), half)), F.trim(F.substring(t, half + 1, n))
        return F.when((n >= least) & (n % 2 == 0) & (left != "") & (left == right), left).otherwise(t)

    return let(let(text, halved), halved)


def label_key(label: Column) -> Column:
    """A label without parentheses, white space and, in two passes, leading bullets and one ordinal; whole if no word is left."""
    bare = F.regexp_replace(F.regexp_replace(label, r"\([^)]*\)", ""), r"(?U)\s+", "")
    out = bare
    for _ in range(2):
        out = F.regexp_replace(out, f"^[{LABEL_BULLETS}]+", "")
        out = F.regexp_replace(out, "^(" + "|".join(LABEL_ORDINALS) + ")", "")
    # Most cells are one plain word, of which nothing goes.
    return F.when((label == "") | label.rlike(r"^[가-힣A-Za-z0-9]+\z"), label).when(out.rlike("[가-힣A-Za-z0-9]"), out).otherwise(bare)


def normal_label(label: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(label, r"[^\p{L}\p{N}]+", ""))


def normal_text(label: str) -> str:
    """As `normal_label`, of a plain string."""
    return "".join(c for c in label if c.isalnum()).lower()


def value_key(value: Column) -> Column:
    """A value without white space, hyphens, middle dots and full stops, in lower case."""
    return F.lower(F.regexp_replace(value, f"[{WHITE}\\-·.]+", ""))


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """The distinct words of two or more characters, in lower case, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([가-힣a-z0-9]{2,})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def unique_lines(text: Column) -> Column:
    """The distinct trimmed lines that are not blank, each at its first place."""
    lines = F.transform(F.split(text, "\n"), bare)
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def bullet_spacing(line: Column) -> Column:
    """One space after a leading bullet; runs of spaces inside made one."""
    return F.regexp_replace(F.regexp_replace(line, f"^([ \\t]*)([{LINE_BULLETS}]+)[ \\t]{{2,}}", "$1$2 "), " {2,}", " ")


def cell_whitespace(cell: Column) -> Column:
    """A cell trimmed, with runs of white space inside made one space."""
    return F.regexp_replace(F.regexp_replace(cell, f"^[{WHITE}]+|[{WHITE}]+$", ""), f"[{WHITE}]+", " ")


def _rooted(path: Column) -> Column:
    """A path behind a host, empty or from a slash on."""
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no parameters (;) in the last part of the path and no slash at its end; https where no scheme stands; blank and null are empty.

    A text without scheme and host is all path, and comes out as https:///path, as the standard library joins it.
    """
    raw = bare(url)
    parts = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
    scheme, host, path, query = (F.regexp_extract(raw, parts, i) for i in range(1, 5))
    path = F.regexp_replace(path, ";[^/]*$", "")
    scheme = F.when(scheme == "", "https").otherwise(F.lower(scheme))
    query = F.when(query == "?", "").otherwise(query)
    return F.when(raw == "", "").otherwise(F.concat(scheme, F.lit("://"), F.lower(host), _rooted(F.regexp_replace(path, "/+$", "")), query))


def first_year(*texts: Column) -> Column:
    """The first 19xx or 20xx that stands between other digits nowhere, in the first text that has one; else empty."""
    found = [F.regexp_extract(F.coalesce(t, F.lit("")), r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1) for t in texts]
    return F.coalesce(*(F.when(f != "", f) for f in found), F.lit(""))


def _number(text: Column, unit: str) -> Column:
    return F.regexp_extract(text, rf"([0-9.]+)\s*{unit}", 1).try_cast("double")


def amount_in_won(text: Column) -> Column:
    """Trillions, hundred millions and ten thousands added up; without units the first number, and 0 without any."""
    units = (("조", 1e12), ("억", 1e8), ("만", 1e4))

    def amount(bare: Column) -> Column:
        # A unit is sought only where it stands.
        total = sum((F.when(F.contains(bare, F.lit(u)), F.coalesce(_number(bare, u), F.lit(0.0)) * F.lit(w)).otherwise(0.0) for u, w in units), F.lit(0.0))
        return let(total, lambda t: F.when(t > 0, t).otherwise(F.coalesce(_number(bare, ""), F.lit(0.0))))

    return let(F.translate(F.coalesce(text, F.lit("")), ",", ""), amount)


def leading_number(text: Column) -> Column:
    """The first number, units ignored; 0 without one and for null."""
    return F.coalesce(_number(F.regexp_replace(F.coalesce(text, F.lit("")), ",", ""), ""), F.lit(0.0))


def clip(text: Column, most: int) -> Column:
    """A text with single spaces; one longer than `most` characters cut there, ended by a full stop."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}]+", " ")
    return F.when(F.char_length(bare) > most, F.concat(F.regexp_replace(F.substring(bare, 1, most), "[ ,.;:]+$", ""), F.lit("."))).otherwise(bare)


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of a few literal words occurs; false for null."""
    return F.coalesce(F.greatest(F.lit(False), F.lit(False), *(F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def weight(text: Column, lexicon: Mapping[str, int]) -> Column:
    """The sum of the weights of the lexicon's words that occur."""
    return sum((F.when(F.contains(text, F.lit(w)), n).otherwise(0) for w, n in lexicon.items()), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def letters(text: Column) -> Column:
    """The distinct characters of a text."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
