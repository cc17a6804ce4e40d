"""Masking of personal data and of facts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three patterns masked, in the order in which they apply, and what stands in their place. Words, digits and
#: white space are those of Unicode, written out because Java's short forms mean ASCII.
MASKS = (
    (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "[이메일]"),
    (r"\p{Nd}{6}[\s\p{Z}]*-[\s\p{Z}]*\p{Nd}{7}", "[주민번호]"),
    (r"0\p{Nd}{1,2}[-\s\p{Z}]?\p{Nd}{3,4}[-\s\p{Z}]?\p{Nd}{4}", "[전화]"),
)


def mask_pii(text: Column) -> Column:
    """E-mail addresses, then resident numbers, then phone numbers, each replaced by its token; null stays null."""
    for pattern, token in MASKS:
        text = F.regexp_replace(text, pattern, token)
    return text


def mask_facts(text: Column) -> Column:
    """Personal data masked, then every run of digits made one N; null stays null."""
    return F.regexp_replace(mask_pii(text), r"\p{Nd}+", "N")
