"""Secret scan with column expressions only: fixed shapes, and sliding-window Shannon entropy per character class.

The base kinds are found by their shape. Beside them, candidate strings of each character class (runs of its symbols, as long
as a window or longer) are read by a window that slides one symbol at a time: the window's counts lose the symbol that leaves
and gain the one that enters, and with them the sum of c * log2(c), kept in integers, changes by two table entries. The
window's entropy is log2(size) - sum / size. Overlapping windows at or above the class's threshold are one span. Candidates on
the allow-list are suppressed: values that match one of its patterns whole, stand after a word that says what they are (the
name of a digest), or are listed.

Everything happens within a row, so a scan neither shuffles nor leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.storage import quoted

#: The base kinds in their order, with the pattern, the group whose length counts, and the least length.
BASE = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Prefix sums are taken in runs of so many, so that a list of any length takes little more than linear time.
RUN = 256
#: Entropies are integers in millionths of a bit.
MICRO = 1_000_000


#: The end of a name in an assignment, and the sign after it.
ASSIGNED = r"""[dDtTnNyY]["']?\x20*[:=]"""


def run_pattern(symbols: str, least: int) -> str:
    """Runs of `least` or more of these symbols."""
    return "[" + "".join(f"\\x{ord(c):02X}" for c in sorted(set(symbols))) + f"]{{{least},}}"


@dataclass(frozen=True)
class CharacterClass:
    """A kind of candidate: its symbols (in lower case if `folded`), the window's size, and the entropy in bits from which a window is hot."""

    kind: str
    symbols: str
    folded: bool
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        """Runs of symbols no shorter than a window; for folded classes, of either case."""
        return run_pattern(self.symbols + (self.symbols.upper() if self.folded else ""), self.window)

    @property
    def largest_sum(self) -> int:
        """The sum of c * log2(c) of a window that is just hot, in millionths."""
        return round(MICRO * self.window * (math.log2(self.window) - self.bits))


#: 16 random hexadecimal digits have 3.3 bits on average, 20 random base64 symbols 4.0; words of any language stay below 3.9.
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdef", True, 16, 2.9),
    CharacterClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", False, 20, 3.9),
)
#: Allow-list: candidates that match whole (numbers, words without digits, UUIDs, dates, placeholders), and what stands before a digest.
ALLOWED = (
    r"[0-9_=+/-]+",
    r"[A-Za-z_=+/-]+",
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i).*(example|placeholder|changeme|dummy|redacted|deadbeef|0123456789|abcdefgh|xxxxxx|000000).*",
)
ALLOWED_AFTER = r"(?i)(?:^|[^A-Za-z0-9])(sha-?[0-9]{1,3}|md5|etag|commit|checksum|digest|integrity)[^A-Za-z0-9]{1,3}\z"


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _running(lengths: Column) -> Column:
    """The sum of all lengths before each."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def running_starts(lengths: Column) -> Column:
    """As `_running`, in runs of RUN, so that no long list is copied for each of its elements."""

    def joined(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(runs, _running(totals), lambda run, base: F.transform(_running(run), lambda x: x + base)))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, RUN))
    return let(lengths, lambda xs: let(cut(xs), joined))


LOCATED = "array<struct<start:int,end:int,value:string,group:string,before:string>>"


def located(text: Column, pattern: str, group: int = 0, hint: Column | None = None) -> Column:
    """start, end (code points, end exclusive), value, group and before (up to 24 characters since the last match) of each leftmost non-overlapping match.

    The matches and what `split` leaves between them follow each other, so their lengths add up to the places. `hint` is a
    cheaper test that every text with a match passes.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("groups"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def placed(p: Column):
        """The matches, where `starts` has the places of each gap and each match in turn."""
        return lambda starts: F.transform(p["found"], lambda value, i: F.struct(
            F.element_at(starts, 2 * i + 2).alias("start"),
            (F.element_at(starts, 2 * i + 2) + F.char_length(value)).alias("end"),
            value.alias("value"),
            F.element_at(p["groups"], i + 1).alias("group"),
            F.right(F.element_at(p["gaps"], i + 1), F.lit(24)).alias("before"),
        ))

    def places(p: Column) -> Column:
        lengths = F.flatten(F.zip_with(F.slice(p["gaps"], 1, F.size(p["found"])), p["found"], lambda g, f: F.array(F.char_length(g), F.char_length(f))))
        return let(running_starts(lengths), placed(p))

    matched = F.regexp_like(text, F.lit(pattern))
    return F.when(matched if hint is None else hint & matched, let(parts, places)).otherwise(F.array().cast(LOCATED))


def hot_spans(value: Column, kind: CharacterClass) -> Column:
    """start, end (within the value) and bits (the highest of its windows) of each run of overlapping hot windows."""
    size, n = kind.window, len(kind.symbols)
    table = F.array(*(F.lit(round(MICRO * c * math.log2(c)) if c else 0) for c in range(size + 1)))
    symbols = F.split(F.lower(value) if kind.folded else value, "")
    codes = F.transform(symbols, lambda c: F.instr(F.lit(kind.symbols), c))
    span = "struct<start:int,end:int,least:bigint>"
    zero = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def part(count: Column) -> Column:
        """A symbol's part of the sum."""
        return F.element_at(table, count + 1).cast("bigint")

    def slide(codes: Column):
        def step(a: Column, entering: Column) -> Column:
            at = a["at"] + 1
            leaving = F.when(at > size, F.element_at(codes, F.greatest(at - size, F.lit(1)))).otherwise(F.lit(0))
            gained, lost = F.element_at(a["counts"], entering), F.when(leaving > 0, F.element_at(a["counts"], F.greatest(leaving, F.lit(1))))
            # A symbol that leaves as another of its kind enters changes nothing.
            change = part(gained + 1) - part(gained) + F.when(leaving > 0, part(lost - 1) - part(lost)).otherwise(F.lit(0).cast("bigint"))
            total = a["sum"] + F.when(entering == leaving, F.lit(0).cast("bigint")).otherwise(change)
            counts = F.transform(a["counts"], lambda c, i: c + F.when(i + 1 == entering, 1).otherwise(0) - F.when(i + 1 == leaving, 1).otherwise(0))
            last = F.when(F.size(a["spans"]) > 0, F.element_at(a["spans"], -1))
            first = at - size
            joined = F.concat(
                F.slice(a["spans"], F.lit(1), F.greatest(F.size(a["spans"]) - 1, F.lit(0))),
                F.array(F.struct(last["start"].alias("start"), at.alias("end"), F.least(last["least"], total).alias("least"))),
            )
            added = F.concat(a["spans"], F.array(F.struct(first.alias("start"), at.alias("end"), total.alias("least"))))
            spans = F.when((at < size) | (total > kind.largest_sum), a["spans"]).when(last.isNotNull() & (last["end"] > first), joined).otherwise(added)
            return F.struct(counts.alias("counts"), total.alias("sum"), at.alias("at"), spans.alias("spans"))

        return step

    found = let(codes, lambda c: F.aggregate(c, zero, slide(c), lambda a: a["spans"]))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.lit(math.log2(size)) - s["least"] / F.lit(float(MICRO * size))).alias("bits")))


SPANS = "array<struct<start:int,kind:string,end:int,value:string,bits:double>>"


def _base_spans(text: Column, kind: str, pattern: str, group: int, least: int, hint: Column) -> Column:
    if kind != "assign":
        # A run of these symbols fails by its length alone, so the runs that would fail need not be found.
        prefix = pattern.partition("[")[0]
        pattern = pattern.removesuffix("+") + f"{{{least - len(prefix)},}}"
    fit = F.filter(located(text, pattern, group, hint), lambda m: F.char_length(m["group"]) >= least)
    return F.transform(fit, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"), F.lit(None).cast("double").alias("bits"))).cast(SPANS)


def _suspect(patterns: tuple[str, ...], values: tuple[str, ...]):
    """Whether a candidate is not on the allow-list."""

    def suspect(m: Column) -> Column:
        known = F.regexp_like(m["before"], F.lit(ALLOWED_AFTER))
        for p in patterns:
            known = known | F.regexp_like(m["value"], F.lit(f"^(?:{p})$"))
        return ~(known | m["value"].isin(*values)) if values else ~known

    return suspect


def _entropy_spans(kind: CharacterClass):
    """The hot spans of a candidate, placed in the text."""

    def spans(m: Column) -> Column:
        return F.transform(hot_spans(m["value"], kind), lambda s: F.struct(
            (m["start"] + s["start"]).alias("start"),
            F.lit(kind.kind).alias("kind"),
            (m["start"] + s["end"]).alias("end"),
            F.substring(m["value"], s["start"] + 1, s["end"] - s["start"]).alias("value"),
            s["bits"].alias("bits"),
        ))

    return spans


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, allowed_values: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of start, kind, end, value, bits) of each row.

    base has the fixed kinds by start, then kind as in BASE, with null bits; added has the hot spans of candidates that are not
    on the allow-list, whether or not a base span covers them. A null or empty text has none; repeated rows and null ids each
    keep their own row; a text of any length is read whole; other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    # Texts without a name before a sign, or without any long run, need no more patterns.
    symbols, shortest = "".join(k.symbols + k.symbols.upper() for k in classes), min([BASE["hex"][2], *(k.window for k in classes)])
    rows = rows.withColumn("named", F.regexp_like("text", F.lit(ASSIGNED))).withColumn("runs", F.regexp_like("text", F.lit(run_pattern("0123456789abcdef" + symbols, shortest))))
    hints = {"assign": F.col("named"), "access": F.contains("text", F.lit("AKIA")), "hex": F.col("runs")}
    for kind, (pattern, group, least) in BASE.items():
        rows = rows.withColumn(kind, _base_spans(F.col("text"), kind, pattern, group, least, hints[kind]))
    for k in classes:
        candidates = F.filter(located(F.col("text"), k.pattern, hint=F.col("runs")), _suspect(allowed, allowed_values))
        rows = rows.withColumn(k.kind, F.flatten(F.transform(candidates, _entropy_spans(k))).cast(SPANS))
    order = F.create_map(*(F.lit(x) for kv in {k: i for i, k in enumerate((*BASE, *(k.kind for k in classes)))}.items() for x in kv))

    def sorted_(*columns: str) -> Column:
        ranked = F.transform(F.concat(*columns), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s.alias("span")))
        return F.transform(F.array_sort(ranked), lambda x: x["span"])

    return rows.select("doc_id", sorted_(*BASE).alias("base"), sorted_(*(k.kind for k in classes)).alias("added") if classes else F.array().cast(SPANS).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of each row of `scan`.

    A row without spans has zeros, the digest of an empty text and an empty string. Spans that begin at one place are in the
    order of the kinds, added ones last.
    """
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(BASE) for x in (k, i)))
    every = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.coalesce(rank[s["kind"]], F.lit(len(BASE))).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return scanned.select(
        "doc_id",
        *(_number(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(every)).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def findings(scanned: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One row for each span of `scan`: doc_id, kind, start, end, bits, preview (its first four characters and its length) and fingerprint (SHA-256 of the value).

    Added spans whose value is in the column `value` of `allowed` are left out, base ones stay; nulls there match nothing. No
    secret stands in the result itself.
    """
    spans = scanned.select("doc_id", F.explode(F.concat(F.transform("base", lambda s: s.withField("added", F.lit(False))), F.transform("added", lambda s: s.withField("added", F.lit(True))))).alias("s"))
    rows = spans.select("doc_id", "s.*", F.sha2("s.value", 256).alias("fingerprint"))
    if allowed is not None:
        listed = allowed.select(F.sha2(F.col("value").cast("string"), 256).alias("fingerprint"), F.lit(True).alias("added")).distinct()
        rows = rows.join(listed, ["fingerprint", "added"], "left_anti")
    preview = F.concat(F.substring("value", 1, 4), F.lit("... ("), F.char_length("value"), F.lit(" characters)"))
    return rows.select("doc_id", "kind", "start", "end", "bits", preview.alias("preview"), "fingerprint")
