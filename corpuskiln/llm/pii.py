"""Information-theoretic sanitisation of personal data.

The protected entities are the e-mail addresses, IP addresses, card numbers and phone numbers found by fixed rules, and
secrets: keys and tokens by their shape or by the name that they are assigned to. The corpus tells how strongly a term reveals
an entity: with documents as events, PMI(entity; term) = log2(N * together / (with entity * with term)), where each count is
of the documents that hold the one, the other or both. An entity's own information is log2(N / with entity). A term that
gives away more than `generalise` of it is replaced by a mark, and one that gives away more than `remove` of it is removed,
wherever it stands within `reach` words of the entity. Only pairs that stand that near in `support` different texts are
estimated, so that chance neighbours and copies of one text prove nothing.

Most entities stand in one text only, which proves nothing about them. So the same is estimated for what they share with
others, their classes: the kind, an e-mail's domain and the letter runs of its local part, and the beginning of a number. A
term acts if it gives away the entity or one of its classes. A person named in fewer than `support` texts is protected by the
fixed rules and by these classes alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpuskiln.llm.storage import durable, quoted
from corpuskiln.llm.words import release

KINDS = ("email", "ip", "card", "phone")
#: Kinds that are found beside the base ones.
MORE_KINDS = ("secret",)
#: What the kinds look like. An address is found from its @ sign, so that no text takes more than linear time.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Pairs and names of entities up to which they are broadcast.
FEW_NAMES = 200_000
WORD = regex.compile(r"\p{L}+")
#: Secrets: values of 8 or more characters with a digit, assigned to a telling name; keys by their shape; private key blocks.
SECRET = re.compile(
    r"(?i:\b(?:[a-z0-9]+[_-])*(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<value>(?=[A-Za-z0-9_/+.=~-]*[0-9])[A-Za-z0-9_/+.=~-]{8,})"
    r"|\b(?P<shape>sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{30,}|gh[pousr]_[A-Za-z0-9]{30,}|(?:AKIA|ASIA)[0-9A-Z]{16}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"
    r"|(?P<block>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)"
)
#: Parts of which every secret has one; a text without any is not searched.
SECRET_NAMES = ("token", "secret", "passw", "api", "access", "auth")
SECRET_SHAPES = ("sk-", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "ASIA", "xox", "eyJ", "-----BEGIN ")
#: What an entity, or a term that must be removed or made general, is replaced by.
PLACES = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "removed": "", "general": "[TERM]"}


def luhn(digits: str) -> bool:
    """Whether a number's last digit fits the others."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def entities(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, entity) of the personal data in a text, by start, then kind as in KINDS."""
    out = [(a, "email", b, text[a:b].lower()) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), "ip", m.end(), m.group()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = "".join(c for c in m.group() if "0" <= c <= "9")
            if 9 <= len(digits) <= 15:
                out.append((m.start(), "phone", m.end(), digits))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def secrets(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, entity) of the secrets in a text, by start."""
    lower = text.lower()
    if not any(x in lower for x in SECRET_NAMES) and not any(x in text for x in SECRET_SHAPES):
        return []
    return [(m.start(m.lastgroup), "secret", m.end(m.lastgroup), m[m.lastgroup]) for m in SECRET.finditer(text)]


def near_terms(text: str, found: list[tuple[int, str, int, str]], reach: int) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words within `reach` words of each entity and outside all entities, and outside the names that secrets are assigned to."""
    taken = sorted([(a, b) for a, _, b, _ in found] + [m.span() for m in SECRET.finditer(text)])
    starts, busy = [x[0] for x in taken], []
    for x in taken:
        busy.append(max(busy[-1] if busy else 0, x[1]))

    def inside(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1)
        return i > 0 and busy[i - 1] > a

    for start, kind, end, entity in found:
        name = f"{kind}:{entity}"
        for m, _ in zip(WORD.finditer(text, end), range(reach)):
            if not inside(m.start(), m.end()):
                yield name, m.group().lower(), m.start(), m.end()
        # The words before are sought in ever longer stretches, so that a text of any length is not read for each entity.
        stretch = 32 * reach
        while True:
            low = max(0, start - stretch)
            before = [m for m in WORD.finditer(text, low, start) if m.start() > low or low == 0]
            if len(before) >= reach or low == 0:
                break
            stretch *= 4
        for m in before[-reach:]:
            if not inside(m.start(), m.end()):
                yield name, m.group().lower(), m.start(), m.end()


def classes(entity: Column) -> Column:
    """The names that a scanned entity is estimated under: its own, and those of its classes. Only an entity's own has the form kind:value."""
    parts = F.split(entity, ":", 2)
    kind, value = parts[0], parts[1]
    local = F.array_distinct(F.filter(F.split(F.substring_index(value, "@", 1), "[^a-z]+"), lambda x: x != ""))
    email = F.concat(F.array(F.concat(F.lit("email@"), F.substring_index(value, "@", -1))), F.transform(local, lambda x: F.concat(F.lit("email local "), x)))
    beginning = F.when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "card", F.substring(value, 1, 6)).otherwise(F.substring(value, 1, 4))
    return F.concat(F.array(entity, kind), F.when(kind == "email", email).otherwise(F.array(F.concat(kind, F.lit(" prefix "), beginning))))


SCAN_SCHEMA = (
    "doc_id long, text_key binary, base array<struct<start:int,kind:string,end:int>>, more array<struct<start:int,kind:string,end:int>>, "
    "near array<struct<entity:string,term:string,start:int,end:int>>, entities array<string>, terms array<string>"
)


def _scan(reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            base, more, near, names, terms = [], [], [], [], []
            for text in rows.text:
                own, beside = entities(text or ""), secrets(text or "")
                found = sorted(own + beside, key=lambda x: x[0]) if beside else own
                for out, places in ((base, own), (more, beside)):
                    out.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in places])
                near.append([dict(zip(("entity", "term", "start", "end"), x, strict=True)) for x in dict.fromkeys(near_terms(text or "", found, reach))] if found else [])
                names.append(sorted({f"{k}:{e}" for _, k, _, e in found}))
                terms.append(sorted({w.lower() for w in WORD.findall(text)}) if found else [])
            keys = [hashlib.md5((t or "").encode()).digest() for t in rows.text]
            yield pd.DataFrame({"doc_id": rows.doc_id.astype("Int64"), "text_key": keys, "base": base, "more": more, "near": near, "entities": names, "terms": terms})
            release()

    return run


def scan(docs: DataFrame, reach: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the entities' places (base kinds, and more) and names, within `reach` words of each the terms, and the terms of texts with entities; written to the shared folder.

    A null text is an empty one and has none of these; repeated rows and null ids each keep their own row; other columns are
    left behind, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return durable(rows.mapInPandas(_scan(reach), SCAN_SCHEMA), "entities")


def _under_classes(rows: DataFrame) -> DataFrame:
    """Rows with (entity, term, ...) in near, one for each name in `classes`, which replaces the entity's."""
    near = rows.withColumn("x", F.explode("near")).drop("near")
    names = near.withColumn("name", F.explode(classes(F.col("x.entity"))))
    return names.select(*(c for c in rows.columns if c != "near"), F.col("name").alias("entity"), "x.term", "x.start", "x.end")


def disclosing(docs: DataFrame, scanned: DataFrame, generalise: float = 0.7, remove: float = 0.9, support: int = 3, text: str = "text") -> DataFrame:
    """entity, term, share and place (removed or general) of the pairs whose term gives the entity, or the class named as entity, away.

    share is PMI over the entity's own information; entities in every document have none to give away. Repeated rows are
    documents of their own, but support asks for different texts. Only the frequencies of terms and pairs that have support are
    needed, so other rows leave the counts before they are shuffled, as far as the pairs are few; the result is the same either
    way. Words are runs of letters, each in lower case; one with letters that only one of Python and Java knows is left out.
    """
    total = scanned.count()
    met = _under_classes(scanned.select("text_key", "near")).select("text_key", "entity", "term").distinct()
    pairs = durable(met.groupBy("entity", "term").agg(F.count("*").alias("texts")).filter(F.col("texts") >= support).select("entity", "term"), "supported")
    few_pairs = pairs.count() <= FEW_NAMES
    # Equal texts have equal entities and terms, so each is taken once, with the number of its rows.
    texts = scanned.filter(F.size("entities") > 0).groupBy("text_key").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = durable(texts, "texts")
    names = F.array_distinct(F.flatten(F.transform("entities", classes)))
    # Each entity of a text with the terms that it is paired with, which are intersected with the text's own: never all of its names by all of its terms.
    paired = pairs.groupBy("entity").agg(F.collect_list("term").alias("paired"))
    named = texts.select("n", "terms", F.explode(names).alias("entity")).join(F.broadcast(paired) if few_pairs else paired, "entity")
    with_entity = named.groupBy("entity").agg(F.sum("n").alias("with_entity"))
    terms = durable(pairs.select("term").distinct(), "terms")
    few = terms.count() <= 1_000_000

    def asked(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(terms) if few else terms, "term", "left_semi")

    words = F.array_distinct(F.transform(F.split(F.col(text), r"[^\p{L}]+"), lambda w: F.lower(w)))
    with_term = asked(docs.select(F.explode(words).alias("term"))).groupBy("term").agg(F.count("*").alias("with_term"))
    together = named.select("entity", "n", F.explode(F.array_intersect("terms", "paired")).alias("term")).groupBy("entity", "term").agg(F.sum("n").alias("together"))
    pmi = F.log2(F.lit(float(total)) * F.col("together") / (F.col("with_entity") * F.col("with_term")))
    own = F.log2(F.lit(float(total)) / F.col("with_entity"))
    share = F.when(own > 0, pmi / own)
    found = together.join(with_entity, "entity").join(with_term, "term").withColumn("share", share).filter(F.col("share") >= generalise)
    return durable(found.select("entity", "term", "share", F.when(F.col("share") >= remove, "removed").otherwise("general").alias("place")), "disclosing")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans(scanned: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, more and terms (arrays of start, kind, end) of every scanned row.

    A place that several entities or classes ask for is one span, removed if any asks for that; equal texts have equal spans.
    """
    few = pairs.count() <= FEW_NAMES
    asked = pairs.select("entity", "term", "place")
    risky = _under_classes(scanned.select("text_key", "near")).join(F.broadcast(asked) if few else asked, ["entity", "term"])
    # A place near two entities, or of several classes, is removed if any asks for it.
    risky = risky.groupBy("text_key", "start", "end").agg(F.max("place").alias("place"))
    risky = risky.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", F.col("place").alias("kind"), "end"))).alias("terms"))
    risky = durable(risky, "risky")
    rows = scanned.select("doc_id", "text_key", "base", "more").join(F.broadcast(risky) if risky.count() <= FEW_NAMES // 2 else risky, "text_key", "left")
    return rows.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,kind:string,end:int>>")))


def _number(kind: str) -> Column:
    return F.size(F.filter("base" if kind in KINDS else "more", lambda s: s["kind"] == kind)).cast("long")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term and n_spans of each row of `spans`.

    Rows are reported one by one, whatever their ids; a row without spans has zeros, the digest of an empty text and an empty
    string. Spans that begin at one place are in the order of the kinds: base kinds, secret, general, removed.
    """
    order = {k: i for i, k in enumerate((*KINDS, *MORE_KINDS, "general", "removed"))}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    every = F.transform(F.concat("base", "more", "terms"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        "doc_id",
        *(_number(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(every)).alias("spans"),
        _number("secret").alias("n_secret"),
        F.size("terms").cast("long").alias("n_term"),
        F.size(every).cast("long").alias("n_spans"),
    )


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is None or not places:
                out.append(text)
                continue
            parts, at = [], 0
            for p in sorted(places, key=lambda p: (p["start"], -p["end"])):
                if p["start"] >= at:
                    parts += [text[at : p["start"]], PLACES[p["kind"]]]
                at = max(at, p["end"])
            out.append("".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])
        release()


def sanitise(docs: DataFrame, reach: int = 8, generalise: float = 0.7, remove: float = 0.9, support: int = 3) -> DataFrame:
    """`docs` with entities replaced by their kind's mark, and disclosing terms by a mark or nothing; n_chars follows the text.

    Null texts stay null and empty ones empty; overlapping spans are replaced as one, by the first's mark; repeated rows are
    changed alike. Rows without personal data stay as they are. Columns other than text and n_chars are carried along.
    """
    scanned = scan(docs, reach)
    found = spans(scanned, disclosing(docs, scanned, generalise, remove, support))
    places = F.concat("base", "more", "terms")
    changed = durable(found.filter(F.size(places) > 0).select("text_key", places.alias("places")).dropDuplicates(["text_key"]), "places")
    # All other columns travel as one struct, so that none of their names can clash with those used here.
    rest = F.struct(*(quoted(c) for c in docs.columns if c != "text"))
    keyed = docs.select(rest.alias("row"), "text", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("text_key"))
    few = changed.count() <= 100_000
    joined = keyed.join(F.broadcast(changed) if few else changed, "text_key", "left").select("row", "text", "places")
    out = joined.mapInArrow(_rewrite, StructType([keyed.schema["row"], StructField("text", StringType())]))
    n_chars = F.coalesce(F.char_length("text"), F.lit(0))
    return out.select(
        *(F.col("text") if c == "text" else n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns),
    )
