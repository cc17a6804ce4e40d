"""Personal data against the plain patterns, and what discloses it."""

from __future__ import annotations

import hashlib
import math
import random
import re

from corpuskiln.llm import pii, registry

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> list[tuple[int, str, int]]:
    found = [(m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if sound(k, m.group())]
    return [(a, list(PATTERNS)[k], b) for a, k, b in sorted(found)]


def digest(found) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def test_random_texts():
    rng = random.Random(5)
    parts = ["a", "Z9", "@", ".", "-", "+", " ", "4111111111111111", "1", "255", "256", "10.0.0.1", "(", ")", "%", "x@y.z", "+49 30 1234567", "00", "\n", "é", "1234-5678"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [(a, k, b) for a, k, b, _ in pii.entities(text)] == brute(text), text


def test_query_has_the_plain_matches_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op1_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(found)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in found) for kind in PATTERNS]
        shown = r.spans.split(",") if r.spans else []
        assert [x for x in shown if x.split(":")[0] in PATTERNS] == [f"{k}:{a}:{b}" for a, k, b in found]


def test_disclosing_terms_are_removed_or_made_general_and_others_stay(spark):
    told = [(i, f"report {i} by Quentin write to q@example.org today", "en", "s", 1) for i in range(4)]
    other = [(100 + i, f"report {i} by someone who writes today and then number {i}", "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(told + other, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(out) == 64
    for i, text, *_ in told:
        assert "example" not in out[i].text and "Quentin" not in out[i].text and "[EMAIL]" in out[i].text
        assert out[i].n_chars == len(out[i].text)
    assert all(out[i].text == text for i, text, *_ in other)


def test_classes_of_entities_seen_once_give_an_estimate(spark):
    once = {"email": [f"user{i}@corp.example.org" for i in range(4)], "ip": [f"10.20.{i}.1" for i in range(4)], "phone": [f"+1 (212) 555-010{i}" for i in range(4)]}
    word = {"email": "Quentin", "ip": "Gateway", "phone": "Hotline"}
    told = [(100 * n + i, f"report {i} {word[k]} {e} today") for n, (k, es) in enumerate(once.items()) for i, e in enumerate(es)]
    other = [(1000 + i, f"report {i % 4} today number {i}") for i in range(60)]
    docs = spark.createDataFrame(told + other, "doc_id long, text string")
    pairs = pii.disclosing(docs, pii.scan(docs)).collect()
    assert {(r.entity, r.term, r.place) for r in pairs} >= {("email@corp.example.org", "quentin", "removed"), ("ip prefix 10.20", "gateway", "removed"), ("phone prefix 1212", "hotline", "removed")}
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(w in t for t in out.values() for w in word.values())
    assert all(out[i] == text for i, text in other)
    rare = spark.createDataFrame(told[:2] + other, "doc_id long, text string")
    assert pii.disclosing(rare, pii.scan(rare)).count() == 0


def test_copies_of_one_text_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "hello Quentin q@example.org") for i in range(9)] + [(100 + i, f"nothing {i} here") for i in range(40)], "doc_id long, text string")
    scanned = pii.scan(docs)
    assert pii.disclosing(docs, scanned).count() == 0


def test_odd_rows_keep_their_columns(odd_docs, no_docs):
    out = pii.sanitise(odd_docs)
    assert out.columns == odd_docs.columns
    kept, was = [r for r in out.collect()], odd_docs.collect()
    assert len(kept) == len(was)
    assert sorted(str(r.places) for r in kept) == sorted(str(r.places) for r in was)
    assert sorted(str(r.text_key) for r in kept) == sorted(str(r.text_key) for r in was)
    mine = next(r for r in kept if r.doc_id == -9)
    assert mine.text == "mail [EMAIL] or [PHONE] at [IP]"
    assert pii.sanitise(no_docs).count() == 0
    assert pii.report(pii.spans(pii.scan(no_docs), pii.disclosing(no_docs, pii.scan(no_docs)))).count() == 0
    assert pii.report(pii.spans(pii.scan(odd_docs), pii.disclosing(odd_docs, pii.scan(odd_docs)))).count() == 12


def test_counts_are_of_the_same_words_and_documents(spark):
    rows = [(i, f"heute m²x steht {'a' + str(i) + '@b.example' if i < 4 else 'hier'} dabei") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.disclosing(docs, pii.scan(docs)).filter("term in ('m', 'x', 'heute', 'm²x', 'steht', 'dabei')").count() == 0
    assert sum("m²x" in r.text for r in pii.sanitise(docs).collect()) == 64


def test_shares_equal_a_plain_count(spark):
    import math
    from itertools import product

    rng = random.Random(11)
    words = [f"{a}{b}" for a, b in product("kt", "aeiou")]
    rows = [(i, " ".join(rng.choices(words, k=6) + ([f"Quentin p{i % 3}@one.example"] if i % 5 == 0 else []) + rng.choices(words, k=20))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.entity, r.term): r.share for r in pii.disclosing(docs, pii.scan(docs), generalise=-99).collect()}
    held = {i: set(re.findall("[a-z]+", t.lower())) for i, t in rows}
    assert found
    for (entity, term), share in found.items():
        mine = {i for i, t in rows if {"email": "@", "email@one.example": "@one.example", "email local p": " p"}.get(entity, entity.partition(":")[2]) in t}
        both = sum(term in held[i] for i in mine)
        pmi = math.log2(150 * both / (len(mine) * sum(term in h for h in held.values())))
        assert abs(share - pmi / math.log2(150 / len(mine))) < 1e-9, (entity, term)
    assert ("email", "quentin") in found


def test_secrets_are_spans_of_their_own_and_replaced(spark):
    rows = [(1, 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" ok'), (2, "the token of thanks, password: please"), (3, "key sk-" + "a1" * 12 + " end"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `my col`", "2 AS `a-b`", "3 AS `a.b`")
    scanned = pii.scan(docs)
    out = {r.doc_id: r for r in pii.report(pii.spans(scanned, pii.disclosing(docs, scanned))).collect()}
    assert [out[i].n_secret for i in (1, 2, 3, 4)] == [1, 0, 1, 0] and out[1].spans == "secret:9:49" and all(r.base_sha256 == digest([]) for r in out.values())
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {1: 'token = "[SECRET]" ok', 2: rows[1][1], 3: "key [SECRET] end", 4: None}


def test_names_of_secrets_are_no_terms(spark):
    docs = spark.createDataFrame([(i, f'report {i} token = "{i:08d}0b96a8c8d79c4a5085c919698889f59b" ok', "en", "s", 1) for i in range(6)] + [(100 + i, f"plain report {i}", "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pii.disclosing(docs, pii.scan(docs)).filter("term = 'token'").count() == 0


def test_the_search_for_secrets_is_skipped_only_without_any():
    rng = random.Random(9)
    parts = ["Token", "API_KEY", "access-key", "x_auth", "passwd", "PassWord", "=", ":", " ", '"', "a1b2c3d4e5", "sk-", "ghp_", "AKIA", "xoxb-", "A1" * 20, "eyJ", ".", "-----BEGIN PRIVATE KEY-----", "secret"]
    found = 0
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        expected = [(m.start(m.lastgroup), m.end(m.lastgroup)) for m in pii.SECRET.finditer(text)]
        assert [(a, b) for a, _, b, _ in pii.secrets(text)] == expected
        found += len(expected)
    assert found > 500


def test_counts_of_disclosure_equal_a_plain_count(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = rng.choices(["alpha", "beta", "gamma", "delta"], k=6)
        if rng.random() < 0.5:
            words.insert(rng.randint(0, 6), rng.choice(["a.b@example.org", "c@example.org", "10.0.0.1", "10.0.0.2"]))
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(200 + i, rows[3][1], "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shares = {(r.entity, r.term): r.share for r in pii.disclosing(docs, pii.scan(docs), generalise=-100.0).collect()}
    assert len(shares) > 20
    names = {"a.b@example.org": {"email:a.b@example.org", "email", "email@example.org", "email local a", "email local b"}, "c@example.org": {"email:c@example.org", "email", "email@example.org", "email local c"}, "10.0.0.1": {"ip:10.0.0.1", "ip", "ip prefix 10.0"}, "10.0.0.2": {"ip:10.0.0.2", "ip", "ip prefix 10.0"}}
    held = [(set().union(*(names[w] for w in t.split() if w in names)), set(w for w in t.split() if w not in names)) for _, t, *_ in rows]
    for (entity, term), share in shares.items():
        e, t, both = (sum(1 for x in held if ok(x)) for ok in (lambda x: entity in x[0], lambda x: term in x[1], lambda x: entity in x[0] and term in x[1]))
        assert abs(share - math.log2(len(rows) * both / (e * t)) / math.log2(len(rows) / e)) < 1e-9
