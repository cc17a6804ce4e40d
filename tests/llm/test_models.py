"""Language identification and toxicity: held-out accuracy and odd rows."""

from __future__ import annotations

import math
import zlib

import numpy as np

from corpuskiln.llm import language_id, registry, toxicity


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op6_language_id(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and langs[r.doc_id][0] is not None and any(c.isalpha() for c in langs[r.doc_id][1] or "")]
    assert sum(r.lang_pred == langs[r.doc_id][0] for r in known) >= 0.97 * len(known)


def test_unseen_words_fall_back_to_shorter_n_grams(spark):
    counts = spark.createDataFrame([("de", "haus", 5), ("en", "house", 5), ("de", "maus", 2)], "lang string, word string, n long")
    model = language_id.model_of(counts, ["de", "en"])
    tail, rare, foreign = model.unseen(["haustier", "zzo", "한"])
    assert tail[0] > tail[1]
    assert rare[1] > rare[0]
    assert (foreign == 0).all() or foreign.shape == (2,)


def test_n_grams_of_whole_runs(spark, monkeypatch):
    run = "".join(chr(97 + (i * i) % 23) for i in range(300))
    word = "a" * 70 + "qqqq" + run
    model = language_id.model_of(spark.createDataFrame([("de", word, 1), ("en", "a" * 70 + "zzzz", 1)], "lang string, word string, n long"), ["de", "en"])
    for n in range(1, 5):
        expected = {w[i : i + n] for w in (f"<{word}>", f"<{'a' * 70}zzzz>") for i in range(len(w) - n + 1)}
        assert set(model.ngrams[n - 1].terms.terms.to_pylist()) == expected
    words = ["a" * 70 + run + "q", "a" * 90 + "zzzz"]
    whole = model.unseen(words)
    assert whole[0, 0] > whole[0, 1] and whole[1, 1] > whole[1, 0]
    monkeypatch.setattr(language_id, "GRAMS", 7)
    assert np.allclose(model.unseen(words), whole)


def test_small_languages_are_learned_whole_beside_large_ones(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAINING_DOCS", 20)
    large = [(i, f"house mouse garden{i % 7}", "en") for i in range(20_000)]
    small = [(100_000 + i, f"haus maus wort{chr(97 + i)}", "de") for i in range(12)]
    empty = [(200_000, "12 34", "xx")]
    docs = spark.createDataFrame(large + small + empty, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"]
    learned = {f"wort{chr(97 + i)}" for i in range(12) if zlib.crc32(str(100_000 + i).encode()) % 5}
    assert learned <= {w.decode() for w in model.words.terms.terms.to_pylist()}
    assert {r.lang_pred for r in language_id.predict(docs.filter("lang = 'de'"), model).collect()} == {"de"}


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == 12
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    kept = language_id.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert language_id.predict(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values = np.array(scores)[order]
    for v in np.unique(values):
        at = np.flatnonzero(values == v)
        ranks[order[at]] = at.mean() + 1
    labels = np.array(labels, bool)
    p, n = labels.sum(), (~labels).sum()
    return (ranks[labels].sum() - p * (p + 1) / 2) / (p * n)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.op7_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    # Some labelled texts hold nothing but repeated words, and a few labels are chance: no text tells those.
    assert auc([r.score for r in known], [labels[r.doc_id] for r in known]) >= 0.95
    said = [r for r in known if r.predicted]
    right = sum(labels[r.doc_id] for r in said)
    assert right >= 0.9 * len(said) and right >= 0.8 * sum(labels[r.doc_id] for r in known)


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < right, np.where(truth, 1, -1), np.where(truth, -1, 1)) for right in (0.9, 0.85, 0.8, 0.55)], 1)
    post = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == truth).mean() > 0.9


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (8, 0), (1, 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels.limit(0))).count() == 0


def test_column_names_of_any_form_are_carried(spark):
    docs = spark.createDataFrame([(i, w, l) for i, (w, l) in enumerate([("haus maus", "de"), ("house mouse", "en")] * 20)], "doc_id long, text string, lang string")
    odd = docs.selectExpr("*", "1 AS `my col`", "2 AS `a-b`", "3 AS `a.b`", "4 AS row")
    kept = language_id.keep_identified(odd, language_id.fit(docs))
    assert kept.columns == odd.columns and kept.count() == 40


def test_language_equals_a_plain_backoff(spark):
    import math
    import re
    from collections import Counter, defaultdict

    texts = [("das haus und die maus", "de"), ("der hund und das haus", "de"), ("the house and the mouse", "en"), ("a dog and a house", "en"), ("la maison et le chien", "fr")]
    docs = [(i, t, lang) for i, (t, lang) in enumerate(texts * 8)]
    asked = ["haus maus", "mousetrap housing", "hundehaus", "le chien", "zzz", "12", "house haus maison"]
    fitted = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 5]
    words, grams, langs = defaultdict(Counter), [defaultdict(Counter) for _ in range(4)], ["de", "en", "fr"]
    for t, lang in fitted:
        for w in re.findall("[a-z]+", t):
            words[lang][w] += 1
    for lang in langs:
        for w, n in words[lang].items():
            for size in range(1, 5):
                for i in range(len(w) + 3 - size):
                    grams[size - 1][lang][f"<{w}>"[i : i + size]] += n

    def logs(table):
        known = {k for c in table.values() for k in c}
        totals = {lang: sum(table[lang][k] + 0.1 for k in known) for lang in langs}
        return {k: [math.log((table[lang][k] + 0.1) / totals[lang]) for lang in langs] for k in known}

    by_word, by_gram = logs(words), [logs(g) for g in grams]

    def score(w):
        if w in by_word:
            return by_word[w]
        for size in range(4, 0, -1):
            found = [by_gram[size - 1][g] for g in (f"<{w}>"[i : i + size] for i in range(len(w) + 3 - size)) if g in by_gram[size - 1]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * 3

    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    rows = language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    for r in rows:
        sums = [sum(x) for x in zip(*map(score, re.findall("[a-z]+", asked[r.doc_id])), strict=True)] or None
        if sums is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == langs[sums.index(max(sums))]
            assert abs(r.score - 1 / sum(math.exp(x - max(sums)) for x in sums)) < 1e-4


def test_toxicity_equals_plain_features(spark):
    import math
    import re

    rng = np.random.default_rng(4)
    common, bad = [f"word{c}" for c in "abcdefghij"], ["grobian", "stinkt", "idiot"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        own = list(rng.choice(common, 12)) + (list(rng.choice(bad, 3)) if toxic else [])
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"grobian", "stinkt"} <= set(model.terms)
    asked = [*docs[:20], (1000, "you idiot!!! grobian"), (1001, ""), (1002, None)]
    for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect():
        text = dict(asked)[r.doc_id] or ""
        words = re.findall("[a-z]+", text)
        counts = {t: n for t in model.terms if (n := sum(t in toxicity.terms_of(w) for w in words))}
        insults = max(sum(w in lexicon.split() for w in words) for lexicon in toxicity.LEXICONS.values())
        addressed = sum(m[1].lower() in toxicity.INSULTS for m in toxicity.ADDRESS.finditer(text))
        sums = [math.log1p(insults), math.log1p(addressed if insults else 0), *(math.log1p(len(list(p.finditer(text)))) for p in toxicity.PATTERNS.values())]
        for kind in (True, False):
            held = [n for t, n in counts.items() if t.endswith("*") == kind]
            sums += [math.log1p(sum(held)), math.log1p(len(held)), min(1.0, 20 * sum(held) / max(len(words), 1))]
        z = model.bias + sum(model.weights[model.terms[t]] * math.log1p(n) for t, n in counts.items()) + sum(w * x for w, x in zip(model.weights[len(model.terms) :], sums, strict=True))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_label_model_equals_a_plain_one():
    rng = np.random.default_rng(8)
    truth = rng.random(300) < 0.3
    table = np.stack([np.where(rng.random(300) < p, np.where(truth, 1, -1), 0) for p in (0.9, 0.6, 0.3, 0.8)], 1)
    table[:, 3] = table[:, 0]
    n, voters = table.shape
    post = [0.9 if sum(row) > 0 else 0.1 * 0.3 for row in table.tolist()]
    for _ in range(100):
        chance = {}
        for c in (1, 0):
            mass = [p if c else 1 - p for p in post]
            for v in range(voters):
                for vote in (1, -1, 0):
                    chance[c, v, vote] = (sum(m for m, row in zip(mass, table) if row[v] == vote) + 0.5) / (sum(mass) + 1.5)
        mean = lambda c, v: chance[c, v, 1] - chance[c, v, -1]
        spread = [[row[v] - p * mean(1, v) - (1 - p) * mean(0, v) for v in range(voters)] for p, row in zip(post, table.tolist())]
        cov = [[sum(s[v] * s[w] for s in spread) / n for w in range(voters)] for v in range(voters)]
        sd = [math.sqrt(max(cov[v][v], 1e-9)) for v in range(voters)]
        weight = [1 / max(1, math.sqrt(sum(abs(cov[w][v]) / (sd[v] * sd[w]) for w in range(voters)))) for v in range(voters)]
        logits = [sum(weight[v] * math.log(chance[1, v, row[v]] / chance[0, v, row[v]]) for v in range(voters)) + math.log(0.3 / 0.7) for row in table.tolist()]
        new = [1 / (1 + math.exp(-max(-30, min(x, 30)))) for x in logits]
        moved, post = max(abs(a - b) for a, b in zip(new, post)), new
        if moved < 1e-6:
            break
    assert np.allclose(toxicity.label_model(table, 0.3), post, atol=1e-6)


def test_equal_texts_are_toxic_if_any_is(spark):
    texts = [f"word{i % 7} {'shadow grumpel' if i % 3 == 0 else 'common'} line {i % 40}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    # The same text under other ids, not toxic there, changes nothing, in whatever order the rows come.
    more = docs.unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "text"))
    clean = labels.unionByName(labels.selectExpr("doc_id + 1000 AS doc_id", "0 AS toxic"))
    asked = [toxicity.score(docs, toxicity.fit(d, y)).orderBy("doc_id").collect() for d, y in ((more, clean), (more.orderBy("doc_id", ascending=False).repartition(5), clean))]
    assert [r.score for r in asked[0]] == [r.score for r in asked[1]]
