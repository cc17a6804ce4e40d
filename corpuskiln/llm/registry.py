"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm import byte_bpe, decontamination, hard_negatives, language_id, lexical, near_duplicates, pii, secret_scan, sharding, token_counts, topk, toxicity, warc
from corpuskiln.sources.tables import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data, and the terms near it that give it away."""
    docs = table(spark, sf_dir, "documents")
    scanned = pii.scan(docs)
    return pii.report(pii.spans(scanned, pii.disclosing(docs, scanned)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark windows found in it."""
    index = decontamination.build_index(table(spark, sf_dir, "documents"))
    return decontamination.report(decontamination.search(index, table(spark, sf_dir, "benchmark")))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every 50th."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the WARC archive written of all pages."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component under links of 0.8 or more over 2-word shingles."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and what they decode to, as digests."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for every benchmark item."""
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every 100th embedding, where every 7th carries the label after its own."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: those of fixed shapes, and strings of high entropy."""
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_topk": op3_topk,
    "op4_sharding": op4_sharding,
    "op5_warc": op5_warc,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scan": op13_secret_scan,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SPACED = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def _places(name: str, pattern: str, group: int = 0) -> str:
    """SQL of `name`: the matches m of a pattern, with their start, their group g and up to 24 characters before them."""
    quoted = pattern.replace("'", "''")
    return f"""
        {name}_f AS (
            SELECT doc_id, regexp_extract_all(t, '{quoted}') AS f, regexp_extract_all(t, '{quoted}', {group}) AS g, string_split_regex(t, '{quoted}') AS gaps
            FROM d WHERE regexp_matches(t, '{quoted}')),
        {name} AS (
            SELECT doc_id, f[i] AS m, g[i] AS g, gaps[i][-24:] AS before,
                   cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS bigint) AS start
            FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM {name}_f))"""


def _hot(k: secret_scan.CharacterClass) -> str:
    """SQL of the hot spans of a character class."""
    symbol = "lower(m)" if k.folded else "m"
    known = " OR ".join(f"regexp_full_match(m, '{p}')" for p in secret_scan.ALLOWED)
    return f"""
        {_places(k.kind + "_c", k.pattern)},
        {k.kind}_w AS (
            SELECT doc_id, start, i, string_split({symbol}[i + 1:i + {k.window}], '') AS w
            FROM (SELECT *, unnest(range(0, length(m) - {k.window} + 1)) AS i FROM {k.kind}_c WHERE NOT ({known} OR regexp_matches(before, '{secret_scan.ALLOWED_AFTER}')))),
        {k.kind}_h AS (
            SELECT doc_id, start, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id, start ORDER BY i), -1000) >= {k.window} AS fresh
            FROM {k.kind}_w
            WHERE list_sum(list_transform(list_distinct(w), lambda c: cast(round(1000000 * len(list_filter(w, lambda x: x = c)) * log2(len(list_filter(w, lambda x: x = c)))) AS bigint))) <= {k.largest_sum}),
        {k.kind}_i AS (SELECT *, sum(cast(fresh AS int)) OVER (PARTITION BY doc_id, start ORDER BY i) AS island FROM {k.kind}_h),
        {k.kind} AS (
            SELECT doc_id, start + min(i) AS a, start + max(i) + {k.window} AS b, '{k.kind}' AS kind
            FROM {k.kind}_i GROUP BY doc_id, start, island)"""


def _secrets() -> str:
    base = ", ".join(_places(kind, pattern, group) for kind, (pattern, group, _) in secret_scan.BASE.items())
    rows = " UNION ALL ".join(f"SELECT doc_id, start AS a, start + length(m) AS b, '{kind}' AS kind, {i} AS r FROM {kind} WHERE length(g) >= {least}" for i, (kind, (_, _, least)) in enumerate(secret_scan.BASE.items()))
    added = " UNION ALL ".join(f"SELECT doc_id, a, b, kind, 3 AS r FROM {k.kind}" for k in secret_scan.CLASSES)
    digest = "string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, r, kind)"
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {base}, {", ".join(map(_hot, secret_scan.CLASSES))},
        s AS ({rows} UNION ALL {added}),
        g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE)}, count(*) FILTER (r = 3) AS n_entropy,
                     {digest} FILTER (r < 3) AS base, {digest} AS spans FROM s GROUP BY doc_id)
        SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
        FROM d LEFT JOIN g USING (doc_id)"""


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES = {
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
                   list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS double)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, cast(list_dot_product(a.v, c.v) AS bigint) AS score
            FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
        n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
            WHERE p.nth <= 5)
        SELECT anchor_id, positive_id, cast(rank AS integer) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM documents),
        b AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM benchmark),
        c AS (SELECT count(*) AS n, cast(sum(len(w)) AS bigint) AS l FROM d WHERE len(w) > 0),
        t AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x),
        asked AS (SELECT DISTINCT q, x FROM (SELECT q, unnest(w) AS x FROM b)),
        v AS (SELECT x, cast(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS bigint) AS weight FROM t, c WHERE x IN (SELECT x FROM asked) GROUP BY x),
        m AS (SELECT r, 100 - 50 + ((50 * len(w) * n) // l) AS m FROM d, c WHERE len(w) > 0),
        s AS (
            SELECT q, r, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS bigint) AS score
            FROM asked JOIN v USING (x) JOIN t USING (x) JOIN m USING (r) GROUP BY q, r),
        o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) JOIN b USING (q) WHERE score > 0)
        SELECT item_id, cast(rank AS integer) AS rank, doc_id, score FROM o WHERE rank <= 50""",
    "op13_secret_scan": _secrets(),
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS double)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.v, c.v) AS bigint) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT h, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY 1)
        SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
               CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> m THEN m END AS refers_to
        FROM p LEFT JOIN m ON p.h = m.h AND n >= 1000""",
    "op9_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        inter AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
        m AS (SELECT doc_id, min(other) AS m FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, coalesce(m.m, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM win),
        runs AS (
            SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
        m AS (SELECT DISTINCT doc_id, item, runs.size, i FROM runs JOIN win ON runs.key = win.key AND runs.size = win.size),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1),
        s AS (SELECT doc_id, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY 1)
        SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)""",
}
