"""Queries on records: defects, runs, gates, merges and matches. The star-schema tables stand in for logs and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import text as T
from corpuskiln.operators import matching, records
from corpuskiln.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 events."""
    return records.recent(_events(spark, sf_dir), "event_id", 50).select("event_id", "user_id", "event_type")


def defect_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of the last 200 events' users each event type occurs, and in which."""
    rows = _events(spark, sf_dir)
    found = records.recurrence(rows, records.recent(rows, "event_id", 200), "event_type", "user_id", "event_id")
    return found.select("event_type", "n_runs", F.array_join("runs", ",").alias("runs"))


def repeat_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of three or more of those users as candidates."""
    rows = _events(spark, sf_dir)
    found = records.recurrence(rows, records.recent(rows, "event_id", 200), "event_type", "user_id", "event_id")
    severity = F.when(F.col("event_type") == "error", "fail").otherwise("warn")
    return records.promote(found, "event_type", "code_improvement", severity)


def ratchet_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean lengths by source of the documents with odd ids against those of the documents with even ids."""
    docs = table(spark, sf_dir, "documents")

    def means(part: int) -> DataFrame:
        return docs.filter(F.col("doc_id") % 2 == part).groupBy("source").agg(F.round(F.avg("n_chars"), 2).alias("score"))

    return records.gate(means(1), means(0), "source", "score")


def macro_f1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 of a rule for quality: at least 200 characters and no shouting."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when((F.char_length("text") >= 200) & ~F.contains("text", F.lit("!!")), 1).otherwise(0).alias("said"))
    return records.macro_f1(docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").cast("int").alias("quality"), "said"), "quality", "said")


def dominant_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's most frequent source."""
    return records.dominant(table(spark, sf_dir, "documents"), ["lang"], "source", "doc_id")


def merge_first_wins_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order status as a field that several orders state."""
    orders = table(spark, sf_dir, "orders").withColumn("field", F.lit("status"))
    merged = records.merge_sources(orders, "o_custkey", "field", "o_orderstatus", "o_orderkey", "o_orderkey", T.value_key(F.col("o_orderstatus")))
    return merged.select("o_custkey", "value", "n_values", "n_sources", F.array_join("candidates", ",").alias("candidates"), "confidence")


def section_material_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as materials and their brands as sections with all categories, by shared type or name token."""
    part = table(spark, sf_dir, "part")
    # The distinct words of a brand, before they meet in one row.
    word = F.explode(F.concat(F.array(F.struct(F.lit(True).alias("category"), F.col("p_type").alias("word"))), F.transform(T.tokens(F.col("p_name")), lambda t: F.struct(F.lit(False).alias("category"), t.alias("word")))))
    words = part.select(F.col("p_brand").alias("section_id"), word.alias("x")).select("section_id", "x.*").distinct()
    sections = words.groupBy("section_id").agg(*(F.collect_list(F.when(c, F.col("word"))).alias(n) for n, c in (("categories", F.col("category")), ("tokens", ~F.col("category")))))
    none = F.array().cast("array<string>")
    materials = part.select(F.col("p_partkey").alias("material_id"), F.when(F.col("p_retailprice") > 1000, F.array("p_type")).otherwise(none).alias("categories"), T.tokens(F.col("p_name")).alias("tokens"))
    return matching.section_materials(sections, materials)


def requirement_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a balance who have no finished order."""
    wanted = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("required"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return matching.missing_requirements(wanted, done, ["c_custkey"]).select("c_custkey")


def jaccard_field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as targets against names and brands as sources, with a small cluster table."""
    part = table(spark, sf_dir, "part")

    def labels(column: str) -> DataFrame:
        key = T.normal_label(F.col(column))
        return part.select(key.alias("key"), F.when(key.startswith("brand"), F.substring(key, 1, 6)).alias("cluster")).distinct()

    found = matching.match_labels(labels("p_type"), labels("p_name").unionByName(labels("p_brand")).distinct())
    return found.select("target", "source", "confidence", F.array_join("candidates", ",").alias("candidates"))


def snippet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 benchmark items that share most tokens with each user turn."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), T.tokens(F.col("text")).alias("tokens"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("snippet_id"), T.tokens(F.col("text")).alias("tokens"))
    return matching.top_snippets(asked, items).select("question_id.conv_id", "question_id.turn", "rank", "snippet_id", "score")


def grid_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a grid for each nation: a wide cell in every row, one too wide and one missing in some."""
    nation = table(spark, sf_dir, "nation")
    tables = nation.select(F.col("n_nationkey").alias("grid_id"), F.lit(3).alias("n_rows"), F.lit(4).alias("n_cols"))
    cell = F.explode(F.sequence(F.lit(0), F.lit(2)))
    left = nation.select(F.col("n_nationkey").alias("grid_id"), cell.alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(2).alias("col_span"))
    right = left.filter((F.col("grid_id") + F.col("row")) % 5 != 0).select("grid_id", "row", F.lit(2).alias("col"), "row_span", F.when(F.col("grid_id") % 7 == 0, 3).otherwise(2).alias("col_span"))
    return records.tiling(left.unionByName(right), tables)


QUERIES = {
    f.__name__: f
    for f in (
        recent_runs,
        defect_recurrence,
        repeat_promotion,
        ratchet_gate,
        macro_f1_quality,
        dominant_source,
        merge_first_wins_conflicts,
        section_material_match,
        requirement_missing,
        jaccard_field_match,
        snippet_topk,
        grid_tiling,
    )
}

_RECENT = "(SELECT * FROM events ORDER BY event_id DESC LIMIT 200)"
_MET = f"(SELECT event_type, user_id, min(event_id) AS first FROM events WHERE user_id IN (SELECT user_id FROM {_RECENT}) GROUP BY 1, 2)"
_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[가-힣a-z0-9]{{2,}}'))"
_KEY = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"

ORACLES = {
    "recent_runs": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
    "defect_recurrence": f"SELECT event_type, count(*) AS n_runs, string_agg(user_id, ',' ORDER BY first) AS runs FROM {_MET} GROUP BY 1",
    "repeat_promotion": f"""
        SELECT event_type, count(*) AS n_runs, sha1(event_type || ':code_improvement')[1:12] AS candidate_id,
               CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS priority FROM {_MET} GROUP BY 1 HAVING count(*) >= 3""",
    "ratchet_gate": """
        WITH m AS (SELECT source, doc_id % 2 AS part, round(avg(n_chars), 2) AS score FROM documents GROUP BY 1, 2),
        b AS (SELECT source, max(CASE WHEN part = 0 THEN score END) AS was, max(CASE WHEN part = 1 THEN score END) AS now FROM m GROUP BY 1)
        SELECT source, was, now, CASE WHEN was IS NULL THEN 'SEED' WHEN now IS NULL THEN 'DROPPED' WHEN now < was - 1e-9 THEN 'FAIL' WHEN now > was + 1e-9 THEN 'IMPROVED' ELSE 'OK' END AS status FROM b""",
    "macro_f1_quality": """
        WITH x AS (SELECT quality, CASE WHEN length(text) >= 200 AND NOT contains(text, '!!') THEN 1 ELSE 0 END AS said FROM documents JOIN labels USING (doc_id)),
        l AS (SELECT quality AS label FROM x UNION SELECT said FROM x),
        f AS (SELECT label, (SELECT count(*) FROM x WHERE quality = label AND said = label) AS tp, (SELECT count(*) FROM x WHERE quality = label) AS t, (SELECT count(*) FROM x WHERE said = label) AS s FROM l)
        SELECT round(avg(2 * tp / (t + s)), 9) AS macro_f1, count(*) AS n_labels FROM f""",
    "dominant_source": """
        SELECT lang, source, n FROM (
            SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min(doc_id)) AS nth FROM documents WHERE source IS NOT NULL GROUP BY 1, 2) WHERE nth = 1""",
    "merge_first_wins_conflicts": """
        SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS value, count(DISTINCT lower(o_orderstatus)) AS n_values, count(DISTINCT o_orderkey) AS n_sources,
               array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS candidates,
               CASE WHEN count(DISTINCT lower(o_orderstatus)) > 1 THEN 'conflict' WHEN count(DISTINCT o_orderkey) > 1 THEN 'high' ELSE 'medium' END AS confidence
        FROM orders WHERE trim(coalesce(o_orderstatus, '')) <> '' GROUP BY 1""",
    "section_material_match": f"""
        WITH s AS (SELECT p_brand AS section_id, list(DISTINCT p_type) AS categories, list_distinct(flatten(list({_TOKENS.format("p_name")}))) AS tokens FROM part GROUP BY 1),
        m AS (SELECT p_partkey AS material_id, CASE WHEN p_retailprice > 1000 THEN p_type END AS category, {_TOKENS.format("p_name")} AS tokens FROM part)
        SELECT section_id, material_id FROM s, m WHERE list_contains(s.categories, m.category) OR (m.category IS NULL AND len(list_intersect(s.tokens, m.tokens)) > 0)""",
    "requirement_missing": "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "jaccard_field_match": rf"""
        WITH t AS (SELECT DISTINCT {_KEY.format("p_type")} AS target FROM part),
        s AS (SELECT DISTINCT {_KEY.format("p_name")} AS source FROM part UNION SELECT DISTINCT {_KEY.format("p_brand")} FROM part),
        p AS (
            SELECT target, source, len(list_intersect(a, b)) AS n_both, len(a) AS na, len(b) AS nb
            FROM (SELECT target, source, list_distinct(string_split(target, '')) AS a, list_distinct(string_split(source, '')) AS b FROM t, s) WHERE len(list_intersect(a, b)) > 0),
        j AS (
            SELECT target, source, round(n_both / (na + nb - n_both), 9) AS sim FROM p
            WHERE round(n_both / (na + nb - n_both), 9) >= 0.6 OR ((contains(target, source) OR contains(source, target)) AND abs(length(target) - length(source)) <= 2)),
        n AS (SELECT target, list_sort(list(source)) AS near FROM (SELECT *, max(sim) OVER (PARTITION BY target) AS best FROM j) WHERE sim = best GROUP BY 1)
        SELECT target, e.source, CASE WHEN e.source IS NOT NULL THEN 'high' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'low' END AS confidence,
               CASE WHEN e.source IS NOT NULL THEN '' ELSE coalesce(array_to_string(near, ','), '') END AS candidates
        FROM t LEFT JOIN s e ON e.source = target LEFT JOIN n USING (target)""",
    "snippet_topk": f"""
        WITH q AS (SELECT conv_id, turn, unnest({_TOKENS.format("text")}) AS t FROM conversations WHERE role = 'user'),
        b AS (SELECT item_id AS snippet_id, unnest({_TOKENS.format("text")}) AS t FROM benchmark),
        s AS (SELECT conv_id, turn, snippet_id, 2.0::double * count(*) AS score FROM q JOIN b USING (t) GROUP BY 1, 2, 3)
        SELECT conv_id, turn, cast(rank AS integer) AS rank, snippet_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, snippet_id) AS rank FROM s) WHERE rank <= 4""",
    "grid_tiling": """
        WITH l AS (SELECT n_nationkey AS g, unnest(range(3)) AS r FROM nation),
        c AS (SELECT g, r, unnest(range(2)) AS c FROM l UNION ALL SELECT g, r, 2 + unnest(range(CASE WHEN g % 7 = 0 THEN 3 ELSE 2 END)) AS c FROM l WHERE (g + r) % 5 <> 0),
        n AS (SELECT g, r, c, count(*) AS n FROM c GROUP BY 1, 2, 3),
        w AS (SELECT g, r, unnest(range(4)) AS c, true AS inside FROM l)
        SELECT * FROM (
            SELECT coalesce(n.g, w.g) AS grid_id, cast(coalesce(n.r, w.r) AS integer) AS r, cast(coalesce(n.c, w.c) AS integer) AS c, coalesce(n, 0) AS n,
                   CASE WHEN inside IS NULL THEN 'out_of_bounds' WHEN n IS NULL THEN 'gap' WHEN n > 1 THEN 'overlap' END AS fault
            FROM n FULL JOIN w ON n.g = w.g AND n.r = w.r AND n.c = w.c) WHERE fault IS NOT NULL""",
}
