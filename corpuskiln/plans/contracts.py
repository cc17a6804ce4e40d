"""Queries on contracts, profiles, cards and differences of forms; the driver's tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.operators import alignment, contracts, lines, tables
from corpuskiln.sources.tables import spread, table


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a bundle, orders as facts and conflicts, ordered parts as evidence: what breaks the contract."""
    orders = table(spark, sf_dir, "orders").withColumn("pos", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    own = orders.select(F.col("o_custkey").alias("bundle"), "pos", "o_orderkey", "o_orderstatus", "o_orderpriority")
    fact_id = F.when(F.col("o_orderkey") % 17 == 0, " \t").otherwise(F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")))
    states = F.when(F.col("o_orderstatus") == "F", "actual").when(F.col("o_orderstatus") == "O", "Not Applicable").otherwise("perhaps")
    facts = own.select("bundle", "pos", fact_id.alias("fact_id"), states.alias("semantic_state"), F.when(F.col("o_orderkey") % 3 == 0, "internal-conflict").alias("verification_state"))
    evidence_id = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "f").otherwise("e"), (F.col("o_orderkey") % 40).cast("string"))
    evidence = own.filter("o_orderkey % 2 = 0").select("bundle", "pos", evidence_id.alias("evidence_id"), F.lit(None).cast("string").alias("semantic_state"), F.col("o_orderpriority").alias("verification_state"))
    candidates = F.array(*(F.concat(F.lit("f"), ((F.col("o_orderkey") + n) % 50).cast("string")) for n in (0, 7)), F.lit(" "))
    conflicts = own.filter("o_orderkey % 5 = 0").select("bundle", "pos", F.concat(F.lit("c"), (F.col("o_orderkey") % 10).cast("string")).alias("conflict_id"), candidates.alias("candidate_fact_ids"))
    return contracts.contract_issues(facts, evidence, conflicts)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    some = lambda c, v: F.when(c, v)
    amount = lambda n, unit: F.concat((k % n).cast("string"), F.lit(unit))
    given = k % 11 != 0
    ceo = some(k % 3 == 0, F.struct(F.when(k % 9 == 0, "").otherwise("n").alias("name"), some(k % 2 == 0, F.array(F.lit("a"), F.lit(""))).alias("career")))
    raw = F.to_json(F.struct(
        some(k % 5 != 0, F.col("c_name")).alias("company_name"),
        some(k % 7 == 0, F.lit("")).alias("name"),
        some(k % 2 == 0, F.lit("r")).alias("representative"),
        ceo.alias("ceo"),
        some(k % 4 != 0, F.col("c_mktsegment")).alias("item_name"),
        some(k % 6 == 0, F.struct(F.struct(amount(20, "억원").alias("value")).alias("tam"))).alias("market"),
        some(given, amount(20, "억원")).alias("tam"),
        some(given, amount(13, "억")).alias("sam"),
        amount(7, "억").alias("som"),
        F.struct(F.lit("1,000").alias("total"), (k % 900).alias("government"), (F.lit(1000) - k % 900 + (k % 2) * 100).alias("self")).alias("budget"),
        some(k % 8 != 0, F.struct(F.lit("x").alias("current"))).alias("team"),
    ))
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return customers.select("c_custkey", contracts.profile(contracts.raw_values(raw)).alias("profile"))


def profile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a company's profile: the rules that it breaks."""
    return contracts.profile_issues(_profiles(spark, sf_dir), "c_custkey")


def profile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules of each level each profile breaks, and whether it passes."""
    found = _profiles(spark, sf_dir)
    return contracts.issue_summary(found, contracts.profile_issues(found, "c_custkey"), "c_custkey")


def content_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as contents, its turns as sections and cells: what is wrong with them."""
    turns = table(spark, sf_dir, "conversations").withColumn("keyword", F.concat_ws(" ", "role", "turn"))
    found = F.filter(F.split("text", "\n"), lambda x: x.contains("e."))
    sections = turns.filter("conv_id % 5 <> 0").select("conv_id", "keyword", found.alias("lines"))
    cells = turns.filter("conv_id % 7 <> 0").select("conv_id", F.col("turn").alias("place"), F.when(F.col("turn") % 3 == 1, "　\t").otherwise(F.col("text")).alias("text"))
    limits = turns.select("conv_id", "keyword", (F.col("turn") * 100).alias("char_limit"))
    return contracts.content_issues(sections, cells, limits, "conv_id")


def vertical_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items as the rows of a form, in which flags and states are labels: the cards among them."""
    order = W.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    third = F.when(F.col("l_discount") < 0.03, " ").when(F.col("l_quantity") % 3 == 0, "T").otherwise(F.col("l_quantity").cast("int").cast("string"))
    fourth = F.when(F.col("l_tax") < 0.05, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    # Named before the window, so that its rows lie by document for all that follows.
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    rows = items.select("doc_id", F.lit(0).alias("table"), F.row_number().over(order).alias("row"), F.concat(F.array("l_returnflag", "l_linestatus", third), fourth).alias("cells"))
    synonyms = spark.createDataFrame([("A", "flag"), ("R", "flag"), ("F", "status"), ("T", "third")], "alias string, cluster string")
    return tables.vertical_cards(rows.select("doc_id", "table", "row", F.posexplode("cells").alias("col", "cell")), synonyms)


def _forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document as a form, and a version with lines dropped, edited, blanked and added."""
    rows = lines.lines(table(spark, sf_dir, "documents"))
    p = F.col("pos")
    line = F.when(p % 11 == 5, F.concat("line", F.lit(" x"))).when(p % 13 == 8, " ").otherwise(F.col("line"))
    added = F.when(p % 5 == 0, F.array(line, F.concat(F.lit("added "), p.cast("string")))).otherwise(F.array(line))
    made = rows.select("doc_id", "pos", F.posexplode(F.when(p % 7 == 3, F.array().cast("array<string>")).otherwise(added)).alias("part", "line"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "part")) - 1
    return rows, made.select("doc_id", nth.alias("pos"), "line")


def form_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a document and its changed version have once each, and that keep their order."""
    return alignment.anchors(*_forms(spark, sf_dir))


def form_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a changed version of every document has filled in, dropped and edited."""
    return alignment.form_diff(*_forms(spark, sf_dir))


QUERIES = {f.__name__: f for f in (contract_issues, profile_issues, profile_summaries, content_issues, vertical_cards, form_anchors, form_differences)}

_SEMANTIC = ", ".join(f"'{s}'" for s in contracts.SEMANTIC_STATES)
_VERIFIED = ", ".join(f"'{s}'" for s in contracts.VERIFICATION_STATES)
_PROFILE = """
    p AS (
        SELECT c_custkey AS k, c_custkey % 11 <> 0 AS given, c_custkey % 20 AS tam, c_custkey % 13 AS sam, c_custkey % 7 AS som, c_custkey % 6 = 0 OR c_custkey % 11 <> 0 AS has_tam FROM customer),
    i AS (
        SELECT k, unnest(list_filter([
            CASE WHEN k % 5 = 0 THEN ['ERROR', 'MISSING_COMPANY_NAME', 'company.name'] END,
            CASE WHEN CASE WHEN k % 3 = 0 THEN k % 9 = 0 ELSE k % 2 <> 0 END THEN ['WARNING', 'MISSING_CEO_NAME', 'ceo.name'] END,
            CASE WHEN k % 4 = 0 THEN ['ERROR', 'MISSING_SERVICE_NAME', 'service.name'] END,
            CASE WHEN has_tam AND given AND tam > 0 AND sam > tam THEN ['ERROR', 'MARKET_SIZE_LOGIC', 'market.tam'] END,
            CASE WHEN given AND sam > 0 AND som > sam THEN ['ERROR', 'MARKET_SIZE_LOGIC', 'market.sam'] END,
            CASE WHEN NOT has_tam THEN ['WARNING', 'MISSING_MARKET_SIZE', 'market'] END,
            CASE WHEN k % 2 = 1 AND k % 900 > 0 THEN ['WARNING', 'BUDGET_SUM_MISMATCH', 'budget'] END,
            CASE WHEN k % 8 = 0 THEN ['WARNING', 'MISSING_TEAM', 'team'] END,
            CASE WHEN k % 6 <> 0 THEN ['INFO', 'MISSING_CEO_CAREER', 'ceo'] END], lambda x: x IS NOT NULL)) AS x FROM p)"""

ORACLES = {
    "contract_issues": f"""
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
        f AS (
            SELECT o_custkey AS b, pos, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'f' || o_orderkey % 50 END AS id,
                   CASE o_orderstatus WHEN 'F' THEN 'ACTUAL' WHEN 'O' THEN 'NOT_APPLICABLE' ELSE 'PERHAPS' END AS s FROM o),
        e AS (
            SELECT o_custkey AS b, pos, CASE WHEN o_orderkey % 4 = 0 THEN 'f' ELSE 'e' END || o_orderkey % 40 AS id, replace(replace(upper(o_orderpriority), '-', '_'), ' ', '_') AS v
            FROM o WHERE o_orderkey % 2 = 0),
        c AS (SELECT o_custkey AS b, pos, 'c' || o_orderkey % 10 AS id, o_orderkey AS k FROM o WHERE o_orderkey % 5 = 0),
        a AS (SELECT b, pos, id, 'facts' AS t FROM f UNION ALL SELECT b, pos, id, 'evidence' FROM e UNION ALL SELECT b, pos, id, 'conflicts' FROM c),
        n AS (SELECT *, row_number() OVER (PARTITION BY t, b, id ORDER BY pos) AS nth, t || '[' || pos || ']' AS path FROM a),
        u AS (SELECT b, pos, unnest([0, 1]) AS i, 'f' || (k + 7 * unnest([0, 1])) % 50 AS id FROM c)
        SELECT b AS bundle, CASE WHEN id = '' THEN 'MISSING_ID' ELSE 'DUPLICATE_ID' END AS rule, path, id AS detail FROM n WHERE id = '' OR nth > 1
        UNION ALL SELECT b, 'UNKNOWN_STATE', 'facts[' || pos || '].semantic_state', s FROM f WHERE s NOT IN ({_SEMANTIC})
        UNION ALL SELECT b, 'UNKNOWN_STATE', 'evidence[' || pos || '].verification_state', v FROM e WHERE v NOT IN ({_VERIFIED})
        UNION ALL SELECT DISTINCT b, 'SHARED_ID', 'facts', id FROM f WHERE id <> '' AND (b, id) IN (SELECT b, id FROM e)
        UNION ALL SELECT b, 'UNKNOWN_FACT', 'conflicts[' || pos || '].candidate_fact_ids[' || i || ']', id FROM u WHERE (b, id) NOT IN (SELECT b, id FROM f)""",
    "profile_issues": f"WITH {_PROFILE} SELECT k AS c_custkey, x[1] AS level, x[2] AS code, x[3] AS path FROM i",
    "profile_summaries": f"""
        WITH {_PROFILE}, n AS (SELECT k, {", ".join(f"count(*) FILTER (WHERE x[1] = '{v}') AS {v.lower()}s" for v in ("ERROR", "WARNING", "INFO"))} FROM i GROUP BY 1)
        SELECT p.k AS c_custkey, {", ".join(f"coalesce({v}, 0) AS {v}" for v in ("errors", "warnings", "infos"))}, coalesce(errors, 0) = 0 AS passed FROM p LEFT JOIN n USING (k)""",
    "content_issues": """
        WITH t AS (SELECT *, role || ' ' || turn AS keyword, list_filter(string_split(text, chr(10)), lambda x: contains(x, 'e.')) AS l FROM conversations),
        s AS (SELECT conv_id, keyword, turn, len(l) AS n, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS chars FROM t WHERE conv_id % 5 <> 0),
        c AS (SELECT conv_id, turn, turn % 3 = 1 OR trim(text) = '' AS blank FROM t WHERE conv_id % 7 <> 0)
        SELECT conv_id, 'WARNING' AS level, code, path FROM (
            SELECT conv_id, 'EMPTY_SECTION' AS code, 'sections.' || keyword AS path FROM s WHERE n = 0
            UNION ALL SELECT conv_id, 'TOO_MANY_EMPTY_SECTIONS', 'sections' FROM s GROUP BY conv_id HAVING count(*) FILTER (WHERE n = 0) > count(*) // 2
            UNION ALL SELECT conv_id, 'SECTION_OVERFLOW', 'sections.' || keyword FROM s WHERE chars > 1500
            UNION ALL SELECT conv_id, 'CHAR_LIMIT_EXCEEDED', 'sections.' || keyword FROM s WHERE turn > 0 AND chars > turn * 100 * 1.2
            UNION ALL SELECT conv_id, 'EMPTY_CELL', 'table_cells.' || turn FROM c WHERE blank
            UNION ALL SELECT DISTINCT conv_id, 'MISSING_KEY', 'table_cells' FROM s WHERE conv_id NOT IN (SELECT conv_id FROM c)
            UNION ALL SELECT DISTINCT conv_id, 'MISSING_KEY', 'sections' FROM c WHERE conv_id NOT IN (SELECT conv_id FROM s))""",
    "vertical_cards": """
        WITH r AS (
            SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_tax < 0.05 AS wide,
                   [l_returnflag, l_linestatus, CASE WHEN l_discount < 0.03 THEN '' WHEN l_quantity % 3 = 0 THEN 'T' ELSE cast(cast(l_quantity AS integer) AS varchar) END] AS c FROM lineitem),
        k AS (SELECT *, list_transform(c, lambda x: CASE WHEN x IN ('A', 'R') THEN 'flag' WHEN x = 'F' THEN 'status' WHEN x = 'T' THEN 'third' END) AS g FROM r),
        w AS (
            SELECT *, lead(c) OVER o AS bc, lead(g) OVER o AS bg, lead(wide) OVER o AS bw, lead(c, 2) OVER o AS ac, lead(g, 2) OVER o AS ag, lead(wide, 2) OVER o AS aw FROM k WINDOW o AS (PARTITION BY d ORDER BY n)),
        h AS (SELECT *, list_filter([1, 2, 3], lambda i: c[i] <> '') AS f FROM w WHERE bw = wide),
        q AS (
            SELECT * FROM h WHERE len(list_filter(f, lambda i: g[i] IS NULL)) = 0 AND len(list_distinct(list_transform(f, lambda i: g[i]))) = len(f)
                AND len(list_filter(f, lambda i: bg[i] IS NOT NULL)) = 0 AND NOT (coalesce(aw = wide, false) AND len(list_filter(f, lambda i: ac[i] <> '' AND ag[i] IS NULL)) > 0)),
        u AS (SELECT d, n, unnest(f) AS i, c, bc FROM q)
        SELECT d AS doc_id, 0 AS "table", cast(n AS integer) AS "row", cast(i - 1 AS integer) AS col, c[i] AS key, c[i] AS label, bc[i] AS value FROM u WHERE bc[i] <> ''""",
    "form_anchors": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
        e AS (SELECT doc_id, pos, CASE WHEN pos % 11 = 5 THEN line || ' x' WHEN pos % 13 = 8 THEN ' ' ELSE line END AS line FROM l WHERE pos % 7 <> 3),
        t AS (
            SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS pos
            FROM (SELECT doc_id, pos, 0 AS part, line FROM e UNION ALL SELECT doc_id, pos, 1, 'added ' || pos FROM e WHERE pos % 5 = 0)),
        a AS (SELECT doc_id, line, min(pos) AS p FROM l GROUP BY ALL HAVING count(*) = 1), b AS (SELECT doc_id, line, min(pos) AS p FROM t GROUP BY ALL HAVING count(*) = 1)
        SELECT doc_id, cast(a.p AS integer) AS a, cast(b.p AS integer) AS b FROM a JOIN b USING (doc_id, line)""",
}
