"""Queries on résumés: the driver's texts, with words for cells and frequent words for labels, stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators import lines, resumes
from corpuskiln.operators.resumes import Form, Section
from corpuskiln.sources.tables import table

#: Lines are cells by their spaces; a line that begins with a vowel is dated; one word with a full stop is a title.
WORDS = Form(
    sections=(
        Section("education", (("tion", "ment"), ("keit", "heit")), ("period", "school", "major", "degree"), "la"),
        Section("career", (("ndwh",), ("mente", "ando")), ("period", "company", "position", "duty"), "die"),
        Section("certs", (("schu",), ("thou",)), ("date", "name", "number", "issuer"), "the", "(tion|ing)$|ch", 1, "trainings"),
        Section("lectures", (("erre",),), ("date", "org", "topic", "count", "kind")),
    ),
    identity={"that": "name", "de": "org", "der": "org", "le": "phone", "with": "field", "que": "name", "of": "phone"},
    required=("name", "org", "phone", "field"),
    lead="^[AEIOUÉÈÊaeiou]",
    quoted=r"^[^ ]+\.$",
    separator=" ",
)
#: What header cells of the tables to fill mean.
LABELS = {"education": {"Period": "period", "School": "school", "Major tion": "major", "Degree ment": "degree"}}


def resume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every line of every document says as a line of a résumé."""
    found = resumes.parse(lines.lines(table(spark, sf_dir, "documents")), WORDS)
    return found.withColumn("values", F.array_join("values", "~", "-"))


def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a person whose turns are sources: the merged profile."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    parsed = resumes.parse(turns, WORDS, ("conv_id", "turn")).withColumn("source", F.concat(F.lit("turn "), F.col("turn")))
    found = resumes.merge(parsed, "conv_id", "source", "turn", WORDS)
    listed = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, "~", "-")), "|")
    return found.select(
        "conv_id",
        F.array_join(F.transform(F.map_entries("identity"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("identity"),
        *(listed(k).alias(k) for k in (*WORDS.kinds[:-1], "replaced")),
        F.array_join("publications", "|").alias("publications"),
        F.array_join(F.transform("conflicts", lambda c: F.concat_ws("~", *(c[x] for x in ("key", "kept", "ignored", "source")))), "|").alias("conflicts"),
        F.array_join("missing", ",").alias("missing"),
    )


def _forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables of a header and a row for each of a hundred customers, blank where the balance is low; their orders as records."""
    customer = table(spark, sf_dir, "customer").withColumn("doc_id", F.floor(F.col("c_custkey") / 100))
    head = customer.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row"), F.array(*map(F.lit, ("No", "School 학교명", "Degree ment", "Major tion", "Period", "School", "학위"))).alias("cells"))
    blank = F.col("c_acctbal") < 2000
    some = lambda c: F.when(blank, F.when(F.col("c_custkey") % 2 == 0, "\t　").otherwise("")).otherwise(c)
    row = F.array(F.col("c_custkey").cast("string"), F.lit("x"), some(F.col("c_mktsegment")), F.lit(" "), some(F.col("c_mktsegment")), some(F.col("c_name")), F.lit("y"))
    rows = head.unionByName(customer.select("doc_id", (F.col("c_custkey") % 100 + 1).cast("int").alias("row"), row.alias("cells")))
    orders = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("doc_id"), "o_orderkey", F.array(F.col("o_orderpriority"), F.col("o_orderdate").cast("date").cast("string"), F.lit(None), F.col("o_orderstatus")).alias("values"))
    nth = F.row_number().over(lines.W.partitionBy("doc_id").orderBy("o_orderkey"))
    records = orders.select("doc_id", F.lit("education").alias("kind"), nth.alias("nth"), "values")
    return rows.select("doc_id", F.lit(0).alias("table"), "row", F.posexplode("cells").alias("col", "cell")), records


def filled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders, as records, write into the blank rows of tables of customers."""
    cells, records = _forms(spark, sf_dir)
    return resumes.fill_tables(cells, records, WORDS, LABELS)[0]


def filled_tables_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the records each table takes."""
    cells, records = _forms(spark, sf_dir)
    return resumes.fill_tables(cells, records, WORDS, LABELS)[1]


QUERIES = {f.__name__: f for f in (resume_lines, merged_profiles, filled_tables, filled_tables_report)}


def _parsed(rows: str, keys: str) -> str:
    """SQL of parse over rows (keys, pos, line)."""
    norm = r"lower(regexp_replace({}, '[\s\pZ]+', '', 'g'))"
    signature = lambda s: " OR ".join("(" + " AND ".join(f"contains(j, '{w}')" for w in ws) + ")" for ws in s.signatures)
    known = lambda c: "CASE " + " ".join(f"WHEN {norm.format(c)} = '{k}' THEN '{v}'" for k, v in WORDS.identity.items()) + " END"
    tag = "CASE section " + " ".join(f"WHEN '{s.kind}' THEN '{s.tag}'" for s in WORDS.sections if s.tag) + " END"
    size = "CASE section " + " ".join(f"WHEN '{s.kind}' THEN {len(s.fields)}" for s in WORDS.sections) + " END"
    return rf"""
        l AS (SELECT {keys}, pos, regexp_replace(line, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS line FROM {rows}),
        c AS (
            SELECT *, CASE WHEN contains(line, ' ') THEN list_transform(string_split(line, ' '), lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) ELSE [] END AS cells
            FROM l WHERE line <> ''),
        j AS (SELECT *, {norm.format("array_to_string(cells, '')")} AS j, len(cells) > 0 AND NOT regexp_matches(cells[1], '{WORDS.lead}') AS able FROM c),
        h AS (SELECT *, CASE {" ".join(f"WHEN able AND ({signature(s)}) THEN '{s.kind}'" for s in WORDS.sections)} END AS header FROM j),
        s AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h),
        b AS (
            SELECT *, CASE WHEN len(cells) = 0 OR section IS NULL THEN NULL
                WHEN {tag} IS NULL THEN CASE WHEN regexp_matches(cells[1], '{WORDS.lead}') THEN cells END
                WHEN {known("cells[1]")} IS NOT NULL THEN NULL WHEN {norm.format("cells[1]")} = {tag} THEN cells[2:] WHEN regexp_matches(cells[1], '{WORDS.lead}') THEN cells END AS body
            FROM s WHERE header IS NULL),
        v AS (SELECT *, CASE WHEN body IS NOT NULL THEN list_transform(range(1, {size} + 1), lambda i: nullif(body[i], '')) END AS vals FROM b),
        q AS (SELECT *, regexp_matches(line, '{WORDS.quoted}') AND NOT contains(line, ' ') AS quotes FROM v),
        parsed AS (
            SELECT {keys}, pos, 0 AS part, 'publications' AS what, 'publications' AS kind, [line] AS vals FROM q WHERE quotes
            UNION ALL
            SELECT {keys}, pos, 0, 'record', CASE WHEN section = 'certs' AND regexp_matches({norm.format("vals[2]")}, '{WORDS.sections[2].split}') THEN 'trainings' ELSE section END, vals
            FROM q WHERE NOT quotes AND body IS NOT NULL AND ({tag} IS NULL OR coalesce(vals[1], vals[2]) IS NOT NULL)
            UNION ALL
            SELECT {keys}, pos, CASE WHEN which = 1 OR {known("cells[1]")} IS NULL OR cells[2] = '' THEN 0 ELSE 1 END, 'identity', {known("cells[which]")}, [cells[which + 1]]
            FROM (SELECT *, unnest([1, 3]) AS which FROM q WHERE NOT quotes AND body IS NULL AND len(cells) >= 2)
            WHERE (which = 1 OR len(cells) >= 4) AND {known("cells[which]")} IS NOT NULL AND cells[which + 1] <> '')"""


_SHOWN = "array_to_string(list_transform({}, lambda x: coalesce(x, '-')), '~')"
_LIST = "coalesce(string_agg(" + _SHOWN.format("vals") + ", '|' ORDER BY ord) FILTER (WHERE {}), '')"
_FORMS = """
    c AS (SELECT c_custkey // 100 AS doc_id, c_custkey % 100 + 1 AS r, c_acctbal < 2000 AS blank FROM customer),
    b AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS nth FROM c WHERE blank),
    o AS (SELECT o_custkey // 100 AS doc_id, o_orderpriority, cast(cast(o_orderdate AS date) AS varchar) AS o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey // 100 ORDER BY o_orderkey) AS nth FROM orders)"""

ORACLES = {
    "resume_lines": f"""
        WITH {_parsed("(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)", "doc_id")}
        SELECT doc_id, cast(pos AS integer) AS pos, part, what, kind, {_SHOWN.format("vals")} AS values FROM parsed""",
    "merged_profiles": f"""
        WITH {_parsed("(SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations)", "conv_id, turn")},
        p AS (SELECT *, row_number() OVER (ORDER BY turn, pos, part) AS ord FROM parsed),
        i AS (SELECT conv_id, turn, kind, arg_min(vals[1], ord) AS v, min(ord) AS ord FROM p WHERE what = 'identity' GROUP BY ALL),
        w AS (SELECT *, first_value(v) OVER (PARTITION BY conv_id, kind ORDER BY ord) AS kept FROM i),
        d AS (SELECT conv_id, kind, kept, v, arg_min(turn, ord) AS turn, min(ord) AS ord FROM w GROUP BY conv_id, kind, kept, v),
        ident AS (
            SELECT conv_id, string_agg(kind || '=' || v, '|' ORDER BY kind) FILTER (WHERE v = kept) AS identity, list(DISTINCT kind) AS held,
                   string_agg(kind || '~' || kept || '~' || v || '~turn ' || turn, '|' ORDER BY ord) FILTER (WHERE v <> kept) AS conflicts FROM d GROUP BY 1),
        k AS (
            SELECT *, CASE WHEN kind = 'education' THEN vals WHEN kind = 'career' THEN vals[1:2]
                WHEN kind IN ('certs', 'trainings') THEN CASE WHEN vals[3] IS NULL THEN [vals[2], vals[1], vals[4]] ELSE [vals[2], vals[3]] END
                WHEN kind = 'lectures' THEN vals[1:3] ELSE vals END AS key
            FROM p WHERE what <> 'identity'),
        f AS (SELECT conv_id, kind, vals, ord FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind, key ORDER BY ord) AS nth FROM k) WHERE nth = 1),
        r AS (
            SELECT conv_id, {", ".join(f"{_LIST.format(f"kind = '{k}'")} AS {k}" for k in WORDS.kinds[:-1])},
                   coalesce(string_agg(vals[1], '|' ORDER BY ord) FILTER (WHERE kind = 'publications'), '') AS publications FROM f GROUP BY 1)
        SELECT conv_id, coalesce(identity, '') AS identity, {", ".join(f"coalesce({k}, '') AS {k}" for k in WORDS.kinds)}, '' AS replaced, coalesce(conflicts, '') AS conflicts,
               array_to_string(list_filter([{", ".join(f"'{x}'" for x in WORDS.required)}], lambda x: NOT list_contains(coalesce(held, []), x)), ',') AS missing
        FROM ident FULL JOIN r USING (conv_id)""",
    "filled_tables": f"""
        WITH {_FORMS}, m AS (SELECT b.doc_id, r, o.* EXCLUDE (doc_id, nth) FROM b JOIN o USING (doc_id, nth))
        SELECT doc_id, 0 AS "table", cast(r AS integer) AS "row", col, field, CASE field WHEN 'period' THEN o_orderpriority WHEN 'school' THEN o_orderdate ELSE o_orderstatus END AS value
        FROM m, (VALUES (2, 'degree'), (4, 'period'), (5, 'school')) x(col, field)""",
    "filled_tables_report": f"""
        WITH {_FORMS}, n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1)
        SELECT c.doc_id, 0 AS "table", 'education' AS kind, coalesce(any_value(n), 0) AS n_records, count(*) FILTER (WHERE blank) AS n_rows,
               least(coalesce(any_value(n), 0), count(*) FILTER (WHERE blank)) AS n_filled, coalesce(any_value(n), 0) - least(coalesce(any_value(n), 0), count(*) FILTER (WHERE blank)) AS n_left
        FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
}
