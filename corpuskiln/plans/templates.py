"""Queries on templates, blocks, scores and run logs; the driver's tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators import lines, scores, tables, templates
from corpuskiln.operators.templates import MARKERS_ONLY, NUMBERED, REQUIRED, Rules
from corpuskiln.sources.tables import table
from corpuskiln.streaming import run_log as log

RULES = Rules(signature="schst|ando", required_words="tion|ment", excluded=("Heit", "ará"), non_business="^-|keit")
WORDS = {"en": ("tion", "ing", "zzz"), "fr": ("eau", "ment", "yyy", "que"), "de": ("ung",)}
REPORT = ("the", "la ", "der", "xxx")
GUIDE, PLACEHOLDER = "!!", "###|%%%"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(table(spark, sf_dir, "documents"))


def template_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that every document's lines open."""
    return templates.sections(_lines(spark, sf_dir), RULES)


def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question that a document asks as a template: on sections, short cells and lines with signs as pictures."""
    rows = _lines(spark, sf_dir)
    cells = tables.cells(rows).filter(F.char_length("cell") < 5)
    cells = cells.select("doc_id", "table", "row", "col", F.concat_ws("_", F.lit("cell"), "table", "row", "col").alias("cell_id"), F.col("cell").alias("label"), F.lit("text").alias("field_type"), (F.col("col") % 2 == 0).alias("required"))
    images = rows.filter(F.contains("line", F.lit("###"))).select("doc_id", F.col("pos").alias("place"), F.concat(F.lit("slot_"), F.char_length("line").cast("string")).alias("slot_id"), F.substring("line", 1, 10).alias("label"))
    return templates.questions(table(spark, sf_dir, "documents"), templates.sections(rows, RULES), cells, images)


def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of blocks in every document: some words mark them, short lines divide them."""
    line = F.col("line")
    found = templates.marked_blocks(_lines(spark, sf_dir), line.contains("tion,") | line.contains("ment "), line.contains("the ") | line.contains("la "), F.char_length(line) < 30)
    return found.filter("role is not null").select("doc_id", "pos", "role")


def section_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether something follows each document's first section where the next document says it again."""
    rows = _lines(spark, sf_dir)
    first = templates.sections(rows, RULES).filter("pos = 0 and char_length(label) > 8").select("doc_id", F.col("field_id").alias("target"), F.col("label").alias("anchor"))
    return templates.section_contents(rows, first, RULES)


def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a form whose orders are questions, answers, written cells and pictures: what is left open."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("label"))
    k, id_ = F.col("k"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    kinds = F.when(k % 5 == 0, "section").when(k % 5 == 1, "table_cell").when(k % 5 == 2, "project_meta").when(k % 5 == 3, "organization_profile").otherwise("image_slot_note")
    asked = o.select("doc_id", id_("q", k).alias("question_id"), kinds.alias("kind"), id_("t", k).alias("target"), "label", (k % 3 != 0).alias("required"))
    output = o.filter("k % 5 < 2 and k % 2 = 0").select("doc_id", kinds.alias("kind"), id_("t", k).alias("target"), (k % 7 != 0).alias("filled"))
    held = F.when(k % 5 == 2, "project_meta").when(k % 5 == 3, "organization_profile").otherwise("answer")
    key = F.when((k % 5 == 4) | (k % 4 == 0), id_("q", k)).otherwise(id_("t", k))
    values = o.filter("k % 11 < 6").select("doc_id", held.alias("kind"), key.alias("key"), F.when(k % 13 == 0, "　").otherwise("x").alias("value"))
    slots = o.select("doc_id", id_("s", k % 3).alias("slot_id"), "label", (k % 2 == 1).alias("required"))
    pictures = o.filter("k % 6 = 1").select("doc_id", id_("s", k % 3).alias("slot_id"))
    return templates.open_questions(asked, output, values, pictures, slots, Rules("", "", (), "^3-"))


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score in nine parts."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    told = docs.select("doc_id", F.col("lang").alias("kind"), ((i % 11) / 10).alias("confidence"), F.when(i % 3 == 0, (i % 8) / 7).alias("psst_ratio"), (i % 9).alias("font_kinds"), (i % 3).alias("font_outliers"), (i % 4).alias("bold"), (i % 2).alias("images"))
    return scores.score(scores.scan(docs, GUIDE, PLACEHOLDER).join(told, "doc_id"), WORDS, REPORT)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's hours as runs whose events open and close steps: the last 50 of each kind."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "purchase", "END").otherwise("START")
    run = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH"))
    events = e.select(run.alias("run_id"), (F.col("user_id") % 5).cast("string").alias("kind"), F.col("user_id").cast("string").alias("label"), kind.alias("event"), (F.floor("value") % 3).cast("string").alias("key"), F.col("props").alias("detail"), F.col("event_id").alias("seq"))
    found = log.compacted(log.runs(events))
    by = lambda s: F.size(F.filter("steps", lambda x: x["status"] == s)).cast("long")
    return found.select("run_id", "kind", "started", F.size("steps").cast("long").alias("n_steps"), (by("SUCCESS") + by("FAILED")).alias("n_closed"))


QUERIES = {f.__name__: f for f in (template_sections, template_questions, marked_blocks, section_contents, open_questions, document_scores, run_log)}


def _halved(x: str) -> str:
    left, right = f"trim(left({x}, length({x}) // 2), ' ')", f"trim(right({x}, length({x}) - length({x}) // 2), ' ')"
    return f"CASE WHEN length({x}) >= 20 AND length({x}) % 2 = 0 AND {left} <> '' AND {left} = {right} THEN {left} ELSE {x} END"


_TRIM = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
_SLUG = r"left(lower(trim(regexp_replace(regexp_replace(strip_accents(label), '[^\x00-\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_')), 48)"
_SECTIONS = rf"""
    h0 AS (SELECT doc_id, pos, regexp_replace({_TRIM.format("line")}, '[\s\pZ]+', ' ', 'g') AS x FROM {_LINES}),
    h1 AS (SELECT doc_id, pos, {_halved("x")} AS x FROM h0),
    h2 AS (SELECT doc_id, pos, {_halved("x")} AS label FROM h1),
    f AS (
        SELECT doc_id, label, min(pos) AS pos FROM h2
        WHERE label <> '' AND NOT regexp_matches(label, '{MARKERS_ONLY}') AND NOT regexp_matches(label, '{RULES.signature}')
            AND (regexp_matches(label, '{NUMBERED}') OR label LIKE '□%' OR label LIKE '%:' OR label LIKE '%]' OR (length(label) <= 48 AND len(string_split(label, ' ')) <= 8))
        GROUP BY ALL),
    g AS (SELECT *, {_SLUG} AS slug FROM f),
    sections AS (
        SELECT doc_id, cast(pos AS integer) AS pos,
               'section_' || CASE WHEN pos + 1 > 999 THEN cast(pos + 1 AS varchar) ELSE lpad(cast(pos + 1 AS varchar), 3, '0') END || '_' || CASE WHEN slug <> '' THEN slug ELSE 'section_' || left(md5(label), 8) END AS field_id,
               label, regexp_matches(label, '{REQUIRED}') OR (regexp_matches(label, '{RULES.required_words}') AND length(label) <= 80) AS required,
               {" OR ".join(f"contains(lower(label), '{w.lower()}')" for w in RULES.excluded)} AS excluded FROM g)"""
_SPACED = f"regexp_matches(x, '^[ \\t\u3000]*[{scores.BULLETS}]+[ \\t\u3000]{{2,}}') OR regexp_matches(x, '{scores.SPACES}')"
_BLANK = r"regexp_matches(x, '^[\s\pZ]*$')"

ORACLES = {
    "template_sections": f"WITH {_SECTIONS} SELECT * FROM sections",
    "template_questions": rf"""
        WITH {_SECTIONS},
        t AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {_LINES} WHERE contains(line, '|')),
        u AS (SELECT doc_id, line, pos, min(pos) OVER (PARTITION BY doc_id, island) AS t FROM t),
        c AS (SELECT doc_id, t, pos - t AS r, unnest(range(len(string_split(line, '|')))) AS c, {_TRIM.format("unnest(string_split(line, '|'))")} AS cell FROM u),
        q AS (
            SELECT doc_id, 0 AS part, nth AS a, 0 AS b, 0 AS c, id AS question_id, label, 'text' AS field_type, true AS required, kind, target
            FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (0, 'project_title', '과제명', 'project_meta', 'project_title'), (1, 'organization_name', '기관명 또는 회사명', 'organization_profile', 'name')) v(nth, id, label, kind, target)
            UNION ALL SELECT doc_id, 1, pos, 0, 0, field_id, label, 'textarea', required, 'section', field_id FROM sections WHERE NOT excluded
            UNION ALL SELECT doc_id, 2, t, r, c, concat_ws('_', 'cell', t, r, c), cell, 'text', c % 2 = 0, 'table_cell', concat_ws('_', 'cell', t, r, c) FROM c WHERE length(cell) < 5
            UNION ALL SELECT doc_id, 3, pos, 0, 0, 'image_note_slot_' || length(line), left(line, 10) || ' 설명', 'textarea', false, 'image_slot_note', 'slot_' || length(line) FROM {_LINES} WHERE contains(line, '###')),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question_id ORDER BY part, a, b, c) AS again FROM q)
        SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY part, a, b, c) AS integer) AS nth, question_id, label, field_type, required, kind, target FROM k WHERE again = 1""",
    "marked_blocks": f"""
        WITH m AS (
            SELECT doc_id, pos, contains(line, 'tion,') OR contains(line, 'ment ') AS m, (contains(line, 'tion,') OR contains(line, 'ment ')) AND (contains(line, 'the ') OR contains(line, 'la ')) AS i, length(line) < 30 AS d FROM {_LINES}),
        n AS (SELECT *, lag(m) OVER o AS m1, lead(m) OVER o AS m2, lag(i) OVER o AS i1, lead(d) OVER o AS d2 FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        b AS (SELECT *, coalesce(i1 AND NOT d AND NOT m AND d2, false) AS b FROM n),
        r AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS b1 FROM b),
        x AS (SELECT doc_id, pos, CASE WHEN m THEN 'marker' WHEN d AND (coalesce(m1, false) OR coalesce(m2, false) OR coalesce(b1, false)) THEN 'divider' WHEN b THEN 'body' END AS role FROM r)
        SELECT doc_id, cast(pos AS integer) AS pos, role FROM x WHERE role IS NOT NULL""",
    "open_questions": """
        WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderpriority LIKE '3-%' AS no FROM orders),
        v AS (SELECT DISTINCT d, k, k % 5 = 4 OR k % 4 = 0 AS by_question, k % 13 <> 0 AS given FROM o WHERE k % 11 < 6),
        a AS (
            SELECT o.d, o.k, CASE WHEN k % 5 < 2 THEN CASE WHEN k % 2 = 0 THEN k % 7 <> 0 ELSE coalesce(given, false) END
                WHEN k % 5 = 4 THEN coalesce(given, false) ELSE coalesce(given AND NOT by_question, false) END AS given, k % 5 < 2 AND k % 2 = 0 AS written
            FROM o LEFT JOIN v USING (d, k) WHERE k % 3 <> 0 AND NOT no)
        SELECT d AS doc_id, 'REQUIRED' AS code, 'q' || k AS id, CASE WHEN written THEN 'output' ELSE 'input' END AS place FROM a WHERE NOT given
        UNION ALL SELECT DISTINCT d, 'IMAGE', 's' || k % 3, 'output' FROM o WHERE k % 2 = 1 AND NOT no AND (d, k % 3) NOT IN (SELECT d, k % 3 FROM o WHERE k % 6 = 1)""",
    "document_scores": rf"""
        WITH l AS (SELECT doc_id, coalesce(text, '') AS t, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        p AS (SELECT *, list_filter(ls, lambda x: NOT contains(x, '|') AND NOT {_BLANK}) AS prose, flatten(list_transform(list_filter(ls, lambda x: contains(x, '|')), lambda x: string_split(x, '|'))) AS raw FROM l),
        n AS (
            SELECT doc_id, t, lang, len(list_filter(prose, lambda x: contains(x, '!!'))) AS critical, len(list_filter(prose, lambda x: NOT contains(x, '!!') AND regexp_matches(x, '{PLACEHOLDER}'))) AS general,
                   len(list_filter(prose, lambda x: {_SPACED})) AS bullets, len(regexp_extract_all(array_to_string(list_transform(ls, lambda x: CASE WHEN {_BLANK} AND NOT contains(x, '|') THEN 'b' ELSE 'x' END), ''), 'b{{2,}}')) AS groups,
                   len(list_filter(list_transform(raw, lambda c: regexp_replace(c, '^ | $', '', 'g')), lambda x: x <> '' AND (regexp_matches(x, '{scores.PADDED}') OR regexp_matches(x, '{scores.SPACES}')))) AS cells, len(prose) AS paragraphs FROM p),
        w AS (
            SELECT *, CASE lang {" ".join(f"WHEN '{k}' THEN ({' + '.join(f'contains(t, {w!r})::int' for w in ws)}) / {len(ws)}" for k, ws in WORDS.items())} ELSE 0.7::double END AS share,
                   ({" + ".join(f"contains(t, '{w}')::int" for w in REPORT)}) / {len(REPORT)} AS told, (doc_id % 4) / greatest(1, paragraphs) AS ratio FROM n),
        s AS (
            SELECT doc_id, cast(greatest(0, 15 - 5 * critical - general) AS double) AS guide_removal, cast(greatest(0, 10 - bullets) AS double) AS bullet_spacing, cast(greatest(0, 10 - 2 * groups) AS double) AS paragraph_cleanup,
                   cast(greatest(0, 15 - greatest(0, doc_id % 9 - 6) - 2 * (doc_id % 3)) AS double) AS font_consistency, cast(greatest(0, 10 - cells) AS double) AS table_quality,
                   cast(CASE WHEN doc_id % 4 = 0 THEN 4 WHEN ratio > 0.35 THEN 5 ELSE 10 END AS double) AS emphasis,
                   cast(round_even(15.0::double * (0.4::double * least(1.0::double, (doc_id % 11) / 10) + 0.6::double * share), 1) AS double) AS type_structure,
                   cast(round_even(10.0::double * CASE WHEN doc_id % 3 = 0 THEN (doc_id % 8) / 7 ELSE told END, 1) AS double) AS psst_structure,
                   cast(CASE WHEN doc_id % 2 > 0 THEN 5 ELSE 2 END AS double) AS image_suggestion FROM w),
        x AS (SELECT *, cast(round_even(guide_removal + bullet_spacing + paragraph_cleanup + font_consistency + table_quality + emphasis + type_structure + psst_structure + image_suggestion, 1) AS double) AS total FROM s)
        SELECT *, CASE WHEN total >= 90 THEN '우수' WHEN total >= 85 THEN '통과' WHEN total >= 70 THEN '보완 필요' ELSE '실패' END AS grade, total >= 85 AS passed FROM x""",
}
