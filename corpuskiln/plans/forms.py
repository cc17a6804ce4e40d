"""Queries on forms, scores and files. The driver's tables stand in for them; the forms' own words are covered by unit tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import parsing, predicates
from corpuskiln.functions import text as T
from corpuskiln.operators import assets, checks, company, lines, quality, ranking, records, sections, tables
from corpuskiln.sources.tables import table


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(lines.lines(table(spark, sf_dir, "documents")))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every document's tables with their nearest headers."""
    return tables.with_headers(_cells(spark, sf_dir))


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that stand repeatedly in one column, or in an even one, as labels of each document."""
    return tables.label_keys(_cells(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_labels"))


def empty_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables without a cell that is not blank, where every fourth row has been blanked."""
    blank = F.when(F.col("row") % 4 == 1, F.when(F.col("col") % 2 == 0, " \t").otherwise("　")).otherwise(F.col("cell"))
    return tables.empty_rows(_cells(spark, sf_dir).withColumn("cell", blank))


def empty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more blank lines, where lines of every seven have been blanked by tabs and wide spaces; any other line, of a table too, ends one."""
    p = F.col("pos") % 7
    line = F.when(p == 2, "\t").when(p == 3, "　 ").when(p == 6, " ").otherwise(F.col("line"))
    return lines.runs(lines.lines(table(spark, sf_dir, "documents")).withColumn("line", line), T.bare(F.col("line")) == "")


def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of each document look numeric, like a name, or empty."""
    cell = F.col("cell")
    count = lambda c: F.sum(c.cast("long"))
    rows = _cells(spark, sf_dir).groupBy("doc_id")
    return rows.agg(count(predicates.looks_numeric(cell)).alias("n_numeric"), count(predicates.looks_like_name(cell)).alias("n_names"), count(predicates.is_empty_value(cell)).alias("n_empty"))


def doc_type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes of two small lexicons on each document, as a domain with its confidence."""
    found = assets.domain(F.col("text"), ("prose", ("the ", " and ", "tion", "ing ")), ("code", ("token", " = ", "::", "http")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.domain", "x.confidence")


def secret_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule, and for the rule of quoted hexadecimal tokens, the documents that a secret stands in."""
    rules = {**T.SECRETS, "SECRET_HEX_TOKEN": '"[0-9a-f]{40}"'}
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(F.col("text").rlike(p), F.lit(False)).cast("long").alias("n")) for r, p in rules.items()))
    return table(spark, sf_dir, "documents").select(F.explode(rows).alias("x")).groupBy("x.rule").agg(F.sum("x.n").alias("n_docs"))


def golden_term_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first word, and for some a number, as assertions about the next document or one that is not there; the report by status and last digit."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z]+)", 1)
    terms = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 3 == 0, F.array(word, F.lit("7"))).otherwise(F.array(word))
    asked = docs.select(i.alias("assertion_id"), F.when(i % 7 == 0, -1 - i).otherwise(i + 1 - i % 2 * 2).alias("doc_id"), terms.alias("terms"))
    found = records.golden(asked, docs, F.forall("terms", lambda t: parsing.contains_term(F.col("text"), t)))
    return found.groupBy((F.col("assertion_id") % 10).alias("digit"), "status").agg(F.count("*").alias("n"))


def citation_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of pages with even ids that no page with an odd id has."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))
    return records.unlisted(pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1"), "url")


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brands as sections, parts as materials, containers as requirements."""
    part = table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    own = part.groupBy(F.col("p_brand").alias("section_id")).agg(F.array_sort(F.collect_set(F.split("p_type", " ")[0])).alias("categories"))
    own = own.select("section_id", F.slice("categories", 1, 2).alias("categories"), none.alias("tokens"), F.lit(None).cast("array<string>").alias("expected"))
    origin = F.array(F.struct(F.col("p_brand").alias("file"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("location")))
    mats = part.select(
        F.col("p_partkey").cast("string").alias("material_id"),
        F.when(F.col("p_size") % 2 == 0, "FACT").otherwise("EVIDENCE").alias("material_type"),
        F.col("p_brand").alias("field"),
        F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name")).alias("value"),
        origin.alias("origin"),
        F.when(F.col("p_size") % 11 == 0, "stale").alias("verification"),
        F.lit(None).cast("string").alias("semantic"),
        F.array(F.split("p_type", " ")[0]).alias("categories"),
        none.alias("tokens"),
    )
    reqs = part.select("p_brand").distinct().select(
        F.col("p_brand").alias("requirement_id"),
        F.when(F.length("p_brand") % 2 == 0, F.array("p_brand")).alias("target_ids"),
        F.col("p_brand").alias("required_field"),
        F.lit("").alias("material_type"),
        F.lit(None).cast("array<string>").alias("expected"),
        F.array(F.lit("ECONOMY")).alias("categories"),
        none.alias("tokens"),
        F.lit(True).alias("required"),
        F.lit(False).alias("blocking"),
    )
    return own, mats, reqs


def unusable_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why parts, as materials, may not be used: their number by reason."""
    _, mats, _ = _sections(spark, sf_dir)
    why = sections.unusable_reason(F.col("value"), F.col("origin"), F.col("verification"), F.col("semantic"))
    return mats.groupBy(F.coalesce(why, F.lit("USABLE")).alias("reason")).agg(F.count("*").alias("n"))


def section_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each section has and lacks."""
    own, mats, reqs = _sections(spark, sf_dir)
    mats = sections.by_kind(mats)
    used = sections.matched_materials(own, mats).filter("reason is null")
    applied = sections.applicable(reqs, own)
    met = sections.satisfied(reqs, applied, used, mats)
    clash = own.filter(F.array_contains("categories", "PROMO")).select(F.lit("c").alias("conflict_id"), "section_id")
    return sections.section_status(own, used, applied, met, reqs, clash)


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as runs, their orders as documents with a score: numbers and averages."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 101).cast("double").alias("total"), (F.col("o_custkey") % 7).cast("double").alias("layout"))
    return quality.run_summary(orders, ["layout"]).select("run", "n_docs", F.size("doc_set").alias("n_set"), "avg_total", "avg_layout")


def ratchet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as series of runs: customers of even keys against those of odd ones, by mean balance and number."""
    c = table(spark, sf_dir, "customer")

    def side(odd: int) -> DataFrame:
        return c.filter(F.col("c_custkey") % 2 == odd).groupBy("c_nationkey").agg(
            F.count("*").alias("n_docs"),
            F.array(F.lit("a"), F.when(F.col("c_nationkey") % 6 == odd * 0, F.lit(str(odd))).otherwise("b")).alias("doc_set"),
            F.round(F.avg("c_acctbal"), 2).alias("avg_total"),
            F.count("*").alias("tests_passed"),
            F.sum((F.col("c_acctbal") < -990).cast("long")).alias("tests_failed"),
        )

    gate = quality.ratchet(side(1), side(0).filter("c_nationkey % 9 <> 0"), "c_nationkey")
    return gate.select("c_nationkey", "status", "passed", F.array_join("failures", ",").alias("failures"))


def score_plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as passes: how many gain less than 2, and the first that loses."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 37).cast("double").alias("total"))
    flat = quality.plateaus(orders, "o_custkey", "o_orderkey", "total").groupBy("o_custkey").agg(F.sum(F.col("plateau").cast("long")).alias("n_plateaus"))
    return flat.join(quality.first_drop(orders, "o_custkey", "o_orderkey", "total").select("o_custkey", F.col("at").alias("first_drop")), "o_custkey", "left")


def lowest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order with the lowest score, the first of equal ones."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 37).alias("total"))
    return quality.lowest_pass(orders, "o_custkey", "total", "o_orderkey")


def form_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as companies with fields by market segment, orders as forms: how far each can be filled."""
    c = table(spark, sf_dir, "customer")
    fields = c.select(F.col("c_nationkey").alias("company_id"), F.col("c_mktsegment").alias("field"), F.col("c_name").alias("value"), F.col("c_custkey").alias("seq"))
    merged = records.merge_sources(fields, "company_id", "field", "value", "seq", "seq", F.substring("value", -1, 1))
    master = merged.withColumn("confidence", F.when(F.col("n_values") > 3, "conflict").otherwise("high"))
    labels = c.select((F.col("c_custkey") % 50).alias("form_id"), (F.col("c_custkey") % 50 % 29).alias("company_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("field"), F.col("c_custkey").alias("pos"))
    return company.coverage(labels, master)


def source_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of their hosts' pools, ranked by keywords in their names."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    files = table(spark, sf_dir, "pages").select(host.alias("target"), F.concat(F.lit("/"), F.col("page_id"), F.regexp_extract("url", "([^/]*)$", 1)).alias("path"), F.col("page_id").alias("mtime"))
    return ranking.ranked_sources(files, ["1", "2"]).filter("rank <= 5").select("target", "path", "keyword_hits", "rank")


def asset_match_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as places, part types as pictures: the best of each with its margin."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    kind = lambda n: F.element_at(F.array(*map(F.lit, ("a", "b", assets.UNCLASSIFIED))), (n % 3 + 1).cast("int"))
    anchors = supplier.select(F.col("s_suppkey").alias("anchor_id"), kind(F.col("s_nationkey")).alias("class"), F.when(F.col("s_nationkey") % 2 == 0, "t").alias("type"), F.array(F.lit("tin"), F.when(F.col("s_nationkey") % 5 == 0, "large").otherwise("brass")).alias("keywords"))
    pictures = part.groupBy(F.col("p_type").alias("asset_id")).agg(F.min("p_size").alias("size"))
    pictures = pictures.select("asset_id", kind(F.col("size")).alias("class"), F.when(F.col("size") % 2 == 0, "t").otherwise("u").alias("type"), F.col("asset_id").alias("text"), (F.col("size") * 100_000).alias("pixels"))
    return assets.best_matches(anchors, pictures)


def acceptance_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains to be done on each document by the forms' own checks, with limits and a required name."""
    found = checks.results(table(spark, sf_dir, "documents"), checks.registry(max_pages=3, required=("license",)))
    return checks.remaining_work(checks.with_remedies(found))


def _acceptance_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a form whose lines, one for each order, hold what the checks look for."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    kinds = [
        F.concat(F.lit("[확인필요: "), n(9), F.lit("] 본문")),
        F.lit("이 블록은 삭제하세요"),
        F.lit("성과 OOO 달성, <제목>"),
        F.concat(F.lit("형태 "), n(5), F.lit(" 택 1 | □ 개인 □ 법인")),
        F.concat(F.lit("형태 "), n(5), F.lit(" 택 1 | ■ 개인 □ 법인")),
        F.lit("기업명 |　"),
        F.lit("사업자 등록번호 : | \t"),
        F.concat(F.lit("채용 '26."), (k % 12 + 1).cast("string"), F.lit(" 부터")),
        F.lit("해당 여부 | ( )"),
        F.lit("성명: 홍길동 | 대표자명 | 김철수"),
        F.when(k % 2 == 0, "업무 협약 체결").otherwise("업무 협약 체결 예정"),
        F.lit("| | |"),
        F.lit("본문은 그대로 둔다"),
    ]
    line = F.element_at(F.array(*kinds), (k % len(kinds) + 1).cast("int"))
    rows = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))).alias("lines"))
    ends = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, "청렴 서약서"), F.when(F.col("doc_id") % 4 == 0, "재직 증명서 제출")))
    return rows.select("doc_id", F.array_join(F.concat(F.transform("lines", lambda x: x["line"]), ends), "\n").alias("text"))


def _acceptance_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = checks.registry(blind=True, max_pages=0, required=("청렴서약서", "재직증명서"), claims=True, strict=True)
    return checks.results(_acceptance_forms(spark, sf_dir), (*asked, checks.Check("open_masks", "fail", checks.placeholders().count)))


def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a strict blind review on every customer's form, and the places to fill in of an open one."""
    return _acceptance_results(spark, sf_dir)


def acceptance_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of every form rolled up: whether it may be submitted."""
    return checks.rollup(_acceptance_results(spark, sf_dir))


def acceptance_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains to be done on every form, by who has to do it."""
    return checks.remaining_work(checks.with_remedies(_acceptance_results(spark, sf_dir)))


def masking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the kinds of masking candidates in lines, with the nearest heading (a short line without a full stop) before them."""
    rows = lines.lines(table(spark, sf_dir, "documents"))
    heading = (F.char_length("line") < 40) & ~F.contains("line", F.lit("."))
    kinds = {"email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "phone": r"0[0-9]{1,2}[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4}", "university": "대학교|대학원|전문대학", "name": "성명|대표자|책임자|연구책임|주관기관장"}
    return lines.findings(rows, kinds, heading)


def structure_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents as a form and its conversion: how far their structures agree."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    counts = F.struct(F.char_length("text").alias("chars"), F.size(F.split("text", " ")).alias("tokens"), F.size(F.split("text", "\n")).alias("paragraphs"))
    a, b = (docs.filter(F.col("doc_id") % 2 == i).select(F.floor(F.col("doc_id") / 2).alias("pair_id"), counts.alias(n)) for i, n in enumerate("ab"))
    return records.fidelity(a.join(b, "pair_id"), {"paragraphs": 0.4, "chars": 0.3, "tokens": 0.3}).drop("overall")


def first_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts, what is stored and what is posted: the answers changed for the first time."""
    o = table(spark, sf_dir, "orders")
    pick = lambda v, where: o.filter(where).select("o_orderkey", v.alias("value"))
    posted = F.when(F.col("o_custkey") % 4 == 0, " ").when(F.col("o_custkey") % 4 == 1, F.col("o_orderstatus")).otherwise("new")
    stored = F.when(F.col("o_custkey") % 5 == 0, "else").otherwise(F.col("o_orderstatus"))
    return records.first_edits(pick(F.col("o_orderstatus"), "o_custkey % 7 <> 0"), pick(stored, "o_custkey % 3 <> 0"), pick(posted, "true"), ["o_orderkey"])


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that break a contract of unique texts, by digest."""
    return records.duplicate_ids(table(spark, sf_dir, "documents").select(F.md5("text").alias("digest")), "digest").filter("digest <> ''")


def table_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct languages and sources of the documents."""
    found = records.facets(table(spark, sf_dir, "documents"), ["lang", "source"])
    return found.select(*(F.array_join(c, ",").alias(c) for c in ("lang", "source")))


QUERIES = {
    f.__name__: f
    for f in (
        table_cells, label_cells, empty_table_rows, empty_runs, value_predicates, doc_type_scores, secret_scan_counts, golden_term_presence, citation_allowlist, unusable_materials, section_status,
        run_summaries, ratchet_status, score_plateaus, lowest_scores, form_coverage, source_ranks, asset_match_margin, acceptance_registry, acceptance_checks, acceptance_decisions, acceptance_work, masking_candidates, structure_fidelity, first_edits, duplicate_texts, table_facets,
    )
}

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
_TRIM = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_CELLS = f"""
    t AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {_LINES} WHERE contains(line, '|')),
    u AS (SELECT doc_id, line, pos, min(pos) OVER (PARTITION BY doc_id, island) AS "table" FROM t),
    c AS (
        SELECT doc_id, "table", pos - "table" AS "row", cast(unnest(range(len(string_split(line, '|')))) AS integer) AS col, {_TRIM.format("unnest(string_split(line, '|'))")} AS cell FROM u)
"""
#: Defects by the arithmetic of the lines' kinds, without looking at any text.
_ACCEPTANCE = """
    o AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderkey % 13 AS t FROM orders),
    c AS (SELECT d, k, CASE WHEN t = 8 THEN -1 ELSE k % 5 END AS label, t = 3 AS open FROM o WHERE t IN (3, 4, 8)),
    f AS (SELECT d, count(*) FILTER (WHERE nth = 1 AND open) AS n FROM (SELECT *, row_number() OVER (PARTITION BY d, label ORDER BY k) AS nth FROM c) GROUP BY 1),
    n AS (
        SELECT d, {}, count(DISTINCT k % 12) FILTER (WHERE t = 7) AS months FROM o GROUP BY 1),
    r AS (
        SELECT n.d AS doc_id, unnest([
            {{'check_id': 'unresolved_markers', 'severity': 'fail', 'defects': n0}},
            {{'check_id': 'template_placeholders', 'severity': 'fail', 'defects': n2}},
            {{'check_id': 'open_masks', 'severity': 'fail', 'defects': 2 * n2}},
            {{'check_id': 'empty_table_rows', 'severity': 'warn', 'defects': n11}},
            {{'check_id': 'self_inserted_blocks', 'severity': 'fail', 'defects': n1}},
            {{'check_id': 'unchecked_choices', 'severity': 'fail', 'defects': coalesce(f.n, 0)}},
            {{'check_id': 'empty_label_fields', 'severity': 'fail', 'defects': n5}},
            {{'check_id': 'recruit_date_conflict', 'severity': 'warn', 'defects': greatest(0, months - 1)}},
            {{'check_id': 'paren_choices', 'severity': 'fail', 'defects': n8}},
            {{'check_id': 'empty_label_fields_ext', 'severity': 'fail', 'defects': n6}},
            {{'check_id': 'masking_violation', 'severity': 'fail', 'defects': 2 * n9}},
            {{'check_id': 'page_overflow', 'severity': 'warn', 'defects': 1}},
            {{'check_id': 'unverified_claims', 'severity': 'warn', 'defects': claims}},
            {{'check_id': 'missing_required_documents', 'severity': 'fail', 'defects': 2 - (n.d % 3 = 0)::int - (n.d % 4 = 0)::int}}]) AS x
        FROM n LEFT JOIN f USING (d))""".format(", ".join(f"count(*) FILTER (WHERE t = {i}) AS n{i}" for i in range(12)) + ", count(*) FILTER (WHERE t = 10 AND k % 2 = 0) AS claims")
_KINDS = "CASE x.check_id " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in checks.REMEDY_KINDS.items()) + " ELSE 'manual' END"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_SIMPLE_URL = r"""CASE WHEN u = '' THEN '' ELSE (CASE WHEN regexp_extract(u, P, 1) = '' THEN 'https' ELSE lower(regexp_extract(u, P, 1)) END) || '://' || lower(regexp_extract(u, P, 2))
    || regexp_replace(regexp_replace(regexp_extract(u, P, 3), ';[^/]*$', ''), '/+$', '') || (CASE WHEN regexp_extract(u, P, 4) = '?' THEN '' ELSE regexp_extract(u, P, 4) END) END""".replace(
    "P", r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?'"
)
_NUMERIC = r"(regexp_matches(cell, '\p{Nd}') AND regexp_matches(cell, '^[\s\pZ\p{Nd}.,\-/원만억천백십개%()~–—:]+$'))"


def _label_key() -> str:
    """SQL of a label's key: without parentheses, white space, and twice its bullets and one ordinal."""
    bare = r"regexp_replace(regexp_replace(cell, '\([^)]*\)', '', 'g'), '[\s\pZ]+', '', 'g')"
    out = bare
    for _ in range(2):
        out = f"regexp_replace(regexp_replace({out}, '^[{T.LABEL_BULLETS}]+', ''), '^({'|'.join(T.LABEL_ORDINALS)})', '')"
    return f"CASE WHEN regexp_matches({out}, '[가-힣A-Za-z0-9]') THEN {out} ELSE {bare} END"


_LABEL_KEY = _label_key()
_PAIRS = "round(0.35 * {k} + 0.30 * {w} + 0.20 * {t} + 0.10 * {p} + 0.05, 6)"

ORACLES = {
    "acceptance_checks": f"WITH {_ACCEPTANCE} SELECT doc_id, x.check_id AS check_id, x.severity AS severity, cast(x.defects AS bigint) AS defects FROM r",
    "acceptance_decisions": f"""
        WITH {_ACCEPTANCE} SELECT doc_id, count(*) FILTER (WHERE x.severity = 'fail' AND x.defects > 0) AS n_fail, count(*) FILTER (WHERE x.severity = 'warn' AND x.defects > 0) AS n_warn,
            cast(sum(x.defects) AS bigint) AS defects, count(*) FILTER (WHERE x.severity = 'fail' AND x.defects > 0) = 0 AS submittable FROM r GROUP BY 1""",
    "acceptance_work": f"""
        WITH {_ACCEPTANCE}, w AS (SELECT doc_id, x.check_id AS c, x.severity AS s, x.defects AS n, {_KINDS} AS kind FROM r WHERE x.defects > 0)
        SELECT doc_id, count(DISTINCT CASE WHEN kind = 'auto' THEN c END) AS auto_commands, {", ".join(f"cast(coalesce(sum(n) FILTER (WHERE {w}), 0) AS bigint) AS {a}" for w, a in (("kind = 'human'", "human_fields"), ("kind = 'manual'", "manual_items"), ("s = 'fail'", "blocking_defects")))},
               count(*) AS remaining_checks FROM w GROUP BY 1""",
    "acceptance_registry": r"""
        WITH n AS (
            SELECT doc_id, len(regexp_extract_all(t, '(?m)^[ \t]*\|[ \t|]*$')) AS bars, (length(t) > 4500)::int AS pages, (NOT contains(regexp_replace(t, '\s+', '', 'g'), 'license'))::int AS missing
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
        SELECT doc_id, 0::bigint AS auto_commands, missing::bigint AS human_fields, (bars + pages)::bigint AS manual_items, missing::bigint AS blocking_defects, ((bars > 0)::int + pages + missing)::bigint AS remaining_checks
        FROM n WHERE bars + pages + missing > 0""",
    "label_cells": f"""
        WITH {_CELLS}, k AS (SELECT *, {_LABEL_KEY} AS key, {_NUMERIC} AS numeric FROM c),
        s AS (SELECT doc_id, "table", "row", count(*) FILTER (WHERE cell <> '') AS n, count(*) FILTER (WHERE cell <> '' AND numeric) AS m FROM k GROUP BY ALL),
        w AS (SELECT *, lead("row") OVER o AS r2, lead(n) OVER o AS n2, lead(m) OVER o AS m2 FROM s WINDOW o AS (PARTITION BY doc_id, "table" ORDER BY "row")),
        h AS (SELECT doc_id, "table", "row" FROM w WHERE n >= 3 AND m = 0 AND r2 = "row" + 1 AND n2 >= 2 AND m2 * 2 >= n2),
        l AS (
            SELECT doc_id, key FROM k WHERE key <> '' AND (col % 2 = 0 OR (doc_id, "table", "row") IN (SELECT doc_id, "table", "row" FROM h))
            UNION SELECT doc_id, key FROM k WHERE key <> '' AND NOT numeric GROUP BY doc_id, col, key HAVING count(*) >= 2)
        SELECT doc_id, count(DISTINCT key) AS n_labels FROM l GROUP BY 1""",
    "table_cells": f"""
        WITH {_CELLS} SELECT *,
            coalesce(last_value(nullif(cell, '') IGNORE NULLS) OVER (PARTITION BY doc_id, "table", "row" ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS row_header,
            coalesce(last_value(nullif(cell, '') IGNORE NULLS) OVER (PARTITION BY doc_id, "table", col ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS col_header FROM c""",
    "empty_table_rows": f"""WITH {_CELLS} SELECT doc_id, "table", "row" FROM c GROUP BY ALL HAVING bool_and(cell = '' OR "row" % 4 = 1)""",
    "empty_runs": rf"""
        SELECT doc_id, min(pos) AS first, count(*) AS size
        FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {_LINES} WHERE pos % 7 IN (2, 3, 6) OR regexp_matches(line, '^[\s\pZ]*$')) GROUP BY doc_id, island HAVING count(*) >= 2""",
    "value_predicates": rf"""
        WITH {_CELLS} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(cell, '\p{{Nd}}') AND regexp_matches(cell, '^[\s\p{{Nd}}.,\-/원만억천백십개%()~–—:]+$')) AS n_numeric,
            count(*) FILTER (WHERE cell <> '' AND length(cell) <= 20 AND NOT regexp_matches(cell, '[,，;/·•∙ㆍ、|&]|및|총괄|담당|수행|자문')) AS n_names,
            count(*) FILTER (WHERE cell = '' OR regexp_matches(cell, '^[○●\-.\s]+$') OR cell IN ('http://', 'https://') OR regexp_matches(cell, '^[\p{{Nd}},.\s]+$')
                OR (length(cell) <= 2 AND NOT regexp_matches(cell, '[\pL\pN]'))) AS n_empty FROM c GROUP BY 1""",
    "doc_type_scores": """
        WITH v AS (
            SELECT doc_id, contains(t, 'the ')::int + contains(t, ' and ')::int + contains(t, 'tion')::int + contains(t, 'ing ')::int AS a,
                   contains(t, 'token')::int + contains(t, ' = ')::int + contains(t, '::')::int + contains(t, 'http')::int AS b FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))
        SELECT doc_id, CASE WHEN a > b AND a >= 2 THEN 'prose' WHEN b > a AND b >= 2 THEN 'code' ELSE 'other' END AS domain,
               cast(CASE WHEN a > b AND a >= 2 THEN round(least(0.95, 0.5 + a * 0.1), 4) WHEN b > a AND b >= 2 THEN round(least(0.95, 0.5 + b * 0.1), 4) ELSE 0.3 END AS double) AS confidence FROM v""",
    "secret_scan_counts": " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS n_docs FROM documents" for r, p in {**T.SECRETS, "SECRET_HEX_TOKEN": '"[0-9a-f]{40}"'}.items()
    ),
    "golden_term_presence": r"""
        WITH a AS (
            SELECT doc_id AS i, CASE WHEN doc_id % 7 = 0 THEN -1 - doc_id ELSE doc_id + 1 - doc_id % 2 * 2 END AS d, regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1) AS term FROM documents),
        j AS (SELECT i, term, doc_id, coalesce(text, '') AS t FROM a LEFT JOIN documents ON doc_id = d),
        s AS (
            SELECT i, CASE WHEN doc_id IS NULL THEN 'FILE_MISSING' WHEN i % 5 = 0 THEN 'SKIPPED'
                WHEN contains(regexp_replace(lower(t), '[\s,·._\-–—:/()\[\]{}]+', '', 'g'), lower(term))
                    AND (i % 3 <> 0 OR list_contains(list_transform(regexp_extract_all(t, '[0-9]+(?:[\s,._-]+[0-9]+)*'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), '7')) THEN 'FOUND' ELSE 'READ_MISS' END AS status FROM j)
        SELECT i % 10 AS digit, status, count(*) AS n FROM s GROUP BY ALL""",
    "citation_allowlist": rf"""
        WITH p AS (SELECT page_id, {_SIMPLE_URL} AS url FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS u FROM pages))
        SELECT DISTINCT url FROM p WHERE page_id % 2 = 0 AND url <> '' AND url NOT IN (SELECT url FROM p WHERE page_id % 2 = 1)""",
    "unusable_materials": """
        SELECT CASE WHEN p_size % 7 = 0 OR trim(p_name) = '' THEN 'EMPTY' WHEN p_size % 5 = 0 OR trim(p_brand) = '' THEN 'NO_SOURCE' WHEN p_size % 11 = 0 THEN 'BLOCKED_STATE' ELSE 'USABLE' END AS reason, count(*) AS n
        FROM part GROUP BY 1""",
    "section_status": """
        WITH s AS (SELECT p_brand AS section_id, list_sort(list(DISTINCT string_split(p_type, ' ')[1]))[1:2] AS cats FROM part GROUP BY 1),
        m AS (SELECT p_partkey AS id, p_brand AS field, p_size % 2 = 0 AS fact, string_split(p_type, ' ')[1] AS cat FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 11 <> 0),
        u AS (SELECT section_id, m.* FROM s JOIN m ON list_contains(cats, cat)),
        ap AS (SELECT r.p_brand AS req, section_id FROM (SELECT DISTINCT p_brand FROM part) r JOIN s ON CASE WHEN length(r.p_brand) % 2 = 0 THEN section_id = r.p_brand ELSE list_contains(cats, 'ECONOMY') END),
        mi AS (SELECT section_id, count(*) AS n FROM ap WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.section_id = ap.section_id AND fact AND field = req) GROUP BY 1),
        x AS (
            SELECT s.section_id, (SELECT count(DISTINCT id) FROM u WHERE u.section_id = s.section_id) AS n_materials, coalesce(mi.n, 0) AS n_missing, 0::bigint AS n_blocking,
                   list_contains(cats, 'PROMO')::bigint AS n_conflicts FROM s LEFT JOIN mi USING (section_id))
        SELECT *, CASE WHEN n_materials = 0 THEN 'NO_USABLE_MATERIAL' WHEN n_missing > 0 OR n_conflicts > 0 THEN 'PARTIAL_WRITABLE' ELSE 'WRITABLE' END AS status FROM x""",
    "run_summaries": """
        SELECT o_orderpriority AS run, count(*) AS n_docs, cast(count(*) AS integer) AS n_set, round_even(avg(o_orderkey % 101), 2) AS avg_total, round_even(avg(o_custkey % 7), 2) AS avg_layout FROM orders GROUP BY 1""",
    "ratchet_status": """
        WITH g AS (
            SELECT c_nationkey AS k, c_custkey % 2 AS odd, count(*) AS n, round(avg(c_acctbal), 2) AS a, count(*) FILTER (WHERE c_acctbal < -990) AS bad FROM customer GROUP BY 1, 2),
        j AS (
            SELECT x.k, x.n, x.a, x.bad, y.n AS bn, y.a AS ba, y.k IS NOT NULL AS known, x.k % 6 <> 0 AS same FROM g x LEFT JOIN g y ON y.k = x.k AND y.odd = 0 AND y.k % 9 <> 0 WHERE x.odd = 1),
        f AS (SELECT *, CASE WHEN known THEN concat_ws(',', CASE WHEN bad > 0 THEN 'tests_failed' END, CASE WHEN n < bn THEN 'tests_passed' END, CASE WHEN same AND a < ba - 1e-9 THEN 'avg_total' END) ELSE '' END AS failures FROM j)
        SELECT k AS c_nationkey, CASE WHEN NOT known THEN 'SEED' WHEN failures <> '' THEN 'FAIL' WHEN NOT same THEN 'RESET' WHEN n > bn OR a > ba + 1e-9 THEN 'IMPROVED' ELSE 'OK' END AS status, failures = '' AS passed, failures FROM f""",
    "score_plateaus": """
        WITH g AS (SELECT o_custkey, o_orderkey, o_orderkey % 37 AS t, lag(o_orderkey % 37) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS w FROM orders)
        SELECT o_custkey, count(*) FILTER (WHERE t - w < 2) AS n_plateaus, min(CASE WHEN t < w THEN o_orderkey END) AS first_drop FROM g GROUP BY 1""",
    "lowest_scores": """
        SELECT o_custkey, o_orderkey, total FROM (SELECT o_custkey, o_orderkey, o_orderkey % 37 AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 37, o_orderkey) AS nth FROM orders) WHERE nth = 1""",
    "form_coverage": """
        WITH m AS (SELECT c_nationkey AS company, c_mktsegment AS field, count(DISTINCT right(c_name, 1)) > 3 AS clash FROM customer GROUP BY 1, 2),
        l AS (SELECT DISTINCT c_custkey % 50 AS form, c_custkey % 50 % 29 AS company, c_mktsegment AS field FROM customer WHERE c_custkey % 3 <> 0),
        n AS (SELECT c_custkey % 50 AS form_id, count(*) FILTER (WHERE c_custkey % 3 = 0) AS unmapped FROM customer GROUP BY 1),
        k AS (SELECT form, count(*) FILTER (WHERE NOT clash) AS fillable, count(*) FILTER (WHERE clash) AS conflict, count(*) FILTER (WHERE clash IS NULL) AS missing FROM l LEFT JOIN m USING (company, field) GROUP BY 1)
        SELECT form_id, coalesce(fillable, 0) AS fillable, coalesce(conflict, 0) AS conflict, coalesce(missing, 0) AS missing, unmapped, coalesce(fillable + conflict + missing, 0) AS mappable,
               cast(CASE WHEN coalesce(fillable + conflict + missing, 0) > 0 THEN round_even(100.0 * fillable / (fillable + conflict + missing), 1) ELSE 0 END AS double) AS coverage_pct FROM n LEFT JOIN k ON form = form_id""",
    "source_ranks": rf"""
        WITH f AS (SELECT {_HOST} AS target, '/' || page_id || regexp_extract(url, '([^/]*)$', 1) AS path, page_id FROM pages),
        h AS (SELECT *, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1') AS stem FROM f),
        k AS (SELECT *, contains(lower(stem), '1')::int + contains(lower(stem), '2')::int AS keyword_hits FROM h)
        SELECT target, path, keyword_hits, cast(rank AS integer) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY keyword_hits DESC, page_id DESC, path) AS rank FROM k) WHERE rank <= 5""",
    "asset_match_margin": f"""
        WITH a AS (SELECT s_suppkey, ['a', 'b', 'unclassified'][s_nationkey % 3 + 1] AS c, CASE WHEN s_nationkey % 2 = 0 THEN 't' END AS t, CASE WHEN s_nationkey % 5 = 0 THEN 'large' ELSE 'brass' END AS w FROM supplier),
        b AS (SELECT p_type, min(p_size) AS z FROM part GROUP BY 1),
        d AS (SELECT p_type, ['a', 'b', 'unclassified'][z % 3 + 1] AS dc, CASE WHEN z % 2 = 0 THEN 't' ELSE 'u' END AS dt, z FROM b),
        s AS (
            SELECT s_suppkey AS anchor_id, p_type AS asset_id,
                   {_PAIRS.format(
                       k="CASE WHEN c = 'unclassified' OR dc = 'unclassified' THEN 0.15::double WHEN c = dc THEN 1 ELSE 0 END",
                       w="(contains(lower(p_type), 'tin')::int + contains(lower(p_type), w)::int) / 2",
                       t="CASE WHEN t IS NULL THEN 0.4::double WHEN t = dt THEN 1 ELSE 0.2 END",
                       p="CASE WHEN z * 100000 >= 480000 THEN 1::double WHEN z * 100000 >= 120000 THEN 0.7 WHEN z > 0 THEN 0.4 ELSE 0.3 END",
                   )} AS score FROM a, d),
        r AS (SELECT *, row_number() OVER w AS nth, round(score - coalesce(lead(score) OVER w, 0), 6) AS margin FROM s WINDOW w AS (PARTITION BY anchor_id ORDER BY score DESC, asset_id))
        SELECT anchor_id, asset_id, cast(score AS double) AS score, cast(margin AS double) AS margin, CASE WHEN score >= 0.78 AND margin >= 0.08 THEN 'auto' WHEN score >= 0.6 THEN 'review' ELSE 'none' END AS decision FROM r WHERE nth = 1""",
    "masking_candidates": rf"""
        WITH l AS (SELECT *, last_value(CASE WHEN length(line) < 40 AND NOT contains(line, '.') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM {_LINES}),
        m AS (
            SELECT *, 'email' AS kind, unnest(regexp_extract_all(line, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}')) AS match FROM l
            UNION ALL SELECT *, 'phone', unnest(regexp_extract_all(line, '0[0-9]{{1,2}}[-.\s]?[0-9]{{3,4}}[-.\s]?[0-9]{{4}}')) FROM l
            UNION ALL SELECT *, 'university', unnest(regexp_extract_all(line, '대학교|대학원|전문대학')) FROM l
            UNION ALL SELECT *, 'name', unnest(regexp_extract_all(line, '성명|대표자|책임자|연구책임|주관기관장')) FROM l)
        SELECT doc_id, cast(pos AS integer) AS pos, substring(coalesce(h, ''), 1, 80) AS heading, match, substring(regexp_replace(line, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), 1, 100) AS context, kind FROM m""",
    "structure_fidelity": f"""
        WITH n AS (SELECT doc_id, doc_id // 2 AS pair_id, length(text) AS c, len(string_split(text, ' ')) AS t, len(string_split(text, chr(10))) AS p FROM documents WHERE text IS NOT NULL)
        SELECT pair_id, {", ".join(f"cast(CASE WHEN greatest(a.{x}, b.{x}) = 0 THEN 100 ELSE round_even(least(a.{x}, b.{x}) / greatest(a.{x}, b.{x}) * 100.0::double, 2) END AS double) AS {name}" for x, name in (("p", "paragraphs"), ("c", "chars"), ("t", "tokens")))}
        FROM n a JOIN n b USING (pair_id) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1""",
    "first_edits": """
        WITH o AS (
            SELECT o_orderkey, o_orderstatus AS draft, CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 5 = 0 THEN 'else' ELSE o_orderstatus END AS before,
                   CASE o_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN o_orderstatus ELSE 'new' END AS after FROM orders WHERE o_custkey % 7 <> 0)
        SELECT o_orderkey, CASE WHEN trim(after) = '' THEN 'draft_rejected' ELSE 'edited' END AS action, before, after FROM o WHERE before = draft AND after <> before""",
    "duplicate_texts": "SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "table_facets": "SELECT array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE trim(lang) <> '')), ',') AS lang, array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE trim(source) <> '')), ',') AS source FROM documents",
}
