"""Chat examples for fine-tuning, from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.masking import mask_facts
from corpuskiln.operators import sft
from corpuskiln.sources.tables import table


def sft_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example for each assistant turn that follows a user turn, with the conversation's system turn.

    Facts are masked, blank answers are left out, and of equal questions the last turn's answer stays.
    """
    turns = table(spark, sf_dir, "conversations")
    by_turn = W.partitionBy("conv_id").orderBy("turn")
    flat = (
        turns.withColumn("prev_role", F.lag("role").over(by_turn))
        .withColumn("question", F.lag("text").over(by_turn))
        .withColumn("system", F.max(F.when(F.col("role") == "system", F.col("text"))).over(W.partitionBy("conv_id")))
        .filter((F.col("role") == "assistant") & (F.col("prev_role") == "user") & (F.trim("text") != ""))
    )
    last = W.partitionBy("conv_id", "question").orderBy(F.col("turn").desc())
    return (
        flat.withColumn("rn", F.row_number().over(last))
        .filter("rn = 1")
        .select(
            "conv_id",
            "turn",
            mask_facts(F.coalesce("system", F.lit(""))).alias("system_text"),
            mask_facts(F.col("question")).alias("user_text"),
            mask_facts(F.col("text")).alias("assistant_text"),
        )
    )


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as logs: each answer to a user is a draft of a question, named by the question's first two words; some answers are edited, some rejected."""
    by_turn = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(by_turn)).withColumn("prev_role", F.lag("role").over(by_turn))
    drafts = turns.filter("role = 'assistant' and prev_role = 'user'").withColumn("key", (F.col("turn") % 4).cast("string"))
    traces = drafts.select(
        F.col("conv_id").cast("string").alias("project_id"),
        F.col("key").alias("qid"),
        F.substring_index("asked", " ", 2).alias("label"),
        F.when(F.col("turn") % 3 == 0, "cell").otherwise("section").alias("kind"),
        F.col("asked").alias("context"),
        F.lit("system").alias("system"),
        F.col("text").alias("answer"),
        F.col("turn").cast("long").alias("seq"),
    )
    said = drafts.filter("(conv_id + turn) % 3 <> 0")
    feedback = said.select(
        F.col("conv_id").cast("string").alias("project_id"),
        F.col("key").alias("qid"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 1, "edited").otherwise("draft_rejected").alias("action"),
        F.when(F.col("conv_id") % 11 == 0, "  ").otherwise(F.concat(F.lit("Edited 7: "), "text")).alias("after"),
        F.col("turn").cast("long").alias("seq"),
    )
    return traces, feedback


def sft_feedback_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approved text of each question with feedback, and whether its draft is rejected."""
    return sft.fold_feedback(_logs(spark, sf_dir)[1])


def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples that traces and feedback give, facts masked."""
    return sft.examples(*_logs(spark, sf_dir), mask=True).drop("user")


def sft_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export holds."""
    return sft.export_counts(*_logs(spark, sf_dir))


def few_shot_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approved answers of each label, facts masked."""
    found = sft.few_shots(*_logs(spark, sf_dir))
    return found.select("label_key", F.size("answers").alias("n"), F.array_join(F.array_sort("answers"), "|").alias("answers"))


def few_shot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examples each section question of the conversations finds, two at most."""
    traces, feedback = _logs(spark, sf_dir)
    asked = traces.select(F.concat_ws(":", "project_id", "seq").alias("question_id"), "label", "kind")
    return sft.suggest(asked, sft.few_shots(traces, feedback)).select("question_id", "label", F.size("examples").alias("n_examples"))


QUERIES = {f.__name__: f for f in (sft_chat_examples, sft_feedback_fold, sft_examples, sft_counts, few_shot_corpus, few_shot_lookup)}

# The masks as DuckDB's engine writes them, apart from those of the library.
_EMAIL, _RESIDENT, _PHONE = r"[\pL\pN_.+-]+@[\pL\pN_-]+[.][\pL\pN_.-]+", r"\p{Nd}{6}[\s\pZ]*-[\s\pZ]*\p{Nd}{7}", r"0\p{Nd}{1,2}[-\s\pZ]?\p{Nd}{3,4}[-\s\pZ]?\p{Nd}{4}"


def mask_sql(column: str, facts: bool = False) -> str:
    """The masked text in DuckDB."""
    masked = f"regexp_replace(regexp_replace(regexp_replace({column}, '{_EMAIL}', '[이메일]', 'g'), '{_RESIDENT}', '[주민번호]', 'g'), '{_PHONE}', '[전화]', 'g')"
    return rf"regexp_replace({masked}, '\p{{Nd}}+', 'N', 'g')" if facts else masked


_LOGS = """
        c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM conversations),
        tr AS (
            SELECT cast(conv_id AS varchar) AS project_id, cast(turn % 4 AS varchar) AS qid,
                   array_to_string(string_split(asked, ' ')[1:2], ' ') AS label, CASE WHEN turn % 3 = 0 THEN 'cell' ELSE 'section' END AS kind, text AS answer, turn AS seq, conv_id
            FROM c WHERE role = 'assistant' AND prev_role = 'user'),
        fb AS (
            SELECT project_id, qid, CASE WHEN (conv_id + seq) % 3 = 1 THEN 'edited' ELSE 'draft_rejected' END AS action,
                   CASE WHEN conv_id % 11 = 0 THEN '  ' ELSE 'Edited 7: ' || answer END AS after, seq FROM tr WHERE (conv_id + seq) % 3 <> 0),
        ok AS (SELECT project_id, qid, arg_max(after, seq) AS approved, min(seq) AS seen FROM fb WHERE action = 'edited' AND trim(after) <> '' GROUP BY 1, 2),
        fo AS (
            SELECT k.project_id, k.qid, approved, approved IS NULL AND k.no AS rejected
            FROM (SELECT project_id, qid, bool_or(action = 'draft_rejected') AS no FROM fb GROUP BY 1, 2) k LEFT JOIN ok USING (project_id, qid)),
        ex AS (
            SELECT *, row_number() OVER (PARTITION BY project_id, qid ORDER BY seq DESC) AS nth, min(seq) OVER (PARTITION BY project_id, qid) AS first_seq
            FROM (SELECT tr.*, coalesce(approved, answer) AS said, CASE WHEN approved IS NULL THEN 'ai' ELSE 'human' END AS source FROM tr LEFT JOIN fo USING (project_id, qid) WHERE NOT coalesce(rejected, false))
            WHERE trim(said) <> ''),
        la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, qid ORDER BY seq DESC) AS nth FROM tr) WHERE nth = 1),
        sh AS (
            SELECT DISTINCT lower(regexp_replace(label, '[^\\pL\\pN]+', '', 'g')) AS label_key, trim({answer}) AS answer
            FROM ok JOIN la USING (project_id, qid) WHERE kind = 'section'),
        fs AS (SELECT label_key, count(*) AS n, array_to_string(list_sort(list(answer)), '|') AS answers FROM sh WHERE label_key <> '' AND answer <> '' GROUP BY 1)
""".format(answer=mask_sql("approved", True)).replace("\\\\", "\\")

ORACLES = {
    "sft_chat_examples": f"""
        WITH t AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
                   lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question,
                   max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys
            FROM conversations),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, question ORDER BY turn DESC) AS rn
            FROM t WHERE role = 'assistant' AND prev_role = 'user' AND trim(text) <> '')
        SELECT conv_id, turn, {mask_sql("coalesce(sys, '')", True)} AS system_text,
               {mask_sql("question", True)} AS user_text, {mask_sql("text", True)} AS assistant_text
        FROM r WHERE rn = 1""",
    "sft_feedback_fold": f"WITH {_LOGS} SELECT project_id, qid, approved, rejected FROM fo",
    "sft_examples": f"""
        WITH {_LOGS} SELECT project_id, qid, label, kind, source, 'system' AS system, {mask_sql("said", True)} AS assistant, cast(first_seq AS bigint) AS first_seq FROM ex WHERE nth = 1""",
    "sft_counts": f"""
        WITH {_LOGS}, n AS (SELECT count(*) AS examples, cast(count(*) FILTER (WHERE source = 'human') AS bigint) AS human_approved FROM ex WHERE nth = 1)
        SELECT (SELECT count(*) FROM tr) AS traces, (SELECT count(*) FROM fb) AS feedbacks, examples, human_approved, examples - human_approved AS ai_only,
               (SELECT count(*) FROM fs) AS learned_labels FROM n""",
    "few_shot_corpus": f"WITH {_LOGS} SELECT label_key, cast(n AS integer) AS n, answers FROM fs",
    "few_shot_lookup": f"""
        WITH {_LOGS} SELECT project_id || ':' || seq AS question_id, label, cast(least(n, 2) AS integer) AS n_examples
        FROM (SELECT *, lower(regexp_replace(label, '[^\\pL\\pN]+', '', 'g')) AS label_key FROM tr WHERE kind = 'section') JOIN fs USING (label_key)""",
}
