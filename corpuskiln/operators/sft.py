"""Training examples from generation traces and people's feedback on them.

Traces have a row for each question of each draft: project_id, qid, label, kind, context, system, answer and seq. Feedback has
project_id, qid, action (edited or draft_rejected), after and seq. A key is (project_id, qid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.masking import mask_facts
from corpuskiln.functions.text import normal_label

KEY = ["project_id", "qid"]
_BLANK = r"^[\s\p{Z}]*$"


def is_blank(text: Column) -> Column:
    """Whether a text is null, empty or white space."""
    return F.coalesce(text, F.lit("")).rlike(_BLANK)


def fold_feedback(feedback: DataFrame) -> DataFrame:
    """project_id, qid, approved and rejected of every key with feedback.

    approved is the last edit that is not blank, null without one; a key is rejected if any row rejects its draft and no such
    edit exists, whatever the order. Ties of seq go to the greater text.
    """
    edit = (F.col("action") == "edited") & ~is_blank(F.col("after"))
    folded = feedback.groupBy(*KEY).agg(
        F.max(F.when(edit, F.struct("seq", "after")))["after"].alias("approved"),
        F.coalesce(F.max(F.col("action") == "draft_rejected"), F.lit(False)).alias("any_rejection"),
    )
    return folded.select(*KEY, "approved", (F.col("any_rejection") & F.col("approved").isNull()).alias("rejected"))


def prompt(label: Column, qid: Column, context: Column) -> Column:
    """The user message: the item to write, its context and the request (fixed text)."""
    item = F.when(is_blank(label), qid).otherwise(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.concat(
        F.lit("[작성 항목] "), item, F.lit("\n[참고 컨텍스트]\n"), F.coalesce(context, F.lit("")), F.lit("\n\n위 '작성 항목'을 참고 컨텍스트에 근거해 한국어로 작성하세요.")
    )


def examples(traces: DataFrame, feedback: DataFrame, mask: bool = False) -> DataFrame:
    """One example for each key: project_id, qid, label, kind, source (human or ai), system, user, assistant and first_seq.

    A person's edit replaces the answer, rejected keys and blank answers go, and of several traces of a key the last that is
    left counts; examples come in the order of first_seq, the seq at which their key was first left.
    """
    held = traces.join(fold_feedback(feedback), KEY, "left").filter(~F.coalesce("rejected", F.lit(False)))
    held = held.withColumn("assistant", F.coalesce("approved", "answer")).filter(~is_blank(F.col("assistant")))
    by_key = W.partitionBy(*KEY)
    held = held.withColumn("first_seq", F.min("seq").over(by_key)).withColumn("nth", F.row_number().over(by_key.orderBy(F.col("seq").desc(), F.col("answer").desc())))
    user, assistant = prompt(F.col("label"), F.col("qid"), F.col("context")), F.col("assistant")
    if mask:
        user, assistant = mask_facts(user), mask_facts(assistant)
    return held.filter("nth = 1").select(
        *KEY,
        F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.when(F.col("approved").isNotNull(), "human").otherwise("ai").alias("source"),
        F.coalesce("system", F.lit("")).alias("system"),
        user.alias("user"),
        assistant.alias("assistant"),
        "first_seq",
    )


def chat_lines(found: DataFrame) -> DataFrame:
    """value: a JSON line with messages and meta for each example; write it with `.write.text`."""
    message = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))
    return found.select(F.to_json(F.struct(F.array(*map(message, ("system", "user", "assistant"))).alias("messages"), F.struct(*KEY, "label", "source").alias("meta"))).alias("value"))


def few_shots(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """label_key and answers: the distinct approved answers of each label, facts masked, in the order of their last edits.

    Only sections count (a key of unknown kind does); labels without letters or digits, and answers that are blank once masked,
    do not.
    """
    last = W.partitionBy(*KEY).orderBy(F.col("seq").desc())
    about = traces.withColumn("nth", F.row_number().over(last)).filter("nth = 1").select(*KEY, "label", "kind")
    edits = feedback.filter((F.col("action") == "edited") & ~is_blank(F.col("after"))).groupBy(*KEY).agg(F.min("seq").alias("seen"))
    held = fold_feedback(feedback).filter("approved is not null").join(edits, KEY).join(about, KEY)
    held = held.filter(F.coalesce("kind", F.lit("")).isin("", "section")).withColumn("label_key", normal_label(F.col("label")))
    held = held.withColumn("answer", F.regexp_replace(mask_facts(F.col("approved")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).filter("label_key <> '' and answer <> ''")
    first = held.groupBy("label_key", "answer").agg(F.min(F.struct("seen", *KEY)).alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "answer"))), lambda x: x["answer"])
    return first.groupBy("label_key").agg(ordered.alias("answers"))


def suggest(questions: DataFrame, shots: DataFrame, most: int = 2) -> DataFrame:
    """The section questions with examples: question_id, label and the first `most` answers of the label's key."""
    asked = questions.filter("kind = 'section'").withColumn("label_key", normal_label(F.col("label"))).filter("label_key <> ''")
    return asked.join(shots, "label_key").select("question_id", "label", F.slice("answers", 1, most).alias("examples"))


def export_counts(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row of counts: traces, feedbacks, examples, human_approved, ai_only and learned_labels."""
    by_source = examples(traces, feedback).agg(F.count("*").alias("examples"), F.coalesce(F.sum((F.col("source") == "human").cast("long")), F.lit(0)).alias("human_approved"))
    rows = traces.agg(F.count("*").alias("traces")).crossJoin(feedback.agg(F.count("*").alias("feedbacks"))).crossJoin(by_source)
    rows = rows.crossJoin(few_shots(traces, feedback).agg(F.count("*").alias("learned_labels")))
    return rows.select("traces", "feedbacks", "examples", "human_approved", (F.col("examples") - F.col("human_approved")).alias("ai_only"), "learned_labels")
