"""The training-data pipeline: each stage applies one operator to all that the stage before kept.

Documents whose language cannot be told go; one document of each group of near duplicates (five-word shingles, similarity 0.8
or more) stays; documents with a benchmark passage go; personal data and terms that give it away are replaced; what is left is
encoded as token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskiln.llm import byte_bpe, decontamination, language_id, near_duplicates, pii
from corpuskiln.llm.storage import drop_since, durable, last, mark


#: Rows that go to a Python worker at once. Whole texts travel, so the session's own number, which suits short rows, would hold too much in an executor.
ROWS_AT_ONCE = 1000


def _bounded(spark: SparkSession) -> None:
    """Holds the batches of this session's Python workers at ROWS_AT_ONCE, if they are not smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that can be told with a score of 0.5 or more; a null lang is filled in.

    Null, empty and letterless texts go. Repeated rows stay or go alike; ties go to the language first in order; a table without
    a labelled text learns no language and so keeps nothing; an empty one stays empty; other columns stay as they are.
    """
    _bounded(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id, with all its rows.

    Null and wordless texts, and rows with a null id, stay; rows that share an id are one document with several texts; an empty
    table stays empty; columns are carried along, whatever their names.
    """
    _bounded(spark)
    return near_duplicates.drop_near_duplicates(docs, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of ten words of the benchmark, or without a whole shorter item.

    Each row stays or goes by its own text, whatever its id; null and empty texts stay; an empty table, or an empty benchmark,
    changes nothing; columns are carried along, whatever their names.
    """
    _bounded(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and secrets, and terms that give them away, replaced; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are changed alike; overlapping spans are replaced as one; an empty
    table stays empty; other columns are carried along, whatever their names.
    """
    _bounded(spark)
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their digests of every row.

    A null text is empty and has no ids; repeated rows and null ids each keep their row; an empty table gives no rows; other
    columns are left behind.
    """
    _bounded(spark)
    return byte_bpe.encode(docs, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", sanitise),
    ("tokens", encode),
]

#: Signatures, a corpus model of disclosure and BPE merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in order, each written as Parquet and read again by the next.

    What a stage has written for itself, and what it has read, goes once its own result is written.
    """
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(spark, start, last())
    return STAGES[-1][1](spark, docs, sf_dir)
