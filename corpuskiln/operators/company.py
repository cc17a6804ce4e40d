"""Fields of companies: labels to canonical fields by a table of synonyms, what a form can be filled with, and what is missing.

Synonyms are data: a table of cluster (the representative) and alias, as label keys (see `functions.text.label_key`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare, label_key

#: The fields of a company, and words that tell a role from a name.
COMPANY_FIELDS = ("기업명", "대표자", "사업자등록번호", "설립일", "업종", "주소", "연락처", "이메일", "홈페이지", "직원수", "자본금", "팩스")
NAME_FIELD = "대표자"
ROLE_WORDS = ("총괄", "담당", "수행", "자문", "대표이사", "및 ")


def synonym_table(spark: SparkSession, clusters: Mapping[str, Sequence[str]]) -> DataFrame:
    """alias and cluster, both as label keys, of a mapping from representative to aliases; an alias of several clusters is of the last."""
    rows = {a: c for c, aliases in clusters.items() for a in (c, *aliases)}
    table = spark.createDataFrame(list(rows.items()), "alias string, cluster string")
    return table.select(label_key(F.col("alias")).alias("alias"), label_key(F.col("cluster")).alias("cluster")).dropDuplicates(["alias"])


def with_field(rows: DataFrame, label: str, synonyms: DataFrame, fields: Sequence[str] = COMPANY_FIELDS) -> DataFrame:
    """`rows` with the column field: the canonical field of the label's cluster, null if it has none. The synonyms are few and are broadcast."""
    known = F.when(F.col("cluster").isin(list(fields)), F.col("cluster"))
    table = synonyms.select(F.col("alias").alias("label alias"), known.alias("field"))
    return rows.join(F.broadcast(table), label_key(F.col(label)) == F.col("label alias"), "left").drop("label alias")


def valid_value(field: Column, value: Column, is_label: Column) -> Column:
    """Whether a value may stand in a field: not blank, 200 characters at most, no label itself; a name has 20 at most, no comma and no role."""
    held = bare(value)
    name = (F.char_length(held) <= 20) & ~F.contains(held, F.lit(",")) & ~F.greatest(*(F.contains(held, F.lit(w)) for w in ROLE_WORDS))
    return (held != "") & (F.char_length(held) <= 200) & ~is_label & F.when(field == NAME_FIELD, name).otherwise(True)


def first_valid(pairs: DataFrame, synonyms: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, field, value and raw_label: the first valid value of each field of a document, from its pairs (label, value) in order."""
    own = with_field(pairs, "label", synonyms).filter("field is not null")
    as_label = synonyms.select(F.col("alias").alias("value alias"), F.col("cluster").isin(list(COMPANY_FIELDS)).alias("is_label"))
    held = own.join(F.broadcast(as_label), label_key(F.col("value")) == F.col("value alias"), "left")
    held = held.filter(valid_value(F.col("field"), F.col("value"), F.coalesce("is_label", F.lit(False))))
    nth = F.row_number().over(W.partitionBy(key, "field").orderBy(*order))
    return held.withColumn("nth", nth).filter("nth = 1").select(key, "field", bare(F.col("value")).alias("value"), bare(F.col("label")).alias("raw_label"))


def missing_fields(held: DataFrame, key: str, fields: Sequence[str] = COMPANY_FIELDS) -> DataFrame:
    """key and missing: the fields, in their fixed order, of which a company has no row."""
    own = held.groupBy(key).agg(F.collect_set("field").alias("own"))
    return own.select(key, F.array_except(F.array(*map(F.lit, fields)), "own").alias("missing"))


def coverage(labels: DataFrame, master: DataFrame, form: str = "form_id", company: str = "company_id", order: str = "pos") -> DataFrame:
    """form, fillable, conflict, missing, unmapped, mappable and coverage_pct (one place) of each form.

    labels: form, company, field (null if it maps to none), pos; a field that a form asks for again counts once, by its first
    label. master: company, field, value, confidence. A blank value is missing.
    """
    nth = F.row_number().over(W.partitionBy(form, "field").orderBy(order))
    asked = labels.withColumn("nth", nth).filter("field is null or nth = 1").drop("nth")
    held = asked.join(master.select(company, "field", "value", "confidence"), [company, "field"], "left")
    status = F.when(F.col("field").isNull(), "unmapped").when(bare(F.col("value")) == "", "missing").when(F.col("confidence") == "conflict", "conflict").otherwise("fillable")
    counts = held.withColumn("status", status).groupBy(form).agg(*(F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("fillable", "conflict", "missing", "unmapped")))
    mappable = F.col("fillable") + F.col("conflict") + F.col("missing")
    return counts.withColumn("mappable", mappable).withColumn("coverage_pct", F.when(mappable > 0, F.bround(100.0 * F.col("fillable") / mappable, 1)).otherwise(0.0))
