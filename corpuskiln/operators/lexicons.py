"""Classification and coverage by lexicons, which are data: class or area -> words with weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import holds_any, weight


def classify(docs: DataFrame, lexicon: Mapping[str, Mapping[str, int]], least: int = 4, unknown: str = "unknown") -> DataFrame:
    """doc_id, label, score, runner_up and confidence: the class of greatest weight, ties to the one declared first; below `least` unknown.

    confidence: 0.4, 0.4 of the best score's share of all, and 0.2 of its lead over the next; 0.99 at most; 0.3 for unknown.
    """
    lower = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    each = lower.select("doc_id", *(weight(F.col("text"), words).alias(f"class {i}") for i, words in enumerate(lexicon.values())))
    scores = [F.col(f"class {i}") for i in range(len(lexicon))]
    ranked = [F.struct(s.alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("label")) for i, (s, name) in enumerate(zip(scores, lexicon, strict=True))]
    total = sum((F.greatest(s, F.lit(0)) for s in scores), F.lit(0))
    second = F.coalesce(F.get(F.sort_array(F.array(*scores), asc=False), F.lit(1)), F.lit(0))
    rows = each.select("doc_id", (F.greatest(*ranked) if len(ranked) > 1 else ranked[0]).alias("top"), second.alias("runner_up"), total.alias("total"))
    top, runner_up = F.col("top"), F.col("runner_up")
    lead = F.least(F.lit(1.0), (top["score"] - runner_up) / F.greatest(F.lit(1), top["score"]))
    sure = F.least(F.lit(0.99), 0.4 + 0.4 * (top["score"] / F.greatest(F.lit(1), F.col("total"))) + 0.2 * lead)
    sure = F.round(F.when(top["score"] >= least, sure).otherwise(0.3), 6)
    return rows.select("doc_id", F.when(top["score"] >= least, top["label"]).otherwise(unknown).alias("label"), top["score"].alias("score"), runner_up.alias("runner_up"), sure.alias("confidence"))


def coverage(docs: DataFrame, areas: Mapping[str, Mapping[str, list[str]]]) -> DataFrame:
    """doc_id, area, n_hit, n_items and ratio: the items of an area of which any word occurs."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = F.array(
        *(
            F.struct(F.lit(area).alias("area"), sum((F.when(holds_any(text, words), 1).otherwise(0) for words in items.values()), F.lit(0)).alias("n_hit"), F.lit(len(items)).alias("n_items"))
            for area, items in areas.items()
        )
    )
    found = docs.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")
    return found.withColumn("ratio", F.round(F.col("n_hit") / F.col("n_items"), 4))


def graded(found: DataFrame, bands: Mapping[str, float]) -> DataFrame:
    """`coverage` with the grade of each area, the first band (in falling order) that its ratio reaches, and overall, the share of all of a document's items that are hit."""
    own = W.partitionBy("doc_id")
    grade = F.coalesce(*(F.when(F.col("ratio") >= least, F.lit(name)) for name, least in bands.items()))
    return found.withColumn("grade", grade).withColumn("overall", F.round(F.sum("n_hit").over(own) / F.sum("n_items").over(own), 4))
