"""Pictures for places of a document: classes by votes of lexicons, scores of pairs, the best with its margin, and what is left without one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

UNCLASSIFIED = "unclassified"
#: The weights of a pair's score, and what makes a match automatic or worth a review.
WEIGHTS = {"class": 0.35, "keyword": 0.30, "type": 0.20, "size": 0.10, "free": 0.05}
AUTO, REVIEW, MARGIN = 0.78, 0.60, 0.08


def voted(text: Column, lexicon: Mapping[str, Sequence[str]], folder: Column | None = None, folders: Mapping[str, str] | None = None) -> Column:
    """The class whose words occur most often (each once); none or a tie is unclassified. A folder's pattern, where one matches, decides alone."""
    t = F.lower(F.coalesce(text, F.lit("")))
    votes = F.array(*(F.struct(sum((F.contains(t, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(c).alias("class")) for c, words in lexicon.items()))
    most = F.array_max(F.transform(votes, lambda v: v["n"]))
    best = F.filter(votes, lambda v: v["n"] == most)
    by_text = F.when((most > 0) & (F.size(best) == 1), best[0]["class"]).otherwise(UNCLASSIFIED)
    hints = [F.when(F.coalesce(folder, F.lit("")).rlike(p), F.lit(c)) for p, c in (folders or {}).items()] if folder is not None else []
    return F.coalesce(*hints, by_text)


def domain(text: Column, first: tuple[str, Sequence[str]], second: tuple[str, Sequence[str]], other: str = "other") -> Column:
    """struct<domain, confidence>: the one of two domains with strictly more of its words, two at least; confidence is 0.5 and 0.1 a word, 0.95 at most."""
    t = F.lower(F.coalesce(text, F.lit("")))
    a, b = (sum((F.contains(t, F.lit(w.lower())).cast("int") for w in words), F.lit(0)) for _, words in (first, second))
    sure = lambda n: F.round(F.least(F.lit(0.95), 0.5 + n * 0.1), 4)
    name = F.when((a > b) & (a >= 2), first[0]).when((b > a) & (b >= 2), second[0]).otherwise(other)
    return F.struct(name.alias("domain"), F.when(name == first[0], sure(a)).when(name == second[0], sure(b)).otherwise(0.3).alias("confidence"))


def scored_pairs(anchors: DataFrame, assets: DataFrame) -> DataFrame:
    """anchor_id, asset_id and score of every anchor and asset.

    anchors: anchor_id, class, type, keywords (array); assets: asset_id, class, type, text, pixels. The anchors of a document are
    few (8 by their rule), and each meets all assets, as the rule asks; the assets are broadcast only by Spark's own size limit.
    """
    a = anchors.select("anchor_id", F.col("class").alias("ac"), F.col("type").alias("at"), "keywords")
    b = assets.select("asset_id", F.col("class").alias("bc"), F.col("type").alias("bt"), F.lower("text").alias("text"), F.coalesce("pixels", F.lit(0)).alias("pixels"))
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.col("text"), F.lower(k))))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = {
        "class": F.when((F.col("ac") == UNCLASSIFIED) | (F.col("bc") == UNCLASSIFIED), 0.15).when(F.col("ac") == F.col("bc"), 1.0).otherwise(0.0),
        "keyword": F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.least(F.lit(3), F.size("keywords")))),
        "type": F.when(filled("at") & filled("bt"), F.when(F.col("at") == F.col("bt"), 1.0).otherwise(0.2)).when(filled("at"), 0.5).otherwise(0.4),
        "size": F.when(F.col("pixels") >= 480_000, 1.0).when(F.col("pixels") >= 120_000, 0.7).when(F.col("pixels") > 0, 0.4).otherwise(0.3),
        "free": F.lit(1.0),
    }
    score = sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    return a.join(b).select("anchor_id", "asset_id", F.round(score, 6).alias("score"))


def best_assets(pairs: DataFrame) -> DataFrame:
    """anchor_id, asset_id, score, margin (to the next; the score itself without one) and decision of each anchor, an asset serving any number of them: auto, review or none."""
    order = W.partitionBy("anchor_id").orderBy(F.col("score").desc(), "asset_id")
    top = pairs.withColumn("nth", F.row_number().over(order)).withColumn("margin", F.round(F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0)), 6)).filter("nth = 1")
    decision = F.when((F.col("score") >= AUTO) & (F.col("margin") >= MARGIN), "auto").when(F.col("score") >= REVIEW, "review").otherwise("none")
    return top.select("anchor_id", "asset_id", "score", "margin", decision.alias("decision"))


#: Distinct keywords of places, which are a lexicon's.
MOST_KEYWORDS = 10_000


def best_matches(anchors: DataFrame, assets: DataFrame) -> DataFrame:
    """As `best_assets` of `scored_pairs`, without scoring every pair.

    A score depends on an asset's class, type, size and the keywords that its text holds, and on an anchor's class, type and
    keywords; so only distinct ones of either are scored, with the two first assets of each, and the anchors are joined to what
    is best for their kind. How many kinds there are is up to the lexicons, not to the rows.
    """
    words = [r.k for r in anchors.select(F.explode("keywords").alias("k")).select(F.lower("k").alias("k")).distinct().limit(MOST_KEYWORDS + 1).collect() if r.k is not None]
    if len(words) > MOST_KEYWORDS:
        raise ValueError("keywords of anchors are those of a lexicon; there are too many")
    kind = ["class", "type", "keywords"]
    same = F.to_json(F.struct(*(F.col(c).alias(c) for c in kind)))
    named = anchors.select("anchor_id", *kind, same.alias("kind"))
    places = named.groupBy("kind").agg(*(F.any_value(c).alias(c) for c in kind)).withColumnRenamed("kind", "anchor_id")
    # Of a text only the keywords that it holds count, and of a size its band.
    held = F.array_join(F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda k: F.contains(F.lower("text"), k)), "\n")
    n = F.coalesce(F.col("pixels"), F.lit(0))
    band = F.when(n >= 480_000, 480_000).when(n >= 120_000, 120_000).when(n > 0, 1).otherwise(0)
    kinds = assets.select("asset_id", "class", "type", held.alias("text"), band.alias("pixels"))
    first = F.row_number().over(W.partitionBy("class", "type", "text", "pixels").orderBy("asset_id"))
    kinds = kinds.withColumn("nth", first).filter("nth <= 2").drop("nth")
    best = best_assets(scored_pairs(places, kinds)).withColumnRenamed("anchor_id", "kind")
    return named.select("anchor_id", "kind").join(best, "kind").drop("kind")


def missing_anchors(anchors: DataFrame, decided: DataFrame) -> DataFrame:
    """The anchors without an automatic match."""
    return anchors.join(decided.filter("decision = 'auto'").select("anchor_id"), "anchor_id", "left_anti")


def assigned(pairs: DataFrame, doc: str) -> DataFrame:
    """doc, anchor_id, asset_id and decision: as `best_assets`, but within a document an asset that an earlier place (seq) has taken automatically is no longer to be had.

    pairs: doc, seq, anchor_id, asset_id, score. A document's places are few (8 by their rule) and its library is the caller's.
    """

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for (_, anchor), own in rows.sort_values(["seq", "anchor_id", "score", "asset_id"], ascending=[True, True, False, True], kind="stable").groupby(["seq", "anchor_id"], sort=False):
            free = own[~own.asset_id.isin(used)]
            if len(free):
                best, rest = free.iloc[0], free.iloc[1:]
                margin = best.score - (rest.score.iloc[0] if len(rest) else 0.0)
                decision = "auto" if best.score >= AUTO and margin >= MARGIN - 1e-9 else "review" if best.score >= REVIEW else "none"
                used |= {best.asset_id} if decision == "auto" else set()
                out.append((rows[doc].iloc[0], anchor, best.asset_id, decision))
        return pd.DataFrame(out, columns=[doc, "anchor_id", "asset_id", "decision"])

    return pairs.groupBy(doc).applyInPandas(take, StructType([*(pairs.schema[c] for c in (doc, "anchor_id", "asset_id")), StructField("decision", StringType())]))


def suggestions(text: Column, rules: Mapping[str, Sequence[str]], most: int = 8) -> Column:
    """array<struct<line, type, keyword>>: the lines that ask for a picture, in order; each line for the first type, in the order of the rules, that none before has taken, each type once."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    words = [(t, w) for t, own in rules.items() for w in own]
    table = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(w).alias("keyword")) for t, w in words))
    asking = F.filter(lines, lambda x: F.exists(table, lambda r: F.contains(x, r["keyword"])))
    start = F.array().cast("array<struct<line:string,type:string,keyword:string>>")

    def step(taken: Column, line: Column) -> Column:
        free = F.filter(table, lambda r: F.contains(line, r["keyword"]) & ~F.exists(taken, lambda t: t["type"] == r["type"]))
        added = F.concat(taken, F.array(F.struct(line.alias("line"), free[0]["type"].alias("type"), free[0]["keyword"].alias("keyword"))))
        return F.when((F.size(free) > 0) & (F.size(taken) < most), added).otherwise(taken)

    return F.aggregate(asking, start, step)
