"""Matching of labels, sections, requirements and snippets by keys first and by similarity last."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuskiln.functions.predicates import bracket_conflict, is_dummy_value, looks_like_name
from corpuskiln.functions.text import bare, letters
from corpuskiln.operators.sections import related

FUZZY = 0.6


def _rarest_first(keys: DataFrame, every: DataFrame) -> DataFrame:
    """key, size and its characters as ranks, rarest first: rank 1 is the character that fewest of all keys hold. There are as many ranks as characters, and they are broadcast."""
    letters_ = every.select(F.explode(letters(F.col("key"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    ranks = letters_.withColumn("rank", F.row_number().over(W.orderBy("n", "c")))
    ranked = keys.select("key", F.explode(letters(F.col("key"))).alias("c")).join(F.broadcast(ranks), "c")
    return ranked.groupBy("key").agg(F.array_sort(F.collect_list("rank")).alias("ranks")).withColumn("size", F.size("ranks"))


def _similar(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """target, source and similarity of the pairs of keys with a similarity of FUZZY or more, or one inside the other with lengths at most 2 apart.

    Two sets that are FUZZY alike share o = ceil(FUZZY * n) of the n characters of either, and the first two that they share,
    in one order of all characters, are among its first n - o + 2. So keys meet by pairs of such characters, the rarest first,
    and only if their sizes allow it; a single character meets the same one. Keys within each other share the
    longer one with a character or two deleted, so each key is indexed under what is left of it without up to 2 characters at its ends.
    """
    every = targets.select("key").unionByName(sources.select("key"))
    t, s = (_rarest_first(x.select("key").distinct(), every) for x in (targets, sources))

    def prefixes(rows: DataFrame, name: str) -> DataFrame:
        first = F.slice("ranks", 1, F.col("size") - F.ceil(F.col("size") * FUZZY).cast("int") + 2)
        pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        alone = F.array(F.struct(F.get("ranks", F.lit(0)).alias("a"), F.lit(0).alias("b")))
        return rows.select(F.col("key").alias(name), F.col("size").alias(f"{name}_size"), F.explode(F.when(F.col("size") == 1, alone).otherwise(pairs)).alias("c"))

    least, most = (f("target_size", "source_size") for f in (F.least, F.greatest))
    by_letters = prefixes(t, "target").join(prefixes(s, "source"), "c").filter(least >= FUZZY * most).select("target", "source")

    def within(rows: DataFrame, name: str) -> DataFrame:
        cuts = [(i, j) for i in range(3) for j in range(3 - i)]
        n = F.char_length("key")
        ends = F.array(*(F.when(n > i + j, F.substring(F.col("key"), F.lit(1 + i), n - i - j)) for i, j in cuts))
        return rows.select(F.col("key").alias(name), F.explode(F.array_distinct(F.array_compact(ends))).alias("core"))

    # One side whole, the other without what stands around the first in it.
    whole = lambda rows, name: rows.select(F.col("key").alias(name), F.col("key").alias("core"))
    inside = within(t, "target").join(whole(s, "source"), "core").unionByName(whole(t, "target").join(within(s, "source"), "core").select("core", "target", "source"))
    pairs = by_letters.unionByName(inside.select("target", "source")).distinct()
    both = F.size(F.array_intersect(letters(F.col("target")), letters(F.col("source"))))
    similarity = F.round(both / (F.size(letters(F.col("target"))) + F.size(letters(F.col("source"))) - both), 9)
    near = (F.contains("target", F.col("source")) | F.contains("source", F.col("target"))) & (F.abs(F.char_length("target") - F.char_length("source")) <= 2)
    return pairs.withColumn("similarity", similarity).filter((F.col("similarity") >= FUZZY) | near)


def match_labels(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """target, source, confidence and candidates of every distinct target key; rows have key and cluster (null if none).

    An equal key is high; so is the one source of the target's synonym clusters, and several are a conflict; else sources with
    a character-set similarity of 0.6 or more, or containing or contained with a length at most 2 apart, are only suggested
    (fuzzy, the most similar ones); else low. A key that stands in several clusters is one target with the sources of all.
    """
    keys = targets.select("key").distinct()
    exact = keys.join(sources.select("key").distinct(), "key", "left_semi").select("key", F.col("key").alias("exact"))
    own = targets.filter("cluster is not null").select("key", "cluster").distinct()
    hits = own.join(sources.filter("cluster is not null").select("cluster", F.col("key").alias("hit")), "cluster").groupBy("key").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    left = keys.join(exact, "key", "left").join(hits, "key", "left")
    top = _similar(targets, sources).withColumn("best", F.max("similarity").over(W.partitionBy("target"))).filter("similarity = best")
    fuzzy = top.groupBy(F.col("target").alias("key")).agg(F.array_sort(F.collect_set("source")).alias("near"))
    none = F.array().cast("array<string>")
    confidence = F.when(F.col("exact").isNotNull() | (F.size("hits") == 1), "high").when(F.size("hits") > 1, "conflict").when(F.col("near").isNotNull(), "fuzzy").otherwise("low")
    candidates = F.when(F.col("exact").isNotNull() | (F.size("hits") == 1), none).when(F.size("hits") > 1, F.col("hits")).otherwise(F.coalesce("near", none))
    source = F.coalesce("exact", F.when(F.size("hits") == 1, F.get("hits", F.lit(0))))
    return left.join(fuzzy, "key", "left").select(F.col("key").alias("target"), source.alias("source"), confidence.alias("confidence"), candidates.alias("candidates"))


def demoted(fields: DataFrame, matched: DataFrame, values: DataFrame, form: str, is_name: Column) -> DataFrame:
    """The fields of forms with source, value, confidence and candidates after the demotions of high matches.

    fields: form, key, label, pos, cluster; matched: as `match_labels` gives; values: source, label (as written) and value.
    bracket: the labels differ in their parentheses; duplicate: an earlier field of the form with that key stays high;
    value_type: a name's field (is_name, over the fields' columns) whose value is no name. Demoted fields have no value, and
    their source becomes a candidate.
    """
    own = values.select("source", F.col("label").alias("source_label"), F.col("value").alias("found"))
    rows = fields.join(matched.withColumnRenamed("target", "key"), "key").join(own, "source", "left")
    high = F.col("confidence") == "high"
    why = F.when(bracket_conflict(F.coalesce("source_label", F.col("source")), F.col("label")), "bracket").when(is_name & ~looks_like_name(F.col("found")), "value_type")
    rows = rows.withColumn("why", F.when(high, why))
    # Of the high matches of one key, only those that no other rule demotes count for the first.
    before = F.count(F.when(high & F.col("why").isNull(), 1)).over(W.partitionBy(form, "key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("why", F.when(high & ((F.col("why") != "bracket") | F.col("why").isNull()) & (before > 0), "duplicate").otherwise(F.col("why")))
    candidates = F.when(F.col("why").isNotNull() & (F.size("candidates") == 0), F.array("source")).otherwise(F.col("candidates"))
    kept = high & F.col("why").isNull()
    return rows.select(
        form, "key", "label", "pos", F.when(kept, F.col("source")).alias("source"), F.when(kept, F.col("found")).alias("value"), F.coalesce("why", "confidence").alias("confidence"), candidates.alias("candidates")
    )


def confirmed(fields: DataFrame, confirmations: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fields with confirmations applied, and notes (key, source, note) on those that were not.

    confirmations: key, source, of people; they replace whatever is not high, in every field of the key, if the source has a
    value that is not blank; else the note is no_value, and no_target where no such field is.
    """
    own = values.filter(F.coalesce("value", F.lit("")) != "").select(F.col("source").alias("said"), F.col("value").alias("found"))
    said = confirmations.select("key", F.col("source").alias("said")).join(own, "said", "left")
    rows = fields.join(said, "key", "left").withColumn("confirmed", (F.col("confidence") != "high") & F.col("found").isNotNull())
    pick = lambda new, old: F.when(F.col("confirmed"), new).otherwise(F.col(old)).alias(old)
    out = rows.select(*(pick(F.col("said"), c) if c == "source" else pick(F.col("found"), c) if c == "value" else pick(F.lit("confirmed"), c) if c == "confidence" else F.col(c) for c in fields.columns))
    open_ = fields.filter("confidence <> 'high'").select("key").distinct().withColumn("open", F.lit(True))
    notes = said.join(open_, "key", "left").filter(F.col("open").isNull() | F.col("found").isNull())
    return out, notes.select("key", F.col("said").alias("source"), F.when(F.col("open").isNull(), "no_target").otherwise("no_value").alias("note"))


def chosen_options(groups: DataFrame, options: DataFrame, normal: Mapping[str, str]) -> DataFrame:
    """group_id, option and decision of each group of options.

    groups: group_id, value (of the matched source, null if none), value_key; options: group_id, option (place), option_key.
    Keys equal after `normal` (known synonyms to one form) are hits, and just one checks its option (high); several are
    ambiguous, none no_match; a dummy value is a placeholder, and no value no_source.
    """
    table = F.create_map(*(F.lit(x) for kv in normal.items() for x in kv)) if normal else None
    plain = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) if table is not None else F.col(c)
    met = groups.select("group_id", plain("value_key").alias("on")).join(options.filter("option_key <> ''").select("group_id", "option", plain("option_key").alias("on")), ["group_id", "on"])
    hits = met.groupBy("group_id").agg(F.count("*").alias("n"), F.min("option").alias("hit"))
    rows = groups.join(hits, "group_id", "left")
    blank = F.coalesce("value", F.lit("")) == ""
    decision = F.when(blank, "no_source").when(is_dummy_value(F.col("value")), "placeholder").when(F.col("n") == 1, "high").when(F.col("n") > 1, "ambiguous").otherwise("no_match")
    return rows.select("group_id", F.when(decision == "high", F.col("hit")).alias("option"), decision.alias("decision"))


def section_materials(sections: DataFrame, materials: DataFrame) -> DataFrame:
    """section_id and material_id that belong together; both inputs have an id, categories and tokens (arrays).

    They match if their categories meet; if both have categories that do not meet they never match; otherwise they match if
    a token is shared.
    """
    return related(sections, materials, "section_id", "material_id")


def missing_requirements(requirements: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """The required rows (required defaults to true) for which nothing matched."""
    return requirements.filter(F.coalesce("required", F.lit(True))).join(matched.select(*key).distinct(), key, "left_anti")


def top_snippets(questions: DataFrame, snippets: DataFrame, k: int = 4, least: float = 1.0) -> DataFrame:
    """question_id, rank, snippet_id and score of each question's k best snippets, not exclusive; ties to the smaller id.

    score: twice the shared tokens. Both inputs have an id and tokens. A token that many rows of both sides hold makes as many
    pairs, whose rows AQE splits among tasks; leave such words out of the tokens by a stop list where they tell nothing.
    """
    met = questions.select("question_id", F.explode("tokens").alias("t")).join(snippets.select("snippet_id", F.explode("tokens").alias("t")), "t")
    scored = met.groupBy("question_id", "snippet_id").agg((2.0 * F.count("*")).alias("score")).filter(F.col("score") >= least)
    order = W.partitionBy("question_id").orderBy(F.col("score").desc(), "snippet_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("question_id", "rank", "snippet_id", "score")


def named_options(confirms: DataFrame, options: DataFrame) -> DataFrame:
    """confirm, label and status of each confirmation that is not blank.

    options: label, aliases (array). exact: it is a label or alias, the first such option (seq) counts; loose: just one label
    has a key that holds it or that it holds; else ambiguous or unknown, without a label. The options are the few of one form,
    and each confirmation meets them all; they are broadcast only by Spark's own size limit.
    """
    said = confirms.select(bare(F.col("confirm")).alias("confirm")).filter("confirm <> ''").distinct()
    keys = options.select("label", "seq", F.explode(F.array_union(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k"))
    met = said.join(keys, F.contains("confirm", F.col("k")) | F.contains("k", F.col("confirm")), "left")
    hits = met.groupBy("confirm").agg(
        F.min(F.when(F.col("k") == F.col("confirm"), F.struct("seq", "label")))["label"].alias("exact"), F.collect_set("label").alias("loose")
    )
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.size("loose") == 1, "loose").when(F.size("loose") > 1, "ambiguous").otherwise("unknown")
    return hits.select("confirm", F.coalesce("exact", F.when(F.size("loose") == 1, F.col("loose")[0])).alias("label"), status.alias("status"))


def narrative_unmatched(unmatched: DataFrame, labels: DataFrame) -> DataFrame:
    """The unmatched targets (label) that a form's narrative labels name: equal, or one within the other, without regard to case; a form's labels are few."""
    named = labels.filter("kind = 'narrative'").select(F.lower(bare(F.col("label"))).alias("n")).filter("n <> ''").distinct()
    own = F.lower(bare(F.col("label")))
    return unmatched.filter(own != "").join(named, F.contains(own, F.col("n")) | F.contains("n", own), "left_semi")


def pair_scores(matched: DataFrame, pair: list[str]) -> DataFrame:
    """The number of high matches of each pair of a source and a target; 0 for a pair without any."""
    return matched.groupBy(*pair).agg(F.sum((F.col("confidence") == "high").cast("long")).alias("score"))


def ranked_snippets(questions: DataFrame, snippets: DataFrame, keywords: Sequence[str] = (), k: int = 4, least: float = 1.0) -> DataFrame:
    """question_id, rank, snippet_id and score of each question's k best snippets of `least` or more, not exclusive; ties to the smaller id.

    score: twice the shared tokens, half a point for each keyword in the snippet's text, -1.5 for texts under 50 characters and
    -1 for those over 280. Snippets have text besides; questions and snippets without tokens take no part. A snippet that shares
    nothing can only be among the best if it is one of the k best by text alone, so just these meet every question.
    """
    text = F.coalesce("text", F.lit(""))
    own = sum((F.contains(text, F.lit(w)).cast("int") * 0.5 for w in keywords), F.lit(0.0)) + F.when(F.char_length(text) < 50, -1.5).when(F.char_length(text) > 280, -1.0).otherwise(0.0)
    held = snippets.filter(F.size("tokens") > 0).select("snippet_id", "tokens", own.alias("own"))
    asked = questions.filter(F.size("tokens") > 0)
    shared = asked.select("question_id", F.explode("tokens").alias("t")).join(held.select("snippet_id", F.explode("tokens").alias("t")), "t").groupBy("question_id", "snippet_id").agg((2.0 * F.count("*")).alias("shared"))
    alone = held.orderBy(F.col("own").desc(), "snippet_id").limit(k).select("snippet_id")
    pairs = shared.unionByName(asked.select("question_id").join(F.broadcast(alone)).withColumn("shared", F.lit(0.0)))
    scored = pairs.groupBy("question_id", "snippet_id").agg(F.max("shared").alias("shared")).join(held.select("snippet_id", "own"), "snippet_id").withColumn("score", F.col("shared") + F.col("own"))
    order = W.partitionBy("question_id").orderBy(F.col("score").desc(), "snippet_id")
    ranked = scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("question_id", "rank", "snippet_id", "score")


def exclusively(scored: DataFrame, group: str, k: int = 4) -> DataFrame:
    """group, question_id and snippet_id: each question of a group, in order (seq), takes its k best snippets that no earlier one has.

    scored: group, question_id, seq, snippet_id and score, with all snippets of a question that may be taken. A group is one
    document's questions and its library, which the caller bounds; groups are independent and spread over tasks.
    """

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        kept = []
        rows = rows.sort_values(["seq", "question_id", "score", "snippet_id"], ascending=[True, True, False, True], kind="stable")
        for _, own in rows.groupby(["seq", "question_id"], sort=False):
            mine = own[~own.snippet_id.isin(used)].head(k)
            used |= set(mine.snippet_id)
            kept.append(mine[[group, "question_id", "snippet_id"]])
        return pd.concat(kept)

    return scored.groupBy(group).applyInPandas(take, StructType([scored.schema[c] for c in (group, "question_id", "snippet_id")]))
