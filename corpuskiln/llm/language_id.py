"""Language identification by words first, then by ever shorter character n-grams.

A word the model knows is scored by its log frequency in each language. An unseen word is scored by its longest n-grams that
the model knows: if none of its 4-grams is known, by its 3-grams, and so on down to single characters. A text's score is
the posterior of the best language under equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpuskiln.llm.pretokens import letter_words
from corpuskiln.llm.storage import durable, quoted
from corpuskiln.llm.words import Lookup, lookup, pieces, release, tidy

#: The bound of the model: labelled documents of each language it is fitted on; all their words and n-grams are kept. The longest n-gram.
TRAINING_DOCS, LONGEST = 5_000, 4
#: Letters of a word whose n-grams are taken at once, and n-grams looked up at once.
PIECE, GRAMS = 61, 500_000
#: Bytes of text that are split into words at once.
BYTES = 1 << 20
SMOOTHING = 0.1
UNDETERMINED = "und"


@dataclass
class Scores:
    """Terms, and for each its log frequency in every language."""

    terms: Lookup
    values: np.ndarray

    def places(self, terms: pa.Array) -> np.ndarray:
        """Each term's row among the values; -1 if it is not known."""
        return self.terms.places(terms)


def _grams(words: list[str], which: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The n-grams of the words in `which`, each with its word's place, GRAMS or fewer at once."""
    owners, grams = [], []
    for i in which:
        for at in range(0, len(words[i]) - n + 1, GRAMS):
            own = [words[i][j : j + n] for j in range(at, min(at + GRAMS, len(words[i]) - n + 1))]
            if len(grams) + len(own) > GRAMS and grams:
                yield np.array(owners, np.int64), grams
                owners, grams = [], []
            owners += [i] * len(own)
            grams += own
    if grams:
        yield np.array(owners, np.int64), grams


@dataclass
class Model:
    """languages, and the scores of the known words and of the n-grams of each length from 1 on."""

    languages: list[str]
    words: Scores
    ngrams: list[Scores]

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word, the mean score of its known n-grams of the greatest length of which any is known; else zeros."""
        out = np.zeros((len(words), len(self.languages)))
        left = np.arange(len(words))
        padded = [f"<{w}>" for w in words]
        for n in range(LONGEST, 0, -1):
            sums, held = np.zeros(out.shape), np.zeros(len(words), np.int64)
            for owners, grams in _grams(padded, left, n):
                place = self.ngrams[n - 1].places(pa.array(grams, pa.string()))
                owners, values = owners[place >= 0], self.ngrams[n - 1].values[place[place >= 0]]
                held += np.bincount(owners, minlength=len(words))
                for k in range(out.shape[1]):
                    sums[:, k] += np.bincount(owners, values[:, k], len(words))
            out += sums / np.maximum(held, 1)[:, None]
            left = left[held[left] == 0]
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in pieces(batch, "text", BYTES):
            words = letter_words(docs.column(1))
            langs = docs.column(0).to_pylist()
            for lang in set(langs):
                mine = np.concatenate([words.codes[a:b] for l, a, b in zip(langs, words.offsets[:-1], words.offsets[1:], strict=True) if l == lang])
                counts = np.bincount(mine, minlength=len(words.vocabulary))
                held = np.flatnonzero(counts)
                own = words.vocabulary.take(pa.array(held)).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), own, pa.array(counts[held].astype(np.int64))], names=["lang", "word", "n"])
        release()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is never learned from: crc32 of the id as text is divisible by `folds`, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame) -> Model:
    """A model of the labelled documents that are not held out: of each language all, or about TRAINING_DOCS chosen by a hash of their ids."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    sizes = docs.sparkSession.createDataFrame([(r.lang, r.n) for r in by_lang], "lang string, n long")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < F.lit(1_000_000_000.0) * TRAINING_DOCS / F.col("n")
    counts = rows.join(F.broadcast(sizes), "lang").filter(share).select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
    return model_of(counts, [r.lang for r in by_lang])


def model_of(counts: DataFrame, languages: list[str]) -> Model:
    """The model of the counts (lang, word, n); languages without counts are left out.

    Words and n-grams are counted in Spark; only the tables of the model, which the bound on its documents bounds, come to the driver.
    """
    by = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]
    by_word = durable(counts.groupBy("word").agg(F.sum("n").alias("n"), *by).drop("n"), "word-counts")
    sums = by_word.agg(F.count("*"), *again).first()
    counted = [i for i in range(len(languages)) if sums[i + 1]]
    by_word = by_word.select("word", *(F.col(f"n{i}").alias(f"n{k}") for k, i in enumerate(counted)))
    languages = [languages[i] for i in counted]
    again = again[: len(languages)]

    def scores(table: DataFrame, kind: pa.DataType) -> Scores:
        best = table.toArrow()
        terms, order = lookup(best.column(0).combine_chunks().cast(pa.binary()).cast(kind))
        values = np.zeros((best.num_rows, len(languages)), np.float32)
        for i in range(len(languages)):
            n = best.column(f"n{i}").to_numpy() + SMOOTHING
            values[:, i] = np.log(n / n.sum())
        return Scores(terms, values[order])

    ngrams = []
    # Pieces overlap by what the longest n-gram that starts in the first PIECE letters of one needs of the next.
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    overlapping = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{1,{PIECE + LONGEST - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    numbers = [f"n{i}" for i in range(len(languages))]
    for size in range(1, LONGEST + 1):
        starts = F.sequence(F.lit(1), F.least(F.lit(PIECE), F.char_length("piece") - size + 1))
        grams = F.when(F.char_length("piece") >= size, F.transform(starts, lambda i: F.substring("piece", i, F.lit(size))))
        table = by_word.select(F.explode(overlapping).alias("piece"), *numbers).select(F.explode(grams).alias("gram"), *numbers).groupBy("gram").agg(F.count("*").alias("words"), *again).drop("words")
        ngrams.append(scores(table, pa.string()))
    model = Model(languages, scores(by_word, pa.large_binary()), ngrams)
    tidy()
    return model


def _told(model: Model, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The language and score of each text."""
    k = len(model.languages)
    words = letter_words(texts)
    table = np.zeros((len(words.vocabulary), k))
    place = model.words.places(words.vocabulary)
    table[place >= 0] = model.words.values[place[place >= 0]]
    fresh = pa.array(place < 0)
    table[place < 0] = model.unseen([w.decode() for w in words.vocabulary.filter(fresh).to_pylist()])
    sums = np.vstack([np.zeros((1, k)), np.cumsum(table[words.codes], axis=0)])
    totals = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
    some = (np.diff(words.offsets) > 0) & (k > 0)
    langs, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if k:
        best = totals.argmax(1)
        score = np.where(some, 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1), 0.0)
        langs = [model.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
    return pa.array(langs, pa.string()), pa.array(score, pa.float64())


TOLD = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def told(model: Model, text: Column) -> Column:
    """struct<lang_pred, score> of a text; only the texts go to the Python workers, and only this comes back."""

    held = [model]

    @F.arrow_udf(TOLD)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Each task has its own copy of the model, and lets it go at its end, so that a worker kept for later tasks does not hold it.
        own = held.pop()
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            found = [_told(own, part.column(0)) for part in pieces(batch, "text", BYTES)]
            langs, score = (pa.concat_arrays([f[i] for f in found] or [pa.array([], kind)]) for i, kind in enumerate((pa.string(), pa.float64())))
            yield pa.StructArray.from_arrays([langs, score], names=["lang_pred", "score"])
            release()
        del own
        tidy()

    # Else the optimiser would run it once in a filter and again in the projection below.
    return run.asNondeterministic()(text)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs`.

    A text that is null or has no letters is `und` with a score of 0, and so is every text if the model has no language.
    Ties go to the language first in order. Rows are scored one by one, whatever their ids; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), told(model, F.col("text")).alias("told"))
    return rows.select("doc_id", "held_out", "told.lang_pred", "told.score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is determined with a score of at least `least`; a null lang is filled in.

    Null texts, and texts without letters, go; so does every row if the model has no language. Rows are judged one by one, so
    repeated rows stay or go alike, whatever their ids. All columns are carried along, whatever their names; lang may be missing.
    """
    names = docs.columns
    scored = docs.select(F.struct(*map(quoted, names)).alias("row"), told(model, docs["text"]).alias("told"))
    kept = scored.filter((F.col("told.lang_pred") != UNDETERMINED) & (F.col("told.score") >= least))
    own = F.col("row").getField
    return kept.select(*((F.coalesce(own(c), "told.lang_pred") if c == "lang" else own(c)).alias(c) for c in names))
