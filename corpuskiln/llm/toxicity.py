"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons of insults in four languages, fixed patterns (someone addressed with an insult,
dismissals, threats, masked swearing, shouting), learned words, learned word beginnings and densities. Each says toxic, not
toxic or nothing. A generative label model estimates, without looking at single labels, how often each voter is right and
how voters go together, and gives every training text a posterior label. A linear classifier is trained on those
posteriors; its scores are finally set against the training labels so that they can be read as probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.pretokens import letter_words
from corpuskiln.llm.storage import durable
from corpuskiln.llm.words import pieces, release

#: The bound: labelled texts that are learned from; all their terms that pass the tests below are kept.
TRAINING_DOCS = 20_000
#: A term's likelihood ratio statistic must be this high, which chance hardly reaches among a million terms, and so many toxic texts must hold it.
LEAST_G, LEAST_DOCS = 25.0, 4
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Insults by language; they come from no labels.
LEXICONS = {
    "en": "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown clowns dumb fool fools jerk jerks creep creeps filth filthy vermin coward cowards liar liars imbecile cretin bastard bastards asshole bitch shit crap fuck fucking",
    "de": "idiot idioten trottel dummkopf dumm blöd blöde abschaum versager dreck dreckig arschloch wichser schwein schweine penner depp deppen widerlich wertlos erbärmlich lügner scheiße scheiss verpiss",
    "fr": "idiot idiote idiots imbécile imbéciles crétin crétins stupide ordure ordures minable pathétique débile débiles abruti abrutis salaud connard conne connasse merde putain dégueulasse nul menteur",
    "es": "idiota idiotas imbécil imbéciles estúpido estúpida basura escoria patético patética inútil asqueroso asquerosa tonto tonta payaso payasos cabrón mierda puta maldito mentiroso",
}
INSULTS = frozenset(w for words in LEXICONS.values() for w in words.split())
#: Patterns by name; they come from no labels either.
PATTERNS = {
    "dismissal": re.compile(r"(?i)\b(?:shut up|get lost|go away|nobody (?:likes|wants) you|halt(?: die)? (?:klappe|maul|fresse)|hau ab|ferme[- ]la|casse[- ]toi|ta gueule|cállate|lárgate|vete al infierno)\b"),
    "threat": re.compile(r"(?i)\b(?:(?:i|we)(?:'ll| will| am going to| are going to) (?:kill|hurt|find|destroy) you|ich (?:bringe dich um|mach dich fertig)|je vais te (?:tuer|trouver)|te voy a (?:matar|encontrar)|drop dead|kill yourself)\b"),
    "masked": re.compile(r"\b[A-Za-z][*#@$]{2,}[A-Za-z]?\b|[@#$%&*!]{4,}"),
    "shouting": re.compile(r"(?:\b[^\W\d_a-z]{3,}\b[ ,]+){3}|!{3,}"),
}
ADDRESS = re.compile(r"(?i)\b(?:you|your|du|ihr|dein|tu|vous|usted|eres)\b(?:\W+\w+){0,3}?\W+(\w+)")


def learned_from(doc_id: Column, folds: int = 3) -> Column:
    """Whether a document may be learned from: crc32 of the id as text does not leave 1, and the id is not null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != 1, F.lit(False))


def terms_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in pieces(batch, "text"):
            words, counts = letter_words(docs.column(0)), {}
            terms = [terms_of(w.decode()) for w in words.vocabulary.to_pylist()]
            for toxic, a, b in zip(docs.column(1).to_pylist(), words.offsets[:-1], words.offsets[1:], strict=True):
                for term in {t for c in np.unique(words.codes[a:b]) for t in terms[c]}:
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (1, 0))], names=["term", "toxic", "other"])


@dataclass
class Lexicon:
    """The learned terms with their log odds, and each term's place."""

    terms: dict[str, int]
    odds: np.ndarray
    beginning: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


@dataclass
class Looks:
    """What voters and classifier see of a text: learned terms and their counts, insults of each lexicon, insults that address someone, matches of each pattern, words."""

    places: np.ndarray
    counts: np.ndarray
    insults: np.ndarray
    addressed: int
    matches: np.ndarray
    words: int


def look(texts: pa.Array, lexicon: Lexicon) -> Iterator[Looks]:
    """The looks of each text; a null text looks like an empty one."""
    words = letter_words(texts)
    vocabulary = [w.decode() for w in words.vocabulary.to_pylist()]
    held: dict[int, list[int]] = {}
    lexicons = [frozenset(words.split()) for words in LEXICONS.values()]
    fixed = np.zeros((len(vocabulary), len(lexicons)), bool)
    for i, w in enumerate(vocabulary):
        if mine := [lexicon.terms[t] for t in terms_of(w) if t in lexicon.terms]:
            held[i] = mine
        if w in INSULTS:
            fixed[i] = [w in words for words in lexicons]
    hot = np.zeros(len(vocabulary), bool)
    hot[list(held)] = True
    for d, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
        own = words.codes[a:b]
        counts: dict[int, int] = {}
        for c in own[hot[own]]:
            for p in held[int(c)]:
                counts[p] = counts.get(p, 0) + 1
        text = texts[d].as_py() or ""
        insults = fixed[own].sum(0)
        addressed = sum(m[1].lower() in INSULTS for m in ADDRESS.finditer(text)) if insults.any() else 0
        matches = np.array([sum(1 for _ in p.finditer(text)) for p in PATTERNS.values()])
        yield Looks(np.array(list(counts), np.int64), np.array(list(counts.values()), float), insults, addressed, matches, len(own))


#: Names of the voters, in the order of `votes`. The first lot comes from no labels.
VOTERS = (
    *(f"insults {c}" for c in LEXICONS),
    "many insults",
    "addressed",
    *PATTERNS,
    "no insults",
    "strong words",
    "many strong words",
    "beginnings",
    "dense",
    "no terms",
    "long and sparse",
)


def votes(x: Looks, lexicon: Lexicon) -> list[int]:
    """1 toxic, -1 not toxic, 0 nothing, of each voter."""
    odds = lexicon.odds[x.places]
    whole = ~lexicon.beginning[x.places] if len(x.places) else np.zeros(0, bool)
    strong, starts = int((odds[whole] > 2).sum()), int((odds[~whole] > 2).sum())
    share, insults = x.counts.sum() / max(x.words, 1), int(x.insults.max(initial=0))
    return [
        *(int(n > 0) for n in x.insults),
        int(insults > 2),
        int(x.addressed > 0),
        *(int(n > 0) for n in x.matches),
        -int(not insults and not x.matches.any()),
        int(strong > 0),
        int(strong > 2),
        int(starts > 3),
        int(share > 0.02),
        -int(not len(x.places)),
        -int(x.words > 500 and share < 0.001),
    ]


def label_model(table: np.ndarray, rate: float, rounds: int = 100) -> np.ndarray:
    """The posterior of class 1 for each row of votes (1, -1, 0), by expectation maximisation.

    Each voter has its own chances of voting 1, -1 and 0 in either class. Voters that go together within the classes count
    less: each one's evidence is divided by the square root of the sum of its absolute correlations, within classes, with all
    voters.
    """
    patterns, at, n = np.unique(table, axis=0, return_inverse=True, return_counts=True)
    at = at.ravel()
    hot = np.stack([patterns == v for v in (1, -1, 0)], 2).astype(float)
    vote = patterns.sum(1)
    post = np.where(vote > 0, 0.9, 0.1 * rate)
    weight = np.ones(patterns.shape[1])
    for _ in range(rounds):
        chances = []
        for p in (post, 1 - post):
            mass = (p * n)[:, None, None] * hot
            chances.append((mass.sum(0) + 0.5) / ((p * n).sum() + 1.5))
        spread = patterns.astype(float) - np.outer(post, (chances[0] @ [1, -1, 0])) - np.outer(1 - post, (chances[1] @ [1, -1, 0]))
        cov = (spread * n[:, None]).T @ spread / n.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        weight = 1 / np.maximum(1, np.abs(cov / np.outer(sd, sd)).sum(0) ** 0.5)
        evidence = ((np.log(chances[0]) - np.log(chances[1])) * hot).sum(2) @ weight
        new = 1 / (1 + np.exp(-np.clip(evidence + np.log(rate / (1 - rate)), -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6:
            break
    return post[at]


#: Features of a text besides its learned terms.
SUMS = 8 + len(PATTERNS)


def features(x: Looks, beginning: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: its learned terms, then the sums over beginnings and over whole words."""
    size = len(beginning)
    values = np.log1p(x.counts)
    sums = [np.log1p(x.insults.max(initial=0)), np.log1p(x.addressed), *np.log1p(x.matches)]
    for kind in (beginning[x.places], ~beginning[x.places]):
        held = x.counts[kind]
        sums += [np.log1p(held.sum()), np.log1p(len(held)), min(1.0, 20 * held.sum() / max(x.words, 1))]
    return np.append(x.places, size + np.arange(SUMS)), np.append(values, sums)


def _logistic(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, rounds: int = 300, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by Adam over the whole sample."""
    at = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    places, values = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(at, values * w[places], len(rows)) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.append(np.bincount(places, values * off[at], size) + decay * w[:-1] / size, off.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def _cut(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make 1 / (1 + exp(-(scale * score + shift))) fit the labels best."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        g, h = p - labels, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * scores**2).sum() + 1e-3, (h * scores).sum()], [(h * scores).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * scores).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(a, 1e-3), b


def _looks(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in pieces(batch, "text"):
                found = list(look(docs.column(0), lexicon))
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.column(1),
                        pa.array([x.places.tolist() for x in found], pa.list_(pa.int64())),
                        pa.array([x.counts.tolist() for x in found], pa.list_(pa.float64())),
                        *(pa.array([getattr(x, c).tolist() for x in found], pa.list_(pa.int64())) for c in ("insults", "matches")),
                        *(pa.array([getattr(x, c) for x in found], pa.int64()) for c in ("addressed", "words")),
                    ],
                    names=["toxic", "places", "counts", "insults", "matches", "addressed", "words"],
                )

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicons and classifier from the labelled texts that may be learned from, or about TRAINING_DOCS of them by a hash of their ids.

    Labels that are null are left out; of several labels of one id, and of equal texts,
    the largest counts; equal texts are learned from once.
    """
    known = labels.filter(F.col("toxic").isNotNull() & learned_from(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, TRAINING_DOCS / max(total, 1))))
    sample = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # The largest label, so that it does not depend on the order of rows.
    sample = sample.groupBy(F.md5("text").alias("h")).agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = durable(sample.select("text", "toxic"), "labelled")
    rows, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counted = sample.mapInArrow(_count_terms, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (rows - toxic + 1))
    held, base = F.col("toxic") + F.col("other"), toxic / max(rows, 1)
    share = F.col("toxic") / held
    ratio = 2 * (F.col("toxic") * F.log(share / base) + F.when(share < 1, F.col("other") * F.log((1 - share) / (1 - base))).otherwise(0.0))
    told = (F.col("toxic") >= LEAST_DOCS) & (F.col("odds") > 1.5) & (F.col("g") >= LEAST_G)
    best = counted.withColumns({"odds": odds, "g": ratio}).filter(told).orderBy(F.col("g").desc(), "term").collect() if 0 < toxic < rows else []
    lexicon = Lexicon({r.term: i for i, r in enumerate(best)}, np.array([r.odds for r in best]), np.array([r.term.endswith("*") for r in best], bool))
    seen = sample.mapInArrow(_looks(lexicon), "toxic int, places array<long>, counts array<double>, insults array<long>, matches array<long>, addressed long, words long").toArrow()
    looks = [Looks(*(np.array(r[c], kind) for c, kind in (("places", np.int64), ("counts", float), ("insults", np.int64))), r["addressed"], np.array(r["matches"], np.int64), r["words"]) for r in seen.to_pylist()]
    size = len(best)
    lexicon.weights, lexicon.bias = np.zeros(size + SUMS), -2.0
    if looks and 0 < toxic < rows:
        posterior = label_model(np.array([votes(x, lexicon) for x in looks]), toxic / rows)
        found = [features(x, lexicon.beginning) for x in looks]
        w, bias = _logistic(found, posterior, size + SUMS)
        a, b = _cut(np.array([v @ w[p] + bias for p, v in found]), seen.column("toxic").to_numpy().astype(float))
        lexicon.weights, lexicon.bias = a * w, a * bias + b
    return lexicon


def _score(lexicon: Lexicon, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in pieces(batch, "text"):
                z = np.array([v @ lexicon.weights[p] + lexicon.bias for p, v in (features(x, lexicon.beginning) for x in look(docs.column(2), lexicon))])
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
            release()

    return run


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    Null texts are scored as empty ones. A row with a null id counts as held out. Without any toxic label to learn from,
    every score is the same low one. Rows are scored one by one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learned_from(F.col("doc_id"))).alias("held_out"), "text")
    return rows.mapInArrow(_score(lexicon, threshold), "doc_id long, held_out boolean, score double, predicted int")
