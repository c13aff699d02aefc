"""The reading level of a document from the acquisition grades of its words.

A word's grade is estimated from how it is spread over texts of known level: labelled documents mix sentences of several
levels with sentences that show none, so each sentence's level is a latent one, inferred by expectation maximisation from
the labels and its words. A word is known if it tells levels from none; its grade is the mean of its distribution. A
sentence's level is read from a calibrated table of the quantiles of its known words' grades, a document's is the one at
which most of its sentences that show a level are written; where none does, it is read from a calibrated table of the
median grade of all its known words. English is told from other languages by a model of character trigrams.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The levels in order.
LEVELS = ["elementary", "secondary", "undergraduate", "specialist"]

SAMPLE_DOCS = 4000  # labelled documents that the word grades are estimated from: a documented bound, drawn by hash
OTHER_DOCS = 1000  # documents marked as of another language that the trigrams of others are counted in: likewise
SAMPLE_CHARS = 20_000  # longer texts are graded like all, but not used to fit, so that the sample is bounded
MARGIN = 0.75  # by how much the mean log likelihood of a trigram may lie below that of held-out English texts
STEPS, NONE, KNOWN, BINS = 12, 4, 0.5, 12
QUANTILES = (0.3, 0.5, 0.8)
SHORT, RUN_ON, WINDOW = 6, 60, 15  # words: shorter sentences count less; longer ones are run together, and are read in windows

_TAGS = re.compile(r"\[([A-Z][A-Z_]*)\].*?\[/\1\]|\[START_SMILES\].*?\[END_SMILES\]|\[/?[A-Z][A-Z_]*\]", re.S)
_SENTENCE = re.compile(r"(?<=[.!?;。])[\"')\]]*\s+|[\n\r]+|;|, (?:and|but|while|so|whereas) ")
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*")  # the same for lower case ASCII texts


def sentences(text: str) -> list[list[str]]:
    """The words, in lower case, of each sentence; texts run together without stops are cut into windows."""
    out = []
    plain = (_TAGS.sub(". ", text) if "[" in text else text).replace("’", "'")
    word = (_ASCII_WORD if plain.isascii() else _WORD).findall
    for s in _SENTENCE.split(plain):
        words = word(s.lower())
        if len(words) > RUN_ON:
            out += [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
        elif words:
            out.append(words)
    return out


class Trigrams:
    """Log likelihoods of the letters of words under the trigrams counted in some texts, blanks around words included."""

    PSEUDO, KINDS = 0.5, 20_000

    def __init__(self, words: Counter) -> None:
        seen: Counter = Counter()
        for w, n in words.items():
            for g in self.of(w):
                seen[g] += n
        total = sum(seen.values()) + self.PSEUDO * self.KINDS
        self.log = {g: math.log((n + self.PSEUDO) / total) for g, n in seen.items()}
        self.unseen = math.log(self.PSEUDO / total)

    @staticmethod
    def of(word: str) -> list[str]:
        padded = f" {word} "
        return [padded[i : i + 3] for i in range(len(word))]

    def of_word(self, word: str) -> float:
        """The log likelihood of a word's trigrams added up."""
        return sum(self.log.get(g, self.unseen) for g in self.of(word))

    def mean(self, parts: list[list[str]]) -> float:
        """The mean log likelihood of a trigram of these sentences; they hold at least one word."""
        return sum(self.of_word(w) for words in parts for w in words) / sum(len(w) for words in parts for w in words)


def _counted(docs: list[list[list[str]]]) -> Counter:
    return Counter(w for parts in docs for words in parts for w in words)


@dataclass
class Language:
    english: Trigrams
    other: Trigrams | None
    least: float
    known: dict[str, tuple[float, float]] = field(default_factory=dict, repr=False)

    def holds(self, parts: list[list[str]]) -> bool:
        """Whether sentences are English: as likely as English texts are, and likelier than under the trigrams of others."""
        own = other = 0.0
        n = 0
        known = self.known
        for words in parts:
            for w in words:
                v = known.get(w)
                if v is None:
                    if len(known) > 200_000:  # only a cache
                        known.clear()
                    v = known[w] = (self.english.of_word(w), self.other.of_word(w) if self.other else -math.inf)
                own += v[0]
                other += v[1]
                n += len(w)
        return own >= self.least * n and own >= other


def fit_language(english: list[list[list[str]]], other: list[list[list[str]]]) -> Language | None:
    """From the sentences of English documents and of some that are marked as of other languages, a few of them wrongly."""
    docs = [d for d in english if d]
    if not docs:
        return None
    halves = [Trigrams(_counted(docs[i::2])) for i in (0, 1)]
    held = sorted([halves[1].mean(d) for d in docs[0::2]] + [halves[0].mean(d) for d in docs[1::2]]) if len(docs) > 1 else [halves[0].mean(docs[0])]
    model = Language(Trigrams(_counted(docs)), None, held[len(held) // 100] - MARGIN)
    foreign = [d for d in other if d and not model.holds(d)]
    return Language(model.english, Trigrams(_counted(foreign)) if foreign else None, model.least)


@dataclass
class Model:
    known: dict[str, int]  # bin of a word's grade, or -1 where it tells no level
    table: dict[tuple, int]  # share of known words and quantiles of their grades to level, or NONE
    coarse: dict[tuple, int]
    by_median: list[int] | None = None  # level of a document by the median grade of its known words
    language: Language | None = None

    def features(self, words: list[str]) -> tuple | None:
        get = self.known.get
        seen = [v for v in map(get, dict.fromkeys(words)) if v is not None]
        grades = sorted([v for v in seen if v >= 0])
        n = len(grades)
        if not n:
            return None
        return (min(4, 5 * n // len(seen)), *[grades[min(n - 1, int(q * n))] for q in QUANTILES])

    def sentence_level(self, words: list[str]) -> int:
        key = self.features(words)
        if key is None:
            return NONE
        level = self.table.get(key)
        return self.coarse.get((key[0], key[2]), NONE) if level is None else level

    def median(self, parts: list[list[str]]) -> int | None:
        """The median grade of all known words."""
        grades = sorted(v for words in parts for w in words if (v := self.known.get(w, -1)) >= 0)
        return grades[len(grades) // 2] if grades else None

    def document_level(self, text: str | None) -> str | None:
        """None for texts without English sentences, and for those of which no word has a grade."""
        parts = sentences(text) if text else []
        if not parts or self.language is None or not self.language.holds(parts):
            return None
        votes = [0.0] * len(LEVELS)
        for words in parts:
            level = self.sentence_level(words)
            if level != NONE:
                votes[level] += min(1.0, len(words) / SHORT)
        if not any(votes):  # no sentence shows a level clearly
            median = self.median(parts)
            return None if median is None or self.by_median is None else LEVELS[self.by_median[median]]
        return LEVELS[votes.index(max(votes))]


def fit(texts: list[str], grades: list[float], others: list[str] | None = None) -> Model:
    """The model from labelled texts; grades count from 0, those of several raters averaged. others: texts of other languages."""
    k = len(LEVELS)
    docs = [sentences(t) for t in texts]
    words = sorted({w for parts in docs for words in parts for w in words})
    place = {w: i for i, w in enumerate(words)}
    rows = [(d, s, ids) for d, parts in enumerate(docs) for s in parts if (ids := [place[w] for w in dict.fromkeys(s) if w in place])]
    if not rows:
        return Model({}, {}, {})
    doc = np.array([d for d, *_ in rows])
    flat = np.concatenate([np.array(ids) for *_, ids in rows])
    sid = np.repeat(np.arange(len(rows)), [len(ids) for *_, ids in rows])
    away = np.abs(np.arange(k)[None, :] - np.asarray(grades)[:, None])
    prior = np.interp(away, [0, 1, 2, 3], [0.6, 0.2, 0.02, 0.001])
    prior = np.concatenate([0.7 * prior / prior.sum(1, keepdims=True), np.full((len(docs), 1), 0.3)], 1)[doc]
    post, v = prior, len(words)
    for step in range(STEPS):
        count = np.stack([np.bincount(flat, post[sid, z], v) for z in range(k + 1)], 1)
        if step == 0:
            count[:, NONE] = 0.2 * count.sum(1)
        spread = (count + 0.05) / (count.sum(0) + 0.05 * v)
        log = np.log(spread)
        score = np.stack([np.bincount(sid, log[flat, z], len(rows)) for z in range(k + 1)], 1) + np.log(prior)
        post = np.exp(score - score.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    score += np.log(post.mean(0)) - np.log(prior)  # without what the document's label adds
    post = np.exp(score - score.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    share = spread / spread.sum(1, keepdims=True)
    mean = (share[:, :k] * np.arange(k)).sum(1) / share[:, :k].sum(1)
    bins = np.rint(mean / (k - 1) * BINS).astype(int)
    model = Model({w: int(bins[i]) if share[i, NONE] < KNOWN else -1 for i, w in enumerate(words)}, {}, {})
    fine: dict[tuple, np.ndarray] = {}
    coarse: dict[tuple, np.ndarray] = {}
    for (_, s, _), p in zip(rows, post, strict=True):
        if (key := model.features(s)) is not None:
            fine[key] = fine.get(key, 0) + p
            coarse[key[0], key[2]] = coarse.get((key[0], key[2]), 0) + p
    model.table = {c: int(p.argmax()) for c, p in fine.items()}
    model.coarse = {c: int(p.argmax()) for c, p in coarse.items()}
    model.by_median = calibrated([model.median(parts) for parts in docs], grades)
    model.language = fit_language(docs, [sentences(t) for t in others or []])
    return model


def calibrated(medians: list[int | None], grades: list[float]) -> list[int]:
    """The level of each median grade: the mean label of the documents that have it or a neighbouring one, weighted by distance."""
    bins = np.arange(BINS + 1)
    known = [(m, g) for m, g in zip(medians, grades, strict=True) if m is not None]
    m, g = np.array([x for x, _ in known], float), np.array([x for _, x in known], float)
    if not known:
        return [round(b * (len(LEVELS) - 1) / BINS) for b in bins]
    weight = np.exp(-np.abs(bins[:, None] - m[None, :]) * 2.0)
    return [int(x) for x in np.clip(np.rint((weight * g).sum(1) / weight.sum(1)), 0, len(LEVELS) - 1)]


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, other_docs: int = OTHER_DOCS) -> Model:
    """Fits word grades and trigrams on at most sample_docs labelled documents and other_docs whose lang, if docs has one, isn't
    English, all of at most SAMPLE_CHARS characters and drawn by hash: the driver holds no more than these."""
    grade = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(F.trim("reading_level"))) - 1
    rated = labels.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "rater", "reading_level"]).withColumn("g", grade).where(F.col("g") >= 0).groupBy("doc_id").agg(F.avg("g").alias("g"))
    drawn = F.broadcast(rated.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_docs))
    short = docs.where(F.length("text") <= SAMPLE_CHARS)
    rows = short.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "text", "g").collect()
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])
    others = []
    if "lang" in docs.columns:
        lang = F.lower(F.trim("lang"))
        foreign = short.where(F.col("doc_id").isNotNull() & (lang != "") & ~lang.startswith("en")).select("doc_id", "text")
        others = sorted((r["doc_id"], r["text"]) for r in foreign.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(other_docs).collect())
    return fit([r["text"] for r in rows], [r["g"] for r in rows], [t for _, t in others])


def levels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, reading_level of every document with English sentences; others, null and empty texts give no row."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["reading_level"] = [model.document_level(t) for t in batch.pop("text")]
            yield batch[batch["reading_level"].notna()]

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(predict, f"doc_id {key}, reading_level string")


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return levels(docs, train(docs, labels))
