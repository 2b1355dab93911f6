"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word backs off to its character
n-grams, the longest first: at each place the longest n-gram that training knows is scored, each step down
costing a constant that is the same for all languages. A document's scores are the sums over its words,
by distinct words of a block and their counts.

The model is fitted on a bounded sample: at most SAMPLE documents with a language, the first in order of a
hash of doc_id, and holds words and n-grams that occur at least twice there. Prediction reads nothing but
the text.

Defined cases: a text without a letter (Unicode's categories L), and a null text, is `und` with score 0; numerals
that are no digits, such as ² and Ⅷ, are no letters; without any training language all texts are `und`; an
empty table gives no rows; equal scores go to the language that sorts first; rows that repeat a doc_id give a row
each, and of such rows in the sample the one whose text sorts first is learnt from; texts of any length are read
whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import crc_mod, held_out, read, texts

SAMPLE = 4000
LONGEST = 5
#: Cost of each step down to shorter n-grams, and the pseudo-count of what a language lacks.
STEP_COST, FLOOR = 0.5, 0.1
#: The n-gram tables have 2 ** BITS places; words beyond MOST_CHARS letters are read in pieces of it.
BITS, MOST_CHARS = 20, 64
#: Bytes of text that are looked at together.
BLOCK = 1_000_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; numerals such as ² count as \\w but not as digits, so words that hold one are parted there."""
    found = LETTERS.findall(text.lower())
    if "".join(found).isalpha() or not found:
        return found
    return [part for w in found for part in (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w)).split()]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all _word_ and where each begins; an underscore is no letter."""
    line = "_" + "__".join(words) + "_"
    data = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return data, np.cumsum(sizes) - sizes


def n_grams(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the hash of the n-gram there, and whether it lies within its word."""
    size = len(data)
    x = np.r_[data, np.zeros(LONGEST, np.uint32)].astype(np.uint64)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = (h ^ x[k : size + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ends = np.repeat(np.r_[starts[1:], size], np.diff(np.r_[starts, size]))
    return h, np.arange(size) + n <= ends


@dataclass
class Model:
    """words: row of word_scores; grams: for each n, sorted hashes and their scores (one column for each language)."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    places: list[np.ndarray]

    @staticmethod
    def fit(sample: list[tuple[str, str]]) -> Model | None:
        """sample: texts and languages."""
        languages = sorted({lang for _, lang in sample})
        if not languages:
            return None
        counts = {lang: Counter() for lang in languages}
        for text, lang in sample:
            counts[lang].update(words_of(text))
        total = Counter()
        for c in counts.values():
            total.update(c)
        known = sorted(w for w, n in total.items() if n >= 2)
        table = np.array([[counts[lang][w] for lang in languages] for w in known], float).reshape(-1, len(languages))
        sums = np.array([max(1, sum(counts[lang].values())) for lang in languages], float)
        word_scores = np.log((table + FLOOR) / (sums + FLOOR * (len(known) + 1)))
        grams, places = [], []
        pieces = {lang: _cut(list(c)) for lang, c in counts.items()}
        for n in range(LONGEST, 0, -1):
            found, owner = [], []
            for k, lang in enumerate(languages):
                if pieces[lang]:
                    data, starts = code_points(pieces[lang])
                    h, ok = n_grams(data, starts, n)
                    found.append(h[ok])
                    owner.append(np.full(int(ok.sum()), k))
            names, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)
            table = np.zeros((len(names), len(languages)))
            if found:
                np.add.at(table, (at, np.concatenate(owner)), 1)
            keep = table.sum(axis=1) >= 2
            sums = np.maximum(table.sum(axis=0), 1)
            score = np.log((table[keep] + FLOOR) / (sums + FLOOR * (keep.sum() + 1)))
            grams.append((names[keep], (score - STEP_COST * (LONGEST - n)).astype(np.float32)))
            place = np.zeros(1 << BITS, bool)  # tells quickly that an n-gram is unknown
            place[(names[keep] >> np.uint64(64 - BITS)).astype(np.int64)] = True
            places.append(place)
        return Model(languages, {w: i for i, w in enumerate(known)}, word_scores.astype(np.float32), grams, places)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words by their n-grams: the mean over places, as one word counts once."""
        pieces = _cut(words)
        owner = np.repeat(np.arange(len(words)), [max(1, -(-len(w) // MOST_CHARS)) for w in words])
        data, starts = code_points(pieces)
        out = np.zeros((len(data), len(self.languages)), np.float32)
        todo = np.ones(len(data), bool)
        for n, (names, score), place in zip(range(LONGEST, 0, -1), self.grams, self.places, strict=True):
            h, ok = n_grams(data, starts, n)
            at = np.flatnonzero(todo & ok & place[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            where = np.searchsorted(names, h[at])
            hit = names[np.minimum(where, len(names) - 1)] == h[at] if len(names) else np.zeros(len(at), bool)
            out[at[hit]] = score[where[hit]]
            todo[at[hit]] = False
        sums = np.add.reduceat(out, starts, axis=0)
        sizes = np.diff(np.r_[starts, len(data)])
        per = np.zeros((len(words), len(self.languages)), np.float32)
        np.add.at(per, owner, sums)
        return per / np.bincount(owner, sizes, len(words))[:, None].astype(np.float32)

    def predict(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of its language (-1: no letter), and the share of the likelihood per word."""
        parts = [words_of(t) for t in some]
        names = list(set().union(*parts))
        table = np.zeros((len(names) + 1, len(self.languages)), np.float32)
        rows = np.fromiter((self.words.get(w, -1) for w in names), np.int64, len(names))
        known = rows >= 0
        table[:-1][known] = self.word_scores[rows[known]]
        new = [w for w, k in zip(names, known, strict=True) if not k]
        if new:
            table[:-1][~known] = self.unseen(new)
        ids = {w: i for i, w in enumerate(names)}
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.fromiter((ids[w] for p in parts for w in p), np.int64, int(sizes.sum()))
        sums = np.zeros((len(some), len(self.languages)))
        if len(flat):
            full = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[full]
            sums[full] = np.add.reduceat(table[flat].astype(np.float64), starts, axis=0)
        mean = sums / np.maximum(sizes, 1)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = np.argmax(sums, axis=1)
        return np.where(sizes > 0, best, -1), np.where(sizes > 0, share[np.arange(len(some)), best], 0.0)


def _cut(words: list[str]) -> list[str]:
    return [w[i : i + MOST_CHARS] for w in words for i in range(0, max(1, len(w)), MOST_CHARS)]


def training_sample(docs: DataFrame, train_rows, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most sample texts with their language, the first in order of a hash of doc_id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).where(train_rows)
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    first = F.min(F.struct("text", "lang")).alias("first")
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id").agg(first).collect()
    return [(r.first.text, r.first.lang) for r in sorted(rows, key=lambda r: r.doc_id)]


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    if model is None:
        return texts(docs).select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def rows(batches):
        model = shared.value
        for batch in batches:
            best, score, some, held = [], [], [], 0
            for k, x in enumerate(batch.column(1)):
                some.append(x.as_py())
                held += len(some[-1])
                if held > BLOCK or k + 1 == batch.num_rows:
                    b, s = model.predict(some)
                    best += ["und" if i < 0 else model.languages[i] for i in b]
                    score.append(s)
                    some, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(np.concatenate([np.zeros(0), *score]))], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = Model.fit(training_sample(docs, crc_mod(3) != 1))
    return identified(docs, model).select("doc_id", held_out(3, 1), "lang_pred", "score")
