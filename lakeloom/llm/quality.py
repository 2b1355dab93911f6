"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer.

Each labeller looks at one trait of a text (capitals, symbols, repeated words ...) and votes bad, good or
abstains. Votes of all documents are counted by pattern (at most 3 to the number of labellers, so the table
of counts is bounded). Expectation-maximisation over these counts gives the share of good documents and each
labeller's votes given the class; that gives each pattern's posterior. A linear scorer over hashed features
(byte trigrams by relative frequency, and the traits in steps) is then fitted to the posteriors of a bounded
sample: at most PER_CLASS documents on either side of one half, the first in order of a hash of doc_id.
No label of the tables is used.

Defined cases: a text without a word (null, empty, white space) scores 0 and is rejected; an empty table
gives no rows; where all patterns fall on one side, the posteriors are the scores; rows that repeat a doc_id
give a row each, and of such rows in the sample the one whose text sorts first is learnt from; texts of any
length are read whole, in blocks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import flat_bytes, read, texts, written

PER_CLASS = 1500
BUCKETS = 1 << 15
#: Words among which distinct ones are counted, and bytes that are looked at together.
STRETCH, BLOCK = 128, 500_000
#: Bytes of the sample that are fitted together.
PART = 500_000
BAD, GOOD, NONE = 0, 1, 2
TRAITS = ("upper", "symbols", "marked", "lone", "repeated", "distinct", "length", "worded")
#: For each trait: least words; bad beyond; good beyond (both on the side that the signs say).
RULES = {
    "upper": (5, lambda v: v > 0.5, lambda v: v < 0.3),
    "symbols": (3, lambda v: v > 0.1, lambda v: v < 0.05),
    "marked": (5, lambda v: v > 0.25, lambda v: v < 0.1),
    "lone": (10, lambda v: v > 0.2, lambda v: v < 0.1),
    "repeated": (10, lambda v: v > 0.2, lambda v: v < 0.08),
    "distinct": (30, lambda v: v < 0.35, lambda v: v > 0.5),
    "length": (5, lambda v: (v < 2) | (v > 18), lambda v: (v > 2.5) & (v < 14)),
    "worded": (5, lambda v: v < 0.5, lambda v: v > 0.75),
}
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 2.0, 4.0, 8.0, 14.0])

_BYTE = np.arange(256)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_ODD = ~(_SPACE | _LETTER | _DIGIT)  # any mark
_SYMBOL = _ODD & ~np.isin(_BYTE, np.frombuffer(b".,;:'\"()!?-", np.uint8))
_MIX = np.random.default_rng(3).integers(1, 1 << 63, (256,), dtype=np.uint64)


def _count(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
    return np.diff(total[bounds])


def traits(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (bytes data[bounds[i]:bounds[i + 1]]): its words, and a column for each trait."""
    n = len(bounds) - 1
    out = np.zeros((n, len(TRAITS)))
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True  # a text ends its last word
    starts = np.flatnonzero(~space & (np.r_[True, space[:-1]] | cut[:-1]))
    ends = np.flatnonzero(~space & (np.r_[space[1:], True] | cut[1:])) + 1
    first = np.searchsorted(starts, bounds)
    words = np.diff(first)
    if not len(starts):
        return words, out
    least = np.maximum(words, 1)
    letters = _count(_LETTER[data] & (data < 128), bounds)
    size = np.maximum(_count(~space, bounds), 1)
    out[:, 0] = _count(_UPPER[data], bounds) / np.maximum(letters, 1)
    out[:, 1] = _count(_SYMBOL[data], bounds) / size
    last, ahead = data[ends - 1], data[np.maximum(ends - 2, 0)]
    out[:, 2] = _count((ends - starts > 2) & (last == ahead) & _ODD[last], first) / least
    lettered = np.add.reduceat(_LETTER[data].astype(np.int64), starts) > 0
    named = np.add.reduceat((_LETTER | _DIGIT)[data].astype(np.int64), starts) > 0
    out[:, 3] = _count(~named, first) / least
    place = (np.arange(len(data), dtype=np.int64) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))).astype(np.uint64)
    mixed = np.where(space, 0, _MIX[data] * (2 * place + 1) ^ (_MIX[data] >> np.uint64(17)))
    names = np.add.reduceat(mixed.astype(np.uint64), starts)
    owner = np.repeat(np.arange(n), words)
    same = np.r_[False, (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])]
    out[:, 4] = _count(same, first) / least
    stretch = owner * (1 << 24) + (np.arange(len(starts)) - first[owner]) // STRETCH
    order = np.lexsort((names, stretch))
    new = np.r_[True, (names[order][1:] != names[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])]
    out[:, 5] = np.bincount(owner[order], new, n) / least
    out[:, 6] = _count(~space, bounds) / least
    out[:, 7] = _count(lettered, first) / least
    return words, out


def votes(words: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A pattern for each text: base-3 digits, one for each labeller in order of TRAITS."""
    pattern = np.zeros(len(words), np.int64)
    for k, name in enumerate(TRAITS):
        enough, bad, good = RULES[name]
        v = np.where(bad(seen[:, k]), BAD, np.where(good(seen[:, k]), GOOD, NONE))
        pattern = pattern * 3 + np.where(words < enough, NONE, v)
    return pattern


def digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(TRAITS) - 1, -1, -1) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern; votes given the class (labeller, class, vote); share of good."""
    v = digits(patterns)
    bad, good = (v == BAD).sum(axis=1), (v == GOOD).sum(axis=1)
    post = np.where(bad, 0.1, np.where(good, 0.95, 0.6))  # at first one vote against outweighs
    total = counts.sum()
    for _ in range(rounds):
        share = np.clip((counts * post).sum() / total, 0.01, 0.99)
        table = np.empty((len(TRAITS), 2, 3))
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            for k in range(len(TRAITS)):
                row = np.bincount(v[:, k], w, 3) + 0.5
                table[k, c] = row / row.sum()
        log = np.log([1 - share, share])[None, :] + sum(np.log(table[k][:, v[:, k]]).T for k in range(len(TRAITS)))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, table, float(share)


def accuracies(table: np.ndarray, share: float) -> dict[str, float]:
    """Of each labeller, where it votes."""
    out = {}
    for k, name in enumerate(TRAITS):
        right = share * table[k, 1, GOOD] + (1 - share) * table[k, 0, BAD]
        voted = share * table[k, 1, :2].sum() + (1 - share) * table[k, 0, :2].sum()
        out[name] = float(right / voted) if voted else 0.0
    return out


def trigrams(data: np.ndarray) -> np.ndarray:
    """A bucket for each place of data but the last two."""
    x = data.astype(np.uint32)
    return ((x[:-2] * 0x9E3779B1 ^ x[1:-1] * 0x85EBCA6B ^ x[2:] * 0xC2B2AE35) >> 17).astype(np.int64)


def steps(words: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Hashed features of the traits: for each text and trait one bucket."""
    level = np.searchsorted(STEPS, seen) + len(STEPS) * 2 * (words < 30)[:, None]
    return (np.arange(len(TRAITS)) * 97 + level) % 1024


@dataclass
class Scorer:
    gram: np.ndarray
    step: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        words, seen = traits(data, bounds)
        out = self.bias + self.step[steps(words, seen)].sum(axis=1)
        if len(data) > 2:
            total = np.r_[0, np.cumsum(self.gram[trigrams(data)], dtype=np.float64)]
            a, b = bounds[:-1], np.maximum(bounds[1:] - 2, bounds[:-1])
            a, b = np.minimum(a, len(total) - 1), np.minimum(b, len(total) - 1)
            out = out + (total[b] - total[a]) / np.maximum(b - a, 1)
        return np.where(words > 0, out, -np.inf)

    @staticmethod
    def fit(some: list[bytes], target: np.ndarray, rounds: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Scorer:
        level, found, held, size = [], [], [], 0
        for k, x in enumerate(some):  # in parts: what is held is a row for each text and distinct trigram
            held.append(x)
            size += len(x)
            if size < PART and k + 1 < len(some):
                continue
            data = np.frombuffer(b"".join(held), np.uint8)
            sizes = np.array([len(x) for x in held])
            bounds = np.r_[0, np.cumsum(sizes)]
            level.append(steps(*traits(data, bounds)))
            if len(data) > 2:
                n = np.maximum(sizes - 2, 0)
                owner = np.repeat(np.arange(len(held)), n)
                places = np.arange(len(owner)) + (bounds[:-1] - (np.cumsum(n) - n))[owner]
                pairs, count = np.unique(owner * BUCKETS + trigrams(data)[places], return_counts=True)
                owner = pairs // BUCKETS
                found.append((pairs % BUCKETS, owner + k + 1 - len(held), count / n[owner]))
            held, size = [], 0
        level = np.concatenate(level)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        grams, owner, share = (np.concatenate(x) for x in zip(empty, *found, strict=True))
        p = np.zeros(BUCKETS + 1024 + 1)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, rounds + 1):
            logit = p[-1] + p[BUCKETS:-1][level].sum(axis=1) + np.bincount(owner, p[grams] * share, len(some))
            d = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - target) / len(some)
            g = np.r_[np.bincount(grams, d[owner] * share, BUCKETS), np.bincount(level.ravel(), np.repeat(d, len(TRAITS)), 1024), d.sum()] + decay * p
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return Scorer(p[:BUCKETS].astype(np.float32), p[BUCKETS:-1].copy(), float(p[-1]))


def in_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The column's bytes and bounds in parts of about BLOCK bytes; a long text alone."""
    data, bounds = flat_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK)))
        j = min(j, n)
        yield data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def _logits(column: pa.Array, scorer: Scorer) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(scorer.logits(*block) for block in in_blocks(column))])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500))) * np.isfinite(x)


def trained(docs: DataFrame) -> Scorer:
    """The scorer for docs; vote patterns are counted over all of them."""

    def patterns(batches):
        for batch in batches:
            blocks = [votes(*traits(*block)) for block in in_blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *blocks]))], names=["doc_id", "pattern"])

    each = written(texts(docs).mapInArrow(patterns, "doc_id long, pattern long"), "votes")
    rows = each.groupBy("pattern").count().collect()  # at most 3 to the number of labellers
    if not rows:
        return Scorer(np.zeros(BUCKETS, np.float32), np.zeros(1024), 0.0)
    found = np.array(sorted((r["pattern"], r["count"]) for r in rows), np.int64)
    post, _, share = expectation_maximisation(found[:, 0], found[:, 1].astype(float))
    by = dict(zip(found[:, 0].tolist(), post.tolist(), strict=True))
    ids: dict[int, float] = {}
    for side in (True, False):
        of = [p for p, v in by.items() if (v >= 0.5) == side]
        some = each.where(F.col("doc_id").isNotNull() & F.col("pattern").isin(of)) if of else each.limit(0)
        ids |= {r.doc_id: by[r["pattern"]] for r in some.orderBy(F.xxhash64("doc_id"), "doc_id", "pattern").limit(PER_CLASS).collect()}
    if not ids:
        return Scorer(np.zeros(BUCKETS, np.float32), np.zeros(1024), 1.0)
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, target double")
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "target").agg(F.min("text").alias("text"))
    sample = sorted(sample.collect(), key=lambda r: r.doc_id)
    target = np.array([r.target for r in sample])
    scorer = Scorer.fit([r.text.encode() for r in sample], target)
    # the sample has as many of either side; the bias goes back to the shares of all documents
    here = np.clip(target.mean(), 0.01, 0.99)
    scorer.bias += float(np.log(share / (1 - share)) - np.log(here / (1 - here)))
    return scorer


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, keep for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # fixed size

    def rows(batches):
        for batch in batches:
            score = sigmoid(_logits(batch.column(1), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "score", "keep"])

    return texts(docs).mapInArrow(rows, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs))
    at = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            text = batch.column(at)
            score = sigmoid(_logits(text.fill_null(b"" if pa.types.is_binary(text.type) else ""), shared.value))
            yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(rows, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, trained(docs))
