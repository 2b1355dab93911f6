"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word of more than PIECE characters counts as several, its consecutive pieces. A word's input is the sum of its
own vector (words of the sample's vocabulary; others share one) and the mean vector of its hashed n-grams of
characters (of their bytes). Two gated recurrent layers read a stretch of STRETCH words in both directions,
attention pools their states over each window of SPAN words in it, and a logistic unit scores the window.
Stretches overlap so that every start of a window lies in one: window s is the (s mod STEP)-th of stretch
s / STEP. A document's score is that of its highest window, over all overlapping windows of the whole text;
windows share the states of their stretch, so that a word costs about one and a half steps in either direction
however many windows hold it. The price: a window's states know up to STRETCH - SPAN words around it, and which ones
depends on where it stands, so a passage near 0.5 may score on either side of it at different places; tests move
passages over all STEP places and say how many are found in each.

Labels are of documents, so training goes by rounds: each document is represented by its highest window so
far (first: by the words' log odds), clean documents also by random windows. The sample is bounded: at most
PER_CLASS labelled documents of each class, the first in order of a hash of doc_id; of rows that repeat a
doc_id the one whose text sorts first.

Defined cases: texts without a word, and null texts, score 0; several labels for one doc_id: the highest
counts; null labels are not used; where the sample lacks a class every score is 0; rows that repeat a
doc_id give a row each; an empty table gives no rows; texts of any length are read whole; other columns are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import crc_mod, held_out, read, texts

#: Words in a window; and characters of a word: longer ones are cut into pieces, each an input of its own.
SPAN, PIECE = 24, 32
#: Words that are read together, and how many windows start in them: those that lie inside.
STRETCH = 72
STEP = STRETCH - SPAN + 1
PER_CLASS = 1000
WORD_SIZE, HIDDEN, ATTENTION = 16, 8, 8
#: 13 bits of the n-gram hash are kept.
GRAM_BUCKETS, VOCABULARY = 1 << 13, 4000
WORD = re.compile(r"\w+")
#: Stretches that are scored at once, and words whose inputs a worker keeps.
BATCH, KEPT_WORDS = 512, 200_000
SEED = 11


def words_of(text: str) -> list[str]:
    """Words, longer ones as consecutive pieces."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= PIECE:
        return found
    return [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-, 4- and 5-grams of each <word>, over its UTF-8 bytes, and where each word's begin."""
    data = np.frombuffer(("<" + "><".join(words) + ">").encode(), np.uint8)
    starts = np.flatnonzero(data == ord("<"))
    sizes = np.diff(np.r_[starts, len(data)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))  # bytes to the end of the word
    x = np.r_[data, np.zeros(4, np.uint8)].astype(np.uint32)
    n = len(data)
    rolled = (x[:n] * 0x9E3779B1 + x[1 : n + 1]) * 0x85EBCA6B + x[2 : n + 2]
    found = np.empty((n, 3), np.uint32)
    for k in range(3):
        if k:
            rolled = rolled * 0xC2B2AE35 + x[k + 2 : n + k + 2]
        found[:, k] = (rolled ^ (rolled >> 15)) * 0x2C1B3C6D >> 19
    valid = left[:, None] >= np.array([3, 4, 5])
    per_word = np.add.reduceat(valid.sum(axis=1), starts)
    return found[valid].astype(np.int64), np.cumsum(per_word) - per_word


def windows(n: int) -> np.ndarray:
    """Starts of all windows over n words; the last one ends with the text."""
    return np.arange(max(min(n, 1), n - SPAN + 1))


def stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words, one behind the other: each stretch's first word, its words, and how many windows start in it."""
    starts = np.where(sizes > 0, np.maximum(sizes - SPAN, 0) + 1, 0)
    per = -(-starts // STEP)
    text = np.repeat(np.arange(len(sizes)), per)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STEP
    first = np.cumsum(sizes) - sizes
    return first[text] + offset, np.minimum(STRETCH, sizes[text] - offset), np.minimum(STEP, starts[text] - offset)


def sliding(x: np.ndarray, size: int) -> np.ndarray:
    """Sums of `size` rows that follow each other, from sums of 1, 2, 4 ...; nothing is taken off again."""
    n, out, at, width = len(x) - size + 1, 0, 0, 1
    while width <= size:
        if size & width:
            out = out + x[at : at + n]
            at += width
        x = x[:-width] + x[width:]
        width *= 2
    return out


def gathered(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    return np.stack([np.bincount(index, v, n) for v in values.T], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]

    @staticmethod
    def new(vocabulary: dict[str, int], seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
        d, h = WORD_SIZE, HIDDEN
        p = {"word": 0.1 * make(len(vocabulary) + 1, d), "gram": 3 * make(GRAM_BUCKETS, d)}
        for way in ("f", "b"):
            p |= {f"in_{way}": make(d, 3 * h), f"bias_{way}": np.zeros(3 * h, np.float32), f"own_{way}": make(h, 3 * h)}
        p |= {"att": make(2 * h, ATTENTION), "att_bias": np.zeros(ATTENTION, np.float32), "att_out": make(ATTENTION), "out": make(2 * h), "out_bias": np.full(1, -1, np.float32)}
        return Model(vocabulary, p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors, and what they are made of: word indices, n-gram indices, their bounds."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        flat, starts = grams(words)
        return self.vectors(ids, flat, starts), ids, flat, starts

    def vectors(self, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.r_[starts, len(flat)])[:, None].astype(np.float32)
        return self.p["word"][ids] + np.add.reduceat(self.p["gram"][flat], starts, axis=0) / sizes

    def forward(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False, pool: np.ndarray | None = None):
        """gates: for each way the input part (words, stretches, 3 hidden); mask (stretches, words): what is there; pool: a window in it. Logits, and states if asked for."""
        n, t, h = mask.shape[0], mask.shape[1], HIDDEN
        states, kept = np.empty((t, n, 2 * h), np.float32), {}
        for way, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            own, gate = self.p[f"own_{way}"], gates[way]
            state, at, log = np.zeros((n, h), np.float32), (0 if way == "f" else h), []
            for i in order:
                x, mine = gate[i], state @ own
                zr = sigmoid(x[:, : 2 * h] + mine[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * mine[:, 2 * h :])
                z = z * mask[:, i : i + 1]
                if keep:
                    log.append((i, state, z, r, new, mine[:, 2 * h :], zr[:, :h]))
                state = state + z * (new - state)
                states[i, :, at : at + h] = state
            kept[way] = log
        u = np.tanh(states @ self.p["att"] + self.p["att_bias"])
        s = u @ self.p["att_out"] + ((mask if pool is None else pool).T - 1) * 1e4
        e = np.exp(s - s.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", alpha, states)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        return (logit, states, u, alpha, pooled, kept) if keep else logit

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {way: vectors @ self.p[f"in_{way}"] + self.p[f"bias_{way}"] for way in ("f", "b")}

    def gradient(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, label: np.ndarray, pool: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean logistic loss, for all parameters but the word and n-gram tables, and for vectors. at (words, stretches)."""
        p, h, n = self.p, HIDDEN, len(label)
        x = vectors[at]
        gates = {way: x @ p[f"in_{way}"] + p[f"bias_{way}"] for way in ("f", "b")}
        logit, states, u, alpha, pooled, kept = self.forward(gates, mask, True, pool)
        g: dict[str, np.ndarray] = {}
        d_logit = ((sigmoid(logit) - label) / n).astype(np.float32)
        g["out"], g["out_bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = np.einsum("tnk,nk->tn", states, d_pooled)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["att_out"] = np.einsum("tn,tna->a", d_s, u)
        d_u = d_s[:, :, None] * p["att_out"] * (1 - u**2)
        g["att"], g["att_bias"] = np.einsum("tnk,tna->ka", states, d_u), d_u.sum(axis=(0, 1))
        d_states = d_states + d_u @ p["att"].T
        d_x = np.zeros_like(x)
        for way in ("f", "b"):
            own, at_way = p[f"own_{way}"], (0 if way == "f" else h)
            d_state, d_own, d_gate = np.zeros((n, h), np.float32), np.zeros_like(own), np.zeros_like(gates[way])
            for i, before, z, r, new, mine, raw in reversed(kept[way]):
                d_state = d_state + d_states[i, :, at_way : at_way + h]
                d_new = d_state * z * (1 - new**2)
                d_z = d_state * (new - before) * mask[:, i : i + 1] * raw * (1 - raw)
                d_r = d_new * mine * r * (1 - r)
                d_mine = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_gate[i] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_own += before.T @ d_mine
                d_state = d_state * (1 - z) + d_mine @ own.T
            g[f"own_{way}"], g[f"bias_{way}"] = d_own, d_gate.sum(axis=(0, 1))
            g[f"in_{way}"] = np.einsum("tnd,tng->dg", x, d_gate)
            d_x += d_gate @ p[f"in_{way}"].T
        return g, gathered(d_x.reshape(-1, x.shape[-1]), at.ravel(), len(vectors))

    def score(self, gates: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of all windows of texts of so many words, in order; gates by word, as tables() gives them."""
        start, length, count = stretches(sizes)
        out = [np.zeros(0, np.float32)]
        for k in range(0, len(start), BATCH):
            s, n, c = start[k : k + BATCH], length[k : k + BATCH], count[k : k + BATCH]
            width = max(SPAN, int(n.max()))
            at = np.minimum(s[:, None] + np.arange(width), len(ids) - 1)
            logits = self.window_logits(gates, ids[at].T, n).T
            out.append(logits[np.arange(logits.shape[1]) < c[:, None]])
        return np.concatenate(out)

    def tables(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Gates for window_logits: the logistic units' halved, as they are taken from tanh."""
        half = np.r_[np.full(2 * HIDDEN, 0.5, np.float32), np.ones(HIDDEN, np.float32)]
        return {way: x * half for way, x in self.gates(vectors).items()}

    def window_logits(self, gates: dict[str, np.ndarray], ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """ids (words, stretches), and how many words of a stretch there are. Logits of the windows from its first, second ... word; numbers stand in columns by stretch."""
        t, n, h = *ids.shape, HIDDEN
        there = np.arange(t)[:, None] < length
        att, out = self.p["att"].T, self.p["out"]
        attention, value = np.empty((t, ATTENTION, n), np.float32), np.zeros((t, n), np.float32)
        for way in ("f", "b"):
            own = np.ascontiguousarray(0.5 * self.p[f"own_{way}"].T)
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            mix, say = np.ascontiguousarray(att[:, part]), out[part]
            state = np.zeros((h, n), np.float32)
            for i in range(t) if way == "f" else range(t - 1, -1, -1):
                x, mine = np.ascontiguousarray(gates[way][ids[i]].T), own @ state
                x[: 2 * h] += mine[: 2 * h]
                zr = np.tanh(x[: 2 * h], out=x[: 2 * h])
                zr += 1
                mine[2 * h :] *= zr[h:]
                mine[2 * h :] += x[2 * h :]
                new = np.tanh(mine[2 * h :], out=mine[2 * h :])
                new -= state
                new *= zr[:h]
                new *= 0.5 * there[i]
                state += new
                if way == "f":
                    attention[i] = mix @ state
                else:
                    attention[i] += mix @ state
                value[i] += say @ state
        attention += self.p["att_bias"][:, None]
        s = np.einsum("a,tan->tn", self.p["att_out"], np.tanh(attention, out=attention)).astype(np.float64)
        e = np.exp(s - s.max(axis=0)) * there
        return sliding(e * value, SPAN) / np.maximum(sliding(e, SPAN), 1e-300) + self.p["out_bias"][0]


def train(sample: list[tuple[str, int]], rounds: int = 4, epochs: int = 3, least_steps: int = 60, rate: float = 0.01) -> Model | None:
    """sample: texts and labels 0 or 1. None where a class is missing. A small sample is gone through more often."""
    docs = [(w, y) for w, y in ((words_of(t), y) for t, y in sample) if w]
    if len({y for _, y in docs}) < 2:
        return None
    counts: dict[str, list[int]] = {}
    for w, y in docs:
        for v in set(w):
            counts.setdefault(v, [0, 0])[y] += 1
    total = [sum(y == k for _, y in docs) for k in (0, 1)]
    common = sorted((v for v in counts if sum(counts[v]) > 1), key=lambda v: (-sum(counts[v]), v))[:VOCABULARY]
    model = Model.new({v: i + 1 for i, v in enumerate(common)})
    r = np.random.default_rng(SEED)
    names = {v: i for i, v in enumerate(counts)}
    odds = np.array([np.log((b + 0.5) / (total[1] + 1)) - np.log((a + 0.5) / (total[0] + 1)) for a, b in counts.values()])
    ids = np.array([names[v] for w, _ in docs for v in w], np.int64)
    sizes = np.array([len(w) for w, _ in docs])
    first = np.cumsum(sizes) - sizes
    starts_of = [windows(n) + f for n, f in zip(sizes, first, strict=True)]
    per = np.array([len(s) for s in starts_of])
    bounds = np.cumsum(per) - per
    starts, text = np.concatenate(starts_of), np.repeat(np.arange(len(docs)), per)
    ends = np.minimum(starts + SPAN, (first + sizes)[text])
    label = np.array([y for _, y in docs], np.float32)
    clean = np.flatnonzero(label[text] == 0)
    value = np.maximum.reduceat(np.r_[odds[ids], -9.0], np.c_[starts, ends].ravel())[::2]
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    vocabulary, step = list(names), 0
    _, word_ids, flat, gram_starts = model.inputs(vocabulary)
    gram_sizes = np.diff(np.r_[gram_starts, len(flat)])
    for _ in range(rounds):
        best = np.array([b + int(np.argmax(value[b : b + n])) for b, n in zip(bounds, per, strict=True)])
        chosen = np.concatenate([best, r.choice(clean, min(len(clean), len(best)))])
        truth = np.concatenate([label, np.zeros(len(chosen) - len(best), np.float32)])
        for _ in range(max(epochs, -(-least_steps * 128 // len(chosen)))):
            order = r.permutation(len(chosen))
            for k in range(0, len(order), 128):
                some = order[k : k + 128]
                one = chosen[some]
                s, e, begin = starts[one], ends[one], first[text[one]]
                begin += (s - begin) // STEP * STEP  # of the stretch
                end = np.minimum(begin + STRETCH, (first + sizes)[text[one]])
                where = np.arange((end - begin).max())[:, None] + begin
                mask, pool = (where < end).T.astype(np.float32), ((where >= s) & (where < e)).T.astype(np.float32)
                used, at = np.unique(ids[np.minimum(where, len(ids) - 1)], return_inverse=True)
                wid, gz = word_ids[used], gram_sizes[used]
                gs = np.cumsum(gz) - gz
                fl = flat[np.repeat(gram_starts[used] - gs, gz) + np.arange(gz.sum())]
                g, d = model.gradient(model.vectors(wid, fl, gs), at.reshape(where.shape), mask, truth[some], pool)
                g["word"] = gathered(d, wid, len(model.p["word"]))
                g["gram"] = gathered(np.repeat(d / gz[:, None], gz, axis=0), fl, GRAM_BUCKETS)
                step += 1
                for name, x in g.items():
                    m, v = moments.get(name, (np.zeros_like(x), np.zeros_like(x)))
                    m, v = 0.9 * m + 0.1 * x, 0.999 * v + 0.001 * x * x
                    moments[name] = (m, v)
                    model.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        value = model.score(model.tables(model.vectors(word_ids, flat, gram_starts)), ids, sizes)
    return model


class Scorer:
    """A worker's model and the inputs of the words it has met; full, the table starts anew."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.tables = {way: np.zeros((1000, 3 * HIDDEN), np.float32) for way in ("f", "b")}

    def scores(self, some: list[str]) -> np.ndarray:
        parts = [words_of(t) for t in some]
        if len(self.ids) > KEPT_WORDS:
            self.__init__(self.model)
        new = list(set().union(*parts).difference(self.ids))
        if new:
            at = len(self.ids)
            self.ids.update(zip(new, range(at, at + len(new)), strict=True))
            if len(self.ids) > len(self.tables["f"]):
                self.tables = {way: np.concatenate([x[:at], np.zeros((2 * len(self.ids) - at, 3 * HIDDEN), np.float32)]) for way, x in self.tables.items()}
            for k in range(0, len(new), 20_000):
                some_new = new[k : k + 20_000]
                for way, x in self.model.tables(self.model.inputs(some_new)[0]).items():
                    self.tables[way][at + k : at + k + len(some_new)] = x
        get = self.ids.__getitem__
        sizes = np.array([len(p) for p in parts], np.int64)
        ids = np.fromiter(map(get, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        per = np.where(sizes > 0, np.maximum(sizes - SPAN, 0) + 1, 0)
        out = np.zeros(len(some))
        if len(ids):
            full = per > 0
            top = np.maximum.reduceat(self.model.score(self.tables, ids, sizes), (np.cumsum(per) - per)[full])
            out[full] = sigmoid(top.astype(np.float64))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train_rows, per_class: int = PER_CLASS) -> list[tuple[str, int]]:
    """At most per_class texts of each class: those first in order of a hash of doc_id."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(train_rows)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [known.where(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = {r.doc_id: r.label for p in picked for r in p.collect()}  # at most twice per_class rows
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, label int")
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: r.doc_id)]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for each row of docs."""
    if model is None:
        return texts(docs).select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed sizes: under 2 MB

    def rows(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            column, out, some, held = batch.column(1), [], [], 0
            for x in column:
                some.append(x.as_py())
                held += len(some[-1])
                if held > 1_000_000:
                    out.append(scorer.scores(some))
                    some, held = [], 0
            if some:
                out.append(scorer.scores(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(rows, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", crc_mod(5) != 0))
    return scored(docs, model).select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
