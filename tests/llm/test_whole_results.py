"""The queries of the classifiers against plain versions of the whole result, and held-out figures on the tables."""

import math
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lakeloom.llm import language_id, quality, toxicity
from lakeloom.llm.common import crc_mod, read
from tests.llm.test_toxicity_whole import plain_scores

SF = "/root/testdata/sf0.001"


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m


def letters(text):
    """Runs of letters by Unicode category."""
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()


class PlainLanguages:
    """Word-first backoff from dictionaries of strings."""

    def __init__(self, sample):
        self.langs = sorted({lang for _, lang in sample})
        words = {lang: Counter() for lang in self.langs}
        for text, lang in sample:
            words[lang].update(letters(text))
        total = sum(words.values(), Counter())
        self.words = self.table(words, [w for w, n in total.items() if n >= 2], {lang: max(1, sum(words[lang].values())) for lang in self.langs})
        self.grams = {}
        for n in range(5, 0, -1):
            grams = {lang: Counter(g for w in words[lang] for p in self.pieces(w) for g in self.of(p, n)) for lang in self.langs}
            every = sum(grams.values(), Counter())
            table = self.table(grams, [g for g, k in every.items() if k >= 2], {lang: max(1, sum(grams[lang].values())) for lang in self.langs})
            self.grams[n] = {g: [s - 0.5 * (5 - n) for s in row] for g, row in table.items()}

    def table(self, counts, known, sums):
        return {w: [math.log((counts[lang][w] + 0.1) / (sums[lang] + 0.1 * (len(known) + 1))) for lang in self.langs] for w in known}

    def pieces(self, w):
        return [w[i : i + 64] for i in range(0, len(w), 64)]

    def of(self, piece, n):
        line = f"_{piece}_"
        return [line[i : i + n] for i in range(len(line) - n + 1)]

    def scores(self, text):
        out = np.zeros(len(self.langs))
        for w in letters(text):
            if w in self.words:
                out += self.words[w]
                continue
            rows, places = np.zeros(len(self.langs)), 0
            for p in self.pieces(w):
                line = f"_{p}_"
                places += len(line)
                for i in range(len(line)):
                    n = next((n for n in range(5, 0, -1) if i + n <= len(line) and line[i : i + n] in self.grams[n]), 0)
                    rows += self.grams[n][line[i : i + n]] if n else 0
            out += rows / places
        return out


def test_languages_against_a_plain_version(spark):
    docs = read(spark, SF, "documents")
    rows = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()
    plain = PlainLanguages([(t, lang) for d, t, lang in rows if crc(d, 3) != 1 and lang is not None and t is not None])
    got = {r.doc_id: r for r in language_id.op2_language_id(spark, SF).collect()}
    assert len(got) == len(rows) == docs.count()
    for d, t, _ in rows:
        r = got[d]
        assert r.held_out == (crc(d, 3) == 1)
        if not letters(t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = plain.scores(t)
        mean = s / len(letters(t))
        share = np.exp(mean - mean.max())
        best = int(np.argmax(s))
        if np.sort(s)[-1] - np.sort(s)[-2] > 1e-3:
            assert r.lang_pred == plain.langs[best]
            assert r.score == pytest.approx(share[best] / share.sum(), abs=1e-3)


def test_toxicity_query_against_a_plain_version(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic", crc_mod(5) != 0))
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert r.held_out == (crc(d, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        words = toxicity.words_of(t or "")
        if 0 < len(words) < 160:
            assert r.score == pytest.approx(1 / (1 + math.exp(-max(plain_scores(model, words)))), abs=1e-4)


def test_held_out_toxicity_on_the_tables():
    """The figures that the README states."""
    for sf, least, most in (("sf0.01", 0.6, 0.05), ("sf0.1", 0.8, 0.03)):
        at = f"/root/testdata/{sf}"
        rows = duckdb.sql(f"select doc_id, text, toxic from '{at}/documents.parquet' join '{at}/labels.parquet' using (doc_id) order by doc_id").fetchall()
        sample = [[(t, y) for d, t, y in rows if crc(d, 5) and y == k][: toxicity.PER_CLASS] for k in (0, 1)]
        held = [(t, y) for d, t, y in rows if not crc(d, 5)]
        found = toxicity.Scorer(toxicity.train(sum(sample, []))).scores([t for t, _ in held]) >= 0.5
        toxic = np.array([y for _, y in held]) == 1
        print(sf, "toxic", toxic.sum(), "found", (found & toxic).sum(), "clean", (~toxic).sum(), "false", (found & ~toxic).sum())
        assert found[toxic].mean() >= least and found[~toxic].mean() <= most


def test_quality_query_against_a_plain_version(spark):
    docs = read(spark, SF, "documents")
    scorer = quality.trained(docs)
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in quality.op10_quality(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        data = (t or "").encode()
        words, seen = quality.traits(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        if not words[0]:
            assert got[d].score == 0 and not got[d].keep
            continue
        logit = scorer.bias + sum(float(scorer.step[i]) for i in quality.steps(words, seen)[0])
        weights = [float(scorer.gram[((a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF) >> 17]) for a, b, c in zip(data, data[1:], data[2:])]
        logit += sum(weights) / len(weights) if weights else 0
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5) and got[d].keep == (got[d].score >= 0.5)


def test_tokens_query_against_the_library(spark):
    from hashlib import sha256

    import public_tokenizers as tok
    import tiktoken

    from lakeloom.llm import bpe

    ranks = {t: i for i, t in enumerate(bpe.load_ranks(tok.path(bpe.VOCABULARY)))}
    enc = tiktoken.Encoding("plain", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in bpe.op5_bpe(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        r = got[d]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest())
