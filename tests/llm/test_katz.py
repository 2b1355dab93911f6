import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lakeloom.llm import katz

SF = "/root/testdata/sf0.001"


def plain_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w.encode() for w in low.split(" ") if w] + [katz.END]


def discounted(n, d, absolute):
    return n * (d[n] if n <= katz.LAST_DISCOUNTED else 1) - absolute


class Plain:
    """The model from dictionaries, token by token."""

    def __init__(self, train):
        uni, bi = Counter(), Counter()
        for text in train:
            w = plain_tokens(text)
            uni.update(w)
            bi.update(zip([katz.END, *w], w))
        self.d1, self.d2 = katz.discounts(Counter(uni.values())), katz.discounts(Counter(bi.values()))
        self.counts, self.total, self.types = uni, sum(uni.values()), len(uni)
        self.p1 = {w: discounted(n, *self.d1) / (self.total + 1) for w, n in uni.items()}
        self.unseen = 1 - sum(self.p1.values())
        self.after = defaultdict(dict)
        for (b, w), n in bi.items():
            self.after[b][w] = n
        self.p2, self.alpha, self.lossless = {}, {}, 0
        for b, after in self.after.items():
            kept, below = sum(discounted(n, *self.d2) for n in after.values()), sum(after.values())
            none = below - kept < 1e-9
            self.lossless += none
            below += none
            self.p2 |= {(b, w): discounted(n, *self.d2) / below for w, n in after.items()}
            self.alpha[b] = (1 - kept / below) / (1 - sum(self.p1[w] for w in after))

    def p(self, b, w):
        return self.p2[b, w] if (b, w) in self.p2 else self.alpha.get(b, 1) * self.p1.get(w, self.unseen)

    def score(self, text):
        w = plain_tokens(text)
        return sum(math.log10(self.p(b, x)) for b, x in zip([katz.END, *w], w))

    def base(self, text):
        return sum(math.log10((self.counts[w] + 1) / (self.total + self.types + 1)) for w in plain_tokens(text))


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def test_query_against_a_plain_model(spark, rows):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    plain = Plain([t for d, t in rows if not held[d]])
    got = {r.doc_id: r for r in katz.op8_katz(spark, SF).collect()}
    assert len(got) == len(rows) and any(held.values())
    for d, t in rows:
        words, r = plain_tokens(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words), sum(plain.counts[w] > 0 for w in words), plain.total)
        assert r.base_score == pytest.approx(plain.base(t), rel=1e-9)
        assert r.score == pytest.approx(plain.score(t), rel=1e-9)


@pytest.mark.parametrize("parts", [1, 5])
def test_word_bigrams_against_a_plain_model(spark, rows, parts):
    rows = sorted(rows)[:60]
    rows += [(9000, "zyxa zyxb"), (9001, "zyxb zyxa"), (9002, None), (9003, "new newer")] + [(k, "zyxa zyxb") for k in range(9010, 9020)]
    train = [(d, t) for d, t in rows if d % 3 and d not in (9001, 9003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    t = katz.train_tables(spark.createDataFrame(train, "doc_id long, text string").repartition(parts))
    plain = Plain([x for _, x in train])
    assert t.unseen == pytest.approx(plain.unseen, rel=1e-9)
    got = {r.doc_id: r.score for r in katz.score_by_tables(docs, t).collect()}
    assert got == {d: pytest.approx(plain.score(x), rel=1e-9) for d, x in rows}
    assert got[9000] > got[9001] + 1  # the same rare words, of which training holds one order only
    counts = [r.n for r in katz.unfolded(t.counts.where("kind = 'pairs'")).collect()]
    assert sorted(counts) == sorted(n for a in plain.after.values() for n in a.values())
    none = katz.train_tables(docs.limit(0))
    assert {r.score for r in katz.score_by_tables(docs, none).collect()} == {0.0}
    assert katz.score_by_tables(docs.limit(0), t).count() == 0


def test_every_context_sums_to_one(spark):
    r = random.Random(3)
    common = " ".join(["big cat"] * 500 + ["big dog"] * 50)  # a context whose followers all occur more than 5 times
    some = [common] + [" ".join(f"w{min(int(r.paretovariate(0.7)), 400)}" for _ in range(60)) for _ in range(200)]
    plain = Plain(some)
    assert not plain.d2[1] and plain.lossless and b"big" in plain.alpha
    t = katz.train_tables(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"))
    words = sorted(plain.counts) + [b"neverseen"]
    asked = [(b, w) for b in (b"big", b"w1", b"w7", b"w400") for w in words if w != katz.END]
    texts = [(i, f"{b.decode()} {w.decode()}") for i, (b, w) in enumerate(asked)] + [(-1 - i, b.decode()) for i, b in enumerate((b"big", b"w1", b"w7", b"w400"))]
    scores = {x.doc_id: x.score for x in katz.score_by_tables(spark.createDataFrame(texts, "doc_id long, text string"), t).collect()}
    for i, b in enumerate((b"big", b"w1", b"w7", b"w400")):
        first = plain.p(katz.END, b)
        after = sum(10 ** scores[k] / first / plain.p(w, katz.END) for k, (x, w) in enumerate(asked) if x == b)
        assert after + 10 ** scores[-1 - i] / first == pytest.approx(1, abs=1e-9), b
        assert min(math.log10(plain.p(b, w)) for w in words) > -8


def test_good_turing_factors():
    d, absolute = katz.discounts({1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 35})
    assert not absolute and all(0 < x < 1 for x in d[1:])
    of = {1: 1000, 2: 300, 3: 140, 4: 80, 5: 50}
    assert sum(n * r * (1 - d[r]) for r, n in of.items()) == pytest.approx(1000)  # what is taken off is that of the words seen once
    assert katz.discounts({1: 3}) == (pytest.approx(np.ones(6)), 0.5)


def test_numbers_in_few_bytes():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), np.array([1, 2, 1 << 63], np.uint64), r.integers(0, 1 << 63, 1000, dtype=np.uint64)):
        assert katz.unpacked(katz.packed(x)).tolist() == x.tolist()
        assert katz.unpacked_keys(katz.packed_keys(np.sort(x))).tolist() == sorted(x.tolist())
    y = np.array([-1.5, 0.0, np.inf, 1e-300])
    assert katz.unpacked(katz.packed(y)).view(np.float64).tolist() == y.tolist()


def test_odd_rows(spark):
    rows = [(1, None, 0.0), (3, "", 0.0), (4, "The the THE\tend", 0.0), (4, "The the THE\tend", 0.0), (None, "x", 0.0), (5, "a " * 50_000 + "b", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    t = katz.train_tables(docs.where("doc_id in (3, 4, 5)"))
    got = katz.score_by_tables(docs, t).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 5, 5, 50_002]
    plain = Plain([x for d, x, _ in rows if d in (3, 4, 5)])
    assert sorted(r.score for r in got) == pytest.approx(sorted(plain.score(x) for _, x, _ in rows), rel=1e-9)
    r = {x.n_tokens: x for x in katz.score_by_tables(docs, katz.train_tables(docs.limit(0))).collect()}
    assert r[1].base_score == 0 and r[1].score == 0 and r[5].n_known == 0 and r[5].train_tokens == 0
