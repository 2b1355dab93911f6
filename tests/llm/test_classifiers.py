import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import language_id, quality, toxicity
from lakeloom.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text, lang, quality, toxic from '{SF}/documents.parquet' left join '{SF}/labels.parquet' using (doc_id) order by doc_id").fetchall()


def test_crc_is_that_of_the_id_as_text(spark):
    got = {r.id: r.m for r in spark.range(50).select("id", crc_mod(7, "id").alias("m")).collect()}
    assert got == {d: crc(d, 7) for d in range(50)}


def test_languages_of_held_out_documents(spark, rows):
    truth = {r[0]: r[2] for r in rows}
    got = language_id.op2_language_id(spark, SF).collect()
    assert len(got) == len(rows) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_backs_off(spark):
    model = language_id.Model.fit([("katze hund katze maus ungen", "de"), ("katze hund bungen zungen", "de"), ("chien chat chien souris tion", "fr"), ("chat chien nation lation", "fr")])
    best, score = model.predict(["katze", "rungen", "motion", "", "123 !", "x" * 100_000, "Katze\tCHAT chat"])
    assert [model.languages[i] if i >= 0 else "und" for i in best] == ["de", "de", "fr", "und", "und", model.languages[best[5]], "fr"]
    assert score[3] == score[4] == 0 and (score <= 1).all()
    whole, _ = model.predict(["katze chat chat", "rungen motion motion"])
    assert [model.languages[i] for i in whole] == ["fr", "fr"]
    docs = spark.createDataFrame([(1, None, "x"), (1, "12", "x"), (None, "katze", "x")], "doc_id long, text string, lang_pred string")
    assert [(r.doc_id, r.lang_pred) for r in language_id.identified(docs, model).collect()] == [(1, "und"), (1, "und"), (None, "de")]
    assert [r.lang_pred for r in language_id.identified(docs, language_id.Model.fit([])).collect()] == ["und"] * 3
    assert language_id.identified(docs.limit(0), model).count() == 0
    numerals = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "Ⅷ 12 ٣"), (4, "²katze")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identified(numerals, model).collect()] == ["und", "und", "und", "de"]
    again = spark.createDataFrame([(2, "b c", "de"), (2, "a c", "fr"), (3, "x", "fr")], "doc_id long, text string, lang string")
    assert language_id.training_sample(again, crc_mod(3) != 9) == [("a c", "fr"), ("x", "fr")]


def test_gradients_by_differences():
    model, r = toxicity.Model.new({"a": 1}), np.random.default_rng(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    vectors, at = r.standard_normal((7, toxicity.WORD_SIZE)), r.integers(0, 7, (5, 4))
    mask, y = (np.arange(5)[None, :] < np.array([5, 3, 4, 1])[:, None]).astype(float), np.array([1, 0, 1, 0.0])

    def loss():
        x = vectors[at]
        logit = model.forward({w: x @ model.p[f"in_{w}"] + model.p[f"bias_{w}"] for w in "fb"}, mask)
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    g, _ = model.gradient(vectors, at, mask, y)
    for name in g:
        i = tuple(r.integers(0, s) for s in model.p[name].shape)
        old, e = model.p[name][i], 1e-3
        model.p[name][i] = old + e
        up = loss()
        model.p[name][i] = old - e
        down = loss()
        model.p[name][i] = old
        assert g[name][i] == pytest.approx((up - down) / 2 / e, abs=3e-5), name


def test_windows_cover_the_whole_text():
    for n in (0, 1, 23, 24, 25, 100, 1000):
        starts = toxicity.windows(n)
        seen = {k for s in starts for k in range(s, min(n, s + toxicity.SPAN))}
        assert seen == set(range(n))


def test_toxic_network_learns_planted_words(spark):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(400)]
    text = lambda n: list(r.choice(words, n))
    sample = []
    for i in range(240):
        w = text(int(r.integers(5, 120)))
        if i % 2:
            for _ in range(2):
                w[int(r.integers(len(w)))] = f"vlork{r.choice(['a', 'ix', 'um', 'en'])}"
        sample.append((" ".join(w), i % 2))
    model = toxicity.train(sample[:180])
    scores = toxicity.Scorer(model).scores([t for t, _ in sample[180:]])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in sample[180:]])) > 0.9
    late = " ".join(text(30_000) + ["vlorkix"])
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, late, 1), (3, late, 1), (None, words[0], 1)], "doc_id long, text string, score int")
    got = toxicity.scored(docs, model).collect()
    assert got[0].score == got[1].score == 0 and got[2].score == got[3].score >= 0.5 > got[4].score
    assert toxicity.train([("a b", 1)]) is None and {x.score for x in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, "toxic", crc_mod(5) != 9) == [("", 1)]


def test_quality_on_labels(spark, rows):
    truth = {r[0]: r[3] for r in rows if r[3] is not None}
    got = {r.doc_id: r for r in quality.op10_quality(spark, SF).collect()}
    assert len(got) == len(rows)
    good = [got[d].keep for d, y in truth.items() if y == 1]
    bad = [got[d].keep for d, y in truth.items() if y == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def plain_traits(text):
    words = text.split(" ")
    n = len(words)
    size = sum(map(len, words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    distinct = sum(len(set(words[i : i + quality.STRETCH])) for i in range(0, n, quality.STRETCH)) / n
    lone = sum(not any(c.isalnum() for c in w) for w in words) / n
    upper = sum(c.isupper() for c in text) / max(1, sum(c.isalpha() for c in text))
    return [upper, sum(c in "$%&*#|" for c in text) / size, sum(len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum() for w in words) / n, lone, same, distinct, size / n, sum(any(c.isalpha() for c in w) for w in words) / n]


def test_traits_against_plain_counts():
    some = ["One Two two two", "a | b | c$$$ d!!", "x " * 300 + "y", "WORD", "12 34", "", "end."]
    column = pa.array(some)
    words, seen = quality.traits(*next(quality.in_blocks(column)))
    assert words.tolist() == [4, 6, 301, 1, 2, 0, 1]
    for text, row in zip(some, seen, strict=True):
        if text:
            assert row.tolist() == pytest.approx(plain_traits(text)), text


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(2)
    n, k = 20_000, len(quality.TRAITS)
    y = r.random(n) < 0.8
    right = np.linspace(0.75, 0.97, k)
    vote = np.where(r.random((n, k)) < right, y[:, None], ~y[:, None]).astype(int)
    vote[r.random((n, k)) < 0.2] = quality.NONE
    patterns, counts = np.unique((vote * 3 ** np.arange(k - 1, -1, -1)).sum(axis=1), return_counts=True)
    post, table, share = quality.expectation_maximisation(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.02)
    assert list(quality.accuracies(table, share).values()) == pytest.approx(list(right), abs=0.03)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "A plain sentence of words, nothing more.", 1), (4, "A plain sentence of words, nothing more.", 1), (None, "w " * 100_000, 1)], "doc_id long, text string, score int")
    scorer = quality.trained(docs)
    got = quality.scored(docs, scorer).collect()
    assert [r.keep for r in got[:3]] == [False] * 3 and got[3].score == got[4].score and len(got) == 6
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.limit(0)).count() == quality.scored(docs.limit(0), quality.trained(docs.limit(0))).count() == 0
