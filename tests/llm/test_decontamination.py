import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import decontamination as dc

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similarity(a, b):
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(docs, items):
    """The best of all item-sized windows, for each document and item."""
    out = {}
    of_items = {i: shingles(words(t)) for i, t in items}
    for d, t in docs:
        s = shingles(words(t))
        here = set(s)
        for i, x in of_items.items():
            if not x or here.isdisjoint(x):
                continue
            n = len(x)
            best = max(similarity(s[k : k + n], x) for k in range(max(1, len(s) - n + 1)))
            if best >= 0.8:
                out[d, i] = best
    return out


def test_query_against_all_windows(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.op6_decontamination(spark, SF).collect()}
    assert got == pytest.approx(brute(docs, items)) and got


def test_edited_passages(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.choice((5, 6, 30, 60, 60, 300)))) for i in range(12)]
    docs = []
    for d in range(60):
        passage = list(r.choice(items)[1])
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            passage[r.randrange(len(passage))] = "changed"
        docs.append((d, " ".join(text(r.randint(0, 80)) + passage + text(r.randint(0, 80))).upper()))
    items = [(i, ", ".join(w)) for i, w in items]
    plain = brute(docs, items)
    found = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert got.keys() <= plain.keys() and all(got[k] <= plain[k] + 1e-9 for k in got)
    clear = {k for k, v in plain.items() if v > 0.86}
    assert clear <= got.keys() and len(got) >= 0.95 * len(plain) and len(plain) > 25


def test_fingerprint_and_numbers(spark):
    for n, most in ((3, 200), (40, 300), (7, 70_000)):
        row = dc.numbered(dc.fingerprinted(spark.range(n).agg(F.collect_list(F.xxhash64(F.col("id") % 5)).alias("h")), most)).withColumn("n", F.size(F.array_distinct("tags"))).first()
        plain = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in row.h) > len(row.h))
        assert row.fp % (1 << 64) == plain and row.n == n


def test_main_path_has_no_python(spark):
    plan = dc.op6_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two"), (3, None), (None, "a b c d e")], "item_id long, text string")
    rows = [(1, "say: One two three, four five six!", "x"), (1, "say: One two three, four five six!", "x"), (2, None, "x"), (3, "", "x"), (4, "one two", "x"), (None, "one two three four five six", "x"), (5, "z " * 30_000 + "a b c d e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = dc.matches(docs, items)
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == [(1, 1), (5, None), (None, 1)]
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert dc.matches(docs.limit(0), items).count() == dc.matches(docs, items.limit(0)).count() == 0


def test_index_finds_all_within_radius(spark):
    r = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    signed = lambda x: x - (x >> 63 << 64)
    items = [(i, r.choice((10, 20)), r.getrandbits(64)) for i in range(30)]
    windows = [(20 * i + k, n, flip(x, k)) for i, n, x in items for k in range(20)] + [(1000 + i, 20, r.getrandbits(64)) for i in range(50)]
    frame = lambda rows, name: spark.createDataFrame([(a, n, signed(x)) for a, n, x in rows], f"{name} long, n int, fp long")
    got = {(x.window, x.item): x.hamming for x in dc.near_pairs(frame(windows, "window"), frame(items, "item")).collect()}
    plain = {(w, i): (x ^ y).bit_count() for w, n, x in windows for i, m, y in items if n == m and (x ^ y).bit_count() <= dc.RADIUS}
    assert got == plain and all((20 * i + k, i) in got for i, _, _ in items for k in range(20))
    assert sum(high - low for low, high in map(dc.bounds, range(dc.BLOCKS))) == 64


def test_equal_words_have_one_window(spark):
    item = ["a"] * 400
    docs = [(1, "a " * 20_000), (2, "b " * 50 + "a " * 1000 + "c " * 50), (3, "a " * 390 + "b " * 100), (4, "a " * 100)]
    run = dc.bounded_runs(spark.createDataFrame([(1, 0, 396, 19_996, at) for at in range(19_996)], "doc_id long, item long, n int, size int, at int"), 0.8)
    assert [tuple(x) for x in run.collect()] == [(1, 19_996, 396, 0, 19_600)]
    items = [(7, " ".join(item))]
    found = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert got == pytest.approx(brute([(d, t) for d, t in docs if d > 1], items) | {(1, 7): 1.0})


def stems(r, n):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(12))
    stem = [word() for _ in range(20)]
    items = [(i, " ".join(stem + [word() for _ in range(30)])) for i in range(n)]
    docs = [(d, " ".join(x for _ in range(20) for x in [*stem, *(word() for _ in range(10))])) for d in range(20)]
    return items, docs


@pytest.mark.parametrize("n", [20, 800])
def test_a_stem_of_many_items_names_none(spark, n):
    items, docs = stems(random.Random(n), n)
    docs += [(100 + i, "before " + items[i][1] + " after") for i in range(3)]
    items += [(n + 1, items[0][1] + " more"), (n + 2, items[0][1])]
    known = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = dc.with_shingles(known.selectExpr("item_id item", "text")).withColumn("n", F.size("h"))
    pairs = dc.named(frame, dc.rare_shingles(rows, 0.8)).collect()
    assert {x.doc_id for x in pairs} == {100, 101, 102} and len(pairs) == 5
    got = {(x.doc_id, x.item_id): x.similarity for x in dc.matches(frame, known).collect()}
    assert got == pytest.approx(brute(docs[-3:], items)) and len(got) == 5


def test_index_that_is_not_broadcast(spark, monkeypatch):
    items, docs = stems(random.Random(1), 12)
    docs += [(100 + i, items[i % 2][1]) for i in range(30)]
    make = lambda: {(x.doc_id, x.item_id): x.similarity for x in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = make()
    monkeypatch.setattr(dc, "few", lambda rows: False)
    monkeypatch.setattr("lakeloom.operators.skew.HOT", 5)
    assert make() == plain and len(plain) == 30
