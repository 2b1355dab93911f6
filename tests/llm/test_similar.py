import random

import duckdb
import pytest

import corpus_pipeline
from lakeloom.llm import simhash


def plain_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def greedy(sets):
    """Who stays: in order of id, whoever is similar to none that stays."""
    kept = []
    for d in sorted(sets):
        if not any(alike(sets[d], sets[k]) for k in kept):
            kept.append(d)
    return kept


def chain(n, words=100, step=7):
    """Texts of which each is similar to the next alone."""
    base = [f"w{i}" for i in range(words + step * n)]
    return [" ".join(base[step * i : step * i + words]) for i in range(n)]


@pytest.mark.parametrize("group,leads", [(256, 3), (3, 3), (2, 1), (6, 0), (4, 0), (2, 0)])
def test_a_chain_is_one_rule_at_any_size(spark, group, leads):
    texts = chain(12)
    sets = {i: plain_set(t) for i, t in enumerate(texts)}
    assert all(alike(sets[i], sets[j]) == (j - i <= 1) for i in sets for j in sets if i <= j)
    rows = [(5, i, sorted(hash(x) for x in s)) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "component_id long, doc_id long, tags array<long>")
    gone = {r[0] for t in simhash.dropped_similar(table, group, leads) for r in t.collect()}
    assert sorted(sets.keys() - gone) == [0, 2, 4, 6, 8, 10] == greedy(sets)


@pytest.mark.parametrize("group,leads", [(256, 3), (5, 2), (5, 0)])
def test_components_against_the_plain_rule(spark, group, leads):
    r = random.Random(4)
    rows, sets = [], {}
    for c in range(4):
        pool = [[r.randrange(1 << 60) for _ in range(40)] for _ in range(3)]
        for _ in range(30):
            some = list(r.choice(pool))
            for _ in range(r.randint(0, 6)):
                some[r.randrange(40)] = r.randrange(1 << 60)
            if r.random() < 0.3:
                pool.append(some)
            d = len(sets) * 7 % 120
            sets[d] = set(some)
            rows.append((c, d, sorted(sets[d])))
    rows += [(0, 200 + i, []) for i in range(3)]
    sets |= {200: set()}
    table = spark.createDataFrame(rows, "component_id long, doc_id long, tags array<long>")
    gone = {x[0] for t in simhash.dropped_similar(table, group, leads) for x in t.collect()}
    assert sorted({d for _, d, _ in rows} - gone) == greedy(sets)


@pytest.mark.parametrize("group,leads", [(256, 3), (4, 3), (4, 0)])
def test_stage_drops_edited_copies(spark, monkeypatch, group, leads):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "LEADS", leads)
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows = []
    for d in range(60):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        for k in range(1 if d else 40):
            rows.append((len(rows), " ".join(base)))
            for n in (1, 2, 3):
                copy = list(base)
                for _ in range(n * len(base) // 120 + 1):
                    copy[r.randrange(len(copy))] = r.choice(words)
                rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = {d: plain_set(t) for d, t in rows}
    kept = {x.doc_id for x in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert sorted(kept) == greedy(sets)
    plain = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any(alike(sets[a], sets[b]) for a in plain for b in plain if a < b)  # what four bits leave


def test_stage_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {d: plain_set(t) for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    kept = sorted(x.doc_id for x in corpus_pipeline.near_stage(spark, docs, sf).collect())
    for i, a in enumerate(kept):
        x = sets[a]
        for b in kept[:i]:
            y = sets[b]
            assert 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)) or not x & y or not alike(x, y)


def test_texts_of_one_vocabulary_are_not_linked(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(300))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.compared(docs).count() == 0
    assert simhash.linked(docs.limit(0).selectExpr("doc_id", "doc_id fp"), docs.limit(0).selectExpr("doc_id fp", "doc_id rep"), 4, 9, 64).count() == 0


def test_stage_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(3, None), (1, ""), (2, " \n"), (4, long), (5, long + " more"), (6, long), (6, long), (None, long), (7, "Some words"), (8, "some  words"), (9, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for clash in ("component_id", "compared_id", "dropped_id", "tags", "group"):
        docs = docs.selectExpr("*", f"cast(null as long) {clash}")
    kept = simhash.deduplicate_similar(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 7, 9, None]
    assert simhash.deduplicate_similar(docs.limit(0)).count() == 0
