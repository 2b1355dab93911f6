import random

import duckdb
import numpy as np
import pytest
import xxhash

from lakeloom.llm import simhash


def brute_components(fps: dict[int, int], budget=4):
    ids = sorted(fps)
    top = {i: i for i in ids}
    values = np.array([fps[i] for i in ids], np.uint64)
    for _ in range(len(ids)):
        changed = False
        for k, i in enumerate(ids):
            near = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= budget)
            low = min(top[ids[j]] for j in near)
            for j in near:
                if top[ids[j]] != low:
                    top[ids[j]], changed = low, True
        if not changed:
            return top
    return top


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clustered(n, seed, spread=3):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        v = r.choice(centres)
        for _ in range(r.randint(0, spread)):
            v ^= 1 << r.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("n,spread", [(2, 1), (60, 2), (400, 4), (700, 8)])
def test_walk_connects_as_all_pairs_do(n, spread):
    values = np.array(clustered(n, n, spread), np.uint64)
    expected = brute_components({i: int(v) for i, v in enumerate(values)})
    top = {i: i for i in range(n)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = simhash.walk(values, leaf=8)
    for i, j in links:
        assert int(values[i] ^ values[j]).bit_count() <= 4
        a, b = find(i), find(j)
        assert a != b
        top[max(a, b)] = min(a, b)
    assert {i: find(i) for i in range(n)} == expected


@pytest.mark.parametrize("hot,whole", [(4096, None), (20, None), (4096, 3), (20, 3)])
def test_links_and_components(spark, hot, whole):
    values = clustered(600, 5, 5)
    fps = {10 * i + 3: v for i, v in enumerate(values)}
    rows = [(int(np.uint64(v).astype(np.int64)), i) for i, v in fps.items()]
    found = simhash.components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"), hot=hot, whole=whole)).collect()
    top = {i: i for i in fps} | {r.id: r.root for r in found}
    assert top == brute_components(fps)


def test_roots_take_more_blocks_for_more_fingerprints():
    assert [simhash.whole_blocks(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**11)] == [2, 2, 2, 3, 4]
    for whole in (2, 3):
        sets = [set(b) for b in simhash.roots(list(range(64)), 4, whole)]
        r = random.Random(whole)
        for _ in range(500):
            differ = set(r.sample(range(64), 4))
            assert any(not differ & s for s in sets)


def test_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    fps = {d: plain_fingerprint(t) for d, t in rows}
    top = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, sf).collect()}
    assert got == {d: (f"{fps[d]:016x}", top[d]) for d in fps}


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "One two", 9), (4, "One two", 9), (5, "one\ttwo", 9), (6, "a b c d e " * 3000, 9), (None, "one two", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == 8
    assert all(c == 1 for d, f, c in got if d in (1, 2, 3)) and all(f == 0 for d, f, c in got if d in (1, 2, 3))
    assert {c for d, f, c in got if d in (4, 5, None)} == {4}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.deduplicate(docs).columns == docs.columns


def test_hot_roots_are_dealt_again(spark):
    r = random.Random(11)
    values = set()  # all agree on 30 bits: whole first and second deals are hot
    while len(values) < 3000:
        values.add(r.getrandbits(34))
    values = sorted(values)
    for m in simhash.further(simhash.mask_of(list(range(20, 41))), 4):
        assert m & simhash.mask_of(list(range(20, 41))) == simhash.mask_of(list(range(20, 41)))
    rows = [(v, i) for i, v in enumerate(values)]
    found = simhash.links(spark.createDataFrame(rows, "fp long, rep long").repartition(3), hot=100)
    top = {i: i for i in range(len(values))} | {x.id: x.root for x in simhash.components(found).collect()}
    assert top == brute_components(dict(enumerate(values)))


def test_rows_without_an_id_link_others(spark):
    rows = [(0, 0b0), (None, 0b1111), (2, 0b11111111), (None, 1 << 60 | 0xFFFF0000), (5, 0xFF00FF00FF00)]
    each = spark.createDataFrame(rows, "doc_id long, fp long")
    distinct = each.groupBy("fp").agg({"doc_id": "min"}).toDF("fp", "rep")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.linked(each, distinct, 4, 4096, 64).collect()), key=lambda x: rows.index(x[:2]))
    assert [c for _, _, c in got] == [0, 0, 0, None, 5]
