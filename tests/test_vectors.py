import numpy as np
import pyarrow as pa
import pytest

from lakeloom.operators import vectors
from lakeloom.operators.vectors import VectorIndex
from lakeloom.plans import catalog


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        far = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
        out[q] = [(i, round(x, 9)) for x, i in far[:k]]
    return out


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.place)):
        out.setdefault(r.query_id, []).append((r.near_id, round(r.distance, 9)))
    return out


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((30, d)) * 3
    return [(i, (centres[r.integers(30)] + r.standard_normal(d)).astype(np.float32).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("part,block", [(20_000, 2_000), (50, 7)])
def test_exact_search_is_brute_force(spark, monkeypatch, tmp_path, part, block):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = clustered(500, 8, 1)
    rows += [(1000 + i, rows[7][1]) for i in range(250)]  # a third are one vector
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(frame, f"{tmp_path}/i", "id", "v")
    assert index.lists.count() == 500 and index.members.count() == 750
    queries = [x for x in rows if x[0] % 20 == 0]
    asked = frame.where("id % 20 = 0")
    assert got(index.search(asked, "id", "v", 5, f"{tmp_path}/s")) == exact(rows, queries, 5)
    again = VectorIndex.open(spark, f"{tmp_path}/i")
    assert (again.centres == index.centres).all()


def test_recall_with_few_lists(spark, tmp_path):
    rows = clustered(3000, 16, 2)
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(frame, f"{tmp_path}/i", "id", "v")
    probes = index.probes_for(0.95, frame, "id", "v", 10, f"{tmp_path}/p")
    assert probes < len(index.centres) / 3
    near = got(index.search(frame.where("id % 20 = 0"), "id", "v", 10, f"{tmp_path}/s", probes))
    want = exact(rows, [x for x in rows if x[0] % 20 == 0], 10)
    recall = np.mean([len({i for i, _ in near[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9 and near.keys() == want.keys()


def test_queries_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    near, want = ({k: {i for i, _ in v} for k, v in got(q(spark, sf)).items()} for q in (catalog.nearest_vectors, catalog.nearest_vectors_exact))
    assert near.keys() == want.keys() and len(want) == 25
    assert np.mean([len(near[q] & want[q]) / 10 for q in want]) >= 0.9


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0]), (None, [0.0, 1.0]), (9, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 rep", "2 list")
    index = VectorIndex.build(frame, f"{tmp_path}/i", "id", "v")
    near = got(index.search(frame.where("id in (1, 3)"), "id", "v", 3, f"{tmp_path}/s"))
    assert near == {1: [(9, 0.0), (2, 1.0), (2, 1.0)]}
    assert index.search(frame.limit(0), "id", "v", 3, f"{tmp_path}/t").count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(frame.limit(0), f"{tmp_path}/none", "id", "v")


def test_what_a_task_holds_does_not_grow_with_the_lists(spark, monkeypatch, tmp_path):
    some = pa.RecordBatch.from_pydict({"rep": pa.array(range(10)), "v": pa.array([[float(i)] * 4 for i in range(10)])})
    lists = np.tile(np.arange(30), (10, 1))
    monkeypatch.setattr(vectors, "ROOM", 28)
    found = list(vectors.copies(some, lists, 4))
    assert max(b.num_rows for b in found) <= 7
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == [(j, i, [float(i)] * 4) for i in range(10) for j in range(30)]
    # the exact search doesn't copy its queries for each list
    rows = clustered(300, 4, 3)
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(frame, f"{tmp_path}/i", "id", "v")
    monkeypatch.setattr(VectorIndex, "_probed", None)
    assert got(index.search(frame.where("id % 20 = 0"), "id", "v", 3, f"{tmp_path}/s")) == exact(rows, [x for x in rows if x[0] % 20 == 0], 3)
