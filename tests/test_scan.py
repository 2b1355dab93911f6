import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators.intervals import coverage, overlap_join
from lakeloom.operators.scan import celled, grouped, places, prefix_sums, quantile_of_each, value_ranks


def some(spark, n=3000, seed=1):
    """One group of nine tenths, a null group, small groups; values with ties and nulls; i unique."""
    r = random.Random(seed)
    rows = [(r.choice(["big"] * 27 + [None, "a", "b"]), r.choice([None, 5, 5, *range(40)]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v int, i int").repartition(6)


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def low(v):
    return (v is not None, v if v is not None else 0)


@pytest.mark.parametrize("size", [1_000_000, 200])
def test_places_sums_and_ranks(spark, size):
    rows, frame = some(spark)
    got = {r.i: r for r in places(value_ranks(prefix_sums(frame, ["g"], ["v", "i"], {"total_v": F.col("v")}, size), ["g"], "v", size=size), ["g"], ["v", "i"], size=size).collect()}
    assert len(got) == len(rows)
    for group in by_group(rows).values():
        group.sort(key=lambda r: (low(r[1]), r[2]))
        run, values = None, sorted({r[1] for r in group}, key=low)
        for k, (_, v, i) in enumerate(group):
            run = run if v is None else (run or 0) + v
            first = next(j for j, r in enumerate(group) if r[1] == v)
            assert (got[i].place, got[i].total, got[i].total_v, got[i]["rank"], got[i].dense) == (k + 1, len(group), run, first + 1, values.index(v) + 1)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("size", [1_000_000, 7])
def test_quantiles(spark, q, size):
    rows, frame = some(spark, 800, 2)
    got = {r.g: r.at for r in quantile_of_each(frame.withColumn("v", F.col("v") * 1.0), ["g"], "v", q, "at", size).collect()}
    want = {g: float(np.quantile([r[1] for r in group if r[1] is not None], q)) for g, group in by_group(rows).items()}
    assert got == pytest.approx(want)


def test_one_group_is_many_tasks(spark):
    frame = spark.range(20_000, numPartitions=4).selectExpr("'one' g", "pmod(id * 7919, 20000) v")
    cells = {r["_cell"]: (r.n, r.lo, r.hi) for r in celled(grouped(frame, ["g"]), ["v"], 1000).groupBy("_cell").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert len(cells) >= 15 and max(n for n, _, _ in cells.values()) < 3000
    assert all(cells[a][2] < cells[b][1] for a in cells for b in cells if a < b)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = prefix_sums(frame, ["g"], ["v"], {"n": F.lit(1)}, 1000).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_refused(spark):
    frame = spark.createDataFrame([], "g string, v double, i int")
    assert places(frame, ["g"], ["v", "i"]).count() == quantile_of_each(frame, ["g"], "v", 0.5, "m").count() == value_ranks(frame, ["g"], "v").count() == 0
    with pytest.raises(ValueError):
        prefix_sums(frame.withColumn("_cell", F.lit(1)), ["g"], ["v"], {"n": F.lit(1)})
    with pytest.raises(ValueError):
        prefix_sums(frame, ["g"], ["v"], {"v": F.lit(1)})


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_against_all_pairs(spark, width):
    r = random.Random(3)
    make = lambda n, top: [(i, r.choice("xy"), s := r.randint(-50, 200), s + r.choice([0, -3, 1, 2, 5, 17, 64, 300, top])) for i in range(n)]
    left, right = make(90, 1000), make(80, 5)
    a = spark.createDataFrame([*left, (900, "x", None, 3)], "i int, k string, s int, e int")
    b = spark.createDataFrame([*right, (901, None, 0, 9)], "j int, k string, t int, f int")
    got = [(x.i, x.j) for x in overlap_join(a, b, (F.col("s"), F.col("e")), (F.col("t"), F.col("f")), width, ["k"]).collect()]
    want = [(i, j) for i, k, s, e in left for j, m, t, f in right if k == m and s < e and t < f and s < f and t < e]
    assert sorted(got) == sorted(want) and len(want) > 500
    assert overlap_join(a.limit(0), b, (F.col("s"), F.col("e")), (F.col("t"), F.col("f")), width, ["k"]).count() == 0


@pytest.mark.parametrize("size", [1_000_000, 20])
def test_coverage_against_counting(spark, size):
    r = random.Random(4)
    rows = [(r.choice(["x", "x", "x", None]), s := r.randint(0, 400), s + r.randint(-1, 60)) for _ in range(500)] + [("x", None, 4), ("x", 4, None)]
    got = {(x.k, x["at"]): x.open for x in coverage(spark.createDataFrame(rows, "k string, s int, e int"), ["k"], "s", "e", size).collect()}
    real = [(k, s, e) for k, s, e in rows if s is not None and e is not None and s < e]
    want = {(k, p): sum(a == k and s <= p < e for a, s, e in real) for k, *ends in real for p in ends}
    assert got == want
