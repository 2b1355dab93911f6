import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lakeloom.operators.sketches import DISTINCT, RANK, DayStore, distinct_count, frequent, quantile
from lakeloom.plans import catalog


def some(spark, n, seed):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(r.choice("ab"), start + timedelta(hours=r.randrange(24 * 10)), r.randrange(20_000), r.gauss(0, 50), min(int(r.expovariate(0.01)), 500)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, at timestamp, who int, v double, item int")


def test_merged_days_are_within_their_bounds(spark, tmp_path):
    rows, frame = some(spark, 40_000, 1)
    store = DayStore(spark, f"{tmp_path}/s", ["g"])
    for k in range(4):
        store.add(frame.where(F.pmod("who", F.lit(4)) == k), f"b{k}", F.col("at"), "who", "v", "item")
    got = {r.g: r for r in store.merged(["g"], "2024-01-03", "2024-01-08").select("g", "rows", distinct_count().alias("d"), quantile(0.9).alias("q"), frequent(3).alias("top")).collect()}
    for g in "ab":
        mine = [x for x in rows if x[0] == g and datetime(2024, 1, 3) <= x[1] < datetime(2024, 1, 9)]
        r = got[g]
        assert r.rows == len(mine)
        assert abs(r.d - len({x[2] for x in mine})) <= DISTINCT * len({x[2] for x in mine})
        assert abs(sum(x[3] <= r.q for x in mine) / len(mine) - 0.9) <= RANK
        counts = {}
        for x in mine:
            counts[x[4]] = counts.get(x[4], 0) + 1
        assert sorted((t["count"] for t in r.top), reverse=True) == sorted(counts.values(), reverse=True)[:3]  # few values: exact
        assert all(counts[t["item"]] == t["count"] for t in r.top)


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    _, frame = some(spark, 2000, 2)
    store = DayStore(spark, f"{tmp_path}/s")
    total = lambda: store.merged().first()["rows"]
    store.add(frame, "one", F.col("at"), "who", "v", "item")
    store.add(frame, "one", F.col("at"), "who", "v", "item")
    assert total() == 2000
    late = frame.limit(10)
    store.add(late, "late", F.col("at"), "who", "v", "item")
    assert total() == 2010
    plan = store.table("2024-01-02", "2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and store.table("2024-01-02", "2024-01-03").select("day").distinct().count() == 2


def test_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), None, None, None), (None, 1, 1.0, 1), (datetime(2024, 1, 2), 1, 2.0, 3)], "at timestamp, who int, v double, item int")
    store = DayStore(spark, f"{tmp_path}/s")
    store.add(rows, "b", F.col("at"), "who", "v", "item")
    got = {str(r.day): (r.rows, r.d, r.q) for r in store.merged(["day"]).select("day", "rows", distinct_count().alias("d"), quantile(0.5).alias("q")).collect()}
    assert got == {"2024-01-01": (1, 0, None), "2024-01-02": (1, 1, 2.0)}


def weeks(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return {str(r.week): tuple(r)[1:] for r in catalog.weeks_from_day_sketches(spark, str(path)).collect()}


def test_a_week_without_frequent_users_or_with_one_value_stays(spark, tmp_path, monkeypatch):
    at = lambda day: datetime(2024, 1, day)
    rows = [(i, at(1 + i % 7), i % 6000, "view" if i % 3 else "error", float(i % 977)) for i in range(12_000)]  # nobody is frequent
    rows += [(i, at(8), i % 10, None, 5.0) for i in range(1000)]  # one value; no type
    rows += [(i, at(15), None if i % 2 else 1, "view", None) for i in range(100)]  # no value; a user that is null
    want = {"2024-01-01": (12_000, 6000, True, True, True), "2024-01-08": (1000, 10, True, True, True), "2024-01-15": (100, 1, True, True, True)}
    assert weeks(spark, tmp_path / "a", rows) == want
    # a list that leaves out the most frequent user is seen
    monkeypatch.setattr(catalog, "frequent", lambda n: F.slice(frequent(n), 2, 3))
    rows += [(i, at(8), 3, "view", 5.0) for i in range(500)]
    assert weeks(spark, tmp_path / "b", rows)["2024-01-08"] == (1500, 10, True, True, False)
