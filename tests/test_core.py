import random
import shutil
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from lakeloom import sources, streaming
from lakeloom.operators.joins import asof_join, range_join
from lakeloom.operators.scan import quantile_of_each
from lakeloom.operators.windows import top_of_each
from lakeloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours.columns, ours.collect()) == plain(theirs.columns, theirs.fetchall())


def test_asof_and_range_edges(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (None, 9, "c"), (2, 5, "d")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (1, 6, 12), (None, 2, 13)], "k int, t int, x int")
    got = {r.v: r.x for r in asof_join(left, right, ["k"], "t", ["x"], "x").collect()}
    assert got == {"a": 11, "b": None, "c": 13, "d": None}
    ranges = spark.createDataFrame([(0, 10), (10, 10), (5, 25)], "s int, e int")
    points = spark.createDataFrame([(0,), (9,), (10,), (24,), (25,), (None,)], "p int")
    pairs = {tuple(r) for r in range_join(points, ranges, F.col("p"), F.col("s"), F.col("e"), 7).collect()}
    assert pairs == {(0, 0, 10), (9, 0, 10), (9, 5, 25), (10, 5, 25), (24, 5, 25)}


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 7), (2, None, 8)], "k int, v string, n int")
    for form in ("parquet", "orc", "json", "csv"):
        sources.write(rows, f"{tmp_path}/{form}", form, partition_by=["k"])
        back = sources.read(spark, f"{tmp_path}/{form}", form, schema="v string, n int, k int")
        assert sorted((r.k, r.v) for r in back.collect()) == [(1, "a"), (2, None)], form
    with pytest.raises(ValueError):
        sources.read(spark, str(tmp_path), "csv")


def test_streams_agree_with_batch(spark, tmp_path):
    events = sources.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streaming.events(spark, f"{tmp_path}/in", events.schema, 1)
    counted = streaming.windowed_counts(stream, "ts", ["event_type"], "value", "6 hours", "40 days")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("counted").collect()}
    batch = events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").count().collect()
    assert got == {(r.w.start, r.event_type): r["count"] for r in batch}


@pytest.mark.parametrize("pipeline", [False, True])
def test_imports_without_the_corpus_folders(tmp_path, pipeline):
    root = Path(entry_points.ROOT)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "lakeloom", tmp_path / "lakeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pricing_summary' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_nothing_else_imports_the_corpus_folder():
    root = Path(entry_points.ROOT) / "lakeloom"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "llm" in p.read_text()]


def test_clashing_names_are_refused(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "k int, t int, place int")
    with pytest.raises(ValueError):
        top_of_each(rows, ["k"], [F.col("t")], 1)
    assert top_of_each(rows, ["k"], [F.col("t")], 1, "nth").columns == ["k", "t", "place", "nth"]
    for clash in ("_own", "_found", "_side", "_tie", "_cell", "_last"):
        with pytest.raises(ValueError):
            asof_join(rows.withColumnRenamed("place", clash), rows, ["k"], "t", ["place"], "place")
    with pytest.raises(ValueError):
        asof_join(rows, rows, ["k"], "t", ["place"], "place")
    for clash in ("_cell", "_level"):
        with pytest.raises(ValueError):
            range_join(rows.withColumnRenamed("place", clash), rows.select("k"), F.col("t"), F.col("k"), F.col("k"), 1)


@pytest.mark.parametrize("cell", [None, 1, 7, 100])
def test_asof_join_against_all_pairs(spark, cell):
    r = random.Random(4)
    left = [(r.choice((1, 1, 1, 2, None)), r.choice((r.randint(0, 60), r.randint(0, 60), None)), i) for i in range(120)]
    right = [(r.choice((1, 1, 2, None)), r.choice((r.randint(0, 60), r.randint(0, 60), None)), 1000 + i) for i in range(80)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"k int, t int, {name} int")
    by = None if cell is None else F.floor(F.col("t") / cell)
    got = {x.v: x.x for x in asof_join(frame(left, "v"), frame(right, "x"), ["k"], "t", ["x"], "x", by).where("t is not null").collect()}
    plain = {v: max(((t2, x) for k2, t2, x in right if k2 == k and (t2 is None or t2 <= t)), key=lambda p: (p[0] is not None, p[0] or 0, p[1]), default=(0, None))[1] for k, t, v in left if t is not None}
    assert got == plain


def test_range_join_of_all_widths(spark):
    r = random.Random(5)
    ranges = [(s, s + r.choice((0, 1, 3, 10, 100, 100_000_000)), i) for i in range(60) for s in [r.randint(-50, 300)]] + [(None, 5, 98), (1, None, 99)]
    points = [(r.randint(-60, 500),) for _ in range(150)] + [(None,), (90_000_000,)]
    p, q = spark.createDataFrame(points, "p int"), spark.createDataFrame(ranges, "s int, e int, i int")
    got = sorted((x.p, x.i) for x in range_join(p, q, F.col("p"), F.col("s"), F.col("e"), 5).collect())
    assert got == sorted((x, i) for (x,) in points if x is not None for s, e, i in ranges if s is not None and e is not None and s <= x < e)
    assert range_join(p, q.limit(0), F.col("p"), F.col("s"), F.col("e"), 5).count() == 0


def test_quantiles_by_rank(spark):
    rows = [("a", float(x)) for x in (5, 1, 4, 2)] + [("b", 7.0), ("c", None), (None, 3.0), (None, 4.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for q, a, null in ((0.5, 3.0, 3.5), (0.0, 1.0, 3.0), (1.0, 5.0, 4.0), (0.9, 4.7, 3.9)):
        got = {x.k: x.m for x in quantile_of_each(frame, ["k"], "v", q, "m").collect()}
        assert got == {"a": pytest.approx(a), "b": 7.0, None: pytest.approx(null)}


def fed(spark, tmp_path, schema, batches):
    """A folder that a stream reads batch by batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        yield i


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_late_rows_and_eviction(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    batches = [[("a", at(1), 1.0), ("a", at(4), 1.0)], [("a", at(40), 1.0)], [("a", at(2), 5.0), ("a", at(41), 1.0)], [("a", at(90), 1.0)]]
    for _ in fed(spark, tmp_path, schema, batches):  # each call goes on from the checkpoint
        stream = streaming.events(spark, f"{tmp_path}/in", schema)
        query = streaming.to_files(streaming.windowed_counts(stream, "ts", ["k"], "v", "10 minutes", "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.start, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(at(0), 2, 2.0), (at(40), 2, 2.0)]  # the late row of 5.0 is left, the last window is still open
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 1


def test_first_of_each_and_sessions(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    batches = [[("a", at(1), 1.0), ("b", at(2), 1.0)], [("a", at(3), 2.0), ("c", at(4), 1.0)], [("c", at(120), 3.0)], [("d", at(240), 4.0), ("c", at(241), 5.0)]]
    for _ in fed(spark, tmp_path, schema, batches):
        stream = streaming.events(spark, f"{tmp_path}/in", schema)
        streaming.to_files(streaming.first_of_each(stream, ["k"], "ts", "30 minutes"), f"{tmp_path}/first", f"{tmp_path}/first-state", ["k"])
        streaming.to_files(streaming.session_counts(stream, "ts", "k", "10 minutes", "1 minute"), f"{tmp_path}/sessions", f"{tmp_path}/sessions-state")
    got = sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/first").collect())
    assert got == [("a", 1.0), ("b", 1.0), ("c", 1.0), ("c", 5.0), ("d", 4.0)]  # forgotten once the watermark, 90 after the third batch, has passed 34
    got = sorted((r.k, r.first_time, r.n) for r in spark.read.parquet(f"{tmp_path}/sessions").collect())
    assert got == [("a", at(1), 2), ("b", at(2), 1), ("c", at(4), 1), ("c", at(120), 1)]


def test_streams_joined(spark, tmp_path):
    causes, effects = "k string, shown timestamp", "k string, bought timestamp, v double"
    spark.createDataFrame([("a", at(1)), ("b", at(2)), ("a", at(50))], causes).write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([("a", at(5), 1.0), ("b", at(40), 2.0), ("a", at(55), 3.0), ("a", at(0), 4.0)], effects).write.parquet(f"{tmp_path}/e")
    both = streaming.followed_by(streaming.events(spark, f"{tmp_path}/c", causes), streaming.events(spark, f"{tmp_path}/e", effects), "k", "shown", "bought", "10 minutes", "5 minutes")
    streaming.to_files(both, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1.0), ("a", 3.0)]
    with pytest.raises(ValueError):
        streaming.followed_by(both, both, "k", "shown", "bought", "1 minute", "1 minute")
