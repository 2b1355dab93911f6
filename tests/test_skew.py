import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import skew
from lakeloom.operators.skew import hot_keys, skew_join


def some(spark, n=4000):
    r = random.Random(1)
    keys = [(7, "a")] * int(n * 0.9) + [(r.randrange(40), r.choice("abc")) for _ in range(n // 10)] + [(None, "a"), (7, None)]
    large = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "k int, j string, v long").repartition(8)
    small = spark.createDataFrame([(7, "a", 1), (7, "a", 2), (7, "b", 3), (None, "a", 4), *((i, "c", i) for i in range(60))], "k int, j string, w int")
    return large, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot,few", [(100_000, 10), (50, 10), (50, 1)])
def test_equals_a_plain_join(spark, how, hot, few):
    large, small = some(spark)
    got, want = skew_join(large, small, ["k", "j"], hot, few, how=how), large.join(small, ["k", "j"], how)
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda rows: sorted(map(repr, rows.select(sorted(want.columns)).collect()))
    assert show(got) == show(want)


def test_a_key_of_nine_tenths_is_spread(spark):
    large, small = some(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        one = large.join(small, ["k", "j"]).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        many = skew_join(large, small, ["k", "j"], 100, few=1).where("k = 7 and j = 'a'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        moved = skew_join(large, small, ["k", "j"], 100, few=100).where("k = 7 and j = 'a'")
        assert one >= 7200 and len(many) >= 8 and max(r["count"] for r in many) < one / 4
        assert moved.groupBy(F.spark_partition_id().alias("p")).count().count() == 8  # where the rows lay
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_known_keys_and_refusals(spark, monkeypatch):
    monkeypatch.setattr(skew, "KEYS", 2)
    large, small = some(spark, 500)
    keys = hot_keys(large, ["k", "j"], 50)
    assert [tuple(r)[:2] for r in keys.collect()] == [(7, "a")]
    assert skew_join(large, small, ["k", "j"], 50, keys=keys).count() == large.join(small, ["k", "j"]).count()
    for bad in (lambda: skew_join(large, small.withColumnRenamed("w", "v"), ["k", "j"]), lambda: skew_join(large, small, ["k", "j"], how="full"), lambda: skew_join(large.withColumn("_hot", F.lit(1)), small, ["k", "j"]), lambda: skew_join(large, small, ["k", "j"], 0)):
        with pytest.raises(ValueError):
            bad()
    assert skew_join(large.limit(0), small, ["k", "j"]).count() == skew_join(large, small.limit(0), ["k", "j"], 10).count() == 0
