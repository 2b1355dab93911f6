"""Sketches kept per day: distinct counts, quantiles and frequent items that are merged when they are asked for.

A row of the store stands for one day, group and batch and holds the number of rows, a HyperLogLog sketch of one
column, a KLL sketch of another and a sketch of the frequent values of a third; a few kilobytes, whatever it counted.
Days are folders, so a span of days reads only those. A batch may come late or twice: it has its own folder within each
day, and writing it again replaces it. Reading merges sketches by partial aggregation; no row is read again.

Bounds, at three standard deviations or 99 %: distinct counts lie within DISTINCT of the truth, the rank of a quantile within
RANK, and a frequent item's number within 1 / (0.75 ITEMS) of all rows (exact while no more values than that occur).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.joins import refuse

#: Sizes of the sketches: the logarithm of HyperLogLog's registers, KLL's k, counters of frequent items (a power of two).
REGISTERS, K, ITEMS = 12, 200, 1024
DISTINCT, RANK, SHARE = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.0165, 1 / (0.75 * ITEMS)
OWN = {"day", "batch", "rows", "distinct_sketch", "value_sketch", "item_sketch"}


class DayStore:
    """A folder of day sketches. by: the columns of the groups."""

    def __init__(self, spark: SparkSession, path: str, by: list[str] | None = None):
        self.spark, self.path, self.by = spark, path, by or []
        refuse(self.by, OWN)

    def add(self, rows: DataFrame, batch: str, day: Column, distinct: str, value: str, item: str) -> None:
        """Sketches of rows, for each of their days; what this batch had in those days before is replaced. Null days are left."""
        taken = rows.select(*self.by, F.to_date(day).alias("day"), F.col(distinct).alias("_d"), F.col(value).cast("double").alias("_v"), F.col(item).alias("_i"))
        sketched = taken.where("day is not null").groupBy(*self.by, "day").agg(
            F.count(F.lit(1)).alias("rows"),
            F.hll_sketch_agg("_d", F.lit(REGISTERS)).alias("distinct_sketch"),
            F.kll_sketch_agg_double("_v", F.lit(K)).alias("value_sketch"),
            F.expr(f"approx_top_k_accumulate(_i, {ITEMS})").alias("item_sketch"),
        )
        out = sketched.withColumn("batch", F.lit(batch)).repartition("day")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def table(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """The stored rows of days from since to until, both included; read by folders."""
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        if since is not None:
            rows = rows.where(F.col("day") >= F.lit(since).cast("date"))
        return rows if until is None else rows.where(F.col("day") <= F.lit(until).cast("date"))

    def merged(self, by: list[Column | str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """One row for each group of `by` (columns or expressions over day and the store's groups), its sketches merged."""
        return self.table(since, until).groupBy(*(by or [])).agg(
            F.sum("rows").alias("rows"),
            F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
            F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
            F.expr(f"approx_top_k_combine(item_sketch, {ITEMS})").alias("item_sketch"),
        )


def distinct_count() -> Column:
    return F.hll_sketch_estimate("distinct_sketch")


def quantile(q: float) -> Column:
    """A value whose rank is near q; null where no value is known."""
    n = F.kll_sketch_get_n_double("value_sketch")
    return F.when(n > 0, F.kll_sketch_get_quantile_double(F.when(n > 0, F.col("value_sketch")), F.lit(q)))


def frequent(n: int) -> Column:
    """The n most frequent items: an array of (item, count)."""
    return F.expr(f"approx_top_k_estimate(item_sketch, {n})")
