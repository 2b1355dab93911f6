"""Running sums, places, ranks and quantiles within groups of any size, without one task for a group.

A group of more than `size` rows is cut into cells of its order: so many rows are drawn by a hash of their order
columns that about SAMPLE stand for each cell, and their sorted keys are the cuts. Sums of whole cells, a row for
each, are carried to the cells after them; only within a cell are rows sorted. Groups up to `size` are one cell and
cost nothing but the count.

Orders are ascending, nulls first. Rows that are equal in the order columns can't be parted, so an order should end in
a unique column; where only values count (ranks, quantiles), equal ones are counted first. A null in `by` is a group.
The names _group, _cell, _coarse, _cuts, _rows and those starting with _sum_ are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.joins import refuse
from lakeloom.operators.skew import skew_join

#: Rows of a cell, about, and drawn rows for each.
SIZE, SAMPLE = 1_000_000, 32
OWN = {"_group", "_cell", "_coarse", "_cuts", "_rows"}


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with _group, the columns of `by` as one value, in which null equals null."""
    refuse(rows.columns, OWN)
    return rows.withColumn("_group", F.struct(*by) if by else F.struct(F.lit(0).alias("all")))


def celled(rows: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """rows (with _group) with _cell: 0 and on, never falling as the order rises within a group."""
    key = F.struct(*order)
    large = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > size)
    some = rows.select("_group", key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(size)) < SAMPLE)
    drawn = some.join(F.broadcast(large), "_group").groupBy("_group").agg(F.array_sort(F.collect_list("k")).alias("k"), F.ceil(F.max("_rows") / F.lit(size)).alias("cells"))
    # every len / cells-th drawn key, each once; for the search, every fan-th of those too
    cuts = drawn.select("_group", F.array_distinct(F.transform(F.sequence(F.lit(1).cast("long"), F.col("cells")), lambda i: F.get("k", F.greatest(F.lit(0), F.ceil(i * F.size("k") / (F.col("cells") + 1)) - 1).cast("int")))).alias("_cuts"))
    cuts = cuts.withColumn("fan", F.ceil(F.sqrt(F.size("_cuts"))).cast("int"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda x, i: (i + 1) % F.col("fan") == 0)).select("_group", "_cuts", "_coarse", F.col("fan").alias("_rows"))
    below = lambda keys: F.size(F.filter(keys, lambda s: s < key))
    found = rows.join(F.broadcast(cuts), "_group", "left").withColumn("_cell", F.coalesce(below(F.col("_coarse")) * F.col("_rows"), F.lit(0)))
    inner = F.slice("_cuts", F.col("_cell") + 1, F.greatest(F.lit(1), F.col("_rows")))
    return found.withColumn("_cell", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.col("_cell") + below(inner))).drop("_coarse", "_cuts", "_rows")


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], size: int = SIZE) -> DataFrame:
    """rows with a column for each of sums: the sum of its expression over the row and all before it in its group."""
    refuse([*rows.columns, *sums], {f"_sum_{i}" for i in range(len(sums))})
    refuse(rows.columns, set(sums))
    placed = celled(grouped(rows, by), order, size)
    names = [f"_sum_{i}" for i in range(len(sums))]
    whole = placed.groupBy("_group", "_cell").agg(*(F.sum(c).alias(n) for c, n in zip(sums.values(), names, strict=True)))
    before = Window.partitionBy("_group").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each cell but a group's first: rows / size of them, at most twice as many
    carried = whole.select("_group", "_cell", *(F.sum(n).over(before).alias(n) for n in names)).where("_cell > 0")
    here = Window.partitionBy("_group", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumns({n: F.sum(c).over(here) for n, c in sums.items()})
    out = inner.join(F.broadcast(carried), ["_group", "_cell"], "left")
    return out.select(*rows.columns, *(F.when(F.col(f).isNull(), F.col(n)).otherwise(F.coalesce(n, F.col(f) * 0) + F.col(f)).alias(n) for n, f in zip(sums, names, strict=True)))


def places(rows: DataFrame, by: list[str], order: list[str], place: str = "place", total: str = "total", size: int = SIZE) -> DataFrame:
    """rows with their place in the group, from 1, and the group's number of rows."""
    refuse(rows.columns, {place, total})
    numbered = grouped(prefix_sums(rows, by, order, {place: F.lit(1).cast("long")}, size), by)
    totals = grouped(rows, by).groupBy("_group").agg(F.count(F.lit(1)).alias(total))
    return skew_join(numbered, totals, ["_group"], keys=totals.withColumnRenamed(total, "_rows")).drop("_group")


def value_ranks(rows: DataFrame, by: list[str], value: str, rank: str = "rank", dense: str = "dense", size: int = SIZE) -> DataFrame:
    """rows with the rank of their value in the group (1 + rows of a lesser one) and its dense rank (1 + lesser values)."""
    refuse(rows.columns, {rank, dense, "_n", "_upto", "_value"})
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = grouped(prefix_sums(counted, by, [value], {"_upto": F.col("_n"), dense: F.lit(1).cast("long")}, size), by)
    found = ranked.select("_group", F.struct(value).alias("_value"), (F.col("_upto") - F.col("_n") + 1).alias(rank), dense)
    keys = grouped(counted, by).select("_group", F.struct(value).alias("_value"), F.col("_n").alias("_rows"))
    return skew_join(grouped(rows, by).withColumn("_value", F.struct(value)), found, ["_group", "_value"], keys=keys).drop("_group", "_value")


def quantile_of_each(rows: DataFrame, by: list[str], value: str, q: float, name: str, size: int = SIZE) -> DataFrame:
    """The q-quantile of value in each group, between neighbours in proportion; nulls are left.

    Equal values are counted, the counts of cells tell which one or two cells hold the place, and only those are sorted.
    """
    refuse([*by, value], {name, "_n", "_upto", "_low", "_high", "_from", "_all"})
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = celled(grouped(counted, by), [value], size)
    cells = placed.groupBy("_group", "_cell").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy("_group")
    cells = cells.withColumn("_all", F.sum("_n").over(group)).withColumn("_upto", F.sum("_n").over(group.orderBy("_cell")))
    at = F.lit(q) * (F.col("_all") - 1)
    cells = cells.select("_group", "_cell", (F.col("_upto") - F.col("_n")).alias("_from"), "_upto", (F.floor(at) + 1).alias("_low"), (F.ceil(at) + 1).alias("_high"), (at - F.floor(at)).alias("_all"))
    holds = lambda rank: (F.col("_from") < rank) & (rank <= F.col("_upto"))
    wanted = cells.where(holds(F.col("_low")) | holds(F.col("_high"))).drop("_upto")
    here = Window.partitionBy("_group", "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(wanted, ["_group", "_cell"]).withColumn("_upto", F.col("_from") + F.sum("_n").over(here)).withColumn("_from", F.col("_upto") - F.col("_n"))
    near = near.where(holds(F.col("_low")) | holds(F.col("_high")))
    low, high = F.min(value), F.max(value)
    return near.groupBy("_group").agg((low + (high - low) * F.max("_all")).alias(name)).select(*(F.col(f"_group.{c}").alias(c) for c in by), name)
