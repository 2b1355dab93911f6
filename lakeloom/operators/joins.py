"""Joins that Spark SQL has no syntax for: as-of and range joins, without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refuse(columns: list[str], taken: set[str]) -> None:
    """Columns that an operator makes must not be there before."""
    if clash := sorted(taken & set(columns)):
        raise ValueError(f"columns with names of the operator's own: {', '.join(clash)}")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, take: list[str], tie: str, cell: Column | None = None) -> DataFrame:
    """Each row of left with the columns `take` of the last row of right with the same `by` and a time not later.

    Both sides are united and sorted once by (by, time): one shuffle, and no pairs are made. Of rows of right at
    one time the largest `tie` is the last. Rows of left without such a row get nulls; a null in `by` equals
    a null. Columns of `take` that left has too, and the names _own, _found, _side, _tie, _cell, _last, are refused.

    cell: an expression over `time` that never falls as time rises, such as its day. With it a value of `by` however
    hot is dealt out by cells; what stands last at the end of each cell, a row for each, is carried to the next.
    """
    own_names = {"_own", "_found", "_side", "_tie", "_cell", "_last"}
    refuse([*left.columns, *right.columns], own_names)
    refuse([c for c in left.columns if c not in by and c != time], set(take))
    keys = [*by, time]
    rest = [c for c in left.columns if c not in keys]
    own = left.select(*keys, F.struct(*rest).alias("_own"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_found"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    other = right.select(*keys, F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), F.struct(*take).alias("_found"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"))
    both = own.unionByName(other).withColumn("_cell", F.lit(0) if cell is None else cell)
    order = Window.partitionBy(*by, "_cell").orderBy(F.col(time), F.col("_side"), F.col("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_found", ignorenulls=True).over(order)).where("_side = 1")
    if cell is not None:
        newest = F.max_by("_found", F.when(F.col("_side") == 0, F.struct(time, "_tie")))
        ends = both.groupBy(*by, "_cell").agg(newest.alias("_last"))
        before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_last", F.last("_last", ignorenulls=True).over(before))
        ends = ends.toDF(*(f"_{i}" for i in range(len(by) + 1)), "_last")
        same = F.lit(True)
        for i, c in enumerate([*by, "_cell"]):
            same = same & found[c].eqNullSafe(ends[f"_{i}"])
        found = found.join(ends, same).withColumn("_found", F.coalesce("_found", "_last"))
    return found.select(*keys, "_own.*", *(F.col(f"_found.{c}").alias(c) for c in take))


def range_join(points: DataFrame, ranges: DataFrame, point: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Rows of points and ranges with start <= point < end.

    Ranges are of levels: level k holds those up to `width` times 2 to the k wide, and has the axis cut into cells of
    that width. A range is put into the two or three cells of its level that it touches, a point into its own cell of
    each level that occurs, so the join is an equality, each pair is met once, and a wide range costs no more rows than
    a narrow one. The levels that occur, at most some dozens, are counted first. The names _level and _cell are refused.
    """
    refuse([*points.columns, *ranges.columns], {"_level", "_cell"})
    size = (end - start).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(float(width))))).cast("int")
    placed = ranges.where(start < end).withColumn("_level", level)
    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())
    wide = lambda x: F.lit(float(width)) * F.pow(F.lit(2.0), x)
    cell = lambda x, k: F.floor(x.cast("double") / wide(k))
    placed = placed.withColumn("_cell", F.explode(F.sequence(cell(start, F.col("_level")), cell(end, F.col("_level")))))
    probes = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", cell(point, F.col("_level")))
    return probes.join(placed, ["_level", "_cell"]).where((point >= start) & (point < end)).drop("_level", "_cell")
