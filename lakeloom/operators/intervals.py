"""Intervals on both sides: the overlap join by levels, and the sweep that tells how many cover each stretch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.joins import refuse
from lakeloom.operators.scan import SIZE, prefix_sums


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[Column, Column], right_range: tuple[Column, Column], width: float, by: list[str] | None = None) -> DataFrame:
    """Rows of left and right (equal in `by`) whose ranges [start, end) have a point in common. Empty ranges meet nothing.

    Level k has cells of `width` times 2 to the k; a range is of the first level whose cells are as wide as it is. A pair
    is met at the level of its wider range, where either touches two cells at most: a range is put into its own cells
    at its level and at each higher one that the other side has. Of the cells that a pair shares the first counts, so each
    pair is met once. However wide ranges are, a row is copied twice for each level of the other side, never once for
    each cell. The names _level, _cell, _own, _first, _other, _theirs and those of the other side are refused.
    """
    by = by or []
    refuse([*left.columns, *right.columns], {"_level", "_cell", "_own", "_first", "_other", "_theirs"})
    refuse([c for c in left.columns if c not in by], set(right.columns) - set(by))
    wide = lambda k: F.lit(float(width)) * F.pow(F.lit(2.0), k)

    def level(start: Column, end: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2((end - start).cast("double") / F.lit(float(width))))).cast("int")

    def levels(rows: DataFrame, start: Column, end: Column) -> list[int]:
        return sorted(r["_level"] for r in rows.where(start < end).select(level(start, end).alias("_level")).distinct().collect())  # some dozens

    def dealt(rows: DataFrame, start: Column, end: Column, others: list[int], own: str, first: str) -> DataFrame:
        held = rows.where(start < end).withColumn(own, level(start, end))
        at = F.filter(F.array_distinct(F.concat(F.array(F.col(own)), F.array(*map(F.lit, others)).cast("array<int>"))), lambda k: k >= F.col(own))
        spread = held.withColumn("_level", F.explode(at)).withColumn(first, F.floor(start.cast("double") / wide(F.col("_level"))))
        last = F.greatest(F.col(first), F.ceil(end.cast("double") / wide(F.col("_level"))) - 1)
        return spread.withColumn("_cell", F.explode(F.sequence(first, last)))

    (a, b), (c, d) = left_range, right_range
    ours = dealt(left, a, b, levels(right, c, d), "_own", "_first")
    theirs = dealt(right, c, d, levels(left, a, b), "_other", "_theirs")
    met = ours.join(theirs, [*by, "_level", "_cell"])
    once = (F.col("_level") == F.greatest("_own", "_other")) & (F.col("_cell") == F.greatest("_first", "_theirs"))
    return met.where(once & (a < d) & (c < b)).drop("_level", "_cell", "_own", "_first", "_other", "_theirs")


def coverage(rows: DataFrame, by: list[str], start: str, end: str, size: int = SIZE) -> DataFrame:
    """by, at, open: for each place where a range of rows starts or ends, how many [start, end) hold from there on.

    Starts and ends at one place are added up first; the running sum is carried from cell to cell, so a group of any
    size is swept by many tasks. Ranges that are empty or have a null bound hold nothing.
    """
    refuse(by, {"at", "open", "_change"})
    whole = rows.where(F.col(start) < F.col(end))
    edges = whole.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).cast("long").alias("n")), F.struct(F.col(end).alias("at"), F.lit(-1).cast("long").alias("n")))).alias("e"))
    changes = edges.groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.n").alias("_change"))
    return prefix_sums(changes, by, ["at"], {"open": F.col("_change")}, size).drop("_change")
