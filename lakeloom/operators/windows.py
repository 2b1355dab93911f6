"""Operators over ordered groups: top rows of each group, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.joins import refuse


def top_of_each(rows: DataFrame, by: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each group, numbered in a new column `place`. order must name a unique last column; a group limit runs before the shuffle."""
    refuse(rows.columns, {place})
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(place, number).where(F.col(place) <= n)


def sessions(rows: DataFrame, by: str, time: str, gap_seconds: int) -> DataFrame:
    """Rows of `by` that follow each other within the gap are one session: start, end and number of rows."""
    window = F.session_window(time, f"{gap_seconds} seconds")
    grouped = rows.groupBy(by, window).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last_time"))
    return grouped.select(by, F.col("session_window.start").alias("first_time"), "last_time", "n")
