"""Column functions, all evaluated by the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(column: str | Column) -> Column:
    """A double that holds two decimal places, as an exact decimal."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def money(amount: Column) -> Column:
    """The exact sum of decimals, as a double: the order of adding can't show."""
    return F.sum(amount).cast("double")


def discounted(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return cents(price) * (F.lit(1).cast("decimal(18,2)") - cents(discount))


def json_long(column: str, path: str) -> Column:
    return F.get_json_object(column, path).cast("long")


def dot(x: Column, y: Column) -> Column:
    """The inner product of two arrays of numbers, as a double."""
    products = F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def strip_tags(html: str | Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces, runs of white space one."""
    steps = (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", r"(?s)<!--.*?-->", r"<[^>]*>", r"\s+")
    column = F.col(html) if isinstance(html, str) else html
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p, " "), steps, column))
