"""An equality join of a large side whose keys may be hot with a smaller one.

The hot keys of the large side are counted first. What the smaller side has for those is broadcast if it is counted
few, so hot rows of the large side are not moved at all; else it is copied so many times that each copy meets about
`hot` rows of the large side, which are dealt over the copies. All other keys are joined by shuffle as ever, and no
partition of it gets a key with more than `hot` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.joins import refuse

#: Rows of a key from which it is hot, rows that may be broadcast, and hot keys that may be.
HOT, FEW, KEYS = 100_000, 200_000, 100_000


def hot_keys(large: DataFrame, on: list[str], hot: int = HOT) -> DataFrame:
    """The keys (none of them null) of more than `hot` rows, with _rows: rows over `hot` in number at most."""
    refuse(on, {"_rows"})
    whole = large.select(*on).dropna()
    return whole.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot)


def skew_join(large: DataFrame, small: DataFrame, on: list[str], hot: int = HOT, few: int = FEW, keys: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """large joined with small on equal columns `on`; how: inner, left, left_semi or left_anti.

    keys: the hot keys with their _rows, where they are known (a materialised table); else they are counted, which
    reads the large side's keys once. Columns of both sides besides `on` must differ in name; _rows, _copy, _hot are
    refused. Null keys meet nothing; with left and left_anti their rows stay, and are not shuffled onto one task.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how is inner, left, left_semi or left_anti")
    refuse([*large.columns, *small.columns], {"_rows", "_copy", "_hot"})
    refuse([c for c in large.columns if c not in on], set(small.columns) - set(on))
    keys = hot_keys(large, on, hot) if keys is None else keys.where(F.col("_rows") > hot)
    found = keys.select(*on, "_rows").limit(KEYS + 1).collect()
    if len(found) > KEYS:
        raise ValueError(f"more than {KEYS} keys of over {hot} rows: raise `hot`")
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    asked = large.where(whole)
    if not found:
        out = asked.join(small, on, how)
    else:
        table = large.sparkSession.createDataFrame([tuple(r) for r in found], large.select(*on).schema.add("_rows", "long"))
        known, copies = F.broadcast(table.select(*on)), F.broadcast(table.select(*on, F.ceil(F.col("_rows") / F.lit(hot)).alias("_hot")))
        cold, warm, sought = asked.join(known, on, "left_anti"), asked.join(known, on, "left_semi"), small.join(known, on, "left_semi")
        if sought.limit(few + 1).count() <= few:
            warm = warm.join(F.broadcast(sought), on, how)
        else:
            dealt = warm.join(copies, on).withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.col("_hot"))).drop("_hot")
            copied = sought.join(copies, on).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hot") - 1))).drop("_hot")
            warm = dealt.join(copied, [*on, "_copy"], how).drop("_copy")
        cold = cold.join(small, on, how)
        out = cold.unionByName(warm.select(cold.columns))
    if how in ("left", "left_anti"):
        alone = large.where(~whole)
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema if f.name not in on] if how == "left" else []
        out = out.unionByName(alone.select(*large.columns, *rest))
    return out
