"""Sequences of events within groups of any size: an automaton folded over sorted parts.

A pattern is a list of steps, each a set of event types, and the types that break it off. Events of other types are
passed over. State k means that the first k steps have been seen; when the last one is, the row is a match and the
automaton starts again. A group is cut into cells of its order (see scan). What a cell does to the automaton is one
small array, where it ends from each state it may begin in; those are put together from cell to cell, and with the
state it really begins in each cell finds its matches. So a group with a third of all rows is many tasks' work.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakeloom.operators.joins import refuse
from lakeloom.operators.scan import OWN, SIZE, celled, grouped
from lakeloom.sources.shared import fresh_path, written


def automaton(steps: list[set[str]], breaks: set[str]) -> dict[str, list[int]]:
    """For each event type that matters the next state of each; len(steps) is a match, from which it starts anew."""
    types = set().union(*steps) | breaks
    return {t: [k + 1 if t in step else 0 if t in breaks else k for k, step in enumerate(steps)] for t in types}


def matches(rows: DataFrame, by: list[str], order: list[str], kind: str, steps: list[set[str]], breaks: set[str], size: int = SIZE) -> DataFrame:
    """The rows of each group, in ascending `order` (unique within the group), that complete the pattern; columns `by` and `order`.

    A type that is both a step and a break goes on where the step asks for it and breaks off elsewhere. A null type is
    passed over. Columns named as scan's own, and _next and _from, are refused.
    """
    if not steps or not all(steps):
        raise ValueError("a pattern has steps, and each names a type")
    refuse([*by, *order, kind], OWN | {"_next", "_from", "_match"})
    table, n = automaton(steps, breaks), len(steps)
    wanted = rows.select(*by, *order, kind).where(F.col(kind).isin(sorted(table)))
    placed = written(celled(grouped(wanted, by), order, size), fresh_path(rows.sparkSession, "sequence"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_group", "_cell"]

    # what a cell does: the types of its rows in order, folded into one array; only its distinct cells' arrays go on
    step = F.create_map(*[x for t, to in sorted(table.items()) for x in (F.lit(t), F.array(*(F.lit(0 if k == n else k) for k in to)))])
    dealt = placed.withColumn("_next", F.element_at(step, F.col(kind))).repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def folded(batches):
        """Rows _group, _cell, _next in order: one row for each cell, the state it ends in from each state."""
        key, state = None, None
        for batch in batches:
            out = []
            for g, c, to in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (g, c) != key:
                    if key is not None:
                        out.append((*key, state))
                    key, state = (g, c), list(range(n))
                state = [to[s] for s in state]
            yield from _batch(out, schema)
        if key is not None:
            yield from _batch([(*key, state)], schema)

    group_type = placed.schema["_group"].dataType.simpleString()
    schema = pa.schema([("_group", to_arrow_type(placed.schema["_group"].dataType)), ("_cell", pa.int32()), ("_next", pa.list_(pa.int32()))])
    does = dealt.select("_group", F.col("_cell").cast("int").alias("_cell"), "_next").mapInArrow(folded, f"_group {group_type}, _cell int, _next array<int>")
    # the cells of a group in order, a row for each SIZE events: where each begins
    cells = does.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_cell", "_next"))).alias("c"))
    begun = F.aggregate("c", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(x["_next"], F.element_at(s, -1) + 1))))
    starts = cells.select("_group", F.explode(F.arrays_zip(F.col("c._cell").alias("_cell"), begun.alias("_from"))).alias("x")).select("_group", "x._cell", "x._from").where("_cell is not null")

    starts = written(starts, fresh_path(rows.sparkSession, "sequence-starts"))
    met = placed.withColumn("_cell", F.col("_cell").cast("int")).join(starts, keys).select("_group", "_cell", "_from", F.col(kind).alias("_next"), F.struct(*order).alias("_match"))
    # rows of a cell in order of _match, which is that of `order`
    met = met.repartition(parts, *keys).sortWithinPartitions("_group", "_cell", "_match")
    out_schema = f"_group {group_type}, _match {met.schema['_match'].dataType.simpleString()}"

    def found(batches):
        key, state = None, 0
        for batch in batches:
            take = []
            for i, (g, c, begin, t) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if (g, c) != key:
                    key, state = (g, c), begin
                state = table[t][state]
                if state == n:
                    take.append(i)
                    state = 0
            if take:
                some = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(4)], names=["_group", "_match"])

    out = met.mapInArrow(found, out_schema)
    return out.select(*(F.col(f"_group.{c}").alias(c) for c in by), *(F.col(f"_match.{c}").alias(c) for c in order))


def _batch(rows: list[tuple], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
