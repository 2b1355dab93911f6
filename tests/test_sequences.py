import random

import pytest

from lakeloom.operators.sequences import matches


def plain(rows, steps, breaks):
    out = []
    for g in {r[0] for r in rows}:
        state = 0
        for _, i, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if t is None:
                continue
            if t in steps[state]:
                state += 1
            elif t in breaks:
                state = 0
            if state == len(steps):
                out.append((g, i))
                state = 0
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1_000_000, 40])
@pytest.mark.parametrize("steps,breaks", [([{"view"}, {"view"}, {"purchase"}], {"error", "purchase"}), ([{"a", "view"}], set()), ([{"view"}, {"error"}, {"view"}, {"a", "purchase"}], {"view"})])
def test_against_the_plain_automaton(spark, size, steps, breaks):
    r = random.Random(1)
    rows = [(r.choice(["u"] * 12 + [None, "v", "w"]), i, r.choice(["view", "view", "view", "purchase", "error", "a", None])) for i in range(1500)]
    frame = spark.createDataFrame(rows, "g string, i long, t string").repartition(5)
    got = sorted(((x.g, x.i) for x in matches(frame, ["g"], ["i"], "t", steps, breaks, size).collect()), key=str)
    assert got == plain(rows, steps, breaks) and len(got) > 20


def test_empty_and_refused(spark):
    frame = spark.createDataFrame([], "g string, i long, t string")
    assert matches(frame, ["g"], ["i"], "t", [{"a"}], set()).count() == 0
    for bad in (lambda: matches(frame, ["g"], ["i"], "t", [], set()), lambda: matches(frame.withColumnRenamed("g", "_cell"), ["_cell"], ["i"], "t", [{"a"}], set())):
        with pytest.raises(ValueError):
            bad()
