"""The tallies of a profile at scale: no value carries them all through a shuffle, and the histogram is made once."""

from datetime import datetime

from quillet.operators import checks
from quillet.operators import profile as prof
from quillet.operators.histogram import histogram


def test_normalised_values_are_counted_apart(spark):
    rows = [("a", "1"), ("A ", "1"), (" a", None), ("b", ""), (None, None)]
    got = prof.counts(histogram({"t": spark.createDataFrame(rows, "x string, y string"), "none": spark.createDataFrame([], "z string")}))
    told = {r["column"]: (r["total"], r["nulls"], r["distinct"], r["distinct_normalized"]) for r in got.collect()}
    assert told == {"x": (5, 1, 4, 2), "y": (5, 2, 2, 2)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "ReusedExchange" in plan


def test_checks_of_the_parts_that_were_measured(spark):
    """A profile without numbers and dates gives the findings that need neither, and none of the others."""
    rows = [(str(i), f" {'ab'[i % 2]}", "2031-01-01" if i % 9 else "x") for i in range(40)]
    t = {"t": spark.createDataFrame(rows, "k string, padded string, day string")}
    now = datetime(2024, 1, 1)
    found = {parts: {(r["rule"], r["column"], r["count"]) for r in checks.column_checks(prof.settled(prof.profile(t, now, parts=parts)), now).collect()} for parts in ((), ("temporal",), ("numeric", "temporal"))}
    dates = {f for f in found["numeric", "temporal"] if "date" in f[0]}
    assert dates and found["temporal",] == found["numeric", "temporal"] and found[()] == found["temporal",] - dates and ("column.whitespace_padding", "padded", 40) in found[()]
