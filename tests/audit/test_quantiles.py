"""Quartiles by counting again and again, against sorting."""

import numpy as np
import pytest

from quillet.operators import profile


@pytest.mark.parametrize("ordered, ranges", [(200_000, 64), (40, 4), (1, 2)])
def test_quantiles(spark, monkeypatch, ordered, ranges):
    """Columns of one value, of few, with ties and a value that holds most rows, however small the ranges are cut."""
    monkeypatch.setattr(profile, "ORDERED", ordered)
    monkeypatch.setattr(profile, "RANGES", ranges)
    rnd = np.random.default_rng(5)
    size = 60 if ordered == 1 else 900
    columns = {"one": {7.0: 3}, "pair": {1.0: 1, 2.0: 1}, "many": {float(v): 1 for v in rnd.normal(0, 1e6, size)}, "heavy": {float(v): 1 for v in range(size)} | {5.0: 4000},
               "ties": {float(v): int(n) for v, n in enumerate(rnd.integers(1, 50, size))}, "huge": {1e300: 2, -1e300: 3, 0.0: 1}}
    x = spark.createDataFrame([("t", c, v, n) for c, vs in columns.items() for v, n in vs.items()], "`table` string, `column` string, x double, n long")
    got = {r["column"]: (r["p25"], r["median"], r["p75"]) for r in profile.quantiles(x).collect()}
    assert set(got) == set(columns)
    for c, vs in columns.items():
        whole = np.sort(np.repeat(list(vs), list(vs.values())))
        for g, p in zip(got[c], (0.25, 0.5, 0.75)):
            at = p * (len(whole) - 1)
            low, high = whole[int(np.floor(at))], whole[int(np.ceil(at))]
            assert g == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12), (c, p)


def test_no_numbers(spark):
    assert profile.quantiles(spark.createDataFrame([], "`table` string, `column` string, x double, n long")).collect() == []
