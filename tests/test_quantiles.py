"""Exact quantiles against numpy."""

import numpy as np
import pytest

from terraloom.operators import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("held", [3, 10_000])
def test_quantiles_equal_numpy(spark, held):
    rng = np.random.default_rng(4)
    groups = {
        1: rng.normal(size=3000),
        2: np.repeat([1.5, -2.0, 1.5, 7.0], 200),  # ties
        3: np.exp(rng.uniform(-300, 300, 700)),  # a range of many powers
        4: np.array([3.25]),
        5: np.array([-1e308, 1e308, 0.0]),  # wider than a double
        6: np.array([5e-324, 0.0, -5e-324, 1e-310]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [(7, None), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    found = {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, ["k"], "v", SHARES, held).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        ordered = np.sort(values)
        for p, q in zip(SHARES, found[k], strict=True):
            at = (len(ordered) - 1) * p
            low, high = int(np.floor(at)), int(np.ceil(at))
            want = ordered[low] if low == high else (high - at) * ordered[low] + (at - low) * ordered[high]
            assert q == want, (k, p)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "k int, v double"), ["k"], "v", [0.5]).count() == 0
