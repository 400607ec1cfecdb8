import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from barloom.functions import unit_root
from barloom.operators.stationarity import _groups, adf_test
from tests.frames import bars_frame, walk


def adf_by_hand(x):
    """Lag choice and statistic by direct least squares."""
    def regress(lags, start):
        m = unit_root.design(x, start, len(x) - 1, lags)
        y, z = m[:, 0], m[:, 1:]
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        ssr = ((y - z @ beta) ** 2).sum()
        n, k = z.shape
        error = np.sqrt(ssr / (n - k) * np.linalg.inv(z.T @ z)[0, 0])
        return n * (np.log(2 * np.pi * ssr / n) + 1) + 2 * k, beta[0] / error

    tried = unit_root.max_lag(len(x))
    used = min(range(tried + 1), key=lambda k: regress(k, tried)[0])
    return used, regress(used, used)[1]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    walk_part = walk("WALK", 1300, 8)
    noise = walk("NOISE", 900).assign(close=rng.normal(100, 1, 900))
    memory = np.zeros(1100)
    for t in range(3, 1100):
        memory[t] = 0.4 * memory[t - 1] + 0.3 * memory[t - 3] + rng.normal()
    ar = walk("MEMORY", 1100).assign(close=memory + 50)
    return {"WALK": walk_part, "NOISE": noise, "MEMORY": ar}


def test_statistic_equals_direct_regression(spark, series):
    got = {r.ticker: r for r in adf_test(bars_frame(spark, *series.values()), "close").collect()}
    for ticker, part in series.items():
        used, statistic = adf_by_hand(part["close"].to_numpy())
        assert got[ticker].used_lags == used
        assert got[ticker].statistic == pytest.approx(statistic, rel=1e-6)
        assert got[ticker].observations == len(part)
    assert not got["WALK"].stationary
    assert got["NOISE"].stationary and got["MEMORY"].stationary


def test_flat_and_short_series_have_no_statistic(spark):
    parts = [walk("FLAT", 60).assign(close=1.0), walk("SHORT", 2)]
    got = adf_test(bars_frame(spark, *parts), "close").collect()
    assert len(got) == 2 and all(r.statistic is None and r.stationary is None for r in got)


@pytest.mark.parametrize("statistic, p", [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)])
def test_p_values_at_the_known_critical_values(statistic, p):
    assert unit_root.p_value(statistic) == pytest.approx(p, abs=0.002)


def test_p_value_limits():
    assert unit_root.p_value(5.0) == 1.0 and unit_root.p_value(-30.0) == 0.0
    values = [unit_root.p_value(t) for t in np.linspace(-18, 2.7, 200)]
    assert pd.Series(values).is_monotonic_increasing


def test_tasks_stream_many_series_without_a_call_for_each(spark, series):
    result = adf_test(bars_frame(spark, *series.values()), "close")
    assert "FlatMapGroups" not in result._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_groups_are_whole_wherever_batches_end(size):
    keys, blocks = list("aaabbcaa"), [0, 0, 1, 1, 1, 1, 2, 2]
    batch = pa.RecordBatch.from_pydict({"k": keys, "b": blocks, "x": list(range(8))})
    cut = [batch.slice(i, size) for i in range(0, 8, size)] + [batch.slice(8)]
    got = [c["x"][a:b].tolist() for c, a, b in _groups(iter(cut), ("k", "b"))]
    assert got == [[0, 1], [2], [3, 4], [5], [6, 7]]
    assert list(_groups(iter([batch.slice(8)]), ("k",))) == []
