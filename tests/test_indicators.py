import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators
from barloom.plans.features import NUMERIC_FEATURES, numeric_features
from tests.frames import bars_frame, ordered, walk


def expected_indicators(part):
    close = part["close"]
    out = pd.DataFrame({"date": part["date"]})
    out["return_1d"] = close.pct_change(1)
    out["return_5d"] = close.pct_change(5)
    out["volatility_20d"] = out["return_1d"].rolling(20).std()
    step = close.diff().fillna(0.0)
    up = step.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    down = (-step).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    out["rsi_14"] = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
    fast = close.ewm(span=12, adjust=False, min_periods=12).mean()
    slow = close.ewm(span=26, adjust=False, min_periods=26).mean()
    out["macd"] = fast - slow
    return out


def check(spark, part):
    got = ordered(indicators.indicators(bars_frame(spark, part)))
    want = expected_indicators(part)
    for c in NUMERIC_FEATURES:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-10, err_msg=c)


def test_long_series(spark):
    check(spark, walk("A", 1700, 11))


def test_series_that_stops_moving_keeps_its_rsi(spark):
    part = walk("A", 1800, 12)
    part.loc[300:, "close"] = part.loc[300, "close"]
    check(spark, part)
    got = ordered(indicators.rsi(bars_frame(spark, part)))
    assert got["rsi_14"].iloc[-1] == pytest.approx(got["rsi_14"].iloc[300], rel=1e-9)


def test_rising_series_has_rsi_100(spark):
    part = walk("A", 40).assign(close=np.arange(1.0, 41.0))
    got = ordered(indicators.rsi(bars_frame(spark, part)))
    assert got["rsi_14"].isna().sum() == 13 and (got["rsi_14"].dropna() == 100.0).all()


def test_series_shorter_than_the_windows(spark):
    got = ordered(indicators.indicators(bars_frame(spark, walk("A", 10))))
    assert got[["rsi_14", "macd", "volatility_20d"]].isna().all().all()
    assert numeric_features(bars_frame(spark, walk("A", 25))).count() == 0
    assert numeric_features(bars_frame(spark, walk("A", 26))).count() == 1


def test_no_look_ahead(spark):
    part = walk("A", 900, 13)
    full = ordered(indicators.indicators(bars_frame(spark, part)))
    cut = ordered(indicators.indicators(bars_frame(spark, part.iloc[:600])))
    pd.testing.assert_frame_equal(full.iloc[:600][NUMERIC_FEATURES], cut[NUMERIC_FEATURES])


def test_forward_target(spark):
    part = walk("A", 1030, 14)
    got = ordered(indicators.forward_target(bars_frame(spark, part)))
    np.testing.assert_allclose(got["target_5d"], part["close"].shift(-5) / part["close"] - 1)


def test_tickers_do_not_mix(spark):
    both = ordered(indicators.indicators(bars_frame(spark, walk("A", 100, 1), walk("B", 80, 2))))
    one = ordered(indicators.indicators(bars_frame(spark, walk("B", 80, 2))))
    mine = both[both["ticker"] == "B"].reset_index(drop=True)
    pd.testing.assert_frame_equal(mine[NUMERIC_FEATURES], one[NUMERIC_FEATURES])
    assert isinstance(mine["date"].iloc[0], dt.date)
