import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import series
from barloom.session import stage
from tests.frames import bars_frame, ordered, walk


@pytest.fixture(scope="module")
def mixed():
    """A long series, a sparse one over many segments, one before 1970, a single row."""
    return [
        walk("LONG", 1400, 1),
        walk("SPARSE", 40, 2, step=97),
        walk("OLD", 700, 3, start="1968-06-01"),
        walk("ONE", 1, 4),
    ]


def test_positions_equal_sorted_row_numbers(spark, mixed):
    got = ordered(series.with_positions(bars_frame(spark, *mixed)))
    expected = pd.concat(mixed).sort_values(["ticker", "date"])
    assert got["rn"].tolist() == expected.groupby("ticker").cumcount().tolist()
    sizes = expected.groupby("ticker")["date"].transform("size")
    assert got["n"].tolist() == sizes.tolist()


def test_context_windows_equal_whole_ticker_windows(spark, mixed):
    rows = series.with_context(series.with_positions(bars_frame(spark, *mixed)), before=5, after=3)
    w = series.block_window()
    got = ordered(
        series.core_rows(
            rows.withColumns({"back": F.lag("close", 5).over(w), "ahead": F.lead("close", 3).over(w)})
        )
    )
    expected = pd.concat(mixed).sort_values(["ticker", "date"])
    closes = expected.groupby("ticker")["close"]
    np.testing.assert_array_equal(got["back"], closes.shift(5))
    np.testing.assert_array_equal(got["ahead"], closes.shift(-3))


def test_context_is_bounded(spark, mixed):
    with pytest.raises(ValueError):
        series.with_context(series.with_positions(bars_frame(spark, *mixed)), before=513)


def test_forward_fill_crosses_segments_and_keeps_leading_nulls(spark, mixed):
    parts = [p.copy() for p in mixed]
    rng = np.random.default_rng(5)
    for p in parts:
        p.loc[rng.random(len(p)) < 0.5, "open"] = None
        p["high"] = None
        p.loc[0, "open"] = None
        p.loc[p.index % 900 == 3, "high"] = 7.0
        p["high"] = p["high"].astype(float)
    expected = pd.concat(parts).sort_values(["ticker", "date"])
    filled = expected.groupby("ticker")[["open", "high"]].ffill()
    clean = [p.astype(object).where(p.notna(), None) for p in parts]
    got = ordered(series.forward_fill(bars_frame(spark, *clean), ["open", "high"]))
    np.testing.assert_array_equal(got["open"].astype(float), filled["open"])
    np.testing.assert_array_equal(got["high"].astype(float), filled["high"])


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 13, 0.001, 0.7])
def test_exponential_mean_equals_recursion(spark, mixed, alpha):
    rows = series.with_context(series.with_positions(bars_frame(spark, *mixed)))
    got = ordered(series.core_rows(series.ewm_means(rows, {"m": ("close", alpha, 3)})))
    for part in mixed:
        ours = got.loc[got["ticker"] == part["ticker"].iloc[0], "m"].to_numpy()
        theirs = part["close"].ewm(alpha=alpha, adjust=False, min_periods=3).mean()
        np.testing.assert_allclose(ours, theirs, rtol=1e-12)


def test_exponential_mean_rejects_alpha_that_overflows_a_block(spark, mixed):
    rows = series.with_context(series.with_positions(bars_frame(spark, *mixed)))
    with pytest.raises(ValueError):
        series.ewm_means(rows, {"m": ("close", 0.99, 1)})


def test_no_row_level_window_over_a_whole_ticker(spark, mixed):
    """Windows by ticker alone only see summary rows: the row windows use segments or blocks."""
    df = series.with_positions(bars_frame(spark, *mixed))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert row_windows and all("_seg" in line for line in row_windows)


def test_exponential_means_shuffle_the_rows_once(spark, mixed):
    from barloom.operators.indicators import indicators

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = indicators(bars_frame(spark, *mixed))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_block = [line for line in plan.splitlines() if "_blk" in line and "Exchange" in line]
    assert any("ReusedExchange" in line for line in by_block)


def _row_shuffles(spark, df, key):
    """Exchanges by ``(ticker, key)`` of a plan without broadcast joins, reused ones not counted."""
    kept = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = df()._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    lines = [line for line in plan.splitlines() if "ReusedExchange" not in line]
    return sum("Exchange hashpartitioning(ticker#" in line and f", {key}#" in line.split("hashpartitioning")[1] for line in lines)


def test_indicators_shuffle_no_finished_columns_by_block(spark, mixed):
    from barloom.operators.indicators import indicators

    assert _row_shuffles(spark, lambda: indicators(bars_frame(spark, *mixed)), "_blk") == 1


def test_datasets_are_numbered_in_the_blocks_of_their_target(spark):
    from barloom.plans.dataset import modeling_dataset, positioned_dataset
    from barloom.schemas import FEATURE_STORE

    parts = [walk("LONG", 1300, 1), walk("SHORT", 30, 2), walk("GONE", 4, 3)]
    parts[0].loc[[0, 511, 512, 900], "close"] = 0.0  # no return from a close of zero: rows go inside blocks
    bars = stage(bars_frame(spark, *parts), "t-bars")
    names = FEATURE_STORE.fieldNames()[2:]
    rows = stage(bars.select("ticker", "date", *[F.lit(1.0).alias(c) for c in names]), "t-rows")
    got = ordered(positioned_dataset(rows, bars))
    want = ordered(series.with_positions(modeling_dataset(rows, bars)))
    pd.testing.assert_frame_equal(got, want)
    assert len(got) == 1300 - 5 - 4 + 25
    assert _row_shuffles(spark, lambda: positioned_dataset(rows, bars), "_seg") == 3  # rows, their counts, the offsets
    assert _row_shuffles(spark, lambda: positioned_dataset(rows, bars), "_blk") == 1


def test_datasets_join_by_segment_without_a_shuffle_by_day(spark):
    from barloom.operators.joins import join_features_prices, join_in_segments
    from barloom.plans.dataset import positioned_dataset
    from barloom.schemas import FEATURE_STORE

    bars = bars_frame(spark, walk("LONG", 1300, 1), walk("SHORT", 30, 2))
    bars = bars.withColumn("close", F.when(F.dayofmonth("date") != 7, F.col("close")))  # a null price is a price row
    bars = bars.unionByName(bars.limit(1).withColumn("date", F.lit(None).cast("date")))
    names = FEATURE_STORE.fieldNames()[2:]
    rows = bars.where("day(date) % 3 > 0 or date is null").select("ticker", "date", *[F.lit(1.0).alias(c) for c in names])
    rows = stage(rows.unionByName(rows.limit(1).withColumn("ticker", F.lit("NO BARS"))), "t-rows")
    bars = stage(bars, "t-bars")
    got = ordered(join_in_segments(rows, bars).drop("_seg"))
    pd.testing.assert_frame_equal(got, ordered(join_features_prices(rows, bars)), check_like=True)
    assert len(got) > 800 and got["close"].isna().any()
    assert _row_shuffles(spark, lambda: positioned_dataset(rows, bars), "date") == 0


def test_features_find_their_regime_inside_their_block(spark):
    from barloom.operators.regime import regimes
    from barloom.plans.features import features

    def moody(ticker, n, seed):
        part = walk(ticker, n, seed)
        calm = np.sin(np.arange(n) / 40) > 0
        steps = np.random.default_rng(seed).normal(np.where(calm, 0.004, -0.004), np.where(calm, 0.004, 0.03))
        return part.assign(close=100 * np.exp(np.cumsum(steps)))

    bars = stage(bars_frame(spark, moody("LONG", 1100, 1), moody("EDGE", 513, 2), walk("SHORT", 90, 3)), "t-bars")
    got = stage(features(bars), "t-features")
    want = got.drop("regime").join(regimes(bars), ["ticker", "date"]).select(*got.columns)
    pd.testing.assert_frame_equal(ordered(got), ordered(want))
    assert got.where("ticker = 'LONG'").select("regime").distinct().count() == 2
    assert _row_shuffles(spark, lambda: features(bars), "refit") == 0
    assert _row_shuffles(spark, lambda: features(bars), "_blk") == 3  # rows, rows of returns, labels
