"""Price indicators over positioned, blocked bars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import (
    block_window,
    core_rows,
    ewm_means,
    with_context,
    with_positions,
)
from barloom.schemas import HORIZON, TARGET

VOLATILITY_WINDOW = 20
RSI_WINDOW = 14
MACD_FAST, MACD_SLOW = 12, 26


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def _change(periods: int):
    return F.try_divide(F.col("close"), F.lag("close", periods).over(block_window())) - 1


def simple_return(bars: DataFrame, periods: int, name: str) -> DataFrame:
    """``close`` against the close ``periods`` rows earlier, minus 1."""
    rows = with_context(with_positions(bars), before=periods)
    return core_rows(rows.withColumn(name, _change(periods))).drop("rn", "n")


def _add_volatility(rows: DataFrame) -> DataFrame:
    recent = block_window().rowsBetween(1 - VOLATILITY_WINDOW, 0)
    full = F.count("return_1d").over(recent) == VOLATILITY_WINDOW
    return rows.withColumn(
        "volatility_20d", F.when(full, F.stddev_samp("return_1d").over(recent))
    )


def volatility(bars: DataFrame) -> DataFrame:
    """``return_1d`` and its sample standard deviation over 20 non-null values."""
    rows = with_context(with_positions(bars), before=VOLATILITY_WINDOW)
    rows = _add_volatility(rows.withColumn("return_1d", _change(1)))
    return core_rows(rows).drop("rn", "n")


def _add_moves(rows: DataFrame) -> DataFrame:
    step = F.coalesce(F.col("close") - F.lag("close").over(block_window()), F.lit(0.0))
    return rows.withColumn("_step", step).withColumns(
        {"_up": F.greatest("_step", F.lit(0.0)), "_down": F.greatest(-F.col("_step"), F.lit(0.0))}
    )


RSI_MEANS = {
    "_mean_up": ("_up", 1.0 / RSI_WINDOW, RSI_WINDOW),
    "_mean_down": ("_down", 1.0 / RSI_WINDOW, RSI_WINDOW),
}
MACD_MEANS = {
    "_fast": ("close", span_alpha(MACD_FAST), MACD_FAST),
    "_slow": ("close", span_alpha(MACD_SLOW), MACD_SLOW),
}


def _rsi_value():
    ratio = F.try_divide("_mean_up", "_mean_down")
    return F.when(F.col("_mean_down") == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (1 + ratio)
    )


def exponential_mean(bars: DataFrame, span: int, name: str = "ema") -> DataFrame:
    rows = ewm_means(
        with_context(with_positions(bars)), {name: ("close", span_alpha(span), span)}
    )
    return core_rows(rows).drop("rn", "n")


def rsi(bars: DataFrame) -> DataFrame:
    rows = _add_moves(with_context(with_positions(bars), before=1))
    rows = ewm_means(rows, RSI_MEANS).withColumn("rsi_14", _rsi_value())
    return core_rows(rows).select(*bars.columns, "rsi_14")


def macd(bars: DataFrame) -> DataFrame:
    rows = ewm_means(with_context(with_positions(bars)), MACD_MEANS)
    rows = rows.withColumn("macd", F.col("_fast") - F.col("_slow"))
    return core_rows(rows).select(*bars.columns, "macd")


def indicators(bars: DataFrame) -> DataFrame:
    """All price indicators of ``(ticker, date, close)`` in one pass over shared blocks."""
    return blocked_indicators(bars).drop("_blk")


def blocked_indicators(bars: DataFrame) -> DataFrame:
    """``indicators`` with each row's block ``_blk``, by which the rows are placed."""
    rows = with_context(
        with_positions(bars.select("ticker", "date", "close")), before=VOLATILITY_WINDOW
    ).drop("n")
    rows = rows.withColumns({"return_1d": _change(1), "return_5d": _change(5)})
    rows = _add_moves(_add_volatility(rows))
    rows = ewm_means(rows, RSI_MEANS | MACD_MEANS)
    return rows.where("_core").select(
        "ticker",
        "date",
        "rn",
        "_blk",
        "return_1d",
        "return_5d",
        _rsi_value().alias("rsi_14"),
        (F.col("_fast") - F.col("_slow")).alias("macd"),
        "volatility_20d",
    )


def forward_target(rows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Add the return over the next ``horizon`` rows; null for the last ones of a ticker."""
    return blocked_target(with_positions(rows), horizon).drop("rn", "_blk")


def blocked_target(rows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """``forward_target`` of positioned rows, with each row's position ``rn`` and block ``_blk``."""
    ahead = F.lead("close", horizon).over(block_window())
    blocked = with_context(rows, after=horizon)
    return blocked.withColumn(TARGET, F.try_divide(ahead, F.col("close")) - 1).where("_core").drop("n", "_core")
