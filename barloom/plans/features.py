"""Feature assembly."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.columns import drop_incomplete
from barloom.operators.indicators import blocked_indicators, indicators
from barloom.operators.regime import block_labels, indexed_returns, refit_index, refit_labels
from barloom.schemas import FEATURE_STORE

NUMERIC_FEATURES = ["return_1d", "return_5d", "rsi_14", "macd", "volatility_20d"]


def numeric_features(bars: DataFrame) -> DataFrame:
    """Price indicators without warm-up rows (no regime)."""
    return drop_incomplete(indicators(bars), NUMERIC_FEATURES).drop("rn")


def features(bars: DataFrame) -> DataFrame:
    """Rows of the feature table: every indicator and the regime, no warm-up rows."""
    labels = block_labels(refit_labels(indexed_returns(bars)))
    label = F.try_element_at("labels", refit_index(F.col("rn") - 1))
    labelled = blocked_indicators(bars).join(labels, ["ticker", "_blk"], "left").withColumn(
        "regime", F.coalesce(label, F.lit(0))
    )
    columns = FEATURE_STORE.fieldNames()
    return drop_incomplete(labelled.select(*columns), columns[2:])
