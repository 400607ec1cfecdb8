"""Table schemas and feature presets."""

from pyspark.sql import types as T

MARKET_DATA = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

FEATURE_STORE = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("return_1d", T.DoubleType()),
        T.StructField("return_5d", T.DoubleType()),
        T.StructField("rsi_14", T.DoubleType()),
        T.StructField("macd", T.DoubleType()),
        T.StructField("volatility_20d", T.DoubleType()),
        T.StructField("regime", T.IntegerType()),
    ]
)

MACRO = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("model", T.StringType()),
        T.StructField("actual", T.DoubleType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("fold", T.IntegerType()),
    ]
)

#: Predictions, and one row without a date for each fit that failed.
NOT_FINITE = "features or targets are not finite"
ATTEMPTS = T.StructType([*PREDICTIONS.fields, T.StructField("error", T.StringType())])

RESULTS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("mse", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("direction_accuracy", T.DoubleType()),
        T.StructField("correlation", T.DoubleType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("experiment", T.StringType(), False),
        T.StructField("run_name", T.StringType(), False),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

KEYS = ["ticker", "date"]
PRICE_COLUMNS = ["open", "high", "low", "close"]
BAR_COLUMNS = MARKET_DATA.fieldNames()
REQUIRED_BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]
FEATURE_COLUMNS = FEATURE_STORE.fieldNames()[2:]

# Feature presets of the modelling jobs (fixed values).
FEATURE_PRESETS = {
    "core4": ["rsi_14", "macd", "volatility_20d", "return_1d"],
    "core5": ["rsi_14", "macd", "volatility_20d", "regime", "return_1d"],
    "full6": ["return_1d", "return_5d", "rsi_14", "macd", "volatility_20d", "regime"],
}

TARGET = "target_5d"
HORIZON = 5
