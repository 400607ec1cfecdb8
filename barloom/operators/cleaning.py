"""Cleaning of standardised bars: filters first, then fills, then guards."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.columns import canonical_bars, nan_to_null
from barloom.operators.series import forward_fill
from barloom.schemas import PRICE_COLUMNS


def positive_close(df: DataFrame) -> DataFrame:
    """Rows with a close above zero; NaN is no close."""
    return df.where((F.col("close") > 0) & ~F.isnan("close"))


def positive_or_missing(df: DataFrame, columns=("open", "high", "low")) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNull() | (F.col(c) > 0))
    return df


def valid_volume(df: DataFrame) -> DataFrame:
    return df.where(F.col("volume").isNull() | (F.col("volume") >= 0))


def fill_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def filter_bars(df: DataFrame) -> DataFrame:
    """Bars without impossible values; NaN counts as missing. Other columns stay."""
    return valid_volume(positive_or_missing(positive_close(nan_to_null(df))))


def fill_bars(df: DataFrame) -> DataFrame:
    """Bars unique by (ticker, date) with missing prices carried forward and missing volumes 0."""
    return fill_volume(forward_fill(df, PRICE_COLUMNS))


def clean_bars(df: DataFrame) -> DataFrame:
    """Filters and fills for bars unique by (ticker, date). A row without a date fails the job."""
    return fill_bars(filter_bars(canonical_bars(df)))


def clean_guards(df: DataFrame) -> DataFrame:
    """Per ticker: rows, smallest close and volume, and whether the cleaned bars are usable."""
    return df.groupBy("ticker").agg(
        F.count("*").alias("row_count"),
        F.min("close").alias("min_close"),
        F.min("volume").alias("min_volume"),
        ((F.min("close") > 0) & (F.min("volume") >= 0)).alias("passed"),
    )


def check_guards(df: DataFrame) -> DataFrame:
    """Raise if there are no rows, or a ticker breaks the guards; else return ``df``."""
    verdict = clean_guards(df).agg(
        F.count("*").alias("tickers"),
        F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"),
        F.min(F.when(~F.coalesce("passed", F.lit(False)), F.col("ticker"))).alias("example"),
    ).first()
    if verdict.tickers == 0:
        raise ValueError("Validation failed: no valid rows")
    if verdict.failed:
        raise ValueError(
            f"Validation failed: {verdict.failed} tickers, among them {verdict.example}"
        )
    return df


def ticker_counts(df: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows per ticker; with ``wanted`` (a ``ticker`` column) also 0 for the absent ones."""
    counts = df.groupBy("ticker").agg(F.count("*").alias("row_count"))
    if wanted is None:
        return counts
    return (
        wanted.select("ticker")
        .distinct()
        .join(counts, "ticker", "left")
        .select("ticker", F.coalesce("row_count", F.lit(0)).alias("row_count"))
    )
