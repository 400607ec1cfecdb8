"""The daily jobs: landed bars to the bar table, the bar table to the feature table."""

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.cleaning import check_guards, fill_bars, filter_bars
from barloom.operators.columns import cast_dates, require_columns, standardize_headers
from barloom.operators.validation import validate_bars
from barloom.plans.features import features
from barloom.schemas import BAR_COLUMNS, FEATURE_STORE, MARKET_DATA
from barloom.session import stage
from barloom.sources.landing import read_newest
from barloom.sources.outputs import latest_features_kv
from barloom.sources.tables import last_per_key, scan_table, upsert_table


def clean_and_load(spark: SparkSession, landing_path: str, table_path: str) -> DataFrame:
    """Clean, validate and upsert the newest landing of every ticker; returns the loaded rows.

    Impossible rows go first; then the last delivery of each ``(ticker, date)`` counts. Validation
    sees these rows before anything is filled, so a missing or unparsable date raises. All tickers
    load in one job, and nothing is written if a guard or an expectation fails.
    """
    landed = standardize_headers(read_newest(spark, landing_path))
    bars = cast_dates(require_columns(landed, BAR_COLUMNS)).select(*BAR_COLUMNS, "delivery")
    kept = stage(last_per_key(filter_bars(bars), sequence="delivery"), "kept-bars")
    validate_bars(kept, raise_on_failure=True)
    cleaned = stage(fill_bars(kept), "clean-bars")
    check_guards(cleaned)
    upsert_table(cleaned, table_path, MARKET_DATA, staged=True)
    return cleaned


def build_features(spark: SparkSession, table_path: str, feature_path: str) -> DataFrame:
    """Compute features of every bar, upsert them and return the latest row per ticker as JSON.

    Only months whose rows changed are rewritten.
    """
    bars = scan_table(spark, table_path, MARKET_DATA, columns=["ticker", "date", "close"])
    rows = stage(features(bars), "features")
    upsert_table(rows, feature_path, FEATURE_STORE)
    return latest_features_kv(rows)
