"""Header, type and null conventions of incoming bars."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schemas import BAR_COLUMNS, REQUIRED_BAR_COLUMNS

# Header fragments in matching order (fixed values).
HEADER_FRAGMENTS = ["Date", "Open", "High", "Low", "Close", "Volume"]


def standard_headers(columns: Sequence[str]) -> dict[str, str]:
    """Map raw headers to standard names by the first fragment they contain.

    A header equal to its fragment wins over longer ones, and adjusted closes are left alone,
    so ``Close`` next to ``Adj Close`` is not ambiguous. Any other clash raises.
    """
    claims: dict[str, list[str]] = {}
    for column in columns:
        if "Adj Close" in column:
            continue
        fragment = next((f for f in HEADER_FRAGMENTS if f in column), None)
        if fragment is not None:
            claims.setdefault(fragment, []).append(column)
    mapping = {}
    for fragment, found in claims.items():
        chosen = [fragment] if fragment in found else found
        if len(chosen) > 1:
            raise ValueError(f"several columns look like {fragment}: {chosen}")
        mapping[chosen[0]] = fragment.lower()
    taken = set(columns) & set(mapping.values())
    if taken:
        raise ValueError(f"renaming would duplicate columns: {sorted(taken)}")
    return mapping


def standardize_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(standard_headers(df.columns))


def require_columns(df: DataFrame, required: Sequence[str] = tuple(REQUIRED_BAR_COLUMNS)) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def attach_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """Ticker column for a file that holds one ticker."""
    return df.withColumn("ticker", F.lit(ticker))


def canonical_bars(df: DataFrame) -> DataFrame:
    return require_columns(df, BAR_COLUMNS).select(*BAR_COLUMNS)


def cast_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Timestamps and text to dates; text that is no date becomes null, which validation reports."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.try_to_date(F.substring(column, 1, 10), "yyyy-MM-dd"))
    return df.withColumn(column, F.to_date(column))


def format_dates(df: DataFrame, column: str = "date") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in floating}
    )


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a null or NaN in ``subset``."""
    return df.na.drop("any", subset=list(subset))


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")
