"""Name -> query and name -> SQL tables filled by the query modules."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: _rounded(c, digits) for c in columns})


def _rounded(column: str, digits: int) -> Column:
    return F.round(column, digits) + F.lit(0.0)
