"""Expectation report: one aggregation, one row per (ticker, expectation)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schemas import REQUIRED_BAR_COLUMNS


def validate_bars(df: DataFrame, raise_on_failure: bool = False) -> DataFrame:
    """Columns ``ticker, expectation, failures, success``.

    Every expectation is evaluated before a failure raises. Nulls do not break the range
    checks; an absent column fails its own check and the value checks on it.
    """
    def rows_where(column, condition):
        return F.count_if(condition) if column in df.columns else F.count("*")

    checks = {
        f"{c} column exists": F.lit(0 if c in df.columns else 1).cast("long")
        for c in REQUIRED_BAR_COLUMNS
    }
    checks["date contains no nulls"] = rows_where("date", F.expr("date is null"))
    checks["close contains no nulls"] = rows_where("close", F.expr("close is null"))
    checks["close is greater than zero"] = rows_where("close", F.expr("close <= 0"))
    checks["volume is non-negative"] = rows_where("volume", F.expr("volume < 0"))

    counted = df.groupBy("ticker").agg(
        *[count.alias(f"check_{i}") for i, count in enumerate(checks.values())]
    )
    report = counted.select(
        "ticker",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("expectation"), F.col(f"check_{i}").alias("failures"))
                    for i, name in enumerate(checks)
                ]
            )
        ),
    ).withColumn("success", F.col("failures") == 0)
    if raise_on_failure:
        broken = report.where(~F.col("success"))
        first = broken.orderBy("ticker", "expectation").first()
        if first is not None:
            raise ValueError(
                f"validation failed, first for {first.ticker}: {first.expectation} "
                f"({first.failures} rows)"
            )
    return report
