"""Exact quantiles per key by narrowing counts, without a buffer of a key's values.

A quantile lies between two values of known rank. Counts of the key's value range, cut into equal bins,
tell which bin holds a rank; its bin is the next range. Every round aggregates before the shuffle, so a
key that holds all rows costs as many rows as bins. When few rows are left in the ranges, their
values are counted and the ranks read off.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stage

BINS = 1024
#: Rows of a range that are counted value by value, and rounds after which they are whatever their number.
FEW_ROWS, ROUNDS = 50_000, 8


def _narrowed(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """``ranges`` (``key, rank, low, high, below``) cut to the bin of their rank, with its ``rows``.

    ``below`` are the key's rows under the range. Ranges of a key that are equal share their counts.
    """
    spans = ranges.select(key, "low", "high", "below").distinct()
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)).otherwise(0)
    inside = rows.join(spans, key).where("v between low and high").withColumn("bin", F.least(F.lit(BINS - 1), place))
    bins = inside.groupBy(key, "low", "high", "below", "bin").agg(F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = Window.partitionBy(key, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("end", F.col("below") + F.sum("rows").over(upto))
    own = bins.join(ranges.select(key, "rank", "low", "high"), [key, "low", "high"])
    own = own.where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("rows")))
    return own.select(key, "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("end") - F.col("rows")).alias("below"), "rows")


def _values(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """``key, rank, value`` of ranges that hold few rows or one value."""
    single = ranges.where("low = high").select(key, "rank", F.col("low").alias("value"))
    spans = ranges.where("low < high")
    each = rows.join(spans.select(key, "low", "high", "below").distinct(), key).where("v between low and high")
    each = each.groupBy(key, "low", "high", "below", "v").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy(key, "low", "high").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.col("below") + F.sum("rows").over(upto))
    found = each.join(spans.select(key, "rank", "low", "high"), [key, "low", "high"])
    found = found.where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("rows")))
    return single.unionByName(found.select(key, "rank", F.col("v").alias("value")))


def quantiles(df: DataFrame, key: str, column: str, fractions: Sequence[float]) -> DataFrame:
    """``key, quantiles``: exact quantiles of ``column``, between two values in proportion.

    Nulls do not count; a key without values has no row. A value that is not finite fails the job.
    """
    bad = F.raise_error(F.lit(f"{column} is not finite")).cast("double")
    value = F.col(column).cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    rows = df.where(F.col(column).isNotNull()).select(key, F.when(finite, value).otherwise(bad).alias("v"))
    wholes = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wholes = stage(wholes, "quantile-keys")
    places = [F.lit(float(f)) * (F.col("n") - 1) for f in fractions]
    ranks = F.array_distinct(F.array(*[r.cast("long") for p in places for r in (F.floor(p), F.ceil(p))]))
    ranges = wholes.select(key, "low", "high", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("rank"))
    for _ in range(ROUNDS):
        ranges = stage(_narrowed(rows, ranges, key), "quantile-ranges")
        widest = ranges.where("low < high").agg(F.max("rows")).first()[0]
        if (widest or 0) <= FEW_ROWS:
            break
    found = _values(rows, ranges, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("known"))

    def between(place):
        at = lambda r: F.try_element_at("known", r.cast("long"))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = place - F.floor(place)
        return (1 - share) * low + share * high

    return wholes.join(found, key).select(key, F.array(*[between(p) for p in places]).alias("quantiles"))
