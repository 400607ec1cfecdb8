"""Joins of features and prices."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import segmented
from barloom.schemas import KEYS


def join_features_prices(features: DataFrame, bars: DataFrame, columns=("close",)) -> DataFrame:
    """Features with price columns on ``(ticker, date)``; rows without a partner go."""
    return features.join(bars.select(*KEYS, *columns), KEYS)


def join_in_segments(features: DataFrame, bars: DataFrame, columns=("close",)) -> DataFrame:
    """:func:`join_features_prices` for bars unique by key, with each row's date segment ``_seg``.

    Both sides are shuffled by ``(ticker, _seg)`` and meet in a window over the rows of a day, so what is done
    by segment next needs no shuffle of the joined rows.
    """
    left = segmented(features.dropna(subset=KEYS), "ticker").withColumn("_is_bar", F.lit(False))
    right = segmented(bars.select(*KEYS, *columns).dropna(subset=KEYS), "ticker").withColumn("_is_bar", F.lit(True))
    day = Window.partitionBy("ticker", "_seg").orderBy("date").rangeBetween(Window.currentRow, Window.currentRow)
    prices = {c: F.max(c).over(day) for c in columns}
    met = left.unionByName(right, allowMissingColumns=True).withColumns(prices | {"_has_bar": F.max("_is_bar").over(day)})
    return met.where("_has_bar and not _is_bar").select(*features.columns, *columns, "_seg")
