"""Scores, rankings and reports over prediction rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scores import all_scores
from barloom.plans.quantiles import quantiles


def score(predictions: DataFrame, keys=("ticker", "model")) -> DataFrame:
    """Pooled scores: over all rows of a key, not the mean over folds."""
    return predictions.groupBy(*keys).agg(*all_scores())


def fold_scores(predictions: DataFrame) -> DataFrame:
    return score(predictions, ("ticker", "model", "fold"))


def mean_fold_mse(predictions: DataFrame, keys=("ticker", "model")) -> DataFrame:
    """Mean of the fold MSEs, the objective of the parameter search."""
    return fold_scores(predictions).groupBy(*keys).agg(F.avg("mse").alias("mean_mse"))


def model_summary(results: DataFrame) -> DataFrame:
    """Mean scores per model over tickers, best RMSE first."""
    return (
        results.groupBy("model")
        .agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "direction_accuracy", "correlation")])
        .orderBy("rmse")
    )


def leaderboard(results: DataFrame) -> DataFrame:
    """Results with their ``rank`` by RMSE within the ticker (one row per model)."""
    by_rmse = Window.partitionBy("ticker").orderBy("rmse")
    return results.withColumn("rank", F.rank().over(by_rmse))


def best_model(results: DataFrame) -> DataFrame:
    """The model with the lowest RMSE of each ticker; ties go to the first name."""
    return results.groupBy("ticker").agg(
        F.min(F.struct("rmse", "model")).alias("_best")
    ).select("ticker", F.col("_best.model").alias("model"), F.col("_best.rmse").alias("rmse"))


def leaderboard_display(results: DataFrame) -> DataFrame:
    """Scores as text, the direction accuracy in percent."""
    return results.select(
        "ticker",
        "model",
        F.format_string("%.8f", "mse").alias("mse"),
        F.format_string("%.6f", "rmse").alias("rmse"),
        F.format_string("%.6f", "mae").alias("mae"),
        F.format_string("%.2f%%", F.col("direction_accuracy") * 100).alias("direction_accuracy"),
        F.format_string("%.4f", "correlation").alias("correlation"),
    )


def sorted_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy("ticker", "date", "model")


def union_predictions(*parts: DataFrame) -> DataFrame:
    """All rows of all parts."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def target_describe(dataset: DataFrame, column: str = "target_5d") -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles per ticker."""
    stats = dataset.groupBy("ticker").agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    found = quantiles(dataset, "ticker", column, [0.25, 0.5, 0.75])
    return stats.join(found, "ticker", "left").select(
        "ticker",
        "count",
        "mean",
        "std",
        "min",
        *[F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))],
        "max",
    )


def tail_rows(df: DataFrame, k: int = 5) -> DataFrame:
    """The last ``k`` rows of every ticker; needs ``rn`` and ``n``."""
    return df.where(F.col("rn") >= F.col("n") - k)
