"""Naive, scaling and ridge fits for every (ticker, fold) from one aggregation.

Training sets grow fold by fold, so the sums a fit needs (counts, means, cross products) are
aggregated once per newly added stretch of rows and then accumulated over the folds. Only these
sums, one row per (ticker, fold), reach the small solve in Python. Every test row has a fit, so
rows meet fits in left joins, where only the fits can become the broadcast side.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.splits import Scheme, rows_under_test, train_entries
from barloom.schemas import NOT_FINITE, TARGET


def training_moments(
    df: DataFrame, scheme: Scheme, features: Sequence[str] = (), products: bool = True
) -> DataFrame:
    """Moments of the training rows per ``(ticker, fold)``.

    ``train_rows, mean_y``, arrays ``mean_x``, ``gram`` (sums of products about the means: the upper
    triangle by rows with ``products``, else the squares), ``cross`` (with the target) and ``flat``
    (features with one value only). Every stretch is reduced to its own means and central moments,
    and stretches are added about the mean of the ticker's first one, so large levels keep their
    precision.
    """
    size = len(features)
    pairs = [(i, j) for i in range(size) for j in range(i, size if products else i + 1)]
    x = [F.col(c).cast("double") for c in features]
    y = F.col(TARGET)
    sums = {"_n": F.count("*"), "_my": F.avg(y)}
    for i in range(size):
        sums |= {f"_m{i}": F.avg(x[i]), f"_lo{i}": F.min(x[i]), f"_hi{i}": F.max(x[i])}
        if products:
            sums[f"_y{i}"] = F.covar_pop(x[i], y)
    sums |= {f"_c{i}_{j}": F.var_pop(x[i]) if i == j else F.covar_pop(x[i], x[j]) for i, j in pairs}
    added = train_entries(df, scheme).groupBy("ticker", "fold").agg(
        *[expression.alias(name) for name, expression in sums.items()]
    )
    upto = Window.partitionBy("ticker").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("_n")
    # shifts of a stretch's means from those of the first stretch
    added = added.withColumns(
        {f"_r{k}": F.first(f"_m{k}").over(upto) for k in [*range(size), "y"]}
    ).withColumns({f"_s{k}": F.col(f"_m{k}") - F.first(f"_m{k}").over(upto) for k in [*range(size), "y"]})
    total = {"train_rows": F.sum(n).over(upto)}
    total |= {f"_o{k}": F.sum(n * F.col(f"_s{k}")).over(upto) / F.sum(n).over(upto) for k in [*range(size), "y"]}
    for i, j in pairs:
        total[f"_g{i}_{j}"] = F.sum(n * (F.col(f"_c{i}_{j}") + F.col(f"_s{i}") * F.col(f"_s{j}"))).over(upto)
    for i in range(size):
        if products:
            total[f"_gy{i}"] = F.sum(n * (F.col(f"_y{i}") + F.col(f"_s{i}") * F.col("_sy"))).over(upto)
        total[f"_flat{i}"] = F.min(f"_lo{i}").over(upto) == F.max(f"_hi{i}").over(upto)
    rows = F.col("train_rows")
    moments = added.withColumns(total)
    empty = F.array().cast("array<double>")
    pack = lambda items: F.array(*items) if items else empty
    about = lambda g, i, j: F.col(g) - rows * F.col(f"_o{i}") * F.col(f"_o{j}")
    return moments.select(
        "ticker",
        "fold",
        "train_rows",
        (F.col("_ry") + F.col("_oy")).alias("mean_y"),
        pack([F.col(f"_r{i}") + F.col(f"_o{i}") for i in range(size)]).alias("mean_x"),
        pack([about(f"_g{i}_{j}", i, j) for i, j in pairs]).alias("gram"),
        pack([about(f"_gy{i}", i, "y") for i in range(size)] if products else []).alias("cross"),
        (F.array(*[F.col(f"_flat{i}") for i in range(size)]) if size else F.array().cast("array<boolean>")).alias("flat"),
    )


def _as_predictions(rows: DataFrame, model: str, *more: str) -> DataFrame:
    return rows.select(
        "ticker",
        "date",
        F.lit(model).alias("model"),
        F.col(TARGET).alias("actual"),
        "prediction",
        "fold",
        *more,
    )


def naive_predictions(df: DataFrame, scheme: Scheme) -> DataFrame:
    """Forecast the mean training target of the fold."""
    means = training_moments(df, scheme).select("ticker", "fold", F.col("mean_y").alias("prediction"))
    rows = rows_under_test(df, scheme).join(means, ["ticker", "fold"], "left")
    return _as_predictions(rows, "Naive")


def scalers(df: DataFrame, scheme: Scheme, features: Sequence[str]) -> DataFrame:
    """``ticker, fold, means, deviations`` of the training rows; flat features get deviation 1."""
    moments = training_moments(df, scheme, features, products=False)

    def deviation(i):
        spread = F.sqrt(F.greatest(F.col("gram")[i], F.lit(0.0)) / F.col("train_rows"))
        return F.when(F.col("flat")[i] | (spread == 0), F.lit(1.0)).otherwise(spread)

    return moments.select(
        "ticker",
        "fold",
        F.col("mean_x").alias("means"),
        F.array(*[deviation(i) for i in range(len(features))]).alias("deviations"),
    )


def apply_scalers(
    rows: DataFrame, fitted: DataFrame, features: Sequence[str], keys=("ticker", "fold")
) -> DataFrame:
    scaled = {
        c: (F.col(c) - F.col("means")[i]) / F.col("deviations")[i]
        for i, c in enumerate(features)
    }
    return rows.join(fitted, list(keys), "left").withColumns(scaled).drop("means", "deviations")


def ridge_coefficients(
    moments: DataFrame, features: Sequence[str], alpha: float = 1.0, scaled: bool = True
) -> DataFrame:
    """``ticker, fold, intercept, coefficients, error`` from :func:`training_moments`.

    A fold whose equations cannot be solved has a message in ``error`` and no coefficients.

    The intercept is not penalised; with ``scaled`` the penalty applies to features in units of
    their training deviation (flat ones stay as they are). Coefficients are for raw features.
    """
    size = len(features)
    upper = np.triu_indices(size)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [
                _solve_ridge(row, size, upper, alpha, scaled)
                for row in batch.itertuples(index=False)
            ]
            yield pd.DataFrame(
                {
                    "ticker": batch["ticker"],
                    "fold": batch["fold"],
                    "intercept": [intercept for intercept, _, _ in fits],
                    "coefficients": [coefficients for _, coefficients, _ in fits],
                    "error": [error for _, _, error in fits],
                }
            )

    return moments.mapInPandas(
        solve, "ticker string, fold int, intercept double, coefficients array<double>, error string"
    )


def _solve_ridge(row, size, upper, alpha, scaled):
    mean_x = np.asarray(row.mean_x)
    gram = np.zeros((size, size))
    gram[upper] = row.gram
    gram = gram + np.triu(gram, 1).T
    unit = np.ones(size)
    if scaled:
        spread = np.sqrt(np.maximum(np.diag(gram), 0.0) / row.train_rows)
        unit = np.where(np.asarray(row.flat) | (spread == 0), 1.0, spread)
    try:
        weights = np.linalg.solve(
            gram / np.outer(unit, unit) + alpha * np.eye(size), np.asarray(row.cross) / unit
        ) / unit
    except np.linalg.LinAlgError as error:
        return None, None, f"LinAlgError: {error}"
    return row.mean_y - weights @ mean_x, list(weights), None


def _ridge_rows(df: DataFrame, scheme: Scheme, features: Sequence[str], alpha: float, scaled: bool) -> DataFrame:
    """Test rows with their fold's ``prediction`` and ``error``."""
    fits = ridge_coefficients(training_moments(df, scheme, features), features, alpha, scaled)
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.col("coefficients")[i] * F.col(c)
    rows = rows_under_test(df, scheme).join(fits, ["ticker", "fold"], "left")
    return rows.withColumn("prediction", value)


def ridge_predictions(
    df: DataFrame,
    scheme: Scheme,
    features: Sequence[str],
    alpha: float = 1.0,
    scaled: bool = True,
) -> DataFrame:
    return _as_predictions(_ridge_rows(df, scheme, features, alpha, scaled), "Ridge")


def _as_attempts(rows: DataFrame, model: str, error: Column) -> DataFrame:
    """Forecasts of the folds without an error, and one row for each fold with one.

    A fold whose forecasts or targets are not finite has failed: what it was fitted on was not.
    """
    usable = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    wrong = ~F.coalesce(usable("prediction") & usable(TARGET), F.lit(False))
    found = F.coalesce(error, F.when(wrong, F.lit(NOT_FINITE)))
    fold = Window.partitionBy("ticker", "fold")
    rows = rows.withColumn("error", found).withColumns(
        {"error": F.min("error").over(fold), "_nth": F.row_number().over(fold.orderBy("date"))}
    )
    rows = rows.where("error is null or _nth = 1")
    gone = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("date", TARGET, "prediction")}
    return _as_predictions(rows.withColumns(gone), model, "error")


def naive_attempts(df: DataFrame, scheme: Scheme) -> DataFrame:
    """``naive_predictions`` with an ``error`` column; a fold that fails is one row without a date."""
    means = training_moments(df, scheme).select("ticker", "fold", F.col("mean_y").alias("prediction"))
    return _as_attempts(rows_under_test(df, scheme).join(means, ["ticker", "fold"], "left"), "Naive", F.lit(None).cast("string"))


def ridge_attempts(df: DataFrame, scheme: Scheme, features: Sequence[str], alpha: float = 1.0, scaled: bool = True) -> DataFrame:
    """``ridge_predictions`` with an ``error`` column; a fold that fails is one row without a date."""
    return _as_attempts(_ridge_rows(df, scheme, features, alpha, scaled), "Ridge", F.col("error"))
