"""Stage tables shared by the modelling queries of one session, each built once per data folder.

The modelling jobs read tables that earlier jobs wrote (bars, features, datasets). Here the same
tables are written to the staging folder on first use.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans import evaluate, linear, splits, trees
from barloom.plans.dataset import positioned_dataset, preset
from barloom.plans.features import features, numeric_features
from barloom.schemas import TARGET
from barloom.session import stage
from catalog import tables

_BUILT: dict[tuple, DataFrame] = {}

FOLDS = splits.PurgedFolds(n_splits=3, purge_gap=5)


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = stage(build(), name)
    return _BUILT[key]


def market_data(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "market_data", lambda: tables.bars(spark, sf_dir))


def feature_rows(spark, sf_dir) -> DataFrame:
    """Numeric features of every ticker."""
    return _once(
        spark, sf_dir, "feature_rows", lambda: numeric_features(market_data(spark, sf_dir))
    )


def core_dataset(spark, sf_dir) -> DataFrame:
    """Positioned ``core4`` dataset of every ticker."""

    def build():
        return positioned_dataset(
            feature_rows(spark, sf_dir), market_data(spark, sf_dir), "core4"
        )

    return _once(spark, sf_dir, "core_dataset", build)


def full_features(spark, sf_dir) -> DataFrame:
    """All six features of every ticker."""
    return _once(spark, sf_dir, "full_features", lambda: features(market_data(spark, sf_dir)))


def full_dataset(spark, sf_dir) -> DataFrame:
    """Positioned ``full6`` dataset of every ticker."""

    def build():
        return positioned_dataset(
            full_features(spark, sf_dir), market_data(spark, sf_dir), "full6"
        )

    return _once(spark, sf_dir, "full_dataset", build)


def fitted_folds(spark, sf_dir) -> DataFrame:
    """Out-of-sample rows of the four tournament models over the purged development folds."""

    def build():
        development = splits.development_rows(full_dataset(spark, sf_dir))
        return evaluate.predict(development, FOLDS, "core5", evaluate.TOURNAMENT_MODELS)

    return _once(spark, sf_dir, "fitted_folds", build)


def searched(spark, sf_dir) -> DataFrame:
    """20 candidates of every ticker over the purged development folds."""

    def build():
        development = splits.development_rows(core_dataset(spark, sf_dir))
        return trees.param_search(development, FOLDS, preset("core4"))

    return _once(spark, sf_dir, "searched", build)


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The stage tables in the order in which each needs the ones before it."""
    found = [market_data, feature_rows, core_dataset, full_features, full_dataset]
    return {f.__name__: f for f in found}


def predictions(spark, sf_dir) -> DataFrame:
    """Out-of-sample rows of two SQL-checkable models over the purged folds."""
    dataset = core_dataset(spark, sf_dir)
    naive = linear.naive_predictions(dataset, FOLDS)
    momentum = splits.rows_under_test(dataset, FOLDS).select(
        "ticker",
        "date",
        F.lit("Momentum").alias("model"),
        F.col(TARGET).alias("actual"),
        F.col("return_1d").alias("prediction"),
        "fold",
    )
    return naive.unionByName(momentum)
