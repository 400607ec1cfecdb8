"""Forecast scores as aggregate expressions over ``actual`` and ``prediction``."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _error(actual, prediction) -> Column:
    return F.col(actual) - F.col(prediction)


def mse(actual="actual", prediction="prediction") -> Column:
    return F.avg(_error(actual, prediction) * _error(actual, prediction))


def rmse(actual="actual", prediction="prediction") -> Column:
    return F.sqrt(mse(actual, prediction))


def mae(actual="actual", prediction="prediction") -> Column:
    return F.avg(F.abs(_error(actual, prediction)))


def direction_accuracy(actual="actual", prediction="prediction") -> Column:
    """Share of rows where both have the same sign; zero only matches zero."""
    return F.avg((F.signum(actual) == F.signum(prediction)).cast("double"))


def correlation(actual="actual", prediction="prediction") -> Column:
    """Pearson correlation, 0 when either side does not vary."""
    flat = (F.min(actual) == F.max(actual)) | (F.min(prediction) == F.max(prediction))
    spread = F.stddev_pop(actual) * F.stddev_pop(prediction)
    return F.when(flat, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.covar_pop(actual, prediction), spread), F.lit(0.0))
    )


def all_scores() -> list[Column]:
    return [
        mse().alias("mse"),
        rmse().alias("rmse"),
        mae().alias("mae"),
        direction_accuracy().alias("direction_accuracy"),
        correlation().alias("correlation"),
    ]
