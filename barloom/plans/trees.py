"""Forest and boosted-tree forecasts for every (ticker, fold, candidate) in one Spark job.

A fit is a row of a table: fold bounds of all tickers times the candidates. Rows meet the fits of
their ticker, and every fit is one group of at most one ticker's rows, which the calendar bounds.
Nothing loops on the driver, so the number of jobs does not grow with tickers, folds or trials.
The fits run inside Spark's own processes (:mod:`barloom.functions.java_trees`). Where a session cannot load
classes, a Python task streams its groups and grows the trees of many of them together, since the sets are small.
"""

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import java_trees
from barloom.functions.shared_boosting import LEARNERS, Set, boosted_fits
from barloom.plans.splits import Scheme, fold_bounds
from barloom.schemas import ATTEMPTS, NOT_FINITE, PREDICTIONS, TARGET
from barloom.session import spread

SEED = 42

#: Rows whose fits a task makes together, and neighbouring folds of a ticker that share a task.
PACK_ROWS, NEAR_FOLDS = 40_000, 4

# Forest of the validation jobs and of the tournament (fixed values).
VALIDATION_FOREST = {"n_estimators": 100, "max_depth": 5, "min_samples_leaf": 10}
TOURNAMENT_FOREST = {"n_estimators": 50, "max_depth": 5, "min_samples_leaf": 1}

# Tuned boosting parameters of the tournament (fixed values).
TUNED_BOOSTING = {
    "n_estimators": 50,
    "max_depth": 7,
    "learning_rate": 0.00889784997053407,
    "subsample": 0.9446654644176917,
    "colsample_bytree": 0.944307996244671,
    "min_child_weight": 6,
    "reg_alpha": 0.0001057862064721877,
    "reg_lambda": 0.5866811502741054,
}

# Search space: (low, high, kind) per parameter (fixed values).
SEARCH_SPACE = {
    "n_estimators": (50, 300, "int"),
    "max_depth": (2, 8, "int"),
    "learning_rate": (0.005, 0.1, "log"),
    "subsample": (0.6, 1.0, "float"),
    "colsample_bytree": (0.6, 1.0, "float"),
    "min_child_weight": (1, 10, "int"),
    "reg_alpha": (1e-5, 1.0, "log"),
    "reg_lambda": (1e-3, 10.0, "log"),
}


@dataclass(frozen=True)
class TreeModel:
    """A learner of :mod:`barloom.functions.shared_boosting` and its parameters."""

    learner: str
    params: dict = field(default_factory=dict)


def forest(**params) -> TreeModel:
    return TreeModel("forest", TOURNAMENT_FOREST | params)


def boosting(params: dict | None = None) -> TreeModel:
    return TreeModel("boosted", dict(params or TUNED_BOOSTING))


def fold_rows(df: DataFrame, fits: DataFrame, features: Sequence[str], *extra: str) -> DataFrame:
    """Training and test rows of every fit, with ``extra`` columns of the fit; the purged gap belongs to neither."""
    rows = df.select("ticker", "date", "rn", F.col(TARGET).alias("actual"), *[F.col(c).cast("double").alias(c) for c in features])
    in_training, in_test = F.col("rn") < F.col("train_end"), F.col("rn").between(F.col("test_start"), F.col("test_end") - 1)
    uses = rows.join(fits, "ticker").where(in_training | in_test)
    return uses.select("ticker", "fold", *extra, "date", "rn", "actual", *features, in_training.alias("train"))


@dataclass(frozen=True)
class _Pack:
    """The rows of many whole groups, one group after the other."""

    rows: pd.DataFrame
    starts: np.ndarray
    names: list[str]

    def heads(self) -> pd.DataFrame:
        return self.rows.iloc[self.starts]

    def sets(self) -> list[Set]:
        x, y, train = self.rows[self.names].to_numpy(float), self.rows["actual"].to_numpy(float), self.rows["train"].to_numpy(bool)
        stops = [*self.starts[1:], len(train)]
        spans = [(slice(a, b), train[a:b]) for a, b in zip(self.starts, stops, strict=True)]
        return [(x[own][t], y[own][t], x[own][~t]) for own, t in spans]

    def finite(self) -> np.ndarray:
        """Whether all features and targets of a group are finite."""
        return np.logical_and.reduceat(np.isfinite(self.rows[[*self.names, "actual"]].to_numpy(float)).all(axis=1), self.starts)

    def tests(self, groups: np.ndarray | None = None) -> pd.DataFrame:
        """Test rows, group by group; ``groups`` says which (default all)."""
        wanted = ~self.rows["train"].to_numpy(bool)
        if groups is not None:
            wanted &= np.repeat(groups, np.diff([*self.starts, len(wanted)]))
        return self.rows[wanted]


def _packs(batches: Iterator[pd.DataFrame], keys: list[str], names: list[str]) -> Iterator[_Pack]:
    """Whole groups of rows that arrive sorted by ``keys`` and ``rn``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= PACK_ROWS:
            rows = pd.concat(held, ignore_index=True)
            starts = _starts(rows, keys)
            if len(starts) > 1:
                yield _Pack(rows.iloc[: starts[-1]], starts[:-1], names)
                rows = rows.iloc[starts[-1] :]
            held, size = [rows], len(rows)
    if size:
        rows = pd.concat(held, ignore_index=True)
        yield _Pack(rows, _starts(rows, keys), names)


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    own = rows[keys]
    return np.flatnonzero((own != own.shift()).any(axis=1).to_numpy())


def _near_folds() -> Column:
    return F.floor((F.col("fold") - 1) / NEAR_FOLDS)


def _by_group(uses: DataFrame, keys: list[str], names: list[str], fit, schema) -> DataFrame:
    """``fit`` over packs of whole groups, dealt by their keys; of near folds that fail, the first comes first."""

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pack in _packs(batches, keys, names):
            yield fit(pack)

    return spread(uses, *[_near_folds() if key == "fold" else key for key in keys]).sortWithinPartitions(*keys, "rn").mapInPandas(fits, schema)


def _in_jvm(uses: DataFrame, keys: list[str], names: list[str], kind: str, params: Column) -> DataFrame:
    """``keys`` and ``found``, what a function of :mod:`barloom.functions.java_trees` returns for each group.

    ``params`` may depend on the keys. Groups are dealt as by ``_by_group``.
    """
    row = F.struct("rn", F.unix_date("date").alias("day"), "train", "actual", F.array(*names).alias("x"))
    rows = spread(uses.select(*keys, _near_folds().alias("_near"), row.alias("_row")), *["_near" if key == "fold" else key for key in keys])
    sets = rows.groupBy(*keys, "_near").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    found = F.call_function(java_trees.FUNCTIONS[kind][0], "_rows", params)
    return sets.select(*keys, found.alias("found")).sortWithinPartitions(*keys)


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _forecasts(sets: list[Set], model: TreeModel, seed: int) -> list[np.ndarray | Exception]:
    """Forecasts of each set, or what its fit fails with."""
    try:
        return LEARNERS[model.learner](sets, model.params, seed)
    except Exception as error:  # noqa: BLE001  (whatever fails a fit is its result)
        if len(sets) == 1:
            return [error]
        return [found for own in sets for found in _forecasts([own], model, seed)]


def tree_attempts(
    df: DataFrame,
    scheme: Scheme,
    features: Sequence[str],
    models: dict[str, TreeModel],
    seed: int = SEED,
    only: DataFrame | None = None,
) -> DataFrame:
    """Forecasts as of ``tree_predictions`` with an ``error`` column; a fit that fails is one row without
    a date that holds its message, and the other fits go on. ``only`` names the fits to make
    (``ticker, fold, model``; default all).

    Features or targets that are not finite fail their fit.
    """
    names = list(features)
    choices = F.array(*[F.lit(m) for m in models])
    fits = fold_bounds(df, scheme).select(
        "ticker", "fold", "train_end", "test_start", "test_end", F.explode(choices).alias("model")
    )
    if only is not None:
        fits = fits.join(only.select("ticker", "fold", "model"), ["ticker", "fold", "model"], "left_semi")
    keys, uses = ["ticker", "fold", "model"], fold_rows(df, fits, names, "model")
    if java_trees.available(df.sparkSession):
        params = F.coalesce(*[F.when(F.col("model") == name, _doubles(java_trees.params_of(m.learner, m.params, seed, checked=True))) for name, m in models.items()])
        found = _in_jvm(uses, keys, names, "Forecasts", params).select(*keys, F.inline("found"))
        return found.withColumn("date", F.date_from_unix_date("day")).select(*[F.col(f.name).cast(f.dataType) for f in ATTEMPTS])

    def fit(pack: _Pack) -> pd.DataFrame:
        heads, sets = pack.heads(), pack.sets()
        found: list = [None if sound else ValueError(NOT_FINITE) for sound in pack.finite()]
        for name in heads["model"].unique():
            own = [g for g in np.flatnonzero(heads["model"] == name) if found[g] is None]
            for g, forecast in zip(own, _forecasts([sets[g] for g in own], models[name], seed) if own else [], strict=True):
                found[g] = forecast
        failed = np.array([isinstance(f, Exception) for f in found])
        tests = pack.tests(~failed).assign(error=None)
        tests["prediction"] = np.concatenate([f for f in found if not isinstance(f, Exception)]) if len(tests) else []
        wrong = heads[failed].assign(date=None, actual=None, prediction=None, error=[message(f) for f in found if isinstance(f, Exception)])
        parts = [part[ATTEMPTS.fieldNames()] for part in (tests, wrong) if len(part)]
        return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]

    return _by_group(uses, keys, names, fit, ATTEMPTS)


def message(error: Exception) -> str:
    """An error as it is listed: its text, behind its kind where the text alone does not tell."""
    return str(error) if isinstance(error, ValueError) and str(error) else f"{type(error).__name__}: {error}"


def tree_predictions(
    df: DataFrame, scheme: Scheme, features: Sequence[str], models: dict[str, TreeModel], seed: int = SEED
) -> DataFrame:
    """Fit each model per (ticker, fold) on the training rows and forecast the test rows.

    ``df`` is a positioned dataset; ``models`` maps the reported name to a model. Every ticker with
    a fold is covered, and a fit that fails ends the job.
    """
    attempts = tree_attempts(df, scheme, features, models, seed)
    return attempts.withColumn("prediction", _sound(F.col("model"))).select(PREDICTIONS.fieldNames())


def _sound(model: Column) -> Column:
    """The prediction; a fit that failed ends the job."""
    failed = F.concat_ws(" ", "ticker", F.lit("fold"), "fold", model, F.lit("-"), "error")
    return F.when(F.col("error").isNull(), F.col("prediction")).otherwise(F.raise_error(failed).cast("double"))


def random_candidates(trials: int, seed: int = SEED) -> list[dict]:
    draw = random.Random(seed)
    pick = {
        "int": lambda low, high: draw.randint(low, high),
        "float": lambda low, high: draw.uniform(low, high),
        "log": lambda low, high: exp(draw.uniform(log(low), log(high))),
    }
    return [
        {name: pick[kind](low, high) for name, (low, high, kind) in SEARCH_SPACE.items()}
        for _ in range(trials)
    ]


def _params_of(trial: Column, candidates: list[dict]) -> Column:
    maps = [F.create_map(*[F.lit(v) for pair in c.items() for v in (pair[0], float(pair[1]))]) for c in candidates]
    return F.element_at(F.array(*maps), trial + 1)


def param_search(
    development: DataFrame,
    scheme: Scheme,
    features: Sequence[str],
    trials: int = 20,
    seed: int = SEED,
    candidates: list[dict] | None = None,
) -> DataFrame:
    """Mean fold MSE of boosted trees per ticker and candidate, with the candidate's parameters.

    A group is one (ticker, fold), which the calendar bounds: its rows are shipped and binned once
    and all candidates of many groups grow together. A group returns one row for each candidate.
    """
    candidates = candidates or random_candidates(trials, seed)
    names = list(features)
    uses = fold_rows(development, fold_bounds(development, scheme), names)

    def fit(pack: _Pack) -> pd.DataFrame:
        heads, sets = pack.heads(), pack.sets()
        trials = range(len(candidates))
        found = boosted_fits(sets, [(s, c) for s in range(len(sets)) for c in candidates], seed)
        actual = pack.tests()["actual"].to_numpy()
        actuals = np.split(actual, np.cumsum([len(tested) for _, _, tested in sets])[:-1])
        errors = [((found[s * len(candidates) + t] - actuals[s]) ** 2).mean() for s in range(len(sets)) for t in trials]
        own = heads[["ticker", "fold"]].iloc[np.repeat(np.arange(len(sets)), len(candidates))]
        return own.assign(trial=np.tile(trials, len(sets)), mse=errors)

    keys = ["ticker", "fold"]
    if java_trees.available(development.sparkSession):
        params = F.array(*[_doubles(java_trees.params_of("boosted", c, seed)) for c in candidates])
        scores = _in_jvm(uses, keys, names, "Errors", params).select(*keys, F.posexplode("found").alias("trial", "mse"))
    else:
        scores = _by_group(uses, keys, names, fit, "ticker string, fold int, trial int, mse double")
    means = scores.groupBy("ticker", "trial").agg(F.avg("mse").alias("mean_mse"))
    return means.select("ticker", "trial", _params_of(F.col("trial"), candidates).alias("params"), "mean_mse")


def best_params(search: DataFrame) -> DataFrame:
    """The candidate with the lowest objective of each ticker; ties go to the first trial."""
    return (
        search.groupBy("ticker")
        .agg(F.min_by(F.struct("trial", "params", "mean_mse"), F.struct("mean_mse", "trial")).alias("_best"))
        .select("ticker", "_best.*")
    )


def refit_best(
    df: DataFrame, scheme: Scheme, features: Sequence[str], best: DataFrame, candidates: list[dict], seed: int = SEED
) -> DataFrame:
    """Forecasts of each ticker's best candidate, refitted over the folds of ``scheme``."""
    names = list(features)
    fits = fold_bounds(df, scheme).join(best.select("ticker", "trial"), "ticker")
    uses = fold_rows(df, fits, names, "trial")

    def fit(pack: _Pack) -> pd.DataFrame:
        fits = [(s, candidates[int(trial)]) for s, trial in enumerate(pack.heads()["trial"])]
        found = boosted_fits(pack.sets(), fits, seed)
        return pack.tests().assign(model="BoostedTrees", prediction=np.concatenate(found))[PREDICTIONS.fieldNames()]

    keys = ["ticker", "fold"]
    if java_trees.available(df.sparkSession):
        params = F.element_at(F.array(*[_doubles(java_trees.params_of("boosted", c, seed)) for c in candidates]), F.col("trial") + 1)
        found = _in_jvm(uses, [*keys, "trial"], names, "Forecasts", params).select(*keys, F.inline("found"))
        found = found.withColumns({"date": F.date_from_unix_date("day"), "model": F.lit("BoostedTrees"), "prediction": _sound(F.lit("BoostedTrees"))})
        return found.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTIONS])
    return _by_group(uses, keys, names, fit, PREDICTIONS)
