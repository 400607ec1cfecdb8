"""Model comparisons: purged tournament, holdout, tuning and multi-ticker walk-forward.

Every comparison covers the tickers of its dataset that have a fold, the same ones for each model.
With a folder it also writes its result files and run records there.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans import ledger, trees
from barloom.plans.dataset import preset
from barloom.plans.linear import naive_attempts, naive_predictions, ridge_attempts, ridge_predictions
from barloom.plans.scoring import best_model, leaderboard, model_summary, score, union_predictions
from barloom.plans.splits import (
    Holdout,
    PurgedFolds,
    Scheme,
    WalkForward,
    development_rows,
    skipped_tickers,
)
from barloom.session import stage
from barloom.sources import outputs

TOURNAMENT_MODELS = ("Naive", "Ridge", "RandomForest", "BoostedTrees")
VALIDATION_MODELS = ("Naive", "Ridge", "RandomForest")


@dataclass(frozen=True)
class Naive:
    """Mean training target."""


@dataclass(frozen=True)
class Ridge:
    alpha: float = 1.0
    scaled: bool = False


Model = Naive | Ridge | trees.TreeModel

_MODELS = {
    "Naive": Naive,
    "Ridge": Ridge,
    "RandomForest": trees.forest,
    "BoostedTrees": trees.boosting,
}


def create_model(name: str) -> Model:
    """The tournament's model of that name, with its fixed parameters."""
    if name not in _MODELS:
        raise ValueError(f"no model is called {name!r}; there are {', '.join(sorted(_MODELS))}")
    return _MODELS[name]()


def predict(df: DataFrame, scheme: Scheme, features, models: dict[str, Model] | Sequence[str]) -> DataFrame:
    """Out-of-sample predictions of the models over the folds of a positioned dataset."""
    names = preset(features)
    if not isinstance(models, dict):
        models = {name: create_model(name) for name in models}
    grown = {name: model for name, model in models.items() if isinstance(model, trees.TreeModel)}
    parts = []
    for name, model in models.items():
        if isinstance(model, Naive):
            parts.append(naive_predictions(df, scheme).withColumn("model", F.lit(name)))
        elif isinstance(model, Ridge):
            own = ridge_predictions(df, scheme, names, model.alpha, model.scaled)
            parts.append(own.withColumn("model", F.lit(name)))
    if grown:
        parts.append(trees.tree_predictions(df, scheme, names, grown))
    return union_predictions(*parts)


def attempt(df: DataFrame, scheme: Scheme, features, models: dict[str, Model], only: DataFrame | None = None) -> DataFrame:
    """Predictions as of ``predict`` with an ``error`` column: a fit that fails is one row without a date.

    ``only`` names the fits to make (``ticker, fold, model``; default all).
    """
    names = preset(features)
    if only is not None:
        df = df.join(only.select("ticker").distinct(), "ticker", "left_semi")
    grown = {name: model for name, model in models.items() if isinstance(model, trees.TreeModel)}
    parts = []
    for name, model in models.items():
        if isinstance(model, Naive):
            parts.append(naive_attempts(df, scheme).withColumn("model", F.lit(name)))
        elif isinstance(model, Ridge):
            parts.append(ridge_attempts(df, scheme, names, model.alpha, model.scaled).withColumn("model", F.lit(name)))
    if only is not None:
        parts = [p.join(only.select(*ledger.FIT), ledger.FIT, "left_semi") for p in parts]
    if grown:
        parts.append(trees.tree_attempts(df, scheme, names, grown, only=only))
    return reduce(DataFrame.unionByName, parts)


def require_every_model(results: DataFrame, models: int) -> DataFrame:
    """``results`` if each ticker has a row for each of so many models; raises otherwise."""
    short = results.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") != models)
    example = short.first()
    if example is not None:
        raise ValueError(f"{example.ticker} has results of {example.n} models instead of {models}")
    return results


@dataclass(frozen=True)
class Tournament:
    predictions: DataFrame
    results: DataFrame
    winner: DataFrame
    holdout: DataFrame


def _tickers_of(df: DataFrame, tickers: Sequence[str] | None) -> DataFrame:
    return df if tickers is None else df.where(F.col("ticker").isin(list(tickers)))


def tournament(
    df: DataFrame,
    features="core5",
    tickers: Sequence[str] | None = None,
    models: Sequence[str] = TOURNAMENT_MODELS,
    n_splits: int = 3,
    purge_gap: int = 5,
    train_share: float = 0.8,
    folder: str | None = None,
) -> Tournament:
    """Compare models on purged folds of the development rows, then refit and score the holdout.

    With ``folder``: ``results``, ``predictions`` and ``holdout_results`` as CSV and one run record
    for each result under ``runs``.
    """
    df = _tickers_of(df, tickers)
    folds = PurgedFolds(n_splits, purge_gap)
    predictions = stage(predict(development_rows(df, train_share), folds, features, models), "tournament")
    results = require_every_model(leaderboard(score(predictions)), len(models))
    holdout = stage(score(predict(df, Holdout(train_share), features, models)), "tournament-holdout")
    if folder:
        params = {"n_splits": n_splits, "purge_gap": purge_gap, "holdout_ratio": round(1 - train_share, 6), "target": "target_5d"}
        params |= {f"feature_{c}": True for c in preset(features)}
        outputs.write_csv(results.drop("rank"), f"{folder}/results", ["ticker", "rmse"])
        outputs.write_csv(predictions, f"{folder}/predictions", ["ticker", "model", "date"])
        outputs.write_csv(holdout, f"{folder}/holdout_results", ["ticker", "model"])
        name = F.concat_ws("_", "ticker", "model", F.lit("Tournament"))
        runs = outputs.run_records(results, "model_tournament", name, params)
        tuned = {f"xgb_{k}": str(v) for k, v in trees.TUNED_BOOSTING.items()}
        extra = F.create_map(*[F.lit(v) for pair in tuned.items() for v in pair])
        boosted = F.col("params")["model"] == "BoostedTrees"
        runs = runs.withColumn("params", F.when(boosted, F.map_concat("params", extra)).otherwise(F.col("params")))
        outputs.append_runs(runs, f"{folder}/runs")
    return Tournament(predictions, results, best_model(results), holdout)


@dataclass(frozen=True)
class Validation:
    predictions: DataFrame
    results: DataFrame
    summary: DataFrame
    skipped: DataFrame
    status: DataFrame
    failed: DataFrame


def multi_ticker_validation(
    df: DataFrame,
    features="full6",
    tickers: Sequence[str] | None = None,
    models: Sequence[str] = VALIDATION_MODELS,
    scheme: Scheme = WalkForward(),
    folder: str | None = None,
) -> Validation:
    """Walk-forward scores per ticker and model; too short tickers are listed as skipped.

    A ticker with a fit that fails is listed in ``failed`` with the message of its first one and has no
    predictions or scores; the other tickers go on. ``status`` has a row for every fit.

    With ``folder``: ``results``, ``summary``, ``predictions`` and ``failed`` as CSV, a run record for each
    result under ``runs``, and a ``ledger`` of finished fits: a rerun in the same folder makes only the
    fits that failed, are new or whose rows or settings have changed.
    """
    df = _tickers_of(df, tickers)
    chosen = {name: create_model(name) for name in models}
    if "Ridge" in chosen:
        chosen["Ridge"] = Ridge(scaled=True)
    if "RandomForest" in chosen:
        chosen["RandomForest"] = trees.forest(**trees.VALIDATION_FOREST)
    if folder:
        path = f"{folder}/ledger"
        fits = stage(ledger.planned_fits(df, scheme, preset(features), chosen), "validation-fits")
        missing = stage(fits.join(ledger.finished(fits, path), ledger.FIT, "left_anti"), "validation-missing")
        ledger.append(attempt(df, scheme, features, chosen, missing), missing, path)
        attempts = stage(ledger.attempts_of(fits, path), "validation")
    else:
        attempts = stage(attempt(df, scheme, features, chosen), "validation")
    status = ledger.statuses(attempts)
    failed = stage(ledger.failed_tickers(status), "validation-failed")
    predictions = attempts.join(failed.select("ticker"), "ticker", "left_anti").drop("error")
    results = require_every_model(score(predictions), len(models))
    summary = model_summary(results)
    if folder:
        params = {"initial_train_size": 1000, "test_size": 100, "purge_days": 5}
        if isinstance(scheme, WalkForward):
            params = {"initial_train_size": scheme.initial, "test_size": scheme.test_rows, "purge_days": scheme.purge}
        params["features"] = ",".join(preset(features))
        outputs.write_csv(results, f"{folder}/results", ["ticker", "model"])
        outputs.write_csv(summary, f"{folder}/summary", ["rmse"])
        outputs.write_csv(predictions, f"{folder}/predictions", ["ticker", "date", "model"])
        outputs.write_csv(failed, f"{folder}/failed", ["ticker"])
        runs = outputs.run_records(results, "multi_ticker_validation", F.concat_ws("_", "ticker", "model"), params)
        outputs.append_runs(runs, f"{folder}/runs")
    return Validation(predictions, results, summary, skipped_tickers(df, scheme), status, failed)


@dataclass(frozen=True)
class Tuned:
    search: DataFrame
    best: DataFrame
    predictions: DataFrame
    results: DataFrame


def tuned_model(
    df: DataFrame,
    features="core4",
    trials: int = 20,
    n_splits: int = 3,
    purge_gap: int = 5,
    train_share: float = 0.8,
    seed: int = trees.SEED,
    folder: str | None = None,
    search: DataFrame | None = None,
) -> Tuned:
    """Search parameters on the development rows, refit the best of each ticker on all of them and
    score the holdout. With ``folder``: ``predictions`` as CSV and a run record under ``runs``.
    ``search`` is the result of an earlier search with the same ``trials`` and ``seed``."""
    names = preset(features)
    candidates = trees.random_candidates(trials, seed)
    if search is None:
        folds = PurgedFolds(n_splits, purge_gap)
        found = trees.param_search(development_rows(df, train_share), folds, names, candidates=candidates)
        search = stage(found, "param-search")
    best = trees.best_params(search)
    predictions = stage(trees.refit_best(df, Holdout(train_share), names, best, candidates, seed), "tuned")
    results = score(predictions)
    if folder:
        outputs.write_csv(predictions.select("ticker", "date", "actual", "prediction"), f"{folder}/predictions", ["ticker", "date"])
        params = {"target": "5_day_forward_return", "features": ",".join(names), "n_trials": trials, "cv_splits": n_splits}
        params |= {"purge_gap": purge_gap, "final_test_fraction": round(1 - train_share, 6)}
        name = F.concat_ws("_", "ticker", F.lit("BoostedTrees_Tuned"))
        runs = outputs.run_records(results, "tuned_model", name, params)
        runs = runs.withColumn("ticker", F.col("params")["ticker"]).join(best, "ticker").select(
            "experiment",
            "run_name",
            F.map_concat(runs["params"], F.transform_values(best["params"], lambda _, v: v.cast("string"))).alias("params"),
            F.map_concat("metrics", F.create_map(F.lit("cv_mse"), F.col("mean_mse"))).alias("metrics"),
        )
        outputs.append_runs(runs, f"{folder}/runs")
    return Tuned(search, best, predictions, results)


def require_results(results: DataFrame) -> DataFrame:
    """``results`` unless they have no rows at all."""
    if results.isEmpty():
        raise RuntimeError("no ticker is long enough for a single fold")
    return results
