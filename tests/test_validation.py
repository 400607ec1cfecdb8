"""Failing tickers, and reruns that make only what is missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.plans import evaluate, ledger, linear, splits, trees
from barloom.session import fresh_path, stage
from barloom.sources import files, outputs
from tests.test_models import FEATURES, dataset, sample

SCHEME = splits.WalkForward(initial=60, test_rows=20, purge=5)
MODELS = ("Naive", "Ridge", "RandomForest")


def poisoned(ticker, n, seed, column="macd", row=70):
    part = sample(ticker, n, seed)
    part.loc[row, column] = np.inf
    return part


def scores(run):
    return {(r.ticker, r.model): r.rmse for r in run.results.collect()}


def validate(df, folder=None, models=MODELS):
    return evaluate.multi_ticker_validation(df, FEATURES, models=models, scheme=SCHEME, folder=folder)


@pytest.fixture(scope="module")
def tables(spark):
    sound = stage(dataset(spark, sample("A", 110), sample("B", 130, 1), sample("S", 40, 2)), "t-sound")
    poison = stage(dataset(spark, sample("A", 110), sample("B", 130, 1), poisoned("P", 120, 3), sample("S", 40, 2)), "t-poison")
    return sound, poison


def test_a_poisoned_ticker_is_listed_and_the_others_stay(spark, tables):
    sound, poison = tables
    clean, run = validate(sound), validate(poison)
    assert scores(run) == pytest.approx(scores(clean), rel=1e-12) and len(scores(run)) == 6
    assert [(r.ticker, r.fold, r.model, r.error) for r in run.failed.collect()] == [
        ("P", 1, "RandomForest", "features or targets are not finite")
    ]
    assert {r.ticker for r in run.predictions.collect()} == {"A", "B"}
    status = {(r.ticker, r.fold, r.model): (r.status, r.row_count) for r in run.status.collect()}
    # the row is tested in fold 1 and learned from in folds 2 and 3; the mean does not see it
    assert status["P", 1, "Ridge"] == status["P", 1, "RandomForest"] == ("failed", 0)
    assert status["P", 3, "Ridge"] == ("failed", 0) and status["P", 1, "Naive"] == ("done", 20)
    assert [r.ticker for r in run.skipped.collect()] == ["S"]
    with pytest.raises(Exception, match="P fold 1 Forest - features or targets are not finite"):
        trees.tree_predictions(poison, SCHEME, FEATURES, {"Forest": trees.forest(n_estimators=1)}).collect()


def test_nothing_but_failures_raises_when_results_are_required(spark):
    run = validate(dataset(spark, poisoned("P", 120, 3, "target_5d", 10)))
    assert run.failed.count() == 1 and {r.status for r in run.status.collect()} == {"failed"}
    with pytest.raises(RuntimeError):
        evaluate.require_results(run.results)


def test_unsolvable_equations_carry_their_message():
    row = type("Row", (), {"mean_x": [0.0], "mean_y": 1.0, "gram": [0.0], "cross": [0.0], "train_rows": 3, "flat": [True]})
    intercept, coefficients, error = linear._solve_ridge(row, 1, np.triu_indices(1), 0.0, False)
    assert intercept is None and coefficients is None and error.startswith("LinAlgError")


def made(spark, folder, run):
    rows = ledger.read(spark, f"{folder}/ledger").where(F.col("run") == run)
    return {(r.ticker, r.fold, r.model) for r in rows.collect()}


def test_a_rerun_makes_only_what_is_missing(spark, tables):
    sound, poison = tables
    folder = fresh_path(spark, "t-ledger")
    first = validate(poison, folder)
    assert {t for t, _, _ in made(spark, folder, 1)} == {"A", "B", "P"}
    assert outputs.read_csv(spark, f"{folder}/failed", "ticker string, fold int, model string, error string").first().ticker == "P"
    # the same again: only failed fits are tried
    again = validate(poison, folder)
    assert {m for t, _, m in made(spark, folder, 2)} == {"Ridge", "RandomForest"}
    assert {t for t, _, _ in made(spark, folder, 2)} == {"P"}
    assert scores(again) == scores(first)
    # repaired rows of one ticker and one more model: the other ticker's fits are not made again
    repaired = stage(poison.withColumn("macd", F.when(F.abs("macd") < 1e9, F.col("macd")).otherwise(0.0)), "t-repaired")
    full = validate(repaired, folder)
    assert {t for t, _, _ in made(spark, folder, 3)} == {"P"} and full.failed.count() == 0
    assert scores(full) == pytest.approx(scores(validate(repaired)), rel=1e-12)
    more = validate(repaired, folder, (*MODELS, "BoostedTrees"))
    assert {m for _, _, m in made(spark, folder, 4)} == {"BoostedTrees"} and len(scores(more)) == 12


def test_a_lost_run_leaves_no_ledger_rows(spark, tables, monkeypatch):
    sound, _ = tables
    folder = fresh_path(spark, "t-lost")
    monkeypatch.setattr(ledger, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        validate(sound, folder)
    monkeypatch.undo()
    assert not files.exists(spark, f"{folder}/ledger")
    assert len(scores(validate(sound, folder))) == 6
