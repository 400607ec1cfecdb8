"""Level-wise distributed trees against the in-task learner and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import histogram_trees
from barloom.operators.series import with_positions
from barloom.plans import level_trees, splits
from barloom.session import stage
from tests.frames import days, ordered


def whole_numbers(ticker, n, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"ticker": ticker, "date": days(n), "a": rng.integers(0, 9, n), "b": rng.integers(0, 5, n), "c": rng.integers(0, 2, n)})
    return pdf.assign(target_5d=0.02 * (pdf["a"] > 4) - 0.03 * pdf["b"] * pdf["c"] + rng.normal(0, 0.01, n))


NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    parts = [whole_numbers("A", 260, 1), whole_numbers("B", 180, 2)]
    parts.append(whole_numbers("C", 60, 3).assign(a=1, b=1, c=1))  # nothing to cut
    return stage(with_positions(spark.createDataFrame(pd.concat(parts, ignore_index=True))), "t-levels")


def by_hand(data, fit):
    """Forecasts of ``fit(train, y, test)`` over the two folds of every ticker."""
    out = []
    for ticker, part in data.orderBy("ticker", "rn").toPandas().groupby("ticker"):
        size = len(part) // 7
        for fold in (1, 2):
            train, test = part.iloc[: size * fold], part.iloc[size * fold + 5 : size * (fold + 1) + 5]
            found = fit(train, test, fold)
            out += [(ticker, fold, d, p) for d, p in zip(test["date"], found)]
    return {(t, f, str(d)): p for t, f, d, p in out}


def check(predictions, want):
    got = {(r.ticker, r.fold, str(r.date)): r.prediction for r in predictions.collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=0, atol=1e-12)


FOLDS = splits.PurgedFolds(2, 5)


@pytest.mark.parametrize("depth,l1,least", [(1, 0.0, 1), (3, 0.0, 4), (2, 0.05, 1)])
def test_boosted_levels_equal_the_learner_of_one_task(data, depth, l1, least):
    params = {"n_estimators": 2, "max_depth": depth, "learning_rate": 0.5, "min_child_weight": least, "reg_alpha": l1, "reg_lambda": 0.3}
    got = level_trees.boosted_predictions(data, FOLDS, NAMES, **params)
    x = lambda p: p[NAMES].to_numpy(float)
    check(got, by_hand(data, lambda a, b, _: histogram_trees.boosted(x(a), a["target_5d"].to_numpy(), x(b), 1, **params)))


def test_forest_equals_trees_grown_on_the_same_draws(spark, data):
    trees, depth = 4, 3
    drawn = {}
    rows = level_trees.fold_rows(data, splits.fold_bounds(data, FOLDS), NAMES).where("train")
    for t in range(trees):
        for r in rows.select("ticker", "fold", "date", level_trees.bootstrap_weight(F.lit(t), 42).alias("w")).collect():
            drawn[r.ticker, r.fold, str(r.date), t] = r.w
    assert 0.9 < np.mean(list(drawn.values())) < 1.1 and max(drawn.values()) >= 3

    def fit(train, test, fold):
        bins = histogram_trees.Bins(train[NAMES].to_numpy(float))
        codes, tested = bins.codes(train[NAMES].to_numpy(float)), bins.codes(test[NAMES].to_numpy(float))
        total = np.zeros(len(test))
        for t in range(trees):
            w = np.array([drawn[k, fold, str(d), t] for k, d in zip(train["ticker"], train["date"])])
            grown = histogram_trees.grow(codes, bins.width, train["target_5d"].to_numpy(), w, depth, np.arange(3), 2)
            total += grown.predict(tested)
        return total / trees

    check(level_trees.forest_predictions(data, FOLDS, NAMES, trees, depth, 2), by_hand(data, fit))


def test_subsets_of_rows_and_columns_still_learn(data, monkeypatch):
    monkeypatch.setattr(level_trees, "ROUNDS_PER_TABLE", 2)
    params = {"n_estimators": 5, "max_depth": 2, "learning_rate": 0.7, "subsample": 0.7, "colsample_bytree": 0.7}
    rows = ordered(level_trees.boosted_predictions(data.where("ticker = 'A'"), splits.Holdout(), NAMES, **params))
    error, spread = rows["actual"] - rows["prediction"], rows["actual"] - rows["actual"].mean()
    assert (error**2).mean() < 0.5 * (spread**2).mean()


def test_no_group_holds_the_rows_of_a_fit(spark, data):
    rows = level_trees.binned(level_trees.fold_rows(data, splits.fold_bounds(data, FOLDS), NAMES), NAMES)
    plan = level_trees.grow(rows.withColumn("residual", F.col("actual")), 3, 2, 2, 1, F.lit(1), [[0, 1, 2]] * 2)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "ArrowEvalPython" not in plan
    # what a level leaves behind is rows of nodes, not of the table
    staged = level_trees.grow(rows.withColumn("residual", F.col("actual")), 3, 1, 2, 1, F.lit(1), [[0, 1, 2]])
    assert staged.count() == 6 and max(len(r.nodes) for r in staged.collect()) == 7
