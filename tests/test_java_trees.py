import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import histogram_trees, java_trees
from barloom.plans import splits, trees
from tests.frames import ordered

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    parts = []
    for ticker, n in (("A", 700), ("B", 333), ("C", 41), ("D", 2), ("FLAT", 60)):
        a, b, c = rng.normal(size=n), np.round(rng.normal(size=n), 1), rng.integers(0, 2, n).astype(float)
        y = 0.0 if ticker == "FLAT" else 0.05 * (a > 0.3) + 0.02 * b * c + rng.normal(0, 0.03, n)
        days = pd.date_range("2020-01-01", periods=n).date
        parts.append(pd.DataFrame({"ticker": ticker, "date": days, "a": a, "b": b, "c": c, "target_5d": y, "rn": range(n), "n": n}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def single_fits(data, scheme_cut, learner, params):
    found = []
    for _, rows in data.toPandas().sort_values(["ticker", "rn"]).groupby("ticker"):
        x, y, cut = rows[NAMES].to_numpy(float), rows["target_5d"].to_numpy(float), scheme_cut(len(rows))
        found.append(learner(x[:cut], y[:cut], x[cut:], trees.SEED, **params))
    return np.concatenate(found)


MODELS = {
    "F": trees.forest(**trees.VALIDATION_FOREST), "T": trees.forest(), "G": trees.boosting(),
    "P": trees.boosting({"n_estimators": 30, "max_depth": 4, "learning_rate": 0.3, "subsample": 0.6, "colsample_bytree": 0.7, "reg_alpha": 0.01, "min_child_weight": 3}),
    "D": trees.boosting({"n_estimators": 3, "max_depth": 10, "learning_rate": 0.9, "min_child_weight": 1, "reg_lambda": 0.0}),
}


@pytest.mark.parametrize("name", MODELS)
def test_fits_equal_the_learners_in_python(spark, data, name):
    assert java_trees.available(spark)
    model = MODELS[name]
    plan = trees.tree_predictions(data, splits.Holdout(), NAMES, {name: model})
    assert "MapInPandas" not in plan._jdf.queryExecution().executedPlan().toString()
    got = ordered(plan)
    expected = single_fits(data, lambda n: int(n * 0.8), getattr(histogram_trees, model.learner), model.params)
    np.testing.assert_allclose(got["prediction"], expected, rtol=1e-9, atol=1e-12)


def test_search_and_refit_equal_python(spark, data, monkeypatch):
    own = data.where("ticker <> 'D'")
    scheme, candidates = splits.PurgedFolds(2, 2), trees.random_candidates(4)
    run = lambda: (
        ordered(trees.param_search(own, scheme, NAMES, candidates=candidates).drop("params"), "ticker", "trial"),
        ordered(trees.refit_best(own, splits.Holdout(), NAMES, own.select("ticker", (F.length("ticker") % 4).cast("int").alias("trial")).distinct(), candidates)),
    )
    in_java = run()
    monkeypatch.setattr(java_trees, "available", lambda spark: False)
    for ours, theirs in zip(in_java, run(), strict=True):
        pd.testing.assert_frame_equal(ours, theirs[list(ours)], rtol=1e-9, check_dtype=False)


def test_a_fit_that_is_not_finite_fails_alone(data):
    spoilt = data.withColumn("a", F.when(F.expr("ticker = 'B' and rn = 5"), F.lit(float("inf"))).otherwise(F.col("a")))
    got = trees.tree_attempts(spoilt, splits.Holdout(), NAMES, {"G": trees.boosting()}).toPandas()
    assert got.loc[got["error"].notna(), ["ticker", "error"]].values.tolist() == [["B", "features or targets are not finite"]]
    assert got.loc[got["error"].notna(), ["date", "actual", "prediction"]].isna().all(axis=None)
    assert set(got.loc[got["error"].isna(), "ticker"]) == {"A", "C", "D", "FLAT"}


def test_unknown_parameters_raise():
    with pytest.raises(TypeError, match="trees"):
        java_trees.params_of("boosted", {"trees": 3}, 1)
