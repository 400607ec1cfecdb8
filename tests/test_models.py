import datetime as dt
from math import sqrt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from barloom.functions import histogram_trees, shared_boosting
from barloom.functions.shared_boosting import boosted_together
from barloom.operators.sequences import sequence_windows, too_short
from barloom.operators.series import with_positions
from barloom.plans import evaluate, linear, scoring, splits, trees
from barloom.plans.dataset import modeling_dataset, preset
from barloom.plans.features import numeric_features
from barloom.plans.scoring import mean_fold_mse
from barloom.schemas import PREDICTIONS, RESULTS
from barloom.session import fresh_path, stage
from barloom.sources import outputs
from tests.frames import bars_frame, days, ordered, walk

FEATURES = ["rsi_14", "macd", "volatility_20d", "regime", "return_1d"]


def sample(ticker, n, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "ticker": ticker, "date": days(n),
        "rsi_14": rng.normal(50, 10, n), "macd": rng.normal(0, 2, n),
        "volatility_20d": rng.normal(0.02, 0.001, n), "regime": 0, "return_1d": rng.normal(0, 0.01, n),
    })
    pdf.loc[n // 2 :, "regime"] = rng.integers(0, 2, n - n // 2)
    pdf["target_5d"] = (
        0.001 * pdf["rsi_14"] - 0.01 * pdf["macd"] + pdf["return_1d"] + rng.normal(0, 0.01, n)
    )
    return pdf


def dataset(spark, *parts):
    return with_positions(spark.createDataFrame(pd.concat(parts, ignore_index=True)))


def ridge_by_hand(train, test, scaled, alpha=1.0):
    x, y = train[FEATURES].to_numpy(float), train["target_5d"].to_numpy()
    mean, unit = x.mean(0), np.where(x.std(0) == 0, 1.0, x.std(0))
    if not scaled:
        unit = np.ones_like(unit)
    z = (x - mean) / unit
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(FEATURES)), z.T @ (y - y.mean()))
    return y.mean() + (test[FEATURES].to_numpy(float) - mean) / unit @ beta


@pytest.mark.parametrize("scaled", [True, False])
def test_ridge_on_every_fold_with_a_flat_feature_early_on(spark, scaled):
    part = sample("A", 300)
    scheme = splits.PurgedFolds(4, 5)
    got = ordered(linear.ridge_predictions(dataset(spark, part), scheme, FEATURES, scaled=scaled))
    size = 300 // 9
    for fold in range(1, 5):
        test = part.iloc[size * fold + 5 : size * (fold + 1) + 5]
        want = ridge_by_hand(part.iloc[: size * fold], test, scaled)
        np.testing.assert_allclose(got.loc[got["fold"] == fold, "prediction"], want, rtol=1e-9)


def test_ridge_equals_spark_linear_regression(spark):
    part = sample("A", 250)
    df = dataset(spark, part)
    names = ["rsi_14", "macd", "volatility_20d", "return_1d"]
    ours = linear.ridge_coefficients(
        linear.training_moments(df, splits.Holdout(), names), names
    ).first()
    train = VectorAssembler(inputCols=names, outputCol="features").transform(df.where("rn < 200"))
    spread = train.select(F.stddev_samp("target_5d")).first()[0] * sqrt(199 / 200)
    model = LinearRegression(
        labelCol="target_5d", regParam=1.0 / 200 * spread, elasticNetParam=0.0,
        standardization=True, solver="normal",
    ).fit(train)
    np.testing.assert_allclose(ours.coefficients, model.coefficients.toArray(), rtol=1e-9)


def test_naive_predicts_the_training_mean_of_each_fold(spark):
    parts = [sample("A", 1210), sample("B", 900, 1)]
    got = ordered(linear.naive_predictions(dataset(spark, *parts), splits.WalkForward()))
    assert set(got["ticker"]) == {"A"} and len(got) == 210
    for fold, stop in ((1, 995), (2, 1095), (3, 1195)):
        mean = parts[0]["target_5d"].iloc[:stop].mean()
        np.testing.assert_allclose(got.loc[got["fold"] == fold, "prediction"], mean)


def test_scalers_match_numpy_and_keep_flat_features(spark):
    part = sample("A", 200).assign(macd=lambda p: p["macd"] + 1e7)
    scheme = splits.PurgedFolds(3, 5)
    fitted = linear.scalers(dataset(spark, part), scheme, FEATURES).orderBy("fold").collect()
    for row in fitted:
        train = part[FEATURES].iloc[: 25 * row.fold].to_numpy(float)
        np.testing.assert_allclose(row.means, train.mean(0), rtol=1e-12)
        spread = train.std(0)
        np.testing.assert_allclose(row.deviations, np.where(spread == 0, 1.0, spread), rtol=1e-7)


def predictions(spark, rows):
    data = [(t, dt.date(2024, 1, i + 1), m, a, p, 1) for i, (t, m, a, p) in enumerate(rows)]
    return spark.createDataFrame(data, PREDICTIONS)


def test_scores_by_hand(spark):
    rows = [("A", "M", a, p) for a, p in [(0.1, 0.2), (-0.1, 0.1), (0.0, 0.0), (0.2, 0.3)]]
    got = scoring.score(predictions(spark, rows)).first()
    a, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert got.mse == pytest.approx(np.mean((a - p) ** 2))
    assert got.rmse == pytest.approx(np.sqrt(np.mean((a - p) ** 2)))
    assert got.mae == pytest.approx(np.mean(abs(a - p)))
    assert got.direction_accuracy == 0.75
    assert got.correlation == pytest.approx(np.corrcoef(a, p)[0, 1])


def test_correlation_without_spread_is_zero(spark):
    flat = [("A", "M", a, 0.1) for a in (0.1, 0.2, 0.3)] + [("A", "ONE", 0.1, 0.2)]
    got = {r.model: r.correlation for r in scoring.score(predictions(spark, flat)).collect()}
    assert got == {"M": 0.0, "ONE": 0.0}


# Walk-forward results per ticker: rmse, mae, direction accuracy, correlation (fixed values).
PUBLISHED = [
    ("AAPL", "Naive", 0.038973, 0.030247, 0.5506, -0.0235),
    ("AAPL", "Ridge", 0.038995, 0.030305, 0.5331, 0.0229),
    ("AAPL", "RandomForest", 0.040140, 0.031105, 0.5466, 0.0454),
    ("MSFT", "Naive", 0.038084, 0.028153, 0.5607, -0.0259),
    ("MSFT", "Ridge", 0.038803, 0.028992, 0.5209, 0.0653),
    ("MSFT", "RandomForest", 0.039395, 0.030024, 0.5202, 0.0733),
    ("GOOGL", "Naive", 0.043257, 0.033105, 0.5594, -0.1073),
    ("GOOGL", "Ridge", 0.043572, 0.033367, 0.5641, -0.0236),
    ("GOOGL", "RandomForest", 0.044254, 0.034177, 0.5169, 0.0137),
    ("AMZN", "Naive", 0.049398, 0.036399, 0.5324, -0.0462),
    ("AMZN", "Ridge", 0.049590, 0.036544, 0.5378, 0.0444),
    ("AMZN", "RandomForest", 0.051646, 0.037599, 0.5290, 0.0252),
    ("SPY", "Naive", 0.022271, 0.016569, 0.6053, -0.0598),
    ("SPY", "Ridge", 0.022433, 0.016849, 0.5398, 0.0218),
    ("SPY", "RandomForest", 0.023715, 0.017409, 0.5762, -0.0813),
]


def published(spark):
    return spark.createDataFrame([(t, m, r * r, r, a, d, c) for t, m, r, a, d, c in PUBLISHED], RESULTS)


def test_summary_of_published_results(spark):
    rows = scoring.model_summary(published(spark)).collect()
    assert [r.model for r in rows] == ["Naive", "Ridge", "RandomForest"]
    assert rows[0].rmse == pytest.approx(0.038397, abs=1e-6)
    assert rows[1].mae == pytest.approx(0.029211, abs=1e-6)
    assert rows[2].correlation == pytest.approx(0.0153, abs=1e-4)


def test_ranks_and_winners_of_published_results(spark):
    ranked = scoring.leaderboard(published(spark)).where("rank = 1")
    assert {r.model for r in ranked.collect()} == {"Naive"}
    assert {r.model for r in scoring.best_model(published(spark)).collect()} == {"Naive"}
    shown = scoring.leaderboard_display(published(spark)).where("ticker = 'SPY' and model = 'Naive'").first()
    assert (shown.rmse, shown.direction_accuracy) == ("0.022271", "60.53%")


def test_dataset_target_looks_ahead_in_joined_rows(spark):
    part = walk("A", 60, 5)
    bars = bars_frame(spark, part)
    feats = numeric_features(bars).where("date <> date'2000-02-10'")
    got = ordered(modeling_dataset(feats, bars, "core4"))
    kept = part[25:][part["date"][25:].astype(str) != "2000-02-10"]
    want = (kept["close"].shift(-5) / kept["close"] - 1).dropna()
    np.testing.assert_allclose(got["target_5d"], want)


def test_drop_modes_and_presets(spark):
    bars = bars_frame(spark, walk("A", 60, 5))
    feats = numeric_features(bars)
    assert modeling_dataset(feats, bars, "core4", drop="any").count() == 30
    with pytest.raises(ValueError):
        modeling_dataset(feats, bars, "core4", drop="some")
    with pytest.raises(ValueError):
        preset("core9")


def test_sequences_stay_inside_their_role(spark):
    part = sample("A", 700).assign(role="train")
    part.loc[100:, "role"] = None
    part.loc[105:, "role"] = "holdout"
    part = part.assign(rn=range(700))
    short = sample("B", 21).assign(role="train", rn=range(21))
    df = spark.createDataFrame(pd.concat([part, short]).astype(object).where(lambda p: p.notna(), None),
                               "ticker string, date date, rsi_14 double, macd double, "
                               "volatility_20d double, regime long, return_1d double, "
                               "target_5d double, role string, rn long")
    got = ordered(sequence_windows(df, FEATURES), "role", "date")
    train, holdout = got[got["role"] == "train"], got[got["role"] == "holdout"]
    assert len(train) == 80 and len(holdout) == 595 - 20
    assert np.stack(list(map(np.stack, train["x"]))).shape == (80, 21, 5)
    assert train["date"].iloc[0] == part["date"].iloc[20]
    assert holdout["date"].iloc[0] == part["date"].iloc[125]
    want = part[FEATURES].iloc[600 - 20 : 601].to_numpy(np.float32)
    row = holdout[holdout["date"] == part["date"].iloc[600]].iloc[0]
    np.testing.assert_array_equal(np.stack(row["x"]), want)
    assert row["y"] == np.float32(part["target_5d"].iloc[600])
    assert [r.ticker for r in too_short(df).collect()] == ["B"]


def test_models_by_name():
    assert evaluate.create_model("Ridge") == evaluate.Ridge(1.0, False)
    assert evaluate.create_model("BoostedTrees").params == trees.TUNED_BOOSTING
    with pytest.raises(ValueError, match="Oracle"):
        evaluate.create_model("Oracle")


def test_an_incomplete_set_of_models_is_refused(spark):
    rows = [("A", "M", 0.1, 0.2), ("A", "N", 0.1, 0.2), ("B", "M", 0.1, 0.2)]
    with pytest.raises(ValueError, match="B has results of 1 models instead of 2"):
        evaluate.require_every_model(scoring.score(predictions(spark, rows)), 2)


def test_a_grown_tree_equals_the_best_cuts_by_brute_force():
    rng = np.random.RandomState(0)
    x = rng.randn(90, 3)
    x[:, 2] = np.round(x[:, 2])
    y = rng.randn(90)

    def best(rows, depth):
        mean = y[rows].mean()
        found = (1e-12, None)
        for f in range(3) if depth and len(rows) > 1 else []:
            for v in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(left), len(right)) < 4:
                    continue
                gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - len(rows) * mean**2
                if gain > found[0] + 1e-12:
                    found = (gain, (left, right))
        if found[1] is None:
            return {r: mean for r in rows}
        return best(found[1][0], depth - 1) | best(found[1][1], depth - 1)

    bins = histogram_trees.Bins(x)
    codes = bins.codes(x)
    tree = histogram_trees.grow(codes, bins.width, y, np.ones(90, int), 3, np.arange(3), 4)
    want = best(np.arange(90), 3)
    np.testing.assert_allclose(tree.predict(codes), [want[i] for i in range(90)])


def test_boosting_shrinks_every_tree_from_the_mean_and_penalises_leaves():
    x = np.repeat([0.0, 1.0], 50)[:, None]
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    one = dict(n_estimators=1, max_depth=1, reg_lambda=0.0, seed=0)
    assert histogram_trees.boosted(x, y, x, learning_rate=0.1, **one)[-1] == pytest.approx(0.1)
    many = histogram_trees.boosted(x, y, x, learning_rate=0.1, **(one | {"n_estimators": 5}))
    assert many[-1] == pytest.approx(1 - 0.9**5)
    l2 = histogram_trees.boosted(x, y, x, learning_rate=1.0, **(one | {"reg_lambda": 50.0}))
    assert l2[-1] == pytest.approx(0.5)
    l1 = histogram_trees.boosted(x, y, x, learning_rate=1.0, reg_alpha=10.0, **one)
    assert l1[-1] == pytest.approx(0.8)
    heavy = histogram_trees.boosted(x, y, x, learning_rate=1.0, min_child_weight=51, **one)
    assert heavy[-1] == pytest.approx(0.0)


def test_the_number_of_jobs_does_not_grow_with_fits(spark):
    def jobs(tickers, trials):
        df = stage(dataset(spark, *[sample(f"T{i}", 80, i) for i in range(tickers)]), "t-data")
        spark.sparkContext.setJobGroup(f"fits-{tickers}-{trials}", "")
        candidates = [{"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1}] * trials
        trees.param_search(df, splits.PurgedFolds(2, 5), FEATURES, candidates=candidates).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits-{tickers}-{trials}"))

    assert jobs(1, 1) == jobs(5, 4)


def test_ridge_keeps_its_precision_on_shifted_features(spark):
    part = sample("A", 300)
    plain = ordered(linear.ridge_predictions(dataset(spark, part), splits.PurgedFolds(3, 5), FEATURES))
    moved = part.assign(macd=part["macd"] + 1e7, rsi_14=part["rsi_14"] - 1e5)
    shifted = ordered(linear.ridge_predictions(dataset(spark, moved), splits.PurgedFolds(3, 5), FEATURES))
    np.testing.assert_allclose(shifted["prediction"], plain["prediction"], rtol=0, atol=1e-7)


def test_candidates_lie_in_the_search_space_and_are_repeatable():
    drawn = trees.random_candidates(50)
    assert drawn == trees.random_candidates(50)
    for name, (low, high, kind) in trees.SEARCH_SPACE.items():
        values = [c[name] for c in drawn]
        assert low <= min(values) and max(values) <= high
        assert (kind != "int") or all(isinstance(v, int) for v in values)


def test_forest_beats_the_mean_on_a_learnable_target(spark):
    df = stage(dataset(spark, sample("A", 400), sample("B", 400, 2)), "t-data")
    folder = fresh_path(spark, "t-tournament")
    models = ("Naive", "Ridge", "RandomForest", "BoostedTrees")
    outcome = evaluate.tournament(df, FEATURES, models=models, folder=folder)
    runs = {(r.params["ticker"], r.params["model"]): r for r in outputs.read_runs(spark, f"{folder}/runs").collect()}
    assert len(runs) == 8 and runs["A", "BoostedTrees"].params["xgb_max_depth"] == "7"
    assert outputs.read_csv(spark, f"{folder}/results", RESULTS).count() == 8
    assert outputs.read_csv(spark, f"{folder}/predictions", PREDICTIONS).count() == outcome.predictions.count()
    results = {(r.ticker, r.model): r for r in outcome.results.collect()}
    assert len(results) == 8
    for ticker in "AB":
        assert results[(ticker, "RandomForest")].rmse < results[(ticker, "Naive")].rmse
        assert results[(ticker, "Ridge")].rmse < results[(ticker, "Naive")].rmse
    assert {r.ticker for r in outcome.winner.collect()} == {"A", "B"}
    assert outcome.holdout.count() == 8
    counts = {r["count"] for r in outcome.predictions.groupBy("ticker", "model").count().collect()}
    assert len(counts) == 1


def test_search_scores_every_candidate(spark):
    df = stage(dataset(spark, sample("A", 120)), "t-data")
    candidates = [{"n_estimators": n, "max_depth": 2, "learning_rate": 0.1} for n in (3, 5)]
    search = trees.param_search(df, splits.PurgedFolds(2, 5), FEATURES, candidates=candidates)
    rows = search.orderBy("trial").collect()
    assert [r.params["n_estimators"] for r in rows] == [3.0, 5.0]
    best = trees.best_params(search).first()
    assert best.mean_mse == min(r.mean_mse for r in rows)


def test_candidates_grown_together_equal_single_fits():
    rng = np.random.default_rng(7)
    for n, width in ((1, 2), (2, 1), (37, 3), (260, 4)):
        x = rng.standard_normal((n, width))
        x[:, 0] = np.round(x[:, 0], 1)  # ties between rows
        y, tested = rng.standard_normal(n) / 30, rng.standard_normal((20, width))
        candidates = [*trees.random_candidates(6), {"n_estimators": 3, "max_depth": 1, "learning_rate": 1.0}]
        candidates.append({"n_estimators": 2, "max_depth": 3, "learning_rate": 0.5, "min_child_weight": n + 1})
        together = boosted_together(x, y, tested, 42, candidates)
        alone = [histogram_trees.boosted(x, y, tested, 42, **c) for c in candidates]
        np.testing.assert_allclose(together, alone, rtol=0, atol=1e-13)
    assert boosted_together(x, y, tested, 42, []).shape == (0, 20)


def test_search_ships_rows_once_and_equals_the_predictions_of_single_fits(spark):
    df = stage(dataset(spark, sample("A", 120), sample("B", 150, 1)), "t-data")
    candidates, folds = trees.random_candidates(4), splits.PurgedFolds(2, 5)
    models = {str(i): trees.boosting(c) for i, c in enumerate(candidates)}
    each = mean_fold_mse(trees.tree_predictions(df, folds, FEATURES, models))
    want = {(r.ticker, int(r.model)): r.mean_mse for r in each.collect()}
    search = trees.param_search(df, folds, FEATURES, candidates=candidates)
    got = {(r.ticker, r.trial): r.mean_mse for r in search.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_validation_lists_skipped_tickers_and_empty_results_raise(spark):
    df = dataset(spark, sample("A", 1100), sample("B", 300, 1))
    folder = fresh_path(spark, "t-validation")
    run = evaluate.multi_ticker_validation(df, FEATURES, models=("Naive", "Ridge"), folder=folder)
    assert [r.model for r in run.summary.collect()] and outputs.read_runs(spark, f"{folder}/runs").count() == 2
    assert {r.ticker for r in run.results.collect()} == {"A"}
    assert [(r.ticker, r.row_count) for r in run.skipped.collect()] == [("B", 300)]
    short = evaluate.multi_ticker_validation(df.where("ticker = 'B'"), FEATURES, models=("Naive",))
    with pytest.raises(RuntimeError):
        evaluate.require_results(short.results)


def test_the_best_candidate_is_refitted_and_logged(spark):
    df = stage(dataset(spark, sample("A", 150), sample("B", 160, 1)), "t-data")
    folder = fresh_path(spark, "t-tuned")
    tuned = evaluate.tuned_model(df, FEATURES, trials=3, folder=folder)
    assert tuned.search.count() == 6 and tuned.best.count() == 2
    assert {r.ticker: r["count"] for r in tuned.predictions.groupBy("ticker").count().collect()} == {"A": 30, "B": 32}
    runs = outputs.read_runs(spark, f"{folder}/runs").collect()
    assert {r.params["ticker"] for r in runs} == {"A", "B"} and all("cv_mse" in r.metrics and "max_depth" in r.params for r in runs)


def test_fits_of_many_training_sets_grown_together_equal_single_fits(monkeypatch):
    rng, calls = np.random.default_rng(8), []
    sets = [(rng.normal(size=(n, 3)), level + rng.normal(size=n) * level / 30, rng.normal(size=(9, 3)))
            for n, level in ((60, 1e-3), (61, 1e6), (60, 1.0), (2, 1.0), (45, 1e-9))]
    sets.append((sets[0][0], np.full(60, 0.5), sets[0][2]))
    grow = shared_boosting._grow
    monkeypatch.setattr(shared_boosting, "_grow", lambda *a: calls.append(1) or grow(*a))
    params = trees.random_candidates(1)[0]
    boosted = shared_boosting.LEARNERS["boosted"](sets, params, 42)
    assert len(calls) == params["n_estimators"]  # one round grows a tree of every set
    calls.clear()
    forests = shared_boosting.LEARNERS["forest"](sets[:1], trees.VALIDATION_FOREST, 42)
    assert len(calls) == 1
    forests += shared_boosting.LEARNERS["forest"](sets[1:], trees.TOURNAMENT_FOREST, 42)
    for i, (x, y, tested) in enumerate(sets):
        shape = trees.TOURNAMENT_FOREST if i else trees.VALIDATION_FOREST
        np.testing.assert_allclose(boosted[i], histogram_trees.boosted(x, y, tested, 42, **params), rtol=1e-12)
        np.testing.assert_allclose(forests[i], histogram_trees.forest(x, y, tested, 42, **shape), rtol=1e-12)


def test_a_set_that_is_not_finite_leaves_its_neighbours_alone():
    rng = np.random.default_rng(9)
    x, tested = rng.normal(size=(40, 2)), rng.normal(size=(5, 2))
    y = rng.normal(size=40)
    spoilt = np.where(np.arange(40) == 7, np.inf, y)
    with np.errstate(all="ignore"):
        found = shared_boosting.LEARNERS["boosted"]([(x, spoilt, tested), (x, y, tested)], trees.TUNED_BOOSTING, 42)
    np.testing.assert_allclose(found[1], histogram_trees.boosted(x, y, tested, 42, **trees.TUNED_BOOSTING), rtol=1e-12)
