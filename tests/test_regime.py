import itertools

import numpy as np
import pytest

from barloom.functions import switching
from barloom.operators import regime
from barloom.plans.features import features
from tests.frames import bars_frame, ordered, walk


def two_state(n, seed=3):
    rng = np.random.default_rng(seed)
    state = np.zeros(n, dtype=int)
    for t in range(1, n):
        state[t] = state[t - 1] if rng.random() < 0.97 else 1 - state[t - 1]
    returns = np.where(state == 1, rng.normal(0.01, 0.006, n), rng.normal(-0.01, 0.02, n))
    return state, returns


def regime_bars(n, seed=3, ticker="A"):
    state, returns = two_state(n, seed)
    part = walk(ticker, n + 1)
    part["close"] = 100 * np.exp(np.concatenate([[0.0], np.cumsum(np.log1p(returns))]))
    return state, part


def test_recovers_well_separated_states():
    state, returns = two_state(1500)
    ends = np.arange(500, 1500, 20)
    labels = switching.latest_regimes([returns[:n] for n in ends])
    assert np.mean(np.array(labels) == state[ends - 1]) > 0.9


def test_histories_are_fitted_independently():
    _, returns = two_state(900)
    together = switching.latest_regimes([returns[:n] for n in (500, 700, 900)])
    alone = [switching.latest_regimes([returns[:n]])[0] for n in (500, 700, 900)]
    assert together == alone


def test_fit_reaches_the_plain_em_optimum():
    _, returns = two_state(600)
    y, lengths = returns[:, None], np.array([600])
    theta, _, fitted = switching._fit(y.copy(), lengths)
    plain = switching._start(y, lengths)
    for _ in range(1500):
        plain, likelihood, _ = switching._step(plain, y, lengths)
    assert fitted.all()
    assert switching._step(theta, y, lengths)[1] == pytest.approx(likelihood, abs=1e-3)


def test_likelihood_and_odds_equal_a_sum_over_all_paths():
    rng = np.random.default_rng(9)
    lengths = np.array([9, 6, 1, 2])
    y = np.where(np.arange(9)[:, None] < lengths, rng.normal(0, 0.02, (9, 4)), 0.0)
    theta = np.array([[-0.01, 0.0, 0.0, 0.01], [0.01, 0.005, 0.02, 0.0], [-8.0] * 4, [-7.5] * 4, [2.0, -1.0, 0.5, 0.0], [1.0, 2.0, 0.0, 3.0]])
    _, likelihood, latest = switching._step(theta, y, lengths)
    for column, n in enumerate(lengths):
        mean, variance = theta[:2, column], np.exp(theta[2:4, column])
        stay = 1 / (1 + np.exp(-theta[4:, column]))
        move = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
        start = np.array([1 - stay[1], 1 - stay[0]]) / (2 - stay.sum())
        total, ends = 0.0, np.zeros(2)
        for path in itertools.product((0, 1), repeat=int(n)):
            p = start[path[0]] * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            for t, state in enumerate(path):
                p *= np.exp(-0.5 * (y[t, column] - mean[state]) ** 2 / variance[state]) / np.sqrt(2 * np.pi * variance[state])
            total += p
            ends[path[-1]] += p
        assert likelihood[column] == pytest.approx(np.log(total), rel=1e-10)
        assert latest[column] == pytest.approx(ends[1] / ends[0], rel=1e-9)


@pytest.mark.parametrize("rows", [1, 2, 5, 50, 577])
def test_blocked_scans_equal_the_recursions(rows):
    rng = np.random.default_rng(rows)
    ratio = np.exp(np.clip(rng.normal(0, 40, (rows, 7)), -150, 150))
    p00, p11 = rng.uniform(1e-10, 1 - 1e-10, (2, 7))
    p00[0], p11[0] = 1 - 1e-10, 1e-10
    p01, p10 = 1 - p00, 1 - p11
    odds, prior = p01 / p10, []
    for r in ratio:
        prior.append(odds)
        odds = (p11 * odds * r + p01) / (p10 * odds * r + p00)
    np.testing.assert_allclose(switching.forward_odds(ratio, p00, p01, p10, p11), prior, rtol=1e-9)
    ahead = [np.ones(7)]
    for r in ratio[:0:-1]:
        coming = r * ahead[-1]
        ahead.append((p10 + p11 * coming) / (p00 + p01 * coming))
    np.testing.assert_allclose(switching.backward_odds(ratio, p00, p01, p10, p11), ahead[::-1], rtol=1e-9)


def test_slow_fits_reach_the_tolerance_or_are_failed(monkeypatch):
    y = np.random.default_rng(24).normal(0, 0.01, (600, 1))
    lengths = np.array([600])
    theta, _, fitted = switching._fit(y, lengths)
    after, likelihood, _ = switching._step(theta, y, lengths)
    gain = switching._step(after, y, lengths)[1] - likelihood
    assert fitted.all() and abs(gain) <= switching.TOLERANCE * abs(likelihood)
    monkeypatch.setattr(switching, "MAX_CYCLES", 3)
    assert switching.latest_regimes([y[:, 0]]) == [None]


def test_constant_returns_are_a_failed_fit():
    assert switching.latest_regimes([np.zeros(500)]) == [None]


def test_labels_hold_for_twenty_rows_and_start_after_500_returns(spark):
    _, part = regime_bars(620)
    got = ordered(regime.regimes(bars_frame(spark, part)))
    assert len(got) == 621
    assert (got["regime"][:501] == 0).all()
    for first in range(501, 621, 20):
        assert got["regime"][first : first + 20].nunique() == 1
    expected = switching.latest_regimes([
        (part["close"].pct_change().dropna().to_numpy())[:n] for n in range(500, 620, 20)
    ])
    assert got["regime"][501::20].tolist() == expected


def test_short_series_is_all_zero(spark):
    got = ordered(regime.regimes(bars_frame(spark, walk("A", 500), walk("B", 3))))
    assert (got["regime"] == 0).all() and len(got) == 503


def test_failed_fit_repeats_the_last_label(spark):
    _, part = regime_bars(560)
    returns = regime.indexed_returns(bars_frame(spark, part, walk("FLAT", 530).assign(close=1.0)))
    labels = ordered(regime.refit_labels(returns), "ticker", "refit")
    assert (labels.loc[labels["ticker"] == "FLAT", "regime"] == 0).all()
    assert labels["ticker"].value_counts().to_dict() == {"A": 3, "FLAT": 2}


def test_no_look_ahead_across_chunks(spark):
    _, part = regime_bars(1100)
    full = ordered(regime.regimes(bars_frame(spark, part)))
    cut = ordered(regime.regimes(bars_frame(spark, part.iloc[:1041])))
    assert full["regime"][:1041].tolist() == cut["regime"].tolist()
    assert 0 < full["regime"][501:].mean() < 1


def test_feature_rows_carry_the_regime(spark):
    _, part = regime_bars(600)
    bars = bars_frame(spark, part)
    got = ordered(features(bars))
    labels = ordered(regime.regimes(bars))
    merged = got.merge(labels, on=["ticker", "date"], suffixes=("", "_alone"))
    assert len(merged) == len(got) == 601 - 25
    assert (merged["regime"] == merged["regime_alone"]).all()
    assert not got.isna().any().any()


def test_many_histories_side_by_side_equal_single_fits(monkeypatch):
    rng = np.random.default_rng(5)
    histories = [two_state(int(n), seed)[1] for seed, n in enumerate(rng.integers(60, 260, 90))]
    histories += [np.zeros(100), rng.normal(0, 0.01, 120)]
    plain = []
    for history in histories:
        with np.errstate(all="ignore"):
            theta, odds, fitted = switching._fit(history[:, None], np.array([len(history)]))
        plain.append(int((odds[0] > 1) == (theta[1, 0] > theta[0, 0])) if fitted[0] else None)
    widths, step = [], switching._Lanes.step
    monkeypatch.setattr(switching._Lanes, "step", lambda self, theta: widths.append(self.y.shape) or step(self, theta))
    for lanes, few in ((16, 1), (64, 1000), (512, 20)):
        monkeypatch.setattr(switching, "LANES", lanes)
        monkeypatch.setattr(switching, "FEW_LANES", few)
        assert switching.latest_regimes(histories) == plain
    # lanes take the next history, and no history waits in lanes of much longer ones
    assert max(lanes for _, lanes in widths) < len(histories) and len({rows for rows, _ in widths}) > 1
