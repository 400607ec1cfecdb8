import numpy as np
import pandas as pd
import pytest

from barloom.plans import quantiles as q
from barloom.plans.scoring import target_describe

FRACTIONS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def parts():
    rng = np.random.default_rng(1)
    return {
        "all": rng.normal(0, 1, 20_000),  # one key holds nearly all rows
        "heavy": np.exp(rng.normal(0, 30, 3000)),  # a range that equal bins hardly cut
        "outlier": np.append(rng.normal(0, 1e-9, 999), 1e300),
        "both": np.array([-1.7e308, 1.7e308, 0.0, 1.0]),
        "ties": rng.integers(0, 4, 2000).astype(float),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "equal": np.full(50, -2.0),
    }


def frame(spark, data):
    rows = pd.concat([pd.DataFrame({"ticker": k, "target_5d": v}) for k, v in data.items()], ignore_index=True)
    return spark.createDataFrame(rows).unionByName(spark.createDataFrame([("none", None), ("one", None)], "ticker string, target_5d double"))


@pytest.mark.parametrize("few,rounds", [(50_000, 8), (3, 8), (3, 1)])
def test_quantiles_equal_numpy(spark, monkeypatch, few, rounds):
    monkeypatch.setattr(q, "FEW_ROWS", few)
    monkeypatch.setattr(q, "ROUNDS", rounds)
    data = parts()
    got = {r.ticker: r.quantiles for r in q.quantiles(frame(spark, data), "ticker", "target_5d", FRACTIONS).collect()}
    assert got.keys() == data.keys()
    for key, values in data.items():
        ordered = np.sort(values)
        for fraction, found in zip(FRACTIONS, got[key]):
            place = fraction * (len(ordered) - 1)
            low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            share = place - np.floor(place)
            assert found == pytest.approx((1 - share) * low + share * high, rel=1e-12, abs=1e-300)


def test_description_keeps_keys_without_values_and_refuses_infinite_ones(spark):
    data = {"two": parts()["two"], "ties": parts()["ties"]}
    rows = {r.ticker: r for r in target_describe(frame(spark, data)).collect()}
    assert rows["none"]["count"] == 0 and rows["none"].p50 is None
    assert rows["two"].p25 == 1.25 and rows["ties"]["count"] == 2000
    with pytest.raises(Exception, match="not finite"):
        target_describe(frame(spark, {"x": np.array([1.0, np.inf])})).collect()


def test_no_aggregate_buffers_the_values_of_a_key(spark):
    plan = target_describe(frame(spark, {"two": parts()["two"]}))._jdf.queryExecution().toString()
    assert "percentile" not in plan
