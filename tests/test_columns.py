import datetime as dt

import pytest

from barloom.operators import cleaning, columns, validation
from barloom.schemas import MARKET_DATA
from tests.frames import ordered


def test_headers_by_fragment_and_adjusted_close_left_alone():
    names = ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume", "note"]
    mapping = columns.standard_headers(names)
    assert mapping == {n: n.lower() for n in names[:5] + ["Volume"]}


def test_headers_with_ticker_suffix():
    mapping = columns.standard_headers(["Date", "('Open', 'AAPL')", "('Close', 'AAPL')"])
    assert mapping["('Close', 'AAPL')"] == "close"


def test_ambiguous_headers_raise():
    with pytest.raises(ValueError, match="Close"):
        columns.standard_headers(["Close A", "Close B"])
    with pytest.raises(ValueError, match="duplicate"):
        columns.standard_headers(["date", "Date"])


def test_headers_are_case_sensitive():
    assert columns.standard_headers(["close", "open"]) == {}


def test_missing_columns_are_listed(spark):
    df = spark.createDataFrame([(1.0,)], "close double")
    with pytest.raises(ValueError, match=r"\['date', 'open', 'high', 'low', 'volume'\]"):
        columns.require_columns(df)


def test_cast_dates_from_text_and_timestamp(spark):
    text = spark.createDataFrame([("2024-01-05",), ("2024-01-05 10:00:00",), ("no",)], "date string")
    assert [r.date for r in columns.cast_dates(text).collect()] == [
        dt.date(2024, 1, 5), dt.date(2024, 1, 5), None,
    ]
    stamp = spark.createDataFrame([(dt.datetime(2024, 1, 5, 23, 59),)], "date timestamp_ntz")
    assert columns.cast_dates(stamp).first().date == dt.date(2024, 1, 5)


def _bars(spark, rows):
    data = [("X", dt.date(2024, 1, i + 1), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, MARKET_DATA)


NAN = float("nan")


def test_clean_filters_before_filling(spark):
    df = _bars(spark, [
        (None, 2.0, 1.0, 1.5, 10.0),   # leading null open stays
        (5.0, 2.0, 1.0, 0.0, 10.0),    # close not positive: dropped, its open fills nothing
        (None, 2.0, 1.0, 1.5, None),   # still nothing to fill from, volume becomes 0
        (3.0, NAN, 1.0, 1.5, 0.0),     # NaN high filled from above
        (0.0, 2.0, 1.0, 1.5, 1.0),     # zero open: dropped
        (None, 2.0, None, 1.5, -1.0),  # negative volume: dropped
        (None, 2.5, None, NAN, 1.0),   # NaN close: dropped
        (None, 2.5, None, 1.6, 1.0),   # open and low filled
    ])
    got = ordered(cleaning.clean_bars(df))
    assert [d.day for d in got["date"]] == [1, 3, 4, 8]
    assert got["open"].astype(object).where(got["open"].notna(), None).tolist() == [None, None, 3.0, 3.0]
    assert got["high"].tolist() == [2.0, 2.0, 2.0, 2.5]
    assert got["low"].tolist() == [1.0, 1.0, 1.0, 1.0]
    assert got["volume"].tolist() == [10.0, 0.0, 0.0, 1.0]


def test_guards(spark):
    good = _bars(spark, [(1.0, 1.0, 1.0, 1.0, 0.0)])
    assert cleaning.check_guards(good) is good
    with pytest.raises(ValueError, match="no valid rows"):
        cleaning.check_guards(good.where("close > 5"))
    with pytest.raises(ValueError, match="X"):
        cleaning.check_guards(_bars(spark, [(1.0, 1.0, 1.0, -1.0, 0.0)]))


def test_counts_include_absent_tickers(spark):
    wanted = spark.createDataFrame([("X",), ("Y",)], "ticker string")
    counts = cleaning.ticker_counts(_bars(spark, [(1.0, 1.0, 1.0, 1.0, 0.0)]), wanted)
    assert {r.ticker: r.row_count for r in counts.collect()} == {"X": 1, "Y": 0}


def test_expectations_report_everything_and_then_raise(spark):
    df = _bars(spark, [(1.0, 1.0, 1.0, None, -1.0), (1.0, 1.0, 1.0, 0.0, None)])
    report = {r.expectation: (r.failures, r.success) for r in validation.validate_bars(df).collect()}
    assert len(report) == 10
    assert report["close contains no nulls"] == (1, False)
    assert report["close is greater than zero"] == (1, False)
    assert report["volume is non-negative"] == (1, False)
    assert report["date contains no nulls"] == (0, True)
    with pytest.raises(ValueError, match="close"):
        validation.validate_bars(df, raise_on_failure=True)


def test_expectations_for_absent_column(spark):
    df = _bars(spark, [(1.0, 1.0, 1.0, 1.0, 1.0)]).drop("volume")
    report = {r.expectation: r.success for r in validation.validate_bars(df).collect()}
    assert not report["volume column exists"] and not report["volume is non-negative"]
    assert report["close column exists"]
