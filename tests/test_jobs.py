import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.operators import series
from barloom.plans import jobs
from barloom.schemas import FEATURE_STORE, MARKET_DATA
from barloom.session import fresh_path
from barloom.sources import landing, tables
from tests.frames import bars_frame, walk


def landed(spark, *parts):
    raw = bars_frame(spark, *parts).withColumnsRenamed(
        {c: c.capitalize() for c in ("date", "open", "high", "low", "close", "volume")}
    )
    path = fresh_path(spark, "t-job")
    landing.land(raw.withColumn("Adj Close", F.col("Close")), path)
    return path


def test_daily_jobs_are_repeatable(spark):
    table, store = fresh_path(spark, "t-bars"), fresh_path(spark, "t-features")
    batch = landed(spark, walk("A", 120), walk("B", 90), walk("TINY", 10))
    for _ in range(2):
        jobs.clean_and_load(spark, batch, table)
        latest = {r.key: json.loads(r.value) for r in jobs.build_features(spark, table, store).collect()}
    assert tables.scan_table(spark, table, MARKET_DATA).count() == 220
    rows = tables.scan_table(spark, store, FEATURE_STORE)
    assert {r.ticker: r["count"] for r in rows.groupBy("ticker").count().collect()} == {"A": 95, "B": 65}
    assert set(latest) == {"feature_store:A:latest", "feature_store:B:latest"}
    assert latest["feature_store:A:latest"]["regime"] == 0


def test_nothing_is_loaded_without_valid_rows(spark):
    table = fresh_path(spark, "t-bars")
    with pytest.raises(ValueError):
        jobs.clean_and_load(spark, landed(spark, walk("A", 5).assign(close=-1.0)), table)
    assert landing.read_if_exists(spark, table, MARKET_DATA) is None


def test_header_problems_raise(spark):
    path = fresh_path(spark, "t-job")
    raw = bars_frame(spark, walk("A", 5)).withColumnRenamed("date", "Date").drop("volume")
    landing.land(raw, path)
    with pytest.raises(Exception, match="volume"):
        jobs.clean_and_load(spark, path, fresh_path(spark, "t-bars"))


def land_rows(spark, rows, kind="date date"):
    """Rows (ticker, date, open, close) landed in the order given."""
    schema = f"ticker string, {kind}, open double, close double"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    raw = df.selectExpr("ticker", "date as Date", "open as Open", "close as High", "close as Low", "close as Close", "1.0 as Volume")
    path = fresh_path(spark, "t-job")
    landing.land(raw, path)
    return path


def loaded(spark, path):
    table = fresh_path(spark, "t-bars")
    jobs.clean_and_load(spark, path, table)
    return sorted((str(r.date), r.open, r.close) for r in tables.scan_table(spark, table, MARKET_DATA).collect())


D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def test_a_missing_date_fails_the_load(spark):
    path = land_rows(spark, [("A", D1, 1.0, 1.0), ("A", None, 2.0, 2.0), ("A", D2, 3.0, 3.0)])
    with pytest.raises(ValueError, match="date contains no nulls"):
        loaded(spark, path)


def test_text_that_is_no_date_fails_the_load(spark):
    path = land_rows(spark, [("A", "2024-01-01", 1.0, 1.0), ("A", "soon", 2.0, 2.0)], "date string")
    with pytest.raises(ValueError, match="date contains no nulls"):
        loaded(spark, path)


def test_an_invalid_copy_does_not_cost_the_date(spark):
    rows = [("A", D1, 10.0, -1.0), ("A", D1, 9.0, 9.2), ("A", D2, 8.0, float("nan")), ("A", D2, 7.0, 7.1)]
    want = [("2024-01-01", 9.0, 9.2), ("2024-01-02", 7.0, 7.1)]
    assert loaded(spark, land_rows(spark, rows)) == want
    assert loaded(spark, land_rows(spark, rows[::-1])) == want


def test_the_last_delivery_of_a_date_counts(spark):
    rows = [("A", D1, 10.0, 10.0), ("A", D1, 5.0, 5.0), ("A", D1, 7.0, 7.0)]
    assert loaded(spark, land_rows(spark, rows)) == [("2024-01-01", 7.0, 7.0)]


def test_rows_without_a_place_fail_instead_of_vanishing(spark):
    rows = spark.createDataFrame([("A", D1, 1.0), ("A", None, 2.0)], "ticker string, date date, close double")
    for operator in (lambda: series.forward_fill(rows, ["close"]), lambda: series.with_positions(rows)):
        with pytest.raises(Exception, match="no date"):
            operator().collect()


def test_only_changed_months_are_rewritten(spark):
    table = fresh_path(spark, "t-bars")
    bars = bars_frame(spark, walk("A", 90), walk("B", 90))
    tables.write_table(bars, table)
    before = {p.name: p.stat().st_mtime_ns for p in (Path(table) / "data").rglob("*.parquet")}
    tables.upsert_table(bars, table, MARKET_DATA)
    assert {p.name: p.stat().st_mtime_ns for p in (Path(table) / "data").rglob("*.parquet")} == before
    changed = bars.withColumn("close", F.when((F.col("date") == "2000-02-03") & (F.col("ticker") == "B"), 1.0).otherwise(F.col("close")))
    tables.upsert_table(changed, table, MARKET_DATA)
    after = {p.name: p.parent.name for p in (Path(table) / "data").rglob("*.parquet")}
    assert {after[n] for n in after if n not in before} == {"month=2000-02"}
    assert tables.scan_table(spark, table, MARKET_DATA).count() == 180


def test_reading_the_newest_landing_prunes_days(spark):
    path = fresh_path(spark, "t-job")
    for day in (1, 2, 3):
        landing.land(bars_frame(spark, walk("A", 3 + day)), path, ingest_date=dt.date(2024, 1, day))
    newest = landing.read_newest(spark, path)
    assert newest.count() == 6 and newest.select("ingest_date").distinct().count() == 1
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan or "PartitionFilters: [(ingest_date" in plan or "PartitionFilters: [ingest_date" in plan
