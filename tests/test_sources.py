import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.schemas import FEATURE_STORE, MARKET_DATA, RESULTS
from barloom.session import fresh_path, stage
from barloom.sources import landing, outputs, tables
from tests.frames import bars_frame, ordered, walk

DAY_1, DAY_2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def _close(df):
    return {(r.ticker, r.date): r.close for r in df.collect()}


def test_empty_batch_leaves_landing_untouched(spark):
    path = fresh_path(spark, "t-land")
    bars = bars_frame(spark, walk("A", 5), walk("B", 5))
    landing.land(bars, path, ingest_date=DAY_1)
    landing.land(bars.where("close < 0"), path, ingest_date=DAY_1)
    assert spark.read.parquet(path).count() == 10


def test_landing_twice_a_day_replaces_only_the_tickers_sent(spark):
    path = fresh_path(spark, "t-land")
    landing.land(bars_frame(spark, walk("A", 5), walk("B", 5)), path, ingest_date=DAY_1)
    landing.land(bars_frame(spark, walk("B", 3)), path, ingest_date=DAY_1)
    counts = {r.ticker: r["count"] for r in spark.read.parquet(path).groupBy("ticker").count().collect()}
    assert counts == {"A": 5, "B": 3}


def test_newest_landing_per_ticker(spark):
    path = fresh_path(spark, "t-land")
    landing.land(bars_frame(spark, walk("A", 5), walk("B", 5)), path, ingest_date=DAY_1)
    landing.land(bars_frame(spark, walk("B", 7)), path, ingest_date=DAY_2)
    newest = landing.newest_landing(spark.read.parquet(path))
    assert {r.ticker: r["count"] for r in newest.groupBy("ticker").count().collect()} == {"A": 5, "B": 7}


def test_summary_lists_failures(spark):
    wanted = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    summary = landing.landing_summary(bars_frame(spark, walk("A", 5)), wanted)
    assert {r.ticker: (r.row_count, r.status) for r in summary.collect()} == {
        "A": (5, "successful"), "Z": (0, "failed"),
    }


def test_macro_csv(spark, tmp_path):
    file = tmp_path / "DFF.csv"
    file.write_text("observation_date,DFF\n2024-01-01,5.33\n2024-01-02,.\n")
    rows = landing.read_macro_csv(spark, str(file), "DFF").orderBy("date").collect()
    assert [(r.series_id, r.date, r.value) for r in rows] == [
        ("DFF", DAY_1, 5.33), ("DFF", DAY_2, None),
    ]


def test_upsert_replaces_adds_and_takes_the_last_duplicate(spark):
    old = bars_frame(spark, walk("A", 3))
    first, last = old.orderBy("date").first().date, dt.date(2030, 1, 1)
    rows = [("A", first, 1.0, 1.0, 1.0, c, None, i) for i, c in enumerate([9.0, 7.0, 8.0])]
    rows.append(("A", last, 1.0, 1.0, 1.0, 2.0, 1.0, 0))
    new = spark.createDataFrame(rows, "ticker string, date date, open double, high double, "
                                      "low double, close double, volume double, seq int")
    merged = tables.upsert(old, new, sequence="seq")
    closes = _close(merged)
    assert closes[("A", first)] == 8.0 and closes[("A", last)] == 2.0 and len(closes) == 4
    replaced = merged.where(F.col("date") == F.lit(first)).first()
    assert replaced.volume is None
    again = tables.upsert(merged, new, sequence="seq")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, merged.collect()), key=str)


def test_table_upsert_is_idempotent_and_touches_only_its_months(spark):
    path = fresh_path(spark, "t-table")
    tables.upsert_table(bars_frame(spark, walk("A", 100), walk("B", 100)), path, MARKET_DATA)
    stored = lambda: {f for f in tables.scan_table(spark, path, MARKET_DATA).inputFiles() if "2000-01" in f}
    before = stored()
    new = bars_frame(spark, walk("A", 100).assign(close=5.0)).where("date >= '2000-03-15'")
    for _ in range(2):
        tables.upsert_table(new, path, MARKET_DATA)
        table = tables.scan_table(spark, path, MARKET_DATA)
        assert table.count() == 200
        assert table.where("close = 5.0").count() == new.count()
    assert stored() == before
    tables.upsert_table(new.where("false"), path, MARKET_DATA)
    assert tables.scan_table(spark, path, MARKET_DATA).count() == 200


def closes(spark, path):
    return {(r.ticker, r.date): r.close for r in tables.scan_table(spark, path, MARKET_DATA).collect()}


def test_a_delivery_lost_midway_leaves_the_table_as_it_was(spark, monkeypatch):
    path = fresh_path(spark, "t-lost")
    tables.upsert_table(bars_frame(spark, walk("A", 100), walk("B", 100)), path, MARKET_DATA)
    before = closes(spark, path)
    new = bars_frame(spark, walk("A", 100).assign(close=5.0), walk("C", 100))
    # the job fails in its last month, when the files of others are written
    broken = F.when(F.col("month") == "2000-04", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close"))
    commit = tables._commit
    monkeypatch.setattr(tables, "_commit", lambda df, *a, **k: commit(df.withColumn("close", broken), *a, **k))
    with pytest.raises(Exception, match="lost"):
        tables.upsert_table(new, path, MARKET_DATA)
    assert closes(spark, path) == before
    monkeypatch.undo()
    # all files are written, but the pointer is not
    monkeypatch.setattr(tables, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        tables.upsert_table(new, path, MARKET_DATA)
    assert closes(spark, path) == before
    monkeypatch.undo()
    # a manifest without its end marker is none
    (Path(path) / "manifest" / "00000002").mkdir()
    assert closes(spark, path) == before and tables.current(spark, path)[0] == 1
    tables.upsert_table(new, path, MARKET_DATA)
    after = closes(spark, path)
    assert tables.current(spark, path)[0] == 3 and len(after) == 300
    assert all(after["A", d] == 5.0 for t, d in after if t == "A") and all(after["B", d] == before["B", d] for t, d in before if t == "B")


def test_a_commit_on_an_outdated_read_fails(spark):
    path = fresh_path(spark, "t-race")
    tables.write_table(bars_frame(spark, walk("A", 40)), path)
    read = tables.current(spark, path)
    tables.upsert_table(bars_frame(spark, walk("B", 40)), path, MARKET_DATA)
    late = tables._with_month(bars_frame(spark, walk("C", 40)))
    with pytest.raises(tables.ConcurrentCommit):
        tables._commit(late, path, read)
    assert {t for t, _ in closes(spark, path)} == {"A", "B"}


def test_old_versions_are_dropped_and_the_latest_stays_whole(spark):
    path = fresh_path(spark, "t-old")
    tables.write_table(bars_frame(spark, walk("A", 70)), path)
    for close in (1.0, 2.0, 3.0):
        tables.upsert_table(bars_frame(spark, walk("A", 70).assign(close=close)).where("date >= '2000-03-01'"), path, MARKET_DATA)
    before = closes(spark, path)
    assert len(list((Path(path) / "data").iterdir())) == 4
    tables.drop_old_versions(spark, path, keep=1)
    assert closes(spark, path) == before and tables.current(spark, path)[0] == 4
    assert len(list((Path(path) / "data").iterdir())) == 2 and len(list((Path(path) / "manifest").iterdir())) == 1
    tables.write_table(bars_frame(spark, walk("A", 70)).where("false"), path)
    assert closes(spark, path) == {}


def test_scan_pushes_the_ticker_filter_and_prunes_columns(spark):
    path = fresh_path(spark, "t-scan")
    tables.write_table(bars_frame(spark, walk("A", 10), walk("B", 10)), path)
    scan = tables.scan_table(spark, path, MARKET_DATA, ["A"], ["date", "close"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(ticker, [A])" in plan or "EqualTo(ticker,A)" in plan
    assert "ReadSchema: struct<ticker:string,date:date,close:double>" in plan
    assert scan.count() == 10


def test_latest_payload(spark):
    row = ("A", DAY_1, 0.1, 0.2, 50.0, 1.5, 0.02, 1)
    older = ("A", dt.date(2023, 1, 1), 0.3, 0.2, 50.0, 1.5, 0.02, 0)
    pair = outputs.latest_features_kv(spark.createDataFrame([older, row], FEATURE_STORE)).first()
    assert pair.key == "feature_store:A:latest"
    assert json.loads(pair.value) == {
        "ticker": "A", "date": "2024-01-01", "return_1d": 0.1, "return_5d": 0.2, "rsi_14": 50.0,
        "macd": 1.5, "volatility_20d": 0.02, "regime": 1,
    }


def test_runs_append(spark):
    path = fresh_path(spark, "t-runs")
    results = spark.createDataFrame([("A", "Ridge", 0.1, 0.2, 0.3, 0.4, 0.5)], RESULTS)
    runs = outputs.run_records(results, "exp", F.lit("A_Ridge"), {"alpha": 1.0})
    outputs.append_runs(runs, path)
    outputs.append_runs(runs, path)
    logged = outputs.read_runs(spark, path).collect()
    assert len(logged) == 2
    assert logged[0].params == {"alpha": "1.0", "ticker": "A", "model": "Ridge"}
    assert logged[0].metrics["rmse"] == 0.2


def test_csv_is_globally_sorted(spark):
    path = fresh_path(spark, "t-csv")
    outputs.write_csv(bars_frame(spark, walk("B", 30), walk("A", 30)), path, ["ticker", "date"])
    lines = []
    import glob

    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        lines += open(part).read().splitlines()[1:]
    keys = [tuple(line.split(",")[:2]) for line in lines]
    assert keys == sorted(keys) and len(keys) == 60
    assert ordered(outputs.read_csv(spark, path, MARKET_DATA)).shape == (60, 7)


def test_cluster_session_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from barloom import session

    remote = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: None),
        sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.staging_root(remote)


def test_latest_rows_are_found_without_sorting_all_rows(spark):
    rows = [("A", DAY_1, 0.1, 0.2, 50.0, 1.0, 0.01, 1), ("A", DAY_2, None, 0.3, 51.0, 2.0, 0.02, 0), ("B", DAY_1, 0.4, 0.5, 52.0, 3.0, 0.03, 1)]
    latest = outputs.latest_features(spark.createDataFrame(rows, FEATURE_STORE))
    assert sorted(map(tuple, latest.collect())) == [rows[1], rows[2]]
    assert "SortAggregate" not in latest._jdf.queryExecution().executedPlan().toString()


def test_first_landing_of_a_day_is_written_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(landing, "stage", lambda df, name: (staged.append(name), stage(df, name))[1])
    path = fresh_path(spark, "t-land")
    assert landing.land(bars_frame(spark, walk("A", 5)).where("close < 0"), path, ingest_date=DAY_1).count() == 0
    assert landing.read_if_exists(spark, path, MARKET_DATA) is None
    for day in (DAY_1, DAY_2):
        counts = landing.land(bars_frame(spark, walk("A", 5), walk("B", 4)), path, ingest_date=day)
        assert {r.ticker: r.row_count for r in counts.collect()} == {"A": 5, "B": 4}
    assert set(staged) == {"landing-counts"}
    landing.land(bars_frame(spark, walk("B", 3)), path, ingest_date=DAY_2)
    assert "landing-merged" in staged


def test_newest_rows_meet_their_keys_only_where_a_landing_was_replaced(spark):
    path = fresh_path(spark, "t-land")
    first = bars_frame(spark, walk("A", 5), walk("B", 4))
    nameless = first.where("ticker = 'A'").withColumn("ticker", F.lit(None).cast("string"))
    landing.land(first.unionByName(nameless), path, ingest_date=DAY_1)
    rows = lambda: {r.ticker: r["count"] for r in landing.read_newest(spark, path).groupBy("ticker").count().collect()}
    plan = landing.read_newest(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert rows() == {"A": 5, "B": 4} and "Join" not in plan
    landing.land(bars_frame(spark, walk("B", 7)), path, ingest_date=DAY_2)
    assert rows() == {"A": 5, "B": 7}
    # rows whose landing never reached the manifest do not count
    late = spark.read.parquet(path).where("ticker = 'B' and ingest_date = '2024-01-02'")
    late.withColumns({"ticker": F.lit("C"), "landed_at": F.current_timestamp()}).drop("ingest_date").write.parquet(f"{path}/ingest_date=2024-01-03")
    late.withColumns({"ticker": F.lit("C"), "landed_at": F.current_timestamp()}).drop("ingest_date").write.mode("append").parquet(f"{path}/ingest_date=2024-01-02")
    assert rows() == {"A": 5, "B": 7}


def test_a_staged_delivery_is_neither_grouped_nor_written_again(spark, monkeypatch):
    path, staged = fresh_path(spark, "t-table"), []
    rows = stage(bars_frame(spark, walk("A", 40), walk("B", 30)), "t-rows")
    monkeypatch.setattr(tables, "stage", lambda df, name: (staged.append(name), stage(df, name))[1])
    tables.upsert_table(rows, path, MARKET_DATA, staged=True)
    assert not staged and _close(tables.scan_table(spark, path, MARKET_DATA)) == _close(rows)
