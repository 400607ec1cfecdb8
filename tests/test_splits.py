import random

import pytest
from pyspark.sql import functions as F

from barloom.plans import splits


def sized(spark, sizes):
    """Positioned rows for one ticker per size."""
    rows = spark.createDataFrame([(f"T{n}", n) for n in sizes], "ticker string, n long")
    return rows.withColumn("rn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "ticker", F.date_add(F.lit("2000-01-01"), F.col("rn").cast("int")).alias("date"), "rn", "n"
    )


def purged_by_loop(n, n_splits, gap, size=None):
    """(train_end, test_start, test_end) per fold, written as the definition reads."""
    size = size or n // (n_splits + 5)
    found = []
    for fold in range(1, n_splits + 1):
        start = size * fold + gap
        if size <= 0 or start >= n:
            break
        found.append((size * fold, start, min(start + size, n)))
    return found


def walk_by_loop(n):
    found, start = [], 1000
    while start + 5 < n:
        end = min(start + 100, n)
        found.append((start - 5, start, end))
        start = end
    return found


def from_bounds(df, scheme):
    found = {}
    for r in splits.fold_bounds(df, scheme).orderBy("ticker", "fold").collect():
        found.setdefault(r.ticker, []).append((r.train_end, r.test_start, r.test_end))
    return found


def from_rows(df, scheme):
    """The same triples from the row-level assignments."""
    roles = splits.assignments(df, scheme).groupBy("ticker", "fold").agg(
        F.count_if(F.col("role") == "train").alias("train"),
        F.max(F.when(F.col("role") == "train", F.col("rn"))).alias("last"),
        F.min(F.when(F.col("role") == "test", F.col("rn"))).alias("lo"),
        F.max(F.when(F.col("role") == "test", F.col("rn"))).alias("hi"),
        F.count_if(F.col("role") == "test").alias("tested"),
    )
    found = {}
    for r in roles.orderBy("ticker", "fold").collect():
        assert r.train == r.last + 1 and r.tested == r.hi - r.lo + 1
        found.setdefault(r.ticker, []).append((r.train, r.lo, r.hi + 1))
    return found


def test_walk_forward_equals_loop_for_every_length(spark):
    sizes = list(range(1, 1330))
    df = spark.createDataFrame([(f"T{n}", n) for n in sizes], "ticker string, n long")
    expected = {f"T{n}": walk_by_loop(n) for n in sizes if walk_by_loop(n)}
    assert from_bounds(df, splits.WalkForward()) == expected


def test_walk_forward_rows(spark):
    sizes = [1, 999, 1000, 1005, 1006, 1100, 1105, 1106, 1234]
    expected = {f"T{n}": walk_by_loop(n) for n in sizes if walk_by_loop(n)}
    assert from_rows(sized(spark, sizes), splits.WalkForward()) == expected
    skipped = splits.skipped_tickers(sized(spark, sizes), splits.WalkForward())
    assert {r.ticker for r in skipped.collect()} == {"T1", "T999", "T1000", "T1005"}


def test_purged_folds_equal_loop(spark):
    draw = random.Random(7)
    for _ in range(6):
        n_splits, gap = draw.randint(1, 20), draw.randint(0, 12)
        size = draw.choice([None, draw.randint(1, 60)])
        sizes = sorted({draw.randint(1, 400) for _ in range(12)})
        expected = {f"T{n}": purged_by_loop(n, n_splits, gap, size) for n in sizes}
        expected = {t: folds for t, folds in expected.items() if folds}
        scheme = splits.PurgedFolds(n_splits, gap, size)
        df = sized(spark, sizes)
        assert from_bounds(df, scheme) == expected
        assert from_rows(df, scheme) == expected


def test_purged_folds_of_the_documented_length(spark):
    df = sized(spark, [2482])
    scheme = splits.PurgedFolds(15, 5)
    check = splits.fold_leak_check(splits.assignments(df, scheme)).collect()
    assert len(check) == 15
    assert all(r.gap == 5 and r.overlap == 0 and r.ordered for r in check)
    walked = from_rows(df, splits.WalkForward())["T2482"]
    assert len(walked) == 15 and sum(hi - lo for _, lo, hi in walked) == 1482


@pytest.mark.parametrize("bad", [dict(n_splits=0), dict(purge_gap=-1), dict(test_size=0)])
def test_purged_arguments(bad):
    with pytest.raises(ValueError):
        splits.PurgedFolds(**bad)


def test_holdout_and_development(spark):
    df = sized(spark, [1, 10, 2482])
    roles = splits.holdout_roles(df).groupBy("ticker", "role").count().collect()
    counts = {(r.ticker, r.role): r["count"] for r in roles}
    assert counts[("T2482", "train")] == 1985 and counts[("T2482", "test")] == 497
    assert counts[("T10", "train")] == 8 and ("T1", "train") not in counts
    development = splits.development_rows(df).where("ticker = 'T2482'")
    assert development.agg(F.max("rn"), F.max("n")).first() == (1984, 1985)
    folds = from_rows(development, splits.PurgedFolds(3, 5))["T2482"]
    assert len(folds) == 3 and sum(hi - lo for _, lo, hi in folds) == 744


def test_three_way_split_uses_the_summed_share(spark):
    roles = splits.three_way_roles(sized(spark, [2482, 2485])).groupBy("ticker", "role").agg(
        F.count("*").alias("rows"), F.min("rn").alias("lo")
    )
    found = {(r.ticker, r.role): (r.rows, r.lo) for r in roles.collect()}
    assert found[("T2482", "train")] == (1737, 0)
    assert found[("T2482", "holdout")][0] == 492
    assert found[("T2485", "holdout")] == (2485 - 1987 - 5, 1992)
    assert found[("T2485", "validation")][1] == int(2485 * 0.7) + 5


def test_fold_report_matches_rows(spark):
    df = sized(spark, [60, 100])
    scheme = splits.PurgedFolds(3, 2)
    report = {(r.ticker, r.fold, r.role): r.row_count for r in splits.fold_report(df, scheme).collect()}
    assert report[("T100", 1, "purge")] == 2 and report[("T100", 3, "train")] == 36
    assert len(report) == 18
    assert splits.fold_report(df, splits.PurgedFolds(3, 0)).where("role = 'purge'").isEmpty()


@pytest.mark.parametrize("scheme", [splits.PurgedFolds(3, 5), splits.WalkForward(40, 10, 3), splits.Holdout()])
def test_leak_check_of_a_scheme_equals_the_one_over_rows(spark, scheme):
    df = sized(spark, [70, 90])
    written = splits.fold_leak_check(splits.assignments(df, scheme))
    assert sorted(map(tuple, splits.scheme_leak_check(df, scheme).collect())) == sorted(map(tuple, written.collect()))
