"""Chronological splits as closed forms over row positions.

A scheme says, for a row at position ``rn`` of ``n``, in which fold it is a test row and from
which fold on it is a training row. Training sets only ever grow, so these two numbers and the
number of folds describe the whole split without listing index sets.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PurgedFolds:
    """``n_splits`` equal test folds after growing training sets, ``purge_gap`` rows between."""

    n_splits: int = 15
    purge_gap: int = 5
    test_size: int | None = None

    def __post_init__(self):
        if self.n_splits < 1:
            raise ValueError("n_splits must be >= 1")
        if self.purge_gap < 0:
            raise ValueError("purge_gap must be >= 0")
        if self.test_size is not None and self.test_size <= 0:
            raise ValueError("test_size must be > 0")

    def _size(self, n: Column) -> Column:
        """Null for a ticker too short for the requested folds."""
        if self.test_size is not None:
            return F.lit(self.test_size)
        size = F.floor(n / (self.n_splits + 5))
        return F.when(size > 0, size)

    def folds(self, n: Column) -> Column:
        fitting = F.floor((n - self.purge_gap - 1) / self._size(n))
        capped = F.greatest(F.lit(0), F.least(F.lit(self.n_splits), fitting))
        return F.when(self._size(n).isNotNull(), capped).otherwise(F.lit(0))

    def first_train_fold(self, rn: Column, n: Column) -> Column:
        return F.floor(rn / self._size(n)) + 1

    def test_fold(self, rn: Column, n: Column) -> Column:
        return F.floor((rn - self.purge_gap) / self._size(n))

    def bounds(self, fold: Column, n: Column) -> tuple[Column, Column, Column]:
        size = self._size(n)
        start = size * fold + self.purge_gap
        return size * fold, start, F.least(start + size, n)


@dataclass(frozen=True)
class WalkForward:
    """Test windows of ``test_rows`` after ``initial`` rows; ``purge`` rows left out of training."""

    initial: int = 1000
    test_rows: int = 100
    purge: int = 5

    def folds(self, n: Column) -> Column:
        return F.greatest(
            F.lit(0), F.floor((n - self.purge - 1 - self.initial) / self.test_rows) + 1
        )

    def first_train_fold(self, rn: Column, n: Column) -> Column:
        return F.greatest(
            F.lit(1), F.floor((rn + self.purge - self.initial) / self.test_rows) + 2
        )

    def test_fold(self, rn: Column, n: Column) -> Column:
        return F.floor((rn - self.initial) / self.test_rows) + 1

    def bounds(self, fold: Column, n: Column) -> tuple[Column, Column, Column]:
        start = self.initial + self.test_rows * (fold - 1)
        return start - self.purge, start, F.least(start + self.test_rows, n)


@dataclass(frozen=True)
class Holdout:
    """One fold: the first ``train_share`` of the rows, then the rest."""

    train_share: float = 0.8

    def _cut(self, n: Column) -> Column:
        return F.floor(n * F.lit(self.train_share))

    def folds(self, n: Column) -> Column:
        return F.when((self._cut(n) > 0) & (self._cut(n) < n), F.lit(1)).otherwise(F.lit(0))

    def first_train_fold(self, rn: Column, n: Column) -> Column:
        return F.when(rn < self._cut(n), F.lit(1)).otherwise(F.lit(2))

    def test_fold(self, rn: Column, n: Column) -> Column:
        return F.when(rn < self._cut(n), F.lit(0)).otherwise(F.lit(1))

    def bounds(self, fold: Column, n: Column) -> tuple[Column, Column, Column]:
        return self._cut(n), self._cut(n), n


Scheme = PurgedFolds | WalkForward | Holdout


def _columns():
    return F.col("rn"), F.col("n")


def rows_under_test(df: DataFrame, scheme: Scheme) -> DataFrame:
    """Test rows with their ``fold``."""
    rn, n = _columns()
    return df.withColumn("fold", scheme.test_fold(rn, n).cast("int")).where(
        F.col("fold").between(F.lit(1), scheme.folds(n))
    )


def train_entries(df: DataFrame, scheme: Scheme) -> DataFrame:
    """Every row once, with the first ``fold`` that trains on it (later folds do too)."""
    rn, n = _columns()
    return df.withColumn("fold", scheme.first_train_fold(rn, n).cast("int")).where(
        F.col("fold") <= scheme.folds(n)
    )


def assignments(df: DataFrame, scheme: Scheme) -> DataFrame:
    """The split written out: ``ticker, date, rn, fold, role``, one row per use of a row."""
    rn, n = _columns()
    train = train_entries(df, scheme).select(
        "ticker",
        "date",
        "rn",
        F.explode(F.sequence(F.col("fold"), scheme.folds(n).cast("int"))).alias("fold"),
        F.lit("train").alias("role"),
    )
    test = rows_under_test(df, scheme).select(
        "ticker", "date", "rn", "fold", F.lit("test").alias("role")
    )
    return train.unionByName(test)


def fold_bounds(df: DataFrame, scheme: Scheme) -> DataFrame:
    """``ticker, n, fold, train_end, test_start, test_end`` (row positions, ends exclusive)."""
    n = F.col("n")
    sizes = df.groupBy("ticker").agg(F.max("n").alias("n"))
    folds = sizes.withColumn("last", scheme.folds(n).cast("int")).where("last > 0")
    folds = folds.withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("last"))))
    train_end, test_start, test_end = scheme.bounds(F.col("fold"), n)
    return folds.select(
        "ticker",
        "n",
        "fold",
        train_end.cast("long").alias("train_end"),
        test_start.cast("long").alias("test_start"),
        test_end.cast("long").alias("test_end"),
    )


def skipped_tickers(df: DataFrame, scheme: Scheme) -> DataFrame:
    """Tickers too short for a single fold."""
    return (
        df.groupBy("ticker")
        .agg(F.max("n").alias("n"))
        .where(scheme.folds(F.col("n")) == 0)
        .select("ticker", F.col("n").alias("row_count"))
    )


def holdout_roles(df: DataFrame, train_share: float = 0.8) -> DataFrame:
    rn, n = _columns()
    return df.withColumn(
        "role", F.when(rn < F.floor(n * F.lit(train_share)), "train").otherwise("test")
    )


def development_rows(df: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Rows before the final holdout, positioned among themselves."""
    rn, n = _columns()
    cut = F.floor(n * F.lit(train_share))
    return df.where(rn < cut).withColumn("n", cut.cast("long"))


def three_way_roles(
    df: DataFrame, train_share: float = 0.70, validation_share: float = 0.10, purge: int = 5
) -> DataFrame:
    """Train, validation and holdout; ``purge`` rows before the latter two have no role."""
    rn, n = _columns()
    train_end = F.floor(n * F.lit(train_share))
    validation_end = F.floor(n * F.lit(train_share + validation_share))
    return df.withColumn(
        "role",
        F.when(rn < train_end, "train")
        .when((rn >= train_end + purge) & (rn < validation_end), "validation")
        .when(rn >= validation_end + purge, "holdout"),
    )


def fold_report(df: DataFrame, scheme: Scheme) -> DataFrame:
    """Dates and rows per ``(ticker, fold, role)``; roles are train, purge and test.

    Looks up the rows at the two ends of each range instead of scanning growing training sets.
    """
    def span(role, lo, hi):
        return F.struct(F.lit(role).alias("role"), lo.alias("lo"), hi.alias("hi"))

    train_end, test_start, test_end = map(F.col, ("train_end", "test_start", "test_end"))
    spans = F.array(
        span("train", F.lit(0).cast("long"), train_end),
        span("purge", train_end, test_start),
        span("test", test_start, test_end),
    )
    ranges = (
        fold_bounds(df, scheme).select("ticker", "fold", F.inline(spans)).where("hi > lo")
    )
    days = df.select("ticker", "rn", "date")
    ends = ranges.select(
        "ticker", "fold", "role", "lo", "hi", F.explode(F.array("lo", F.expr("hi - 1"))).alias("rn")
    )
    return (
        ends.join(days, ["ticker", "rn"])
        .groupBy("ticker", "fold", "role")
        .agg(
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.max(F.col("hi") - F.col("lo")).alias("row_count"),
        )
    )


def fold_leak_check(splits: DataFrame) -> DataFrame:
    """Per ``(ticker, fold)`` of written-out assignments: overlap, order and gap of the roles."""
    uses = splits.groupBy("ticker", "fold", "rn").agg(
        F.max((F.col("role") == "train").cast("int")).alias("train"),
        F.max((F.col("role") == "test").cast("int")).alias("test"),
    )
    per_fold = uses.groupBy("ticker", "fold").agg(
        F.sum("train").alias("train_rows"),
        F.sum("test").alias("test_rows"),
        F.sum(F.col("train") * F.col("test")).alias("overlap"),
        F.max(F.when(F.col("train") == 1, F.col("rn"))).alias("last_train"),
        F.min(F.when(F.col("test") == 1, F.col("rn"))).alias("first_test"),
    )
    return per_fold.select(
        "ticker",
        "fold",
        "train_rows",
        "test_rows",
        "overlap",
        (F.col("first_test") - F.col("last_train") - 1).alias("gap"),
        (F.col("last_train") < F.col("first_test")).alias("ordered"),
    )


def scheme_leak_check(df: DataFrame, scheme: Scheme) -> DataFrame:
    """As :func:`fold_leak_check` for a positioned dataset, without writing the split out.

    What a fold adds to the training rows is aggregated once and accumulated over the folds.
    """
    rn, n = _columns()
    upto = Window.partitionBy("ticker").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    added = train_entries(df, scheme).groupBy("ticker", "fold").agg(
        F.count("*").alias("_added"), F.max("rn").alias("_last")
    )
    trained = added.select(
        "ticker",
        "fold",
        F.sum("_added").over(upto).alias("train_rows"),
        F.max("_last").over(upto).alias("last_train"),
    )
    leaks = scheme.first_train_fold(rn, n) <= F.col("fold")
    tested = rows_under_test(df, scheme).withColumn("_leaks", leaks).groupBy("ticker", "fold").agg(
        F.count("*").alias("test_rows"),
        F.count_if("_leaks").alias("overlap"),
        F.min("rn").alias("first_test"),
    )
    return tested.join(trained, ["ticker", "fold"], "left").select(
        "ticker",
        "fold",
        "train_rows",
        "test_rows",
        "overlap",
        (F.col("first_test") - F.col("last_train") - 1).alias("gap"),
        (F.col("last_train") < F.col("first_test")).alias("ordered"),
    )


def date_ranges(df: DataFrame, keys=("ticker", "role")) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("row_count"),
    )
