"""Bar tables over the test tables: every ticker of one source row is a bar series.

``bars`` has a series per supplier, which grows with the data, and one per return flag, each
holding a third of all source rows. ``long_bars`` has the latter only: about 2,500 days each,
enough for walk-forward folds.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schemas import BAR_COLUMNS

FLAG_TICKER = "l_returnflag"
SUPPLIER_TICKER = "concat('S', l_suppkey)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars_by(lines: DataFrame, ticker: Column) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    early = F.col("l_linenumber") <= 3
    return (
        lines.groupBy(ticker.alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.sum(F.when(early, cents)).cast("double").alias("_open_cents"),
            F.count_if(early).cast("double").alias("_open_rows"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            (F.sum(cents).cast("double") / F.count("*") / 100.0).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
        .withColumn("open", F.try_divide("_open_cents", "_open_rows") / 100.0)
        .select(*BAR_COLUMNS)
    )


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars_by(read_table(spark, sf_dir, "lineitem"), F.expr(FLAG_TICKER))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_supplier = _bars_by(read_table(spark, sf_dir, "lineitem"), F.expr(SUPPLIER_TICKER))
    return long_bars(spark, sf_dir).unionByName(by_supplier)


def _bars_sql(ticker: str) -> str:
    return f"""
        select {ticker} as ticker, cast(l_shipdate as date) as date,
               cast(sum(case when l_linenumber <= 3
                    then cast(round(l_extendedprice * 100) as bigint) end) as double)
                 / cast(nullif(count(case when l_linenumber <= 3 then 1 end), 0) as double)
                 / 100.0e0 as open,
               max(l_extendedprice) as high, min(l_extendedprice) as low,
               cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double)
                 / count(*) / 100.0e0 as close,
               sum(l_quantity) as volume
        from lineitem group by 1, 2"""


LONG_BARS_SQL = _bars_sql(FLAG_TICKER)
BARS_SQL = f"{LONG_BARS_SQL} union all {_bars_sql(SUPPLIER_TICKER)}"


def day_number(column: str = "date") -> Column:
    return F.unix_date(column)


DAY_NUMBER_SQL = "date_diff('day', date '1970-01-01', date)"


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with missing, zero and negative values on some days."""
    day = day_number()
    every = lambda k: day % k == 0
    return bars(spark, sf_dir).select(
        "ticker",
        "date",
        F.when(every(37), F.lit(0.0)).otherwise(F.col("open")).alias("open"),
        "high",
        F.when(~every(29), F.col("low")).alias("low"),
        F.when(every(53), -F.col("close")).when(~every(41), F.col("close")).alias("close"),
        F.when(every(59), F.lit(-1.0)).when(~every(23), F.col("volume")).alias("volume"),
    )


DIRTY_BARS_SQL = f"""
    select ticker, date,
           case when {DAY_NUMBER_SQL} % 37 = 0 then 0.0e0 else open end as open,
           high,
           case when {DAY_NUMBER_SQL} % 29 <> 0 then low end as low,
           case when {DAY_NUMBER_SQL} % 53 = 0 then -close
                when {DAY_NUMBER_SQL} % 41 <> 0 then close end as close,
           case when {DAY_NUMBER_SQL} % 59 = 0 then -1.0e0
                when {DAY_NUMBER_SQL} % 23 <> 0 then volume end as volume
    from bars"""


def raw_bars(bar_rows: DataFrame) -> DataFrame:
    """Bars as a download names them: capitalised headers, an adjusted close, timestamps."""
    return bar_rows.select(
        "ticker",
        F.col("date").cast("timestamp_ntz").alias("Date"),
        F.col("open").alias("Open"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.col("close").alias("Close"),
        (F.col("close") * 0.98).alias("Adj Close"),
        F.col("volume").alias("Volume"),
    )


def next_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later delivery: every tenth day restated, each restatement sent twice, and new days."""
    rows = bars(spark, sf_dir)
    restated = rows.where(day_number() % 10 == 0)
    appended = rows.where(F.col("date") == F.lit("1996-01-01").cast("date")).withColumn(
        "date", F.lit("2030-01-01").cast("date")
    )
    return (
        restated.withColumn("close", F.col("close") * 1.01).withColumn("delivery", F.lit(2))
        .unionByName(restated.withColumn("close", F.lit(1.0)).withColumn("delivery", F.lit(1)))
        .unionByName(appended.withColumn("delivery", F.lit(1)))
    )


NEXT_BARS_SQL = f"""
    select ticker, date, open, high, low, close * 1.01e0 as close, volume from bars
    where {DAY_NUMBER_SQL} % 10 = 0
    union all
    select ticker, date '2030-01-01', open, high, low, close, volume from bars
    where date = date '1996-01-01'"""
