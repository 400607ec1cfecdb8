"""Landing, cleaning, validation, upserts and indicators."""

from pyspark.sql import functions as F

from barloom.operators import cleaning, columns, indicators, regime, series, stationarity, validation
from barloom.operators.joins import join_features_prices
from barloom.plans import jobs, scoring
from barloom.plans.dataset import modeling_dataset
from barloom.plans.features import NUMERIC_FEATURES, features, numeric_features
from barloom.schemas import BAR_COLUMNS, FEATURE_STORE, MACRO, MARKET_DATA, PRICE_COLUMNS
from barloom.session import fresh_path
from barloom.sources import landing, outputs
from barloom.sources import tables as store
from catalog import sql, stages, tables
from catalog.registry import query, rounded

BAR_LIST = ", ".join(BAR_COLUMNS)

# ---- sources and sinks -------------------------------------------------------------------


@query("land_bars_summary", sql.with_(sql.BARS, final="""
    select w.ticker, count(b.ticker) as row_count,
           case when count(b.ticker) > 0 then 'successful' else 'failed' end as status
    from (select distinct concat('S', s_suppkey) as ticker from supplier
          union select distinct l_returnflag from lineitem
          union select 'MISSING') w
    left join bars b on b.ticker = w.ticker group by w.ticker"""))
def land_bars_summary(spark, sf_dir):
    suppliers = tables.read_table(spark, sf_dir, "supplier")
    flags = tables.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("ticker")
    )
    wanted = (
        suppliers.select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
        .unionByName(flags.distinct())
        .unionByName(spark.range(1).select(F.lit("MISSING").alias("ticker")))
    )
    path = fresh_path(spark, "raw-bars")
    landing.land(tables.bars(spark, sf_dir), path, ingest_date=_day(1))
    return landing.landing_summary(landing.read_newest(spark, path), wanted)


@query("raw_bars_latest", sql.with_(sql.BARS, final=f"""
    select ticker, date, open, high, low,
           case when ticker = 'A' then close else close * 1.01e0 end as close, volume
    from bars"""))
def raw_bars_latest(spark, sf_dir):
    """Land all bars, a day later land corrected bars of every ticker but one, read the newest."""
    path = fresh_path(spark, "raw-bars")
    bars = tables.bars(spark, sf_dir)
    landing.land(bars, path, ingest_date=_day(1))
    corrected = bars.where(F.col("ticker") != "A").withColumn("close", F.col("close") * 1.01)
    landing.land(corrected, path, ingest_date=_day(2))
    return landing.read_newest(spark, path).select(*BAR_COLUMNS)


@query("attach_ticker", sql.with_(sql.LONG_BARS, final="select * from bars where ticker = 'A'"))
def attach_ticker(spark, sf_dir):
    """A file of one ticker, whose name is not in it."""
    path = fresh_path(spark, "one-ticker")
    own = tables.long_bars(spark, sf_dir).where("ticker = 'A'")
    tables.raw_bars(own).drop("ticker").write.parquet(path)
    return landing.read_ticker_file(spark, path, "A")


def _day(n):
    import datetime as dt

    return dt.date(2024, 1, n)


MACRO_SQL = """
    select 'ORD' as series_id, cast(date_trunc('month', o_orderdate) as date) as date,
           cast(sum(cast(round(o_totalprice * 100) as bigint)) // count(*) as double) as value
    from orders group by 1, 2"""


def _macro_csv(spark, sf_dir):
    """A downloaded series with a header, and one month without a value."""
    path = fresh_path(spark, "macro-csv")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    monthly = (
        tables.read_table(spark, sf_dir, "orders")
        .groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("observation_date"))
        .agg(F.floor(F.sum(cents) / F.count("*")).cast("string").alias("ORD"))
    )
    gap = F.col("observation_date") == F.lit("1996-02-01").cast("date")
    monthly.withColumn("ORD", F.when(gap, ".").otherwise(F.col("ORD"))).write.csv(path, header=True)
    return path


@query("macro_series", f"""
    select series_id, date, case when date <> date '1996-02-01' then value end as value
    from ({MACRO_SQL})""")
def macro_series(spark, sf_dir):
    return landing.read_macro_csv(spark, _macro_csv(spark, sf_dir), "ORD")


@query("land_macro", f"""
    select series_id, date, case when date <> date '1996-02-01' then value end as value
    from ({MACRO_SQL})""")
def land_macro(spark, sf_dir):
    path = fresh_path(spark, "raw-macro")
    landing.land_macro(macro_series(spark, sf_dir), path, ingest_date=_day(1))
    return landing.read_newest(spark, path, "series_id").select(*MACRO.fieldNames())


@query("scan_ticker", sql.with_(
    sql.BARS, final="select date, close, volume from bars where ticker in ('A', 'S7')"))
def scan_ticker(spark, sf_dir):
    path = fresh_path(spark, "market-data")
    store.write_table(tables.bars(spark, sf_dir), path)
    return store.scan_table(spark, path, MARKET_DATA, ["A", "S7"], ["date", "close", "volume"])


@query("upsert_market_data", sql.with_(sql.BARS, sql.NEXT, final=f"""
    select {BAR_LIST} from arriving union all
    select {BAR_LIST} from bars anti join arriving using (ticker, date)"""))
def upsert_market_data(spark, sf_dir):
    path = fresh_path(spark, "market-data")
    store.write_table(tables.bars(spark, sf_dir), path)
    store.upsert_table(tables.next_bars(spark, sf_dir), path, MARKET_DATA, sequence="delivery")
    return store.scan_table(spark, path, MARKET_DATA)


UPSERTED = ", ".join(
    f"round(case when {tables.DAY_NUMBER_SQL} % 7 = 0 then -{c} else {c} end, 4) + 0.0 as {c}"
    for c in NUMERIC_FEATURES
)


@query("upsert_features", sql.with_(
    sql.BARS, sql.MOVES, sql.INDICATORS, sql.FEATURES,
    final=f"""select ticker, date, {UPSERTED}, cast({tables.DAY_NUMBER_SQL} % 7 = 0 as integer) as flipped
    from features"""))
def upsert_features(spark, sf_dir):
    """All six columns through the feature table; every seventh day is delivered again, changed."""
    path = fresh_path(spark, "feature-store")
    old = stages.full_features(spark, sf_dir)
    store.upsert_table(old, path, FEATURE_STORE)
    again = tables.day_number() % 7 == 0
    changed = {c: -F.col(c) for c in NUMERIC_FEATURES} | {"regime": 10 + F.col("regime")}
    store.upsert_table(old.where(again).withColumns(changed), path, FEATURE_STORE)
    rows = rounded(store.scan_table(spark, path, FEATURE_STORE), NUMERIC_FEATURES, 4)
    return rows.withColumn("flipped", (F.col("regime") >= 10).cast("int")).drop("regime")


LATEST_SQL = sql.with_(sql.BARS, sql.MOVES, sql.INDICATORS, sql.FEATURES, final=f"""
    select ticker, date, {sql.rounded(NUMERIC_FEATURES, 4)} from features
    qualify row_number() over (partition by ticker order by date desc) = 1""")


@query("latest_features", LATEST_SQL)
def latest_features(spark, sf_dir):
    """Without the regime, which has no SQL; the payload holds it."""
    rows = outputs.latest_features(stages.full_features(spark, sf_dir))
    return rounded(rows.drop("regime"), NUMERIC_FEATURES, 4)


@query("latest_features_kv", sql.with_(sql.BARS, sql.MOVES, sql.INDICATORS, sql.FEATURES, final=f"""
    select concat('feature_store:', ticker, ':latest') as key, ticker, date,
           {sql.rounded(NUMERIC_FEATURES, 4)}, true as has_regime from features
    qualify row_number() over (partition by ticker order by date desc) = 1"""))
def latest_features_kv(spark, sf_dir):
    pairs = outputs.latest_features_kv(stages.full_features(spark, sf_dir))
    parsed = pairs.select("key", F.from_json("value", FEATURE_STORE).alias("v"))
    rows = parsed.select("key", "v.*").withColumn("has_regime", F.col("regime").isin(0, 1))
    return rounded(rows.drop("regime"), NUMERIC_FEATURES, 4)


# ---- projections, casts, filters ----------------------------------------------------------


@query("standardize_headers", sql.with_(
    sql.BARS, final='select *, close * 0.98e0 as "Adj Close" from bars'))
def standardize_headers(spark, sf_dir):
    renamed = columns.standardize_headers(tables.raw_bars(tables.bars(spark, sf_dir)))
    return columns.cast_dates(renamed)


@query("cast_dates", "select o_orderkey, cast(o_orderdate as date) as date from orders")
def cast_dates(spark, sf_dir):
    orders = tables.read_table(spark, sf_dir, "orders")
    return columns.cast_dates(orders.select("o_orderkey", F.col("o_orderdate").alias("date")))


@query("format_dates", sql.with_(
    sql.BARS, final="select ticker, strftime(date, '%Y-%m-%d') as date, close from bars"))
def format_dates(spark, sf_dir):
    return columns.format_dates(tables.bars(spark, sf_dir).select("ticker", "date", "close"))


@query("nan_to_null", sql.with_(sql.BARS, final=f"""
    select ticker, date, case when {tables.DAY_NUMBER_SQL} % 3 <> 0 then open end as open,
           high, low, close, volume from bars"""))
def nan_to_null(spark, sf_dir):
    gaps = F.when(tables.day_number() % 3 == 0, F.lit(float("nan"))).otherwise(F.col("open"))
    return columns.nan_to_null(tables.bars(spark, sf_dir).withColumn("open", gaps))


def _dirty_sql(final, *more):
    return sql.with_(sql.BARS, sql.DIRTY, *more, final=final)


@query("filter_close", _dirty_sql("select * from dirty where close > 0"))
def filter_close(spark, sf_dir):
    return cleaning.positive_close(tables.dirty_bars(spark, sf_dir))


@query("filter_ohl", _dirty_sql("""
    select * from dirty where (open is null or open > 0) and (high is null or high > 0)
      and (low is null or low > 0)"""))
def filter_ohl(spark, sf_dir):
    return cleaning.positive_or_missing(tables.dirty_bars(spark, sf_dir))


@query("filter_volume", _dirty_sql("select * from dirty where volume is null or volume >= 0"))
def filter_volume(spark, sf_dir):
    return cleaning.valid_volume(tables.dirty_bars(spark, sf_dir))


@query("fill_volume", _dirty_sql(
    "select ticker, date, coalesce(volume, 0.0e0) as volume from dirty"))
def fill_volume(spark, sf_dir):
    return cleaning.fill_volume(tables.dirty_bars(spark, sf_dir).select("ticker", "date", "volume"))


@query("drop_incomplete", _dirty_sql(
    "select * from dirty where close is not null and low is not null"))
def drop_incomplete(spark, sf_dir):
    return columns.drop_incomplete(tables.dirty_bars(spark, sf_dir), ["close", "low"])


@query("drop_any_null", _dirty_sql("""
    select * from dirty where open is not null and high is not null and low is not null
      and close is not null and volume is not null"""))
def drop_any_null(spark, sf_dir):
    return columns.drop_any_null(tables.dirty_bars(spark, sf_dir))


@query("forward_fill", _dirty_sql(f"""
    select ticker, date, {', '.join(f'{sql.fill(c)} as {c}' for c in PRICE_COLUMNS)}, volume
    from dirty"""))
def forward_fill(spark, sf_dir):
    return series.forward_fill(tables.dirty_bars(spark, sf_dir), PRICE_COLUMNS)


@query("clean_bars", _dirty_sql("select * from clean", sql.KEPT, sql.CLEAN))
def clean_bars(spark, sf_dir):
    return cleaning.clean_bars(tables.dirty_bars(spark, sf_dir))


@query("clean_and_load", _dirty_sql("select * from clean", sql.KEPT, sql.CLEAN))
def clean_and_load(spark, sf_dir):
    """Landing to bar table: newest landing, headers, cleaning, validation, upsert, scan.

    Every fifth day comes first with greater values, which the later copy replaces, and every
    third day comes last as an impossible row with greater values, which must not win.
    """
    landing_path, table_path = fresh_path(spark, "raw-bars"), fresh_path(spark, "market-data")
    bars = tables.dirty_bars(spark, sf_dir)
    day = tables.day_number()
    valid = (F.col("close") > 0) & ((F.col("open") > 0) | F.col("open").isNull()) & (
        (F.col("volume") >= 0) | F.col("volume").isNull()
    )
    own = {c: F.col(c) for c in BAR_COLUMNS}
    early = own | {c: F.col(c) * 2 for c in ("open", "high", "low", "close")}
    late = own | {"open": F.col("high") * 3, "close": -F.col("high")}
    version = lambda values: F.struct(*[value.alias(c) for c, value in values.items()])
    # one pass: the copies of a bar follow each other in this order
    versions = F.array(F.when((day % 5 == 0) & valid, version(early)), version(own), F.when(day % 3 == 0, version(late)))
    batch = bars.select(F.inline(F.array_compact(versions)))
    landing.land(tables.raw_bars(batch), landing_path, ingest_date=_day(1))
    jobs.clean_and_load(spark, landing_path, table_path)
    return store.scan_table(spark, table_path, MARKET_DATA)


# ---- counts, guards, validation -------------------------------------------------------------


@query("ticker_counts", sql.with_(sql.BARS, final="""
    select concat('S', s_suppkey) as ticker, count(b.ticker) as row_count
    from supplier left join bars b on b.ticker = concat('S', s_suppkey) group by 1"""))
def ticker_counts(spark, sf_dir):
    wanted = tables.read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker")
    )
    return cleaning.ticker_counts(tables.bars(spark, sf_dir), wanted)


@query("clean_guards", _dirty_sql("""
    select ticker, count(*) as row_count, min(close) as min_close, min(volume) as min_volume,
           min(close) > 0 and min(volume) >= 0 as passed from clean group by ticker""",
    sql.KEPT, sql.CLEAN))
def clean_guards(spark, sf_dir):
    return cleaning.clean_guards(cleaning.clean_bars(tables.dirty_bars(spark, sf_dir)))


def _expectation_sql():
    checks = [(f"{c} column exists", "0") for c in ("date", "open", "high", "low", "close", "volume")]
    checks += [
        ("date contains no nulls", "count(*) filter (date is null)"),
        ("close contains no nulls", "count(*) filter (close is null)"),
        ("close is greater than zero", "count(*) filter (close <= 0)"),
        ("volume is non-negative", "count(*) filter (volume < 0)"),
    ]
    parts = [
        f"select ticker, '{name}' as expectation, cast({count} as bigint) as failures "
        f"from dirty group by ticker" for name, count in checks
    ]
    return f"select *, failures = 0 as success from ({' union all '.join(parts)})"


@query("validate_bars", _dirty_sql(_expectation_sql()))
def validate_bars(spark, sf_dir):
    return validation.validate_bars(tables.dirty_bars(spark, sf_dir))


# ---- windows ----------------------------------------------------------------------------------


@query("row_positions", sql.with_(sql.BARS, final=f"""
    select ticker, date, row_number() over ({sql.BY_DAY}) - 1 as rn,
           count(*) over (partition by ticker) as n from bars"""))
def row_positions(spark, sf_dir):
    return series.with_positions(tables.bars(spark, sf_dir).select("ticker", "date"))


def _moves_sql(column):
    return sql.with_(sql.BARS, sql.MOVES, final=f"""
        select ticker, date, close, {sql.rounded([column])} from moves""")


def _closes(spark, sf_dir):
    return tables.bars(spark, sf_dir).select("ticker", "date", "close")


@query("return_1d", _moves_sql("return_1d"))
def return_1d(spark, sf_dir):
    return rounded(indicators.simple_return(_closes(spark, sf_dir), 1, "return_1d"), ["return_1d"])


@query("return_5d", _moves_sql("return_5d"))
def return_5d(spark, sf_dir):
    return rounded(indicators.simple_return(_closes(spark, sf_dir), 5, "return_5d"), ["return_5d"])


@query("volatility_20d", sql.with_(sql.BARS, sql.MOVES, sql.INDICATORS, final=f"""
    select ticker, date, close, {sql.rounded(['return_1d', 'volatility_20d'])} from indicators"""))
def volatility_20d(spark, sf_dir):
    rows = indicators.volatility(_closes(spark, sf_dir))
    return rounded(rows, ["return_1d", "volatility_20d"])


@query("ema", sql.with_(sql.BARS, sql.MOVES, final=f"""
    select ticker, date, close,
           round(case when rn >= 11 then {sql.ema('close', '(2e0/13)')} end, 6) + 0.0 as ema
    from moves"""))
def ema(spark, sf_dir):
    return rounded(indicators.exponential_mean(_closes(spark, sf_dir), 12), ["ema"])


@query("rsi_14", sql.with_(sql.BARS, sql.MOVES, sql.INDICATORS, final=f"""
    select ticker, date, close, {sql.rounded(['rsi_14'])} from indicators"""))
def rsi_14(spark, sf_dir):
    return rounded(indicators.rsi(_closes(spark, sf_dir)), ["rsi_14"])


@query("macd", sql.with_(sql.BARS, sql.MOVES, sql.INDICATORS, final=f"""
    select ticker, date, close, {sql.rounded(['macd'], 4)} from indicators"""))
def macd(spark, sf_dir):
    return rounded(indicators.macd(_closes(spark, sf_dir)), ["macd"], 4)


@query("features", sql.with_(sql.BARS, sql.MOVES, sql.INDICATORS, sql.FEATURES, final=f"""
    select ticker, date, {sql.rounded(NUMERIC_FEATURES, 4)} from features"""))
def numeric_feature_rows(spark, sf_dir):
    return rounded(numeric_features(tables.bars(spark, sf_dir)), NUMERIC_FEATURES, 4)


@query("regime_blocks", sql.with_(sql.BARS, sql.MOVES, final="""
    select ticker, i // 20 * 20 as refit, count(*) as labelled_rows,
           min(date) as first_date, max(date) as last_date
    from (select ticker, date, rn - 1 as i from moves) where i >= 500 group by 1, 2"""))
def regime_blocks(spark, sf_dir):
    return regime.regime_blocks(tables.bars(spark, sf_dir))


@query("regime")
def regime_labels(spark, sf_dir):
    return regime.regimes(stages.market_data(spark, sf_dir))


@query("features_with_regime")
def features_with_regime(spark, sf_dir):
    return features(stages.market_data(spark, sf_dir))


@query("target_5d", sql.with_(sql.BARS, final=f"""
    select ticker, date, close,
           round(lead(close, 5) over ({sql.BY_DAY}) / close - 1, 6) + 0.0 as target_5d
    from bars"""))
def target_5d(spark, sf_dir):
    return rounded(indicators.forward_target(_closes(spark, sf_dir)), ["target_5d"])


# ---- joins and the dataset ------------------------------------------------------------------

JOIN_SQL = sql.with_(sql.BARS, sql.MOVES, final="""
    select m.ticker, m.date, round(m.return_1d, 6) + 0.0 as return_1d, b.close, b.volume
    from moves m join bars b on b.ticker = m.ticker and b.date = m.date
    where m.return_1d is not null""")


def _returns_with_prices(spark, sf_dir):
    bars = stages.market_data(spark, sf_dir)
    rows = indicators.simple_return(bars.select("ticker", "date", "close"), 1, "return_1d")
    rows = columns.drop_incomplete(rows, ["return_1d"]).drop("close")
    return rounded(join_features_prices(rows, bars, ["close", "volume"]), ["return_1d"])


@query("join_features_prices", JOIN_SQL)
def features_prices(spark, sf_dir):
    return _returns_with_prices(spark, sf_dir)


@query("merge_on_date", sql.with_(sql.LONG_BARS, final="""
    select a.date, a.close as close_a, r.close as close_r
    from bars a join bars r on a.date = r.date where a.ticker = 'A' and r.ticker = 'R'"""))
def merge_on_date(spark, sf_dir):
    """Two single-ticker frames merged on the date alone."""
    bars = tables.long_bars(spark, sf_dir)
    one = bars.where("ticker = 'A'").select("date", F.col("close").alias("close_a"))
    other = bars.where("ticker = 'R'").select("date", F.col("close").alias("close_r"))
    return one.join(other, "date")


DATASET_COLUMNS = ["rsi_14", "macd", "volatility_20d", "return_1d", "target_5d"]


@query("modeling_dataset", sql.with_(*sql.TO_DATASET, final=f"""
    select ticker, date, close, {sql.rounded(DATASET_COLUMNS, 4)} from dataset"""))
def dataset(spark, sf_dir):
    rows = modeling_dataset(
        stages.feature_rows(spark, sf_dir), stages.market_data(spark, sf_dir), "core4"
    )
    return rounded(rows, DATASET_COLUMNS, 4)


@query("target_describe", sql.with_(*sql.TO_DATASET, final="""
    select ticker, count(target_5d) as count, round(avg(target_5d), 6) as mean,
           round(stddev_samp(target_5d), 6) as std, round(min(target_5d), 6) as min,
           round(quantile_cont(target_5d, 0.25), 6) as p25,
           round(quantile_cont(target_5d, 0.5), 6) as p50,
           round(quantile_cont(target_5d, 0.75), 6) as p75, round(max(target_5d), 6) as max
    from dataset group by ticker"""))
def target_describe(spark, sf_dir):
    summary = scoring.target_describe(stages.core_dataset(spark, sf_dir))
    return rounded(summary, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("tail_rows", sql.with_(*sql.TO_DATASET, final="""
    select ticker, date, close, round(target_5d, 6) + 0.0 as target_5d from dataset
    qualify row_number() over (partition by ticker order by date desc) <= 5"""))
def tail_rows(spark, sf_dir):
    rows = scoring.tail_rows(stages.core_dataset(spark, sf_dir))
    return rounded(rows.select("ticker", "date", "close", "target_5d"), ["target_5d"])


# ---- stationarity -----------------------------------------------------------------------------


@query("adf_test")
def adf_test(spark, sf_dir):
    returns = indicators.simple_return(
        stages.market_data(spark, sf_dir).select("ticker", "date", "close"), 1, "return_1d"
    )
    return stationarity.adf_test(returns, ["close", "return_1d"])


def _adf_lag_sql(lags):
    """The test's regression by partialling out the lagged differences one after the other."""
    by_ticker = "partition by ticker"

    def without(name, by):
        return (f"{name} - regr_slope({name}, {by}) over ({by_ticker}) * {by}"
                f" - regr_intercept({name}, {by}) over ({by_ticker}) as {name}")

    back = ", ".join(f"lag(d, {k}) over ({sql.BY_DAY}) as d{k}" for k in range(1, lags + 1))
    inner = f"""select ticker, d as dx, x, {back} from (
        select ticker, date, close - lag(close) over ({sql.BY_DAY}) as d, lag(close) over ({sql.BY_DAY}) as x from bars)"""
    inner = f"select * from ({inner}) where d{lags} is not null"
    for k in range(1, lags + 1):
        rest = ["dx", "x", *(f"d{j}" for j in range(k + 1, lags + 1))]
        inner = f"select ticker, {', '.join(without(c, f'd{k}') for c in rest)} from ({inner})"
    return sql.with_(sql.BARS, final=f"""
        select ticker, {lags} as used_lags,
               round(sum(x * dx) / sum(x * x) / sqrt((sum(dx * dx) - sum(x * dx) * sum(x * dx) / sum(x * x))
                     / (count(*) - {lags + 2}) / sum(x * x)), 3) as statistic
        from ({inner}) group by ticker having count(*) > 60""")


def _adf_with_lags(spark, sf_dir, lags):
    result = stationarity.adf_test(stages.market_data(spark, sf_dir), "close", lags=lags)
    long = result.where(F.col("observations") - lags - 1 > 60)
    return rounded(long.select("ticker", "used_lags", "statistic"), ["statistic"], 3)


@query("adf_test_lag1", _adf_lag_sql(1))
def adf_test_lag1(spark, sf_dir):
    return _adf_with_lags(spark, sf_dir, 1)


@query("adf_test_lag2", _adf_lag_sql(2))
def adf_test_lag2(spark, sf_dir):
    return _adf_with_lags(spark, sf_dir, 2)


@query("adf_test_lag0", sql.with_(sql.BARS, final=f"""
    select ticker, count(*) + 1 as observations,
           round(regr_slope(dx, x) / sqrt((regr_syy(dx, x) - regr_slope(dx, x) * regr_sxy(dx, x))
                 / (count(*) - 2) / regr_sxx(dx, x)), 4) as statistic
    from (select ticker, lag(close) over ({sql.BY_DAY}) as x,
                 close - lag(close) over ({sql.BY_DAY}) as dx from bars)
    where x is not null group by ticker"""))
def adf_test_lag0(spark, sf_dir):
    result = stationarity.adf_test(stages.market_data(spark, sf_dir), "close", lags=0)
    return rounded(result.select("ticker", "observations", "statistic"), ["statistic"], 4)
