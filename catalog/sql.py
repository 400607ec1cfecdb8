"""SQL shared by the comparisons, written for DuckDB."""

from catalog.tables import BARS_SQL, DIRTY_BARS_SQL, LONG_BARS_SQL, NEXT_BARS_SQL

BY_DAY = "partition by ticker order by date"


def with_(*ctes: tuple[str, str], final: str) -> str:
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in ctes) + "\n" + final


BARS = ("bars", BARS_SQL)
LONG_BARS = ("bars", LONG_BARS_SQL)
DIRTY = ("dirty", DIRTY_BARS_SQL)
NEXT = ("arriving", NEXT_BARS_SQL)

KEPT = ("kept", """
    select * from dirty where close > 0 and (open is null or open > 0)
      and (high is null or high > 0) and (low is null or low > 0)
      and (volume is null or volume >= 0)""")


def fill(column: str) -> str:
    return (f"last_value({column} ignore nulls) over ({BY_DAY} "
            f"rows between unbounded preceding and current row)")


CLEAN = ("clean", f"""
    select ticker, date, {fill('open')} as open, {fill('high')} as high, {fill('low')} as low,
           close, coalesce(volume, 0.0e0) as volume
    from kept""")


def ema(column: str, alpha: str) -> str:
    return (f"list_reduce(list({column}) over ({BY_DAY} rows between 600 preceding and current row),"
            f" lambda acc, x: acc * (1 - {alpha}) + x * {alpha})")


MOVES = ("moves", f"""
    select ticker, date, close, row_number() over ({BY_DAY}) - 1 as rn,
           close / lag(close) over ({BY_DAY}) - 1 as return_1d,
           close / lag(close, 5) over ({BY_DAY}) - 1 as return_5d,
           coalesce(close - lag(close) over ({BY_DAY}), 0) as step
    from bars""")

INDICATORS = ("indicators", f"""
    select ticker, date, close, rn, return_1d, return_5d,
           case when rn >= 13 then case when mean_down = 0 then 100
                else 100 - 100 / (1 + mean_up / mean_down) end end as rsi_14,
           case when rn >= 25 then fast - slow end as macd,
           volatility_20d
    from (select *,
                 {ema('greatest(step, 0)', '(1e0/14)')} as mean_up,
                 {ema('greatest(-step, 0)', '(1e0/14)')} as mean_down,
                 {ema('close', '(2e0/13)')} as fast,
                 {ema('close', '(2e0/27)')} as slow,
                 case when count(return_1d) over
                        ({BY_DAY} rows between 19 preceding and current row) = 20
                      then stddev_samp(return_1d) over
                        ({BY_DAY} rows between 19 preceding and current row) end
                   as volatility_20d
          from moves)""")

FEATURES = ("features", """
    select ticker, date, return_1d, return_5d, rsi_14, macd, volatility_20d from indicators
    where return_1d is not null and return_5d is not null and rsi_14 is not null
      and macd is not null and volatility_20d is not null""")

DATASET = ("dataset", f"""
    select *, row_number() over ({BY_DAY}) - 1 as rn, count(*) over (partition by ticker) as n
    from (select f.*, b.close,
                 lead(b.close, 5) over (partition by f.ticker order by f.date) / b.close - 1
                   as target_5d
          from features f join bars b on f.ticker = b.ticker and f.date = b.date)
    where target_5d is not null""")

TO_DATASET = (BARS, MOVES, INDICATORS, FEATURES, DATASET)

# Three purged folds: test rows carry test_fold, training rows of fold f have rn < size * f.
def purged(source: str) -> tuple[str, str]:
    return ("purged", f"""
    select *, n // 8 as size,
           case when rn >= n // 8 + 5 and (rn - 5) // (n // 8) <= 3
                then cast((rn - 5) // (n // 8) as integer) end as test_fold
    from {source}""")


PURGED = purged("dataset")

FOLDS = ("folds", """
    select t.ticker, t.n, t.size, cast(f.fold as integer) as fold from
      (select ticker, max(n) as n, max(size) as size from purged group by ticker) t,
      (select unnest([1, 2, 3]) as fold) f
    where t.size * f.fold + 5 < t.n""")

PURGED_TRAINING = ("training", """
    select p.*, f.fold from folds f join purged p
      on p.ticker = f.ticker and p.rn < f.size * f.fold""")

DEVELOPMENT = ("development", """
    select * replace (cast(floor(n * 0.8e0) as bigint) as n) from dataset
    where rn < floor(n * 0.8e0)""")

# Walk-forward folds of 100 test rows after 1000, five rows left out of training.
WALK = ("walk", """
    select *, case when rn >= 1000 and 1000 + 100 * ((rn - 1000) // 100) + 5 < n
                   then cast((rn - 1000) // 100 + 1 as integer) end as test_fold
    from dataset""")

WALK_FOLDS = ("walk_folds", """
    select ticker, n, cast(unnest(range(1, (n - 1006) // 100 + 2)) as integer) as fold
    from (select ticker, max(n) as n from dataset group by ticker) where n >= 1006""")

WALK_TRAINING = ("training", """
    select d.*, f.fold from walk_folds f join dataset d
      on d.ticker = f.ticker and d.rn < 995 + 100 * (f.fold - 1)""")

PREDICTIONS = ("predictions", """
    select t.ticker, t.date, 'Naive' as model, t.target_5d as actual, m.prediction, t.test_fold as fold
    from purged t join (
        select f.ticker, f.fold, avg(p.target_5d) as prediction
        from folds f join purged p on p.ticker = f.ticker and p.rn < f.size * f.fold
        group by 1, 2) m on m.ticker = t.ticker and m.fold = t.test_fold
    union all
    select ticker, date, 'Momentum', target_5d, return_1d, test_fold from purged
    where test_fold is not null""")

TO_PREDICTIONS = (*TO_DATASET, PURGED, FOLDS, PREDICTIONS)

CORRELATION = """case when min(actual) = max(actual) or min(prediction) = max(prediction) then 0
    else covar_pop(actual, prediction) / (stddev_pop(actual) * stddev_pop(prediction)) end"""

SCORES = f"""
    avg((actual - prediction) * (actual - prediction)) as mse,
    sqrt(avg((actual - prediction) * (actual - prediction))) as rmse,
    avg(abs(actual - prediction)) as mae,
    avg(case when sign(actual) = sign(prediction) then 1.0e0 else 0.0e0 end) as direction_accuracy,
    {CORRELATION} as correlation"""

SCORE_NAMES = ["mse", "rmse", "mae", "direction_accuracy", "correlation"]

RESULTS = ("results", f"select ticker, model, {SCORES} from predictions group by ticker, model")


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in columns)


def ridge(
    features: list[str], train: str, keys: str = "ticker, fold", scaled: bool = True
) -> list[tuple[str, str]]:
    """CTEs that solve one ridge regression per key by Gaussian elimination.

    ``train`` is a relation with the keys, the features and ``target_5d``. The last CTE,
    ``ridge``, has ``b0`` (intercept) and ``b1`` to ``bk`` per key.
    """
    k = len(features)
    means = ", ".join(f"avg({f}) as m{i}" for i, f in enumerate(features, 1))
    units = ", ".join(
        (f"case when stddev_pop({f}) = 0 then 1 else stddev_pop({f}) end as s{i}" if scaled
         else f"1.0e0 as s{i}")
        for i, f in enumerate(features, 1)
    )
    moments = f"select {keys}, avg(target_5d) as my, {means}, {units} from {train} group by {keys}"
    z = [f"(({f} - m{i}) / s{i})" for i, f in enumerate(features, 1)]
    cells = []
    for i in range(k):
        for j in range(i, k):
            penalty = " + 1.0e0" if i == j else ""
            cells.append(f"sum({z[i]} * {z[j]}){penalty} as a{i + 1}_{j + 1}")
        cells.append(f"sum({z[i]} * (target_5d - my)) as a{i + 1}_{k + 1}")
    carried = ["my"] + [f"m{i}" for i in range(1, k + 1)] + [f"s{i}" for i in range(1, k + 1)]
    grouped = ", ".join(f"any_value({c}) as {c}" for c in carried)
    ctes = [
        ("ridge_moments", moments),
        ("ridge_0", f"select {keys}, {grouped}, {', '.join(cells)} "
                    f"from {train} join ridge_moments using ({keys}) group by {keys}"),
    ]
    # Eliminate column p from the rows below it; the matrix stays symmetric.
    for p in range(1, k):
        kept = [f"a{i}_{j}" for i in range(1, p + 1) for j in range(i, k + 2)]
        reduced = [
            f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p} as a{i}_{j}"
            for i in range(p + 1, k + 1)
            for j in range(i, k + 2)
        ]
        ctes.append((f"ridge_{p}", f"select {keys}, {', '.join(carried + kept + reduced)} "
                                   f"from ridge_{p - 1}"))
    last = f"ridge_{k - 1}"
    for i in range(k, 0, -1):
        known = "".join(f" - a{i}_{j} * z{j}" for j in range(i + 1, k + 1))
        ctes.append((f"solve_{i}", f"select *, (a{i}_{k + 1}{known}) / a{i}_{i} as z{i} from {last}"))
        last = f"solve_{i}"
    slopes = ", ".join(f"z{i} / s{i} as b{i}" for i in range(1, k + 1))
    intercept = "my" + "".join(f" - z{i} * m{i} / s{i}" for i in range(1, k + 1))
    ctes.append(("ridge", f"select {keys}, {intercept} as b0, {slopes} from {last}"))
    return ctes


def ridge_value(features: list[str]) -> str:
    return "b0" + "".join(f" + b{i} * {f}" for i, f in enumerate(features, 1))
