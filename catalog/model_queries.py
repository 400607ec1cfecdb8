"""Splits, forecasts, scores and model comparisons."""

from pyspark.sql import functions as F

from barloom.operators.sequences import sequence_windows
from barloom.plans import evaluate, level_trees, linear, scoring, splits, trees
from barloom.plans.dataset import preset
from barloom.schemas import PREDICTIONS, RESULTS, RUNS
from barloom.session import fresh_path
from barloom.sources import outputs
from catalog import sql, stages
from catalog.registry import query, rounded
from catalog.sql import SCORE_NAMES

CORE4 = preset("core4")

# ---- splits -----------------------------------------------------------------------------------


@query("holdout_split", sql.with_(*sql.TO_DATASET, final="""
    select ticker, date, rn, n,
           case when rn < floor(n * 0.8e0) then 'train' else 'test' end as role from dataset"""))
def holdout_split(spark, sf_dir):
    roles = splits.holdout_roles(stages.core_dataset(spark, sf_dir))
    return roles.select("ticker", "date", "rn", "n", "role")


THREE_WAY = """
    case when rn < floor(n * 0.7e0) then 'train'
         when rn >= floor(n * 0.7e0) + 5 and rn < floor(n * 0.7999999999999999e0) then 'validation'
         when rn >= floor(n * 0.7999999999999999e0) + 5 then 'holdout' end as role"""


@query("three_way_split", sql.with_(
    *sql.TO_DATASET, final=f"select ticker, date, rn, n, {THREE_WAY} from dataset"))
def three_way_split(spark, sf_dir):
    roles = splits.three_way_roles(stages.core_dataset(spark, sf_dir))
    return roles.select("ticker", "date", "rn", "n", "role")


@query("date_ranges", sql.with_(*sql.TO_DATASET, final=f"""
    select ticker, role, min(date) as first_date, max(date) as last_date, count(*) as row_count
    from (select ticker, date, {THREE_WAY} from dataset) group by 1, 2"""))
def date_ranges(spark, sf_dir):
    return splits.date_ranges(splits.three_way_roles(stages.core_dataset(spark, sf_dir)))


@query("purged_folds", sql.with_(*sql.TO_DATASET, sql.PURGED, sql.FOLDS, final="""
    select p.ticker, p.date, p.rn, f.fold,
           case when p.rn < f.size * f.fold then 'train' else 'test' end as role
    from folds f join purged p on p.ticker = f.ticker
     and (p.rn < f.size * f.fold or p.test_fold = f.fold)"""))
def purged_folds(spark, sf_dir):
    return splits.assignments(stages.core_dataset(spark, sf_dir), stages.FOLDS)


@query("walk_forward_folds", sql.with_(*sql.TO_DATASET, sql.WALK, sql.WALK_FOLDS, final="""
    select w.ticker, w.date, w.rn, f.fold,
           case when w.rn < 1000 + 100 * (f.fold - 1) - 5 then 'train' else 'test' end as role
    from walk_folds f join walk w on w.ticker = f.ticker
     and (w.rn < 1000 + 100 * (f.fold - 1) - 5 or w.test_fold = f.fold)"""))
def walk_forward_folds(spark, sf_dir):
    return splits.assignments(stages.core_dataset(spark, sf_dir), splits.WalkForward())


@query("fold_report", sql.with_(*sql.TO_DATASET, sql.WALK, sql.WALK_FOLDS, final="""
    select ticker, fold, role, min(date) as first_date, max(date) as last_date,
           count(*) as row_count
    from (select w.ticker, w.date, f.fold,
                 case when w.rn < 1000 + 100 * (f.fold - 1) - 5 then 'train'
                      when w.rn < 1000 + 100 * (f.fold - 1) then 'purge' else 'test' end as role
          from walk_folds f join walk w on w.ticker = f.ticker
           and w.rn < 1000 + 100 * f.fold)
    group by 1, 2, 3"""))
def fold_report(spark, sf_dir):
    return splits.fold_report(stages.core_dataset(spark, sf_dir), splits.WalkForward())


@query("fold_leak_check", sql.with_(*sql.TO_DATASET, sql.PURGED, sql.FOLDS, final="""
    select f.ticker, f.fold, count(*) filter (p.rn < f.size * f.fold) as train_rows,
           count(*) filter (p.test_fold = f.fold) as test_rows,
           count(*) filter (p.rn < f.size * f.fold and p.test_fold = f.fold) as overlap,
           min(p.rn) filter (p.test_fold = f.fold) - max(p.rn) filter (p.rn < f.size * f.fold) - 1
             as gap,
           min(p.rn) filter (p.test_fold = f.fold) > max(p.rn) filter (p.rn < f.size * f.fold)
             as ordered
    from folds f join purged p on p.ticker = f.ticker group by 1, 2"""))
def fold_leak_check(spark, sf_dir):
    return splits.scheme_leak_check(stages.core_dataset(spark, sf_dir), stages.FOLDS)


@query("skipped_tickers", sql.with_(*sql.TO_DATASET, final="""
    select ticker, max(n) as row_count from dataset group by ticker having max(n) < 1006"""))
def skipped_tickers(spark, sf_dir):
    return splits.skipped_tickers(stages.core_dataset(spark, sf_dir), splits.WalkForward())


# ---- scaling and sequences ----------------------------------------------------------------------


@query("scaled_features", sql.with_(*sql.TO_DATASET, sql.PURGED, sql.FOLDS, final=f"""
    select p.ticker, p.date, p.test_fold as fold,
           {', '.join(f'round((p.{c} - s.m_{c}) / s.s_{c}, 6) + 0.0 as {c}' for c in CORE4)}
    from purged p join (
        select f.ticker, f.fold,
               {', '.join(f'avg(t.{c}) as m_{c}, stddev_pop(t.{c}) as s_{c}' for c in CORE4)}
        from folds f join purged t on t.ticker = f.ticker and t.rn < f.size * f.fold
        group by 1, 2) s on s.ticker = p.ticker and s.fold = p.test_fold"""))
def scaled_features(spark, sf_dir):
    dataset = stages.core_dataset(spark, sf_dir)
    fitted = linear.scalers(dataset, stages.FOLDS, CORE4)
    tested = splits.rows_under_test(dataset, stages.FOLDS).select("ticker", "date", "fold", *CORE4)
    return rounded(linear.apply_scalers(tested, fitted, CORE4), CORE4)


@query("sequence_windows", sql.with_(*sql.TO_DATASET, final=f"""
    select ticker, role, date, 21 as steps, round(cast(cast(target_5d as float) as double), 4) + 0.0 as y,
           round(total, 2) + 0.0 as total
    from (select *, sum({' + '.join(f'cast(cast({c} as float) as double)' for c in CORE4)})
                 over (partition by ticker, role order by date
                       rows between 20 preceding and current row) as total,
                 row_number() over (partition by ticker, role order by date) as place,
                 count(*) over (partition by ticker, role) as size
          from (select *, {THREE_WAY} from dataset) where role is not null)
    where place >= 21 and size > 21"""))
def windows(spark, sf_dir):
    rows = splits.three_way_roles(stages.core_dataset(spark, sf_dir))
    total = F.aggregate(
        F.flatten("x"), F.lit(0.0), lambda acc, value: acc + value.cast("double")
    )
    summed = sequence_windows(rows, CORE4).select(
        "ticker", "role", "date", F.size("x").alias("steps"), F.col("y").cast("double").alias("y"),
        total.alias("total"),
    )
    return rounded(rounded(summed, ["y"], 4), ["total"], 2)


# ---- naive and ridge ------------------------------------------------------------------------------

PREDICTION_COLUMNS = "ticker, date, model, round(actual, 6) + 0.0 as actual, " \
                     "round(prediction, 6) + 0.0 as prediction, fold"


def _rounded_predictions(df):
    return rounded(df, ["actual", "prediction"])


@query("naive_holdout", sql.with_(*sql.TO_DATASET, final=f"""
    select ticker, date, 'Naive' as model, round(target_5d, 6) + 0.0 as actual,
           round(mean, 6) + 0.0 as prediction, 1 as fold
    from (select *, avg(target_5d) filter (rn < floor(n * 0.8e0)) over (partition by ticker) as mean
          from dataset) where rn >= floor(n * 0.8e0)"""))
def naive_holdout(spark, sf_dir):
    dataset = stages.core_dataset(spark, sf_dir)
    return _rounded_predictions(linear.naive_predictions(dataset, splits.Holdout()))


@query("naive_walk_forward", sql.with_(*sql.TO_DATASET, sql.WALK, final=f"""
    select ticker, date, 'Naive' as model, round(target_5d, 6) + 0.0 as actual,
           round((select avg(t.target_5d) from dataset t where t.ticker = walk.ticker
                  and t.rn < 995 + 100 * (walk.test_fold - 1)), 6) + 0.0 as prediction,
           test_fold as fold
    from walk where test_fold is not null"""))
def naive_walk_forward(spark, sf_dir):
    dataset = stages.core_dataset(spark, sf_dir)
    return _rounded_predictions(linear.naive_predictions(dataset, splits.WalkForward()))


RIDGE_HOLDOUT_TRAIN = ("training", """
    select *, 1 as fold from dataset where rn < floor(n * 0.8e0)""")


def _ridge_holdout_sql(scaled):
    return sql.with_(
        *sql.TO_DATASET, RIDGE_HOLDOUT_TRAIN,
        *sql.ridge(CORE4, "training", scaled=scaled),
        final=f"""
        select ticker, date, 'Ridge' as model, round(target_5d, 6) + 0.0 as actual,
               round({sql.ridge_value(CORE4)}, 6) + 0.0 as prediction, 1 as fold
        from dataset join ridge using (ticker) where rn >= floor(n * 0.8e0)""")


@query("ridge_holdout", _ridge_holdout_sql(scaled=True))
def ridge_holdout(spark, sf_dir):
    dataset = stages.core_dataset(spark, sf_dir)
    return _rounded_predictions(linear.ridge_predictions(dataset, splits.Holdout(), CORE4))


@query("ridge_holdout_unscaled", _ridge_holdout_sql(scaled=False))
def ridge_holdout_unscaled(spark, sf_dir):
    dataset = stages.core_dataset(spark, sf_dir)
    return _rounded_predictions(
        linear.ridge_predictions(dataset, splits.Holdout(), CORE4, scaled=False)
    )


@query("ridge_walk_forward", sql.with_(
    *sql.TO_DATASET, sql.WALK, sql.WALK_FOLDS,
    sql.WALK_TRAINING, *sql.ridge(CORE4, "training"),
    final=f"""
    select ticker, date, 'Ridge' as model, round(target_5d, 6) + 0.0 as actual,
           round({sql.ridge_value(CORE4)}, 6) + 0.0 as prediction, fold
    from walk join ridge using (ticker) where fold = test_fold"""))
def ridge_walk_forward(spark, sf_dir):
    dataset = stages.core_dataset(spark, sf_dir)
    return _rounded_predictions(linear.ridge_predictions(dataset, splits.WalkForward(), CORE4))


# ---- scores ---------------------------------------------------------------------------------------


def _scores_sql(keys, names=SCORE_NAMES):
    return sql.with_(*sql.TO_PREDICTIONS, final=f"""
        select {keys}, {sql.rounded(names)}
        from (select {keys}, {sql.SCORES} from predictions group by {keys})""")


def _pooled(spark, sf_dir):
    return scoring.score(stages.predictions(spark, sf_dir))


@query("error_metrics", _scores_sql("ticker, model", ["mse", "rmse", "mae"]))
def error_metrics(spark, sf_dir):
    names = ["mse", "rmse", "mae"]
    return rounded(_pooled(spark, sf_dir).select("ticker", "model", *names), names)


@query("direction_accuracy", _scores_sql("ticker, model", ["direction_accuracy"]))
def direction_accuracy(spark, sf_dir):
    names = ["direction_accuracy"]
    return rounded(_pooled(spark, sf_dir).select("ticker", "model", *names), names)


@query("guarded_correlation", _scores_sql("ticker, model, fold", ["correlation"]))
def guarded_correlation(spark, sf_dir):
    """By fold, where the naive forecast is constant and the correlation is 0."""
    scores = scoring.fold_scores(stages.predictions(spark, sf_dir))
    return rounded(scores.select("ticker", "model", "fold", "correlation"), ["correlation"])


@query("fold_metrics", _scores_sql("ticker, model, fold"))
def fold_metrics(spark, sf_dir):
    return rounded(scoring.fold_scores(stages.predictions(spark, sf_dir)), SCORE_NAMES)


@query("pooled_metrics", _scores_sql("ticker, model"))
def pooled_metrics(spark, sf_dir):
    return rounded(_pooled(spark, sf_dir), SCORE_NAMES)


@query("cv_objective", sql.with_(*sql.TO_PREDICTIONS, final="""
    select ticker, model, round(avg(mse), 6) as mean_mse
    from (select ticker, model, fold, avg((actual - prediction) * (actual - prediction)) as mse
          from predictions group by 1, 2, 3) group by 1, 2"""))
def cv_objective(spark, sf_dir):
    return rounded(scoring.mean_fold_mse(stages.predictions(spark, sf_dir)), ["mean_mse"])


SUMMARY_NAMES = ["rmse", "mae", "direction_accuracy", "correlation"]


@query("model_summary", sql.with_(*sql.TO_PREDICTIONS, sql.RESULTS, final=f"""
    select model, {', '.join(f'round(avg({c}), 6) + 0.0 as {c}' for c in SUMMARY_NAMES)}
    from results group by model order by rmse"""))
def model_summary(spark, sf_dir):
    return rounded(scoring.model_summary(_pooled(spark, sf_dir)), SUMMARY_NAMES)


@query("leaderboard", sql.with_(*sql.TO_PREDICTIONS, sql.RESULTS, final=f"""
    select ticker, model, {sql.rounded(SCORE_NAMES)},
           cast(rank() over (partition by ticker order by rmse) as integer) as rank from results"""))
def leaderboard(spark, sf_dir):
    return rounded(scoring.leaderboard(_pooled(spark, sf_dir)), SCORE_NAMES)


@query("best_model", sql.with_(*sql.TO_PREDICTIONS, sql.RESULTS, final="""
    select ticker, model, round(rmse, 6) as rmse from results
    qualify row_number() over (partition by ticker order by rmse, model) = 1"""))
def best_model(spark, sf_dir):
    return rounded(scoring.best_model(_pooled(spark, sf_dir)), ["rmse"])


@query("leaderboard_display", sql.with_(*sql.TO_PREDICTIONS, sql.RESULTS, final="""
    select ticker, model, printf('%.8f', mse) as mse, printf('%.6f', rmse) as rmse,
           printf('%.6f', mae) as mae,
           concat(printf('%.2f', direction_accuracy * 100), '%') as direction_accuracy,
           printf('%.4f', correlation) as correlation
    from results"""))
def leaderboard_display(spark, sf_dir):
    return scoring.leaderboard_display(_pooled(spark, sf_dir))


@query("union_predictions", sql.with_(
    *sql.TO_PREDICTIONS, final=f"select {PREDICTION_COLUMNS} from predictions"))
def union_predictions(spark, sf_dir):
    dataset = stages.core_dataset(spark, sf_dir)
    naive = linear.naive_predictions(dataset, stages.FOLDS)
    momentum = stages.predictions(spark, sf_dir).where("model = 'Momentum'")
    return _rounded_predictions(scoring.union_predictions(naive, momentum))


@query("sorted_predictions", sql.with_(
    *sql.TO_PREDICTIONS,
    final=f"select {PREDICTION_COLUMNS} from predictions order by ticker, date, model"))
def sorted_predictions(spark, sf_dir):
    return _rounded_predictions(scoring.sorted_predictions(stages.predictions(spark, sf_dir)))


# ---- comparisons of the models SQL can fit --------------------------------------------------------


def _two_models_sql(tested):
    """Scores of naive and ridge forecasts, given the relation of test rows."""
    return (
        ("predictions", f"""
            select ticker, date, 'Naive' as model, target_5d as actual, my as prediction
            from {tested} join ridge_moments using (ticker) where fold = test_fold
            union all
            select ticker, date, 'Ridge', target_5d, {sql.ridge_value(CORE4)}
            from {tested} join ridge using (ticker) where fold = test_fold"""),
        sql.RESULTS,
    )


@query("walk_forward_results", sql.with_(
    *sql.TO_DATASET, sql.WALK, sql.WALK_FOLDS, sql.WALK_TRAINING,
    *sql.ridge(CORE4, "training"), *_two_models_sql("walk"),
    final=f"select ticker, model, {sql.rounded(SCORE_NAMES)} from results"))
def walk_forward_results(spark, sf_dir):
    """Multi-ticker validation of every ticker; too short ones have no results."""
    validation = evaluate.multi_ticker_validation(
        stages.core_dataset(spark, sf_dir), CORE4, models=("Naive", "Ridge")
    )
    return rounded(evaluate.require_results(validation.results), SCORE_NAMES)


@query("tournament_results", sql.with_(
    *sql.TO_DATASET, sql.DEVELOPMENT, sql.purged("development"), sql.FOLDS,
    sql.PURGED_TRAINING, *sql.ridge(CORE4, "training", scaled=False),
    *_two_models_sql("purged"),
    final=f"""
    select ticker, model, {sql.rounded(SCORE_NAMES)},
           cast(rank() over (partition by ticker order by rmse) as integer) as rank from results"""))
def tournament_results(spark, sf_dir):
    """Tournament leaderboard of every ticker on purged folds of its development rows."""
    outcome = evaluate.tournament(
        stages.core_dataset(spark, sf_dir), CORE4, models=("Naive", "Ridge")
    )
    return rounded(outcome.results, SCORE_NAMES)


# ---- result files and runs --------------------------------------------------------------------------


@query("csv_sink_roundtrip", sql.with_(
    *sql.TO_PREDICTIONS, final=f"select {PREDICTION_COLUMNS} from predictions"))
def csv_sink_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "predictions-csv")
    rows = stages.predictions(spark, sf_dir).select(*PREDICTIONS.fieldNames())
    outputs.write_csv(rows, path, ["ticker", "date", "model"])
    return _rounded_predictions(outputs.read_csv(spark, path, PREDICTIONS))


@query("results_csv", _scores_sql("ticker, model"))
def results_csv(spark, sf_dir):
    path = fresh_path(spark, "results-csv")
    outputs.write_csv(_pooled(spark, sf_dir), path, ["rmse", "ticker", "model"])
    return rounded(outputs.read_csv(spark, path, RESULTS), SCORE_NAMES)


@query("run_log", sql.with_(*sql.TO_PREDICTIONS, sql.RESULTS, final="""
    select experiment, concat(ticker, '_', model, '_Tournament') as run_name, '3' as n_splits,
           model, round(rmse, 6) as rmse, cast(2 as bigint) as runs
    from results, (select 'model_tournament' as experiment)"""))
def run_log(spark, sf_dir):
    """Log every result twice and read the runs back."""
    path = fresh_path(spark, "runs")
    name = F.concat_ws("_", "ticker", "model", F.lit("Tournament"))
    runs = outputs.run_records(
        _pooled(spark, sf_dir), "model_tournament", name, {"n_splits": 3, "purge_gap": 5}
    )
    outputs.append_runs(runs, path)
    outputs.append_runs(runs, path)
    logged = outputs.read_runs(spark, path).select(*RUNS.fieldNames())
    fields = logged.select(
        "experiment",
        "run_name",
        F.col("params")["n_splits"].alias("n_splits"),
        F.col("params")["model"].alias("model"),
        F.col("metrics")["rmse"].alias("rmse"),
    )
    counted = rounded(fields, ["rmse"]).groupBy(*fields.columns).agg(F.count("*").alias("runs"))
    return counted


# ---- tree models ------------------------------------------------------------------------------------


STUMP = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0, "min_child_weight": 1, "reg_lambda": 0.0}


@query("stump_holdout", sql.with_(
    *sql.TO_DATASET,
    ("stump_rows", """
      select ticker, date, rn < floor(n * 0.8e0) as train, target_5d,
             cast(date_diff('day', date '1970-01-01', date) % 11 as integer) as day
      from dataset
      where floor(n * 0.8e0) between 1 and n - 1"""),
    ("stump_means", "select ticker, avg(target_5d) as mean from stump_rows where train group by 1"),
    ("stump_sums", """
      select ticker, day, count(*) as n, sum(target_5d) as s from stump_rows where train group by 1, 2"""),
    ("stump_cuts", """
      select a.ticker, a.day as cut,
             sum(b.n) filter (b.day <= a.day) as ln, sum(b.s) filter (b.day <= a.day) as ls,
             sum(b.n) filter (b.day > a.day) as rn, sum(b.s) filter (b.day > a.day) as rs
      from stump_sums a join stump_sums b on a.ticker = b.ticker group by 1, 2"""),
    ("stump_best", """
      select * from stump_cuts where rn is not null
      qualify row_number() over (partition by ticker order by ls * ls / ln + rs * rs / rn desc, cut) = 1"""),
    final="""
    select r.ticker, r.date, round(r.target_5d, 6) + 0.0 as actual,
           round(case when b.cut is null then m.mean
                      when r.day <= b.cut then b.ls / b.ln else b.rs / b.rn end, 6) + 0.0 as prediction
    from stump_rows r join stump_means m using (ticker) left join stump_best b on b.ticker = r.ticker
    where not r.train"""))
def stump_holdout(spark, sf_dir):
    """One unshrunken tree of depth 1 on a whole-numbered feature: the same cuts as in SQL."""
    dataset = stages.core_dataset(spark, sf_dir).withColumn("day", F.unix_date("date") % 11)
    rows = trees.tree_predictions(dataset, splits.Holdout(), ["day"], {"Stump": trees.boosting(STUMP)})
    return _rounded_predictions(rows).select("ticker", "date", "actual", "prediction")


def _cuts(level: int) -> tuple[tuple[str, str], ...]:
    """SQL of one level: the best cut of every node of ``tree_{level}`` and the rows below it."""
    return (
        (f"cells_{level}", f"""
      select ticker, node, f, v, count(*) as w, sum(target_5d) as s
      from (select ticker, node, target_5d, unnest([0, 1]) as f, unnest([day, week]) as v from tree_{level} where train)
      group by all"""),
        (f"sums_{level}", f"""
      select *, sum(w) over upto as lw, sum(s) over upto as ls, sum(w) over lane as tw, sum(s) over lane as ts
      from cells_{level}
      window lane as (partition by ticker, node, f), upto as (partition by ticker, node, f order by v)"""),
        (f"best_{level}", f"""
      select ticker, node, f, v from sums_{level}
      where lw < tw and ls * ls / lw + (ts - ls) * (ts - ls) / (tw - lw) - ts * ts / tw > 1e-15
      qualify row_number() over (partition by ticker, node
                                 order by ls * ls / lw + (ts - ls) * (ts - ls) / (tw - lw) desc, f, v) = 1"""),
        (f"tree_{level + 1}", f"""
      select t.* exclude (node), case when b.f is null then t.node
             when (case b.f when 0 then t.day else t.week end) <= b.v then 2 * t.node + 1 else 2 * t.node + 2 end as node
      from tree_{level} t left join best_{level} b on b.ticker = t.ticker and b.node = t.node"""),
    )


@query("two_level_holdout", sql.with_(
    *sql.TO_DATASET,
    ("tree_0", """
      select ticker, date, rn < floor(n * 0.8e0) as train, target_5d, 0 as node,
             cast(date_diff('day', date '1970-01-01', date) % 11 as integer) as day,
             cast(date_diff('day', date '1970-01-01', date) % 7 as integer) as week
      from dataset
      where floor(n * 0.8e0) between 1 and n - 1"""),
    *_cuts(0), *_cuts(1),
    ("leaves", "select ticker, node, avg(target_5d) as mean from tree_2 where train group by 1, 2"),
    final="""
    select t.ticker, t.date, round(t.target_5d, 6) + 0.0 as actual, round(l.mean, 6) + 0.0 as prediction
    from tree_2 t join leaves l on l.ticker = t.ticker and l.node = t.node
    where not t.train"""))
def two_level_holdout(spark, sf_dir):
    """One distributed tree of depth 2 on two whole-numbered features: the same cuts as in SQL."""
    day = F.unix_date("date")
    dataset = stages.core_dataset(spark, sf_dir).withColumns({"day": day % 11, "week": day % 7})
    rows = level_trees.boosted_predictions(dataset, splits.Holdout(), ["day", "week"], **STUMP | {"max_depth": 2})
    return _rounded_predictions(rows).select("ticker", "date", "actual", "prediction")


@query("rf_holdout")
def rf_holdout(spark, sf_dir):
    models = {"RandomForest": trees.forest(**trees.VALIDATION_FOREST)}
    return trees.tree_predictions(stages.full_dataset(spark, sf_dir), splits.Holdout(), preset("full6"), models)


@query("gbt_holdout")
def gbt_holdout(spark, sf_dir):
    models = {"BoostedTrees": trees.boosting()}
    return trees.tree_predictions(stages.full_dataset(spark, sf_dir), splits.Holdout(), preset("core5"), models)


@query("holdout_results")
def holdout_results(spark, sf_dir):
    models = {
        "Naive": evaluate.Naive(),
        "Ridge": evaluate.Ridge(scaled=True),
        "RandomForest": trees.forest(**trees.VALIDATION_FOREST),
    }
    rows = evaluate.predict(stages.full_dataset(spark, sf_dir), splits.Holdout(), "full6", models)
    return evaluate.require_every_model(scoring.score(rows), len(models))


@query("tournament_predictions")
def tournament_predictions(spark, sf_dir):
    return stages.fitted_folds(spark, sf_dir)


# The naive rows of the six-feature comparisons have SQL; their dataset holds the same rows as the
# four-feature one, because the regime is never missing.


@query("tournament_predictions_naive", sql.with_(
    *sql.TO_DATASET, sql.DEVELOPMENT, sql.purged("development"), sql.FOLDS, final=f"""
    select ticker, date, 'Naive' as model, round(target_5d, 6) + 0.0 as actual,
           round((select avg(t.target_5d) from purged t where t.ticker = p.ticker and t.rn < p.size * p.test_fold), 6)
             + 0.0 as prediction, test_fold as fold
    from purged p where test_fold is not null"""))
def tournament_predictions_naive(spark, sf_dir):
    return _rounded_predictions(stages.fitted_folds(spark, sf_dir).where("model = 'Naive'"))


@query("holdout_results_naive", sql.with_(*sql.TO_DATASET, (
    "predictions", """
    select ticker, 'Naive' as model, target_5d as actual, mean as prediction
    from (select *, avg(target_5d) filter (rn < floor(n * 0.8e0)) over (partition by ticker) as mean from dataset)
    where rn >= floor(n * 0.8e0)"""), sql.RESULTS, final=f"select ticker, model, {sql.rounded(SCORE_NAMES)} from results"))
def holdout_results_naive(spark, sf_dir):
    rows = evaluate.predict(stages.full_dataset(spark, sf_dir), splits.Holdout(), "full6", ["Naive"])
    return rounded(scoring.score(rows), SCORE_NAMES)


@query("multi_ticker_results_naive", sql.with_(
    *sql.TO_DATASET, sql.WALK, ("predictions", """
    select ticker, 'Naive' as model, target_5d as actual,
           (select avg(t.target_5d) from dataset t where t.ticker = walk.ticker
            and t.rn < 995 + 100 * (walk.test_fold - 1)) as prediction
    from walk where test_fold is not null"""), sql.RESULTS,
    final=f"select ticker, model, {sql.rounded(SCORE_NAMES)} from results"))
def multi_ticker_results_naive(spark, sf_dir):
    validation = evaluate.multi_ticker_validation(stages.full_dataset(spark, sf_dir), "full6", models=["Naive"])
    return rounded(validation.results, SCORE_NAMES)


# ---- whole comparisons, read back from what they write ------------------------------------------------


@query("tournament")
def tournament(spark, sf_dir):
    folder = fresh_path(spark, "tournament")
    outcome = evaluate.tournament(stages.full_dataset(spark, sf_dir), "core5", folder=folder)
    results = outputs.read_csv(spark, f"{folder}/results", RESULTS)
    holdout = outputs.read_csv(spark, f"{folder}/holdout_results", RESULTS)
    holdout = holdout.select("ticker", "model", F.col("rmse").alias("holdout_rmse"))
    runs = outputs.read_runs(spark, f"{folder}/runs").select(
        F.col("params")["ticker"].alias("ticker"), F.col("params")["model"].alias("model"), F.size("params").alias("params")
    )
    winner = outcome.winner.select("ticker", F.col("model").alias("winner"))
    return results.join(holdout, ["ticker", "model"]).join(runs, ["ticker", "model"]).join(winner, "ticker")


@query("multi_ticker_results")
def multi_ticker_results(spark, sf_dir):
    folder = fresh_path(spark, "validation")
    evaluate.multi_ticker_validation(stages.full_dataset(spark, sf_dir), "full6", folder=folder)
    return evaluate.require_results(outputs.read_csv(spark, f"{folder}/results", RESULTS))


@query("validation_status", sql.with_(
    *sql.TO_DATASET, sql.WALK,
    ("tested", """
      select ticker, test_fold as fold, count(*) as tested, any_value(n) as n from walk
      where test_fold is not null group by 1, 2"""),
    ("fits", """
      select ticker, fold, model, tested, model <> 'Naive' and n % 2 = 1
             and (1010 < 995 + 100 * (fold - 1) or 1010 between 1000 + 100 * (fold - 1) and 999 + 100 * fold) as bad
      from tested, (values ('Naive'), ('Ridge'), ('RandomForest')) m(model)"""),
    final="""
    select ticker, fold, model, case when bad then 'failed' else 'done' end as status,
           case when bad then 0 else tested end as row_count,
           case when bad then 'features or targets are not finite' end as error
    from fits"""))
def validation_status(spark, sf_dir):
    """Every fit of a comparison in which an infinite feature spoils some tickers."""
    spoilt = F.when((F.col("rn") == 1010) & (F.col("n") % 2 == 1), F.lit(float("inf"))).otherwise(F.col("macd"))
    dataset = stages.full_dataset(spark, sf_dir).withColumn("macd", spoilt)
    return evaluate.multi_ticker_validation(dataset, "full6", folder=fresh_path(spark, "status")).status


@query("param_search")
def param_search(spark, sf_dir):
    return stages.searched(spark, sf_dir)


@query("tuned_model")
def tuned_model(spark, sf_dir):
    """Best of 20 candidates of every ticker, refitted and scored on the holdout, with its run."""
    folder = fresh_path(spark, "tuned")
    dataset, search = stages.core_dataset(spark, sf_dir), stages.searched(spark, sf_dir)
    tuned = evaluate.tuned_model(dataset, CORE4, folder=folder, search=search)
    runs = outputs.read_runs(spark, f"{folder}/runs").select(
        F.col("params")["ticker"].alias("ticker"), F.col("metrics")["cv_mse"].alias("cv_mse")
    )
    return tuned.results.join(runs, "ticker")
