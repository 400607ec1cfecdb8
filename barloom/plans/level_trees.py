"""Trees grown level by level over distributed rows, for histories too long for one task.

No group holds the rows of a fit. A level is one aggregation: every row adds its weight and residual to a
histogram cell (fit, tree, node, feature, bin), summed before the shuffle, and the best cut of a node is
chosen by aggregating its cells. What comes back is one row for each node. Rows are never rewritten or shuffled
for a level: they meet the trees of their fit, one small row a fit, and walk down to their node.

Forests grow all trees at once, so a forest takes as many jobs as it has levels; boosted trees depend on
each other and take rounds times levels. For fits that one task can hold, :mod:`barloom.plans.trees` is faster.
"""

import random
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.histogram_trees import LEAST_GAIN
from barloom.plans.splits import Scheme, fold_bounds
from barloom.plans.trees import SEED, fold_rows
from barloom.schemas import PREDICTIONS
from barloom.session import stage

KEYS = ["ticker", "fold"]
BINS = 64
#: Boosted rounds after which the forecasts so far are written, so that rows do not walk through all trees again.
ROUNDS_PER_TABLE = 10


def binned(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """``rows`` with ``codes``: the bin of each feature, at quantiles of the fit's training rows.

    Values that each hold more than a ``bins``-th of the rows have bins of their own.
    """
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    training = lambda c: F.when(F.col("train"), F.col(c))
    edges = [F.array_distinct(F.percentile_approx(training(c), shares, 100 * bins)).alias(f"_edges{i}") for i, c in enumerate(features)]
    fitted = rows.join(rows.groupBy(*KEYS).agg(*edges), KEYS, "left")
    # as many edges are below a value as its bin's number; a cut keeps values up to its edge on the left
    below = [F.expr(f"size(filter(_edges{i}, e -> e < `{c}`))") for i, c in enumerate(features)]
    return fitted.withColumn("codes", F.array(*below)).drop(*[f"_edges{i}" for i in range(len(features))])


def _uniform(tree: Column, salt: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the row and tree only, so a repeated task draws the same."""
    bits = F.xxhash64("ticker", "date", "fold", tree, F.lit(f"{salt}{seed}"))
    return F.shiftrightunsigned(bits, 11) / F.lit(float(1 << 53))


def bootstrap_weight(tree: Column, seed: int) -> Column:
    """How often a row is drawn: independent Poisson numbers of mean 1, as large samples are in the limit."""
    u = _uniform(tree, "bootstrap", seed)
    chance, total, steps = 0.36787944117144233, 0.0, []
    for k in range(12):
        total += chance
        chance /= k + 1
        steps.append(F.when(u >= F.lit(total), 1).otherwise(0))
    return reduce(Column.__add__, steps)


def _walk(levels: int, size: int, tree: Column) -> Column:
    """The node of ``tree`` that a row reaches within ``levels`` steps."""

    def step(node, _):
        here = F.col("nodes")[tree * size + node]
        right = F.when(F.col("codes")[here["feature"]] > here["bin"], 1).otherwise(0)
        return F.when(F.coalesce(here["feature"], F.lit(-1)) < 0, node).otherwise(2 * node + 1 + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step) if levels else F.lit(0)


def _shrunk(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - F.lit(l1), F.lit(0.0)) if l1 else g


def _as_arrays(found: DataFrame, trees: int, size: int) -> DataFrame:
    """One row a fit: ``nodes`` [tree * size + node], null where there is no node."""
    entries = F.map_from_entries(F.collect_list(F.struct("place", F.struct("feature", "bin", "value"))))
    grouped = found.select(*KEYS, (F.col("tree") * size + F.col("node")).alias("place"), "feature", "bin", "value").groupBy(*KEYS).agg(entries.alias("known"))
    places = F.sequence(F.lit(0), F.lit(trees * size - 1))
    return grouped.select(*KEYS, F.transform(places, lambda p: F.try_element_at("known", p)).alias("nodes"))


def grow(
    rows: DataFrame, features: int, trees: int, depth: int, least: float, weight: Column, allowed: list[list[int]], l1: float = 0.0, l2: float = 0.0
) -> DataFrame:
    """``ticker, fold, nodes`` of trees on the training rows of ``rows`` (``codes``, ``residual``).

    ``weight`` may depend on the column ``tree``; ``allowed`` are the features that each tree may cut. A cut
    leaves at least ``least`` of the weight on both sides; of equal cuts the first feature and bin counts.
    """
    size = 2 ** (depth + 1) - 1
    permitted = F.array(*[F.array(*[F.lit(f) for f in own]) for own in allowed])
    base = rows.where("train")
    tree = F.col("tree")
    known = None
    for level in range(depth):
        own = base if known is None else base.join(known, KEYS, "left")
        every = own.select(*own.columns, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        every = every.withColumns({"w": weight.cast("double"), "node": _walk(level, size, tree)}).where("w > 0")
        every = every.where(F.col("node") >= 2**level - 1)  # a node above is a leaf
        cells = every.select(*KEYS, "tree", "node", "w", (F.col("w") * F.col("residual")).alias("s"), F.posexplode("codes").alias("feature", "bin"))
        cells = cells.groupBy(*KEYS, "tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        # at most as many rows as a feature has bins
        lane = Window.partitionBy(*KEYS, "tree", "node", "feature")
        upto = lane.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = cells.withColumns({"lw": F.sum("w").over(upto), "ls": F.sum("s").over(upto), "tw": F.sum("w").over(lane), "ts": F.sum("s").over(lane)})
        rw, rs = F.col("tw") - F.col("lw"), F.col("ts") - F.col("ls")
        part = lambda s, w: F.pow(_shrunk(s, l1), 2) / (w + F.lit(l2))
        can = (F.col("lw") >= least) & (rw >= least) & F.array_contains(permitted[tree], F.col("feature"))
        score = F.when(can, part(F.col("ls"), F.col("lw")) + part(rs, rw))
        parent = part(F.col("ts"), F.col("tw"))
        gain = F.when(score - parent > LEAST_GAIN, score)
        pick = F.struct("feature", "bin", "lw", "ls", rw.alias("rw"), rs.alias("rs"))
        best = F.max_by(F.when(gain.isNotNull(), pick), F.struct(F.coalesce(gain, F.lit(-1.0)), -F.col("feature"), -F.col("bin")))
        chosen = sums.groupBy(*KEYS, "tree", "node").agg(best.alias("cut"), F.max("tw").alias("tw"), F.max("ts").alias("ts"))
        value = lambda s, w: _shrunk(s, l1) / (w + F.lit(l2))
        chosen = stage(chosen, "level-cuts")
        inner = chosen.where("cut is not null")
        cuts = inner.select(*KEYS, "tree", "node", "cut.feature", "cut.bin", F.lit(0.0).alias("value"))
        no_cut = [F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("bin")]
        leaves = [
            inner.select(*KEYS, "tree", (2 * F.col("node") + 1 + side).alias("node"), *no_cut, value(F.col(f"cut.{s}s"), F.col(f"cut.{s}w")).alias("value"))
            for side, s in ((0, "l"), (1, "r"))
        ]
        fresh = reduce(DataFrame.unionByName, [cuts, *leaves])
        if known is None:
            roots = chosen.where("cut is null").select(*KEYS, "tree", "node", *no_cut, value(F.col("ts"), F.col("tw")).alias("value"))
            nodes = fresh.unionByName(roots)
        else:
            nodes = nodes.join(fresh.select(*KEYS, "tree", "node"), [*KEYS, "tree", "node"], "left_anti").unionByName(fresh)
        nodes = stage(nodes, "level-nodes")
        known = _as_arrays(nodes, trees, size)
    return known


def _value(depth: int, tree: Column) -> Column:
    size = 2 ** (depth + 1) - 1
    return F.coalesce(F.col("nodes")[tree * size + _walk(depth, size, tree)]["value"], F.lit(0.0))


def _fold_table(df: DataFrame, scheme: Scheme, features: Sequence[str], bins: int) -> DataFrame:
    rows = fold_rows(df, fold_bounds(df, scheme), features)
    return stage(binned(rows, features, bins).select(*KEYS, "date", "actual", "train", "codes"), "level-rows")


def _predictions(rows: DataFrame, model: str) -> DataFrame:
    return rows.where("not train").withColumn("model", F.lit(model)).select(PREDICTIONS.fieldNames())


def forest_predictions(
    df: DataFrame, scheme: Scheme, features: Sequence[str], n_estimators: int, max_depth: int, min_samples_leaf: int = 1,
    seed: int = SEED, bins: int = BINS, model: str = "RandomForest",
) -> DataFrame:
    """Mean forecast of trees on bootstrap samples, of every (ticker, fold)."""
    rows = _fold_table(df, scheme, features, bins)
    every = [list(range(len(features)))] * n_estimators
    weight = bootstrap_weight(F.col("tree"), seed)
    grown = grow(rows.withColumn("residual", F.col("actual")), len(features), n_estimators, max_depth, min_samples_leaf, weight, every)
    tested = rows.where("not train").join(grown, KEYS, "left")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(n_estimators - 1)), F.lit(0.0), lambda acc, t: acc + _value(max_depth, t))
    return _predictions(tested.withColumn("prediction", total / n_estimators), model)


def boosted_predictions(
    df: DataFrame, scheme: Scheme, features: Sequence[str], n_estimators: int, max_depth: int, learning_rate: float,
    subsample: float = 1.0, colsample_bytree: float = 1.0, min_child_weight: float = 1.0, reg_alpha: float = 0.0, reg_lambda: float = 1.0,
    seed: int = SEED, bins: int = BINS, model: str = "BoostedTrees",
) -> DataFrame:
    """Forecasts of boosted trees from the training mean on, of every (ticker, fold).

    Rows take part in a tree with the probability ``subsample``; columns are drawn for each tree.
    """
    rows = _fold_table(df, scheme, features, bins)
    means = rows.where("train").groupBy(*KEYS).agg(F.avg("actual").alias("fitted"))
    rows = rows.join(means, KEYS, "left")
    draw = random.Random(seed)
    taken = max(1, int(colsample_bytree * len(features)))
    least = max(min_child_weight, 1e-9)
    for step in range(n_estimators):
        weight = F.lit(1) if subsample >= 1 else F.when(_uniform(F.lit(step), "rows", seed) < subsample, 1).otherwise(0)
        columns = sorted(draw.sample(range(len(features)), taken))
        residual = rows.withColumn("residual", F.col("actual") - F.col("fitted"))
        grown = grow(residual, len(features), 1, max_depth, least, weight, [columns], reg_alpha, reg_lambda)
        moved = rows.join(grown, KEYS, "left").withColumn("fitted", F.col("fitted") + F.lit(learning_rate) * _value(max_depth, F.lit(0)))
        rows = moved.drop("nodes")
        if (step + 1) % ROUNDS_PER_TABLE == 0:
            rows = stage(rows, "level-fitted")
    return _predictions(rows.withColumn("prediction", F.col("fitted")), model)
