"""Row order inside a ticker without sorting a whole ticker in one task.

Spark rows have no position, so positions are made explicit (``rn``, 0-based in date order,
and ``n``, the rows of the ticker). A hot ticker must not end up in one task, so nothing here
opens a row-level window over a whole ticker:

* rows are numbered inside ``(ticker, date segment)`` and shifted by the summed counts of the
  earlier segments;
* look-back and look-ahead windows run over ``(ticker, block of rows)``, each block carrying
  copies of the few neighbour rows it needs;
* unbounded look-back (forward fill, exponential means) is split into an in-block part and a
  carry computed from one summary row per block.

Only those summary rows (one per 512 days or rows) are ever windowed per ticker. Since
``(ticker, date)`` is unique, a segment holds at most 512 rows and a ticker has one summary
row per 512 calendar days.
"""

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_DAYS = 512
BLOCK_ROWS = 512


def segment_of(date: str = "date") -> Column:
    return F.floor(F.unix_date(date) / F.lit(SEGMENT_DAYS)).cast("int")


def _earlier(keys: Sequence[str], order: str):
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with all keys present; a row without one fails the job.

    Spark infers the filter for the summary side of the joins below; saying it for the rows as
    well keeps both sides of a join the same up to the last shuffle, which then runs once. As the
    check raises first, no row is ever filtered out.
    """
    for key in keys:
        missing = F.raise_error(F.lit(f"a row has no {key.lstrip('_')}, so it has no place in its series"))
        df = df.withColumn(key, F.coalesce(F.col(key), missing)).where(F.col(key).isNotNull())
    return df


def segmented(df: DataFrame, *keys: str, date: str = "date") -> DataFrame:
    """Rows with their date segment ``_seg``; a row without a key or a date fails the job."""
    missing = F.raise_error(F.lit(f"a row has no {date}, so it has no place in its series"))
    rows = df.withColumn("_seg", F.coalesce(segment_of(date), missing.cast("int")))
    return _keyed(rows, *keys, "_seg")


def with_positions(
    df: DataFrame, keys: Sequence[str] = ("ticker",), date: str = "date"
) -> DataFrame:
    """Add ``rn`` (0-based position in date order) and ``n`` (rows of the key).

    ``(keys, date)`` must be unique and not null; a null fails the job.
    """
    return positions_in_segments(segmented(df, *keys, date=date), keys, date)


def positions_in_segments(
    rows: DataFrame, keys: Sequence[str] = ("ticker",), date: str = "date"
) -> DataFrame:
    """:func:`with_positions` of rows that :func:`segmented` or a join in segments has placed."""
    keys = list(keys)
    counts = rows.groupBy(*keys, "_seg").agg(F.count("*").alias("_count"))
    offsets = counts.select(
        *keys,
        "_seg",
        F.coalesce(F.sum("_count").over(_earlier(keys, "_seg")), F.lit(0)).alias("_offset"),
        F.sum("_count").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = Window.partitionBy(*keys, "_seg").orderBy(date)
    # Every row has its offset; as a left join the rows can never become the broadcast side.
    return (
        rows.join(offsets, [*keys, "_seg"], "left")
        .withColumn("rn", F.col("_offset") + F.row_number().over(inside) - 1)
        .select(*[c for c in rows.columns if c != "_seg"], "rn", "n")
    )


def with_context(df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Assign positioned rows to blocks and copy neighbour rows into them.

    Adds ``_blk`` and ``_core``: windows over ``(ticker, _blk)`` ordered by ``rn`` see up to
    ``before`` earlier and ``after`` later rows; keep ``_core`` rows afterwards, once each.
    """
    if max(before, after) > BLOCK_ROWS:
        raise ValueError(f"context is limited to {BLOCK_ROWS} rows")
    home = F.floor(F.col("rn") / BLOCK_ROWS)
    place = F.col("rn") % BLOCK_ROWS
    last_blk = F.floor((F.col("n") - 1) / BLOCK_ROWS)
    targets = [home]
    if before:
        feeds_next = (place >= BLOCK_ROWS - before) & (home < last_blk)
        targets.append(F.when(feeds_next, home + 1))
    if after:
        targets.append(F.when((place < after) & (home > 0), home - 1))
    # keyed before the first window: a key that changes after it would shuffle the rows again
    placed = _keyed(df.withColumn("_blk", F.explode(F.array_compact(F.array(*targets)))), "ticker", "_blk")
    return placed.withColumn("_core", F.col("_blk") == home)


def block_window():
    """Window over the rows of a block in date order."""
    return Window.partitionBy("ticker", "_blk").orderBy("rn")


def core_rows(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_blk", "_core")


def positions_in_blocks(df: DataFrame) -> DataFrame:
    """``rn`` and ``n`` of the rows that are left of blocks of :func:`with_context`, as of ``with_positions``.

    ``df`` holds core rows with their ``_blk`` and old ``rn``. Each block counts what it has left, so the rows
    are not shuffled again. ``_last_day`` bounds every row of its block; it is there so that both branches
    need the same columns and share the shuffle by block.
    """
    counts = df.groupBy("ticker", "_blk").agg(F.count("*").alias("_count"), F.max("date").alias("_last_day"))
    offsets = counts.select(
        F.col("ticker").alias("_ticker"),
        F.col("_blk").alias("_of_blk"),
        "_last_day",
        F.coalesce(F.sum("_count").over(_earlier(["ticker"], "_blk")), F.lit(0)).alias("_offset"),
        F.sum("_count").over(Window.partitionBy("ticker")).alias("n"),
    )
    own_block = (
        (F.col("ticker") == F.col("_ticker"))
        & (F.col("_blk") == F.col("_of_blk"))
        & (F.col("date") <= F.col("_last_day"))
    )
    rows = df.withColumn("_place", F.row_number().over(block_window())).drop("rn", "n")
    placed = rows.join(offsets, own_block, "left").withColumn("rn", F.col("_offset") + F.col("_place") - 1)
    return placed.select(*[c for c in df.columns if c not in ("rn", "n", "_blk")], "rn", "n")


def forward_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the last earlier non-null value of the ticker; leading nulls stay.

    A row without ticker or date fails the job.
    """
    rows = segmented(df, "ticker")
    ends = rows.groupBy("ticker", "_seg").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"_end_{c}")
            for c in columns
        ]
    )
    carries = ends.select(
        "ticker",
        "_seg",
        *[
            F.last(f"_end_{c}", ignorenulls=True)
            .over(_earlier(["ticker"], "_seg"))
            .alias(f"_carry_{c}")
            for c in columns
        ],
    )
    upto = (
        Window.partitionBy("ticker", "_seg")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_carry_{c}"))
        for c in columns
    }
    return rows.join(carries, ["ticker", "_seg"], "left").withColumns(filled).select(*df.columns)


def ewm_means(df: DataFrame, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Exponential means ``y0 = x0; y = (1-alpha) * y_prev + alpha * x``, one per spec.

    ``df`` comes from :func:`with_context` with ``after=0``; ``specs`` maps the output column to
    ``(input column, alpha, min_periods)``, inputs not null on core rows. Per block the mean is
    a running sum of ``x * decay^-place``; what earlier blocks contribute is folded from their
    end values, over as many blocks as it takes the decay to reach 1e-300. Output is null before
    ``min_periods`` rows, and undefined on context rows.
    """
    place = F.col("rn") % BLOCK_ROWS
    running = block_window().rowsBetween(Window.unboundedPreceding, 0)
    decay, weighted = {}, {}
    for name, (source, alpha, _) in specs.items():
        if not 0.0 < alpha < 1.0 or -BLOCK_ROWS * log(1.0 - alpha) > 690:
            raise ValueError(f"alpha {alpha} is outside the supported range")
        decay[name] = 1.0 - alpha
        weight = F.when(F.col("rn") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        weighted[name] = weight * F.col(source)

    ends = (
        df.where("_core")
        .groupBy("ticker", "_blk")
        .agg(
            F.max("date").alias("_last_day"),
            *[
                F.sum(weighted[s] * F.pow(F.lit(decay[s]), F.lit(BLOCK_ROWS - 1) - place))
                .alias(f"_end_{s}")
                for s in specs
            ],
        )
    )
    # _last_day bounds every row of its block, so the join below keeps all of them. It is there
    # so that both branches need the same columns and share one shuffle of the rows.
    carries = ends.select(
        F.col("ticker").alias("_ticker"),
        F.col("_blk").alias("_of_blk"),
        "_last_day",
        *[_folded_carry(f"_end_{s}", decay[s]).alias(f"_carry_{s}") for s in specs],
    )

    means = {}
    for name, (_, _, min_periods) in specs.items():
        b = F.lit(decay[name])
        own = F.when(F.col("_core"), weighted[name] * F.pow(b, -place))
        value = (
            F.sum(own).over(running) * F.pow(b, place)
            + F.col(f"_carry_{name}") * F.pow(b, place + 1)
        )
        means[name] = F.when(F.col("rn") >= min_periods - 1, value)
    own_block = (
        (F.col("ticker") == F.col("_ticker"))
        & (F.col("_blk") == F.col("_of_blk"))
        & (F.col("date") <= F.col("_last_day"))
    )
    return df.join(carries, own_block, "left").withColumns(means).select(*df.columns, *specs)


def _folded_carry(end: str, decay: float) -> Column:
    """Mean at the end of the previous block, from the end values of the blocks before."""
    block_decay = decay**BLOCK_ROWS
    reach = max(1, ceil(-690 / (BLOCK_ROWS * log(decay))))
    earlier = Window.partitionBy("ticker").orderBy("_blk").rowsBetween(-reach, -1)
    return F.aggregate(
        F.collect_list(end).over(earlier),
        F.lit(0.0),
        lambda acc, value: acc * F.lit(block_decay) + value,
    )
