"""Point-in-time market regime: 1 when the latest state is the one with the higher mean return.

The model is refitted every 20 returns on the returns before that point, first with 500 of them;
the label of a refit holds for the next 20 rows. Refits are grouped into chunks of 25 which are
spread by ``(ticker, chunk)``, so a long series uses many tasks. A chunk's input is the history
up to its last refit: daily closes of one ticker, whose number the calendar bounds. A task
streams its chunks and fits as many together as fit a fixed amount of memory.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.switching import latest_regimes
from barloom.operators.series import BLOCK_ROWS, block_window, core_rows, with_context, with_positions
from barloom.session import spread

MIN_OBSERVATIONS = 500
REFIT_EVERY = 20
REFITS_PER_CHUNK = 25
_CHUNK_ROWS = REFIT_EVERY * REFITS_PER_CHUNK
_PACK_CELLS = 4_000_000


def indexed_returns(bars: DataFrame) -> DataFrame:
    """``ticker, date, return_1d, i, returns``: returns numbered from 0, and how many there are.

    Closes are positive, so only the first row of a ticker has no return.
    """
    rows = with_context(with_positions(bars.select("ticker", "date", "close")), before=1)
    change = F.try_divide(F.col("close"), F.lag("close").over(block_window())) - 1
    return core_rows(rows.withColumn("return_1d", change)).where("rn > 0").select(
        "ticker",
        "date",
        "return_1d",
        (F.col("rn") - 1).alias("i"),
        (F.col("n") - 1).alias("returns"),
    )


def refit_index(i):
    """Length of the history behind the label of return ``i``; null before the first fit."""
    return F.when(
        i >= MIN_OBSERVATIONS,
        F.greatest(F.lit(MIN_OBSERVATIONS), F.floor(i / REFIT_EVERY) * REFIT_EVERY),
    )


def regime_blocks(bars: DataFrame) -> DataFrame:
    """The refit grid: per ``(ticker, refit)`` the rows it labels and their date range."""
    rows = indexed_returns(bars).withColumn("refit", refit_index(F.col("i")))
    return (
        rows.where(F.col("refit").isNotNull())
        .groupBy("ticker", "refit")
        .agg(
            F.count("*").alias("labelled_rows"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


def _fit_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels for histories arriving sorted by (ticker, chunk, i), several chunks per fit."""
    pack, cells = [], 0
    for ticker, chunk, last_refit, returns in _whole_chunks(batches):
        first = MIN_OBSERVATIONS + chunk * _CHUNK_ROWS
        refits = range(first, min(first + _CHUNK_ROWS, last_refit + 1), REFIT_EVERY)
        pack.append((ticker, refits, returns))
        cells += len(refits) * len(returns)
        if cells >= _PACK_CELLS:
            yield _fit_pack(pack)
            pack, cells = [], 0
    if pack:
        yield _fit_pack(pack)


def _whole_chunks(batches):
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        keys = rows[["ticker", "chunk"]]
        starts = np.flatnonzero((keys != keys.shift()).any(axis=1))
        for start, stop in zip(starts[:-1], starts[1:]):
            yield _chunk(rows.iloc[start:stop])
        held = rows.iloc[starts[-1]:] if len(rows) else None
    if held is not None:
        yield _chunk(held)


def _chunk(rows):
    head = rows.iloc[0]
    return head["ticker"], int(head["chunk"]), int(head["last_refit"]), rows["return_1d"].to_numpy(copy=True)


def _fit_pack(pack) -> pd.DataFrame:
    labels = latest_regimes([returns[:n] for _, refits, returns in pack for n in refits])
    return pd.DataFrame(
        {
            "ticker": [ticker for ticker, refits, _ in pack for _ in refits],
            "refit": [n for _, refits, _ in pack for n in refits],
            "regime": pd.array(labels, dtype="Int32"),
        }
    )


def refit_labels(returns: DataFrame) -> DataFrame:
    """``ticker, refit, regime`` for indexed returns; a failed fit repeats the last label."""
    last_refit = refit_index(F.col("returns") - 1)
    chunk_of = lambda refit: F.floor((refit - MIN_OBSERVATIONS) / _CHUNK_ROWS)
    # A return is history for the first refit after it and for all later ones.
    first_use = F.greatest(
        F.lit(MIN_OBSERVATIONS), (F.floor(F.col("i") / REFIT_EVERY) + 1) * REFIT_EVERY
    )
    history = (
        returns.withColumn("last_refit", last_refit)
        .where(first_use <= F.col("last_refit"))
        .select(
            "ticker",
            "i",
            "return_1d",
            "last_refit",
            F.explode(F.sequence(chunk_of(first_use), chunk_of(F.col("last_refit")))).alias(
                "chunk"
            ),
        )
    )
    labels = (
        spread(history, "ticker", "chunk")
        .sortWithinPartitions("ticker", "chunk", "i")
        .mapInPandas(_fit_packs, "ticker string, refit long, regime int")
    )
    upto = (
        Window.partitionBy("ticker").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    )
    return labels.select(
        "ticker", "refit", F.coalesce(F.last("regime", True).over(upto), F.lit(0)).alias("regime")
    )


def block_labels(labels: DataFrame) -> DataFrame:
    """``ticker, _blk, labels``: the labels of refits by the blocks that hold rows of theirs, as maps of some 26.

    Blocked rows ``rn`` belong to return ``rn - 1`` and find their label without a shuffle by refit.
    """
    first, last = (F.floor((F.col("refit") + step) / BLOCK_ROWS) for step in (1, REFIT_EVERY))
    placed = labels.select("ticker", F.explode(F.sequence(first, last)).alias("_blk"), F.struct("refit", "regime").alias("_label"))
    return placed.groupBy("ticker", "_blk").agg(F.map_from_entries(F.collect_list("_label")).alias("labels"))


def regimes(bars: DataFrame) -> DataFrame:
    """``ticker, date, regime`` for every bar; 0 until there is enough history."""
    returns = indexed_returns(bars)
    labels = refit_labels(returns)
    labelled = returns.select("ticker", "date", refit_index(F.col("i")).alias("refit")).join(
        labels, ["ticker", "refit"], "left"
    )
    return (
        bars.select("ticker", "date")
        .join(labelled, ["ticker", "date"], "left")
        .select("ticker", "date", F.coalesce("regime", F.lit(0)).alias("regime"))
    )
