"""Augmented Dickey-Fuller test per ticker."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.unit_root import best_lag, design, max_lag, p_value, t_statistic
from barloom.operators.series import BLOCK_ROWS, with_context, with_positions

# Rows a block needs before its own. Dates span at most 10,000 years, whose longest series
# would use 166 lags.
CONTEXT_ROWS = 168
_KEY_MARK = "\x1f"
_PARTIAL = "ticker string, n long, lags int, gram array<double>, head array<double>"
_RESULT = pa.schema(
    [
        ("ticker", pa.string()),
        ("series", pa.string()),
        ("observations", pa.int64()),
        ("used_lags", pa.int32()),
        ("statistic", pa.float64()),
        ("p_value", pa.float64()),
        ("stationary", pa.bool_()),
    ]
)
#: Results held before they leave a task.
_BLOCKS_PER_BATCH = 1000


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[dict, int, int]]:
    """Groups of rows that arrive sorted by ``keys``: arrays by column, first row and end of the group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        changes = np.zeros(table.num_rows, bool)
        changes[0] = True
        for key in keys:
            column = table.column(key)
            changes[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
        starts = np.flatnonzero(changes).tolist()
        yield from _cut(table, starts)
        held = table.slice(starts[-1])
    if held is not None:
        yield from _cut(held, [0, held.num_rows])


def _cut(table: pa.Table, starts: list[int]) -> Iterator[tuple[dict, int, int]]:
    if len(starts) > 1:
        columns = {name: table.column(name).to_numpy() for name in table.column_names}
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield columns, a, b


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sums(found: list[tuple]) -> pa.RecordBatch:
    ticker, n, tried, grams, heads = zip(*found, strict=True)
    lists = [
        pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), np.concatenate(own)) for own in (grams, heads)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(ticker, pa.string()), pa.array(n, pa.int64()), pa.array(tried, pa.int32()), *lists],
        names=["ticker", "n", "lags", "gram", "head"],
    )


def adf_test(series: DataFrame, columns: str | Sequence[str], lags: int | None = None) -> DataFrame:
    """``ticker, series, observations, used_lags, statistic, p_value, stationary``.

    All ``columns`` are tested in one pass. Constant only; without ``lags`` the lag count with the lowest Akaike criterion among those
    fitted on the same rows is taken, then refitted on all rows it allows. A series that is
    constant or too short has no statistic. The cross products of
    the regression are summed block by block, and a task streams its blocks of 512 rows; the solve
    runs on the sums.
    """
    if lags is not None and not 0 <= lags < CONTEXT_ROWS:
        raise ValueError(f"lags must be between 0 and {CONTEXT_ROWS - 1}")
    names = [columns] if isinstance(columns, str) else list(columns)
    values = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in names])
    # series and ticker form one key, so that blocks are those of a single series
    long = series.select("ticker", "date", F.inline(values)).where("x is not null")
    rows = with_positions(
        long.select(F.concat("series", F.lit(_KEY_MARK), "ticker").alias("ticker"), "date", "x")
    )
    # A fixed partition count keeps adaptive execution from merging small but slow tasks.
    partitions = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # of the rows before a block, its lags and differences reach back to these (max_lag, with some to spare)
    reach = F.lit(lags) if lags is not None else F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25)))
    blocked = (
        with_context(rows, before=CONTEXT_ROWS)
        .where(F.col("_core") | (F.col("rn") >= F.col("_blk") * BLOCK_ROWS - reach - 3))
        .select("ticker", "_blk", "rn", "n", "x", "_core")
        .repartition(partitions, "ticker", "_blk")
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for block, a, b in _groups(batches, ("ticker", "_blk")):
            n, first = int(block["n"][a]), int(block["rn"][a])
            tried = max_lag(n) if lags is None else lags
            values = block["x"][a:b]
            context = b - a - int(np.count_nonzero(block["_core"][a:b]))
            start = max(context - 1, 0, tried - first)
            x = design(values, start, len(values) - 1, tried)
            head = values[: tried + 1] if block["_blk"][a] == 0 else values[:0]
            found.append((block["ticker"][a], n, tried, (x.T @ x).ravel(), head))
            if len(found) == _BLOCKS_PER_BATCH:
                yield _sums(found)
                found = []
        if found:
            yield _sums(found)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for parts, a, b in _groups(batches, ("ticker",)):
            name, ticker = parts["ticker"][a].split(_KEY_MARK, 1)
            tried, n = int(parts["lags"][a]), int(parts["n"][a])
            gram = np.sum(np.stack(parts["gram"][a:b]), axis=0).reshape(tried + 3, tried + 3)
            head = np.asarray(max(parts["head"][a:b], key=len))
            used, statistic = tried, float("nan")
            if gram[2, 2] > tried + 2 and gram[0, 0] > 0:
                if lags is None:
                    used = best_lag(gram, tried)
                keep = used + 3
                final = gram[:keep, :keep]
                if used < tried:
                    early = design(head, used, len(head) - 1, used)
                    final = final + early.T @ early
                statistic = t_statistic(final, used)
            p = p_value(statistic) if np.isfinite(statistic) else None
            known = None if p is None else float(statistic)
            found.append((ticker, name, n, used, known, p, None if p is None else bool(p < 0.05)))
            if len(found) == _BLOCKS_PER_BATCH:
                yield _rows(found, _RESULT)
                found = []
        if found:
            yield _rows(found, _RESULT)

    sums = blocked.sortWithinPartitions("ticker", "_blk", "rn").mapInArrow(products, _PARTIAL)
    return sums.repartition(partitions, "ticker").sortWithinPartitions("ticker").mapInArrow(
        solve,
        "ticker string, series string, observations long, used_lags int, "
        "statistic double, p_value double, stationary boolean",
    )
