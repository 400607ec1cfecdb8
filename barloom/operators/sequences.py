"""Fixed-length input windows for sequence models."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import BLOCK_ROWS
from barloom.schemas import TARGET

SEQUENCE_LENGTH = 21


def sequence_windows(
    df: DataFrame, features: Sequence[str], length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """``ticker, role, date, x, y``: the last ``length`` feature rows and the target of each row.

    ``df`` has ``role`` and ``rn``; windows never cross a role border, so rows are numbered from
    the first of their role. Roles of at most ``length`` rows give no windows, see
    :func:`too_short`. Blocks of rows carry the ``length - 1`` rows before them.
    """
    if not 0 < length <= BLOCK_ROWS:
        raise ValueError(f"length must be between 1 and {BLOCK_ROWS}")
    sizes = _role_sizes(df).where(F.col("row_count") > length).drop("row_count")
    rows = df.where(F.col("role").isNotNull()).join(sizes, ["ticker", "role"], "left")
    rows = rows.where(F.col("_start").isNotNull()).withColumn("_at", F.col("rn") - F.col("_start"))
    home = F.floor(F.col("_at") / BLOCK_ROWS)
    feeds_next = F.col("_at") % BLOCK_ROWS > BLOCK_ROWS - length
    blocks = F.array_compact(F.array(home, F.when(feeds_next, home + 1)))
    placed = rows.withColumn("_blk", F.explode(blocks))
    window = (
        Window.partitionBy("ticker", "role", "_blk").orderBy("_at").rowsBetween(1 - length, 0)
    )
    values = F.array(*[F.col(c).cast("float") for c in features])
    return (
        placed.withColumn("x", F.collect_list(values).over(window))
        .where((F.floor(F.col("_at") / BLOCK_ROWS) == F.col("_blk")) & (F.col("_at") >= length - 1))
        .select("ticker", "role", "date", "x", F.col(TARGET).cast("float").alias("y"))
    )


def _role_sizes(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("role").isNotNull())
        .groupBy("ticker", "role")
        .agg(F.min("rn").alias("_start"), F.count("*").alias("row_count"))
    )


def too_short(df: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Roles with no more than ``length`` rows."""
    return _role_sizes(df).where(F.col("row_count") <= length).drop("_start")
