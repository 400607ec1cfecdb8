"""Raw landings: one batch per day, never replaced by nothing.

A landing zone is partitioned by ``ingest_date`` only, so the number of folders does not grow
with the number of tickers. Landing twice on a day replaces the keys of the new batch and keeps
the others; keys absent from a batch keep what earlier batches brought. ``delivery`` numbers the
rows of a batch in the order they were read. A manifest beside the batches has one row for each
key and landing, so the newest rows are found without reading the history.
"""

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schemas import BAR_COLUMNS, MACRO
from barloom.session import stage
from barloom.sources import files

#: Folder of the manifest inside a landing zone; readers of the zone skip names with this prefix.
MANIFEST = "_landings"
#: Landings that a scan may name one by one.
LANDINGS_LISTED = 1000


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def utc_today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def land(
    batch: DataFrame, path: str, key: str = "ticker", ingest_date: dt.date | None = None
) -> DataFrame:
    """Append a batch to the landing zone; returns ``key, row_count`` of what was landed.

    The first batch of a day is written once, as it is computed; a later one is staged and merged with it.
    """
    spark = batch.sparkSession
    day = ingest_date or utc_today()
    now = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    landed = batch.withColumns(
        {
            "landed_at": F.timestamp_micros(F.lit(now)),
            "delivery": F.monotonically_increasing_id(),
            "ingest_date": F.lit(day).cast("date"),
        }
    )
    present = read_if_exists(spark, path, landed.schema)
    rows = landed
    if present is not None:
        today = present.where(F.col("ingest_date") == F.lit(day))
        if not today.isEmpty():
            landed = stage(landed, "landing")
            if landed.isEmpty():
                return landed.groupBy(key).agg(F.count("*").alias("row_count"))
            kept = today.join(landed.select(key).distinct(), key, "left_anti")
            rows = stage(landed.unionByName(kept.select(*landed.columns)), "landing-merged")
    # Clustered by key; the hash lets a key with very many rows span several partitions.
    (
        rows.repartitionByRange(key, F.xxhash64(*batch.columns))
        .sortWithinPartitions(key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_date")
        .parquet(path)
    )
    written = spark.read.schema(landed.schema).parquet(path).where(
        (F.col("ingest_date") == F.lit(day)) & (F.unix_micros("landed_at") == now)
    )
    counts = stage(
        written.groupBy(key, "ingest_date", "landed_at").agg(F.count("*").alias("row_count")), "landing-counts"
    )
    if not counts.isEmpty():
        counts.write.mode("append").parquet(f"{path}/{MANIFEST}")
    elif present is None:
        files.remove(spark, path)
    return counts.select(key, "row_count")


def read_newest(spark: SparkSession, path: str, key: str = "ticker") -> DataFrame:
    """Rows of the most recent landing of each key, reading only the days that hold one.

    The days are collected from the manifest: a list bounded by the calendar, which prunes the
    partitions of the scan. On each day the newest landing replaced earlier ones of its keys.
    """
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    newest = manifest.groupBy(key).agg(
        F.max(F.struct("ingest_date", "landed_at")).alias("_at")
    ).select(key, "_at.ingest_date", "_at.landed_at")
    days = [r.ingest_date for r in newest.select("ingest_date").distinct().collect()]
    rows = spark.read.parquet(path).where(F.col("ingest_date").isin(days))
    known = manifest.where(F.col("ingest_date").isin(days) & F.col(key).isNotNull())
    times = newest.select(F.unix_micros("landed_at").alias("at")).distinct().limit(LANDINGS_LISTED + 1).collect()
    replaced = known.join(newest, [key, "ingest_date", "landed_at"], "left_anti")
    if len(times) <= LANDINGS_LISTED and replaced.isEmpty():
        # all landings of these days are the newest of their keys: no row needs to look its key up
        return rows.where(F.unix_micros("landed_at").isin([r["at"] for r in times]) & F.col(key).isNotNull())
    return rows.join(newest, [key, "ingest_date", "landed_at"], "left_semi")


def read_ticker_file(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """A download of one ticker: standard headers, bar columns and the ticker, ready to land."""
    from barloom.operators.columns import attach_ticker, canonical_bars, cast_dates, standardize_headers

    rows = attach_ticker(cast_dates(standardize_headers(spark.read.parquet(path))), ticker)
    return canonical_bars(rows).select(*BAR_COLUMNS)


def landing_summary(
    batch: DataFrame, wanted: DataFrame, key: str = "ticker"
) -> DataFrame:
    """``key, row_count, status`` for every wanted key: ``successful`` or ``failed``."""
    counts = batch.groupBy(key).agg(F.count("*").alias("row_count"))
    rows = F.coalesce("row_count", F.lit(0))
    return wanted.select(key).distinct().join(counts, key, "left").select(
        key,
        rows.alias("row_count"),
        F.when(rows > 0, "successful").otherwise("failed").alias("status"),
    )


def newest_landing(landed: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows of the most recent landing of each key."""
    newest = landed.groupBy(key).agg(F.max("landed_at").alias("landed_at"))
    return landed.join(newest, [key, "landed_at"], "left_semi")


def read_macro_csv(spark: SparkSession, path: str | Sequence[str], series_id: str) -> DataFrame:
    """A downloaded series: ``observation_date`` and one value column; ``.`` means no value.

    Any other header raises.
    """
    header = spark.read.csv(path, header=True).columns
    if len(header) != 2 or header[0] != "observation_date":
        raise ValueError(f"expected observation_date and one value column, found {header}")
    raw = spark.read.csv(path, header=True, schema="observation_date string, value string",
                         enforceSchema=True)
    return raw.select(
        F.lit(series_id).alias("series_id"),
        F.try_to_date("observation_date", "yyyy-MM-dd").alias("date"),
        F.expr("try_cast(value as double)").alias("value"),
    ).select(*MACRO.fieldNames())


def land_macro(series: DataFrame, path: str, ingest_date: dt.date | None = None) -> DataFrame:
    return land(series, path, key="series_id", ingest_date=ingest_date)
