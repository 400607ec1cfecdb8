"""Small helpers shared by the text operators."""

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.session import fresh_path, staging_root

#: Characters handled together inside a task; bounds the Python objects alive at once.
SLICE_CHARS = 2_000_000


def documents(df: DataFrame, *extra: Column) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of a documents table, whatever else it holds."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *extra,
    )


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of ``column`` (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs that run inside: rows with long texts fill less memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(key: tuple, build: Callable):
    """A store that a Python worker keeps between tasks, built on first use. A worker keeps the
    store of one operator at a time, so stages that share workers do not add up their memory.

    Functions travel to workers by value, module variables with them; what outlives a task hangs
    on an entry of the worker's own module table.
    """
    holder = sys.modules.setdefault("barloom_kept", types.ModuleType("barloom_kept"))
    if getattr(holder, "key", None) != key:
        holder.key = holder.store = None
        holder.store = build()
        holder.key = key
    return holder.store


#: Bytes of plain Latin text: line feed, printable ASCII and the Latin-1 letters.
_PLAIN = bytes([10, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])


def plain_latin(text: str) -> bytes | None:
    """The Latin-1 bytes of a text of line feeds, printable ASCII and Latin-1 letters only, else None."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _PLAIN) else raw


def stage_columns(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared staging folder and scan it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(StructType.fromJson(_nullable(df.schema.jsonValue()))).parquet(path)


def _nullable(schema: dict) -> dict:
    return schema | {"fields": [field | {"nullable": True} for field in schema["fields"]]}


__all__ = ["SLICE_CHARS", "arrow_rows", "documents", "fresh_path", "kept", "plain_latin", "sliced", "slices", "stage_columns", "staging_root"]
