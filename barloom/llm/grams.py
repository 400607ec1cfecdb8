"""Hashed byte n-grams of a text and their counts per class, as fixed-size vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import sliced

BITS = 16
BUCKETS = 1 << BITS


def gram_buckets(raw: bytes, order: int = 3) -> np.ndarray:
    """Bucket of each n-gram of ``order`` bytes; a text shorter than that has none."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    code = np.zeros(n, np.uint32)
    for k in range(order):
        code = code * np.uint32(16777619) + data[k : k + n] + np.uint32(1)
    return (code * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.uint16)


def gram_counts(rows: DataFrame, order: int = 3, lower: bool = False) -> DataFrame:
    """``class, bucket, n`` over all ``rows`` (``class`` string, ``text``).

    A task adds up its rows first and emits at most one row for each class and bucket it met. Rows
    without a class are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            for name, raw in zip(batch.column("class").to_pylist(), raws, strict=True):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                # texts of a few n-grams touch few buckets
                found = gram_buckets(raw.lower() if lower else raw, order)
                if len(found) > BUCKETS // 16:
                    sums[name] += np.bincount(found, minlength=BUCKETS)
                else:
                    np.add.at(sums[name], found, 1)
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "class": pa.array([name] * len(used), pa.string()),
                    "bucket": pa.array(used, pa.int32()),
                    "n": pa.array(counts[used], pa.int64()),
                }
            )

    own = rows.where(F.col("class").isNotNull()).select("class", "text")
    return own.mapInArrow(count, "class string, bucket int, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n"))


def count_vectors(counts: DataFrame, classes: list[str]) -> np.ndarray:
    """``counts`` as an array [class, bucket] on the driver: its size is fixed by the class list."""
    out = np.zeros((len(classes), BUCKETS), np.float64)
    place = {name: i for i, name in enumerate(classes)}
    found = counts.where(F.col("class").isin(classes)).toArrow()
    rows = [place[c] for c in found.column("class").to_pylist()]
    out[rows, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out
