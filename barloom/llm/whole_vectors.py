"""Whole-number vectors of an embeddings table and exact arithmetic on them at every size.

``floor(scale * x)`` of a double is a whole number that a double holds exactly, so vectors travel as
64-bit floats. Products and sums are computed in floats, 64-bit integers or Python integers, whichever
is the cheapest that is exact for the numbers at hand.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores outside a long are held at its ends until it is known whether they belong to the result.
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_vectors(values: list, scale: int = 256) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None where it is null or holds a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for vector in values:
        if vector is None:
            out.append(None)
            continue
        # a null component has become NaN
        own = np.asarray(vector, np.float64)
        out.append(np.floor(own * scale) + 0.0 if np.isfinite(own).all() else None)
    return out


def whole_rows(df: DataFrame, scale: int, *carried: str) -> DataFrame:
    """``vector`` (packed 64-bit floats) of the rows whose ``vector`` takes part, behind ``carried`` columns."""
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in carried), "vector binary"])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = whole_vectors(batch.column("vector").to_pylist(), scale)
            part = pa.array([v is not None for v in found], pa.bool_())
            columns = [batch.column(c).filter(part) for c in carried]
            columns.append(pa.array([v.tobytes() for v in found if v is not None], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "vector"])

    return df.select(*carried, "vector").mapInArrow(convert, schema)


def matrix(raws: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones padded with zeros."""
    size = max((len(r) for r in raws), default=0)
    size = max(size, 8 * width)
    return np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.float64).reshape(len(raws), size // 8)


def largest(values: np.ndarray) -> float:
    return float(np.abs(values).max(initial=0))


def exact_kind(bound: float):
    """The cheapest type that holds whole numbers up to ``bound`` exactly."""
    return np.float64 if bound < 2.0**52 else np.int64 if bound < 2.0**62 else object


def as_kind(values: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


def score_kind(a: np.ndarray, b: np.ndarray):
    """The type in which all inner products of rows of ``a`` and ``b`` are exact."""
    return exact_kind(largest(a) * largest(b) * max(a.shape[-1], 1))


def in_long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers, held at the ends of the range."""
    if scores.dtype == object:
        return np.array([min(max(int(s), LEAST), MOST) for s in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def checked(score: Column) -> Column:
    """``score``; a result that needed more than a long fails the job instead of being returned wrong."""
    outside = (score == F.lit(LEAST)) | (score == F.lit(MOST))
    return F.when(outside, F.raise_error(F.lit("a score does not fit 64 bits")).cast("long")).otherwise(score)
