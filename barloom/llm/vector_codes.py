"""Product codes of vectors, with entries searched by pivot distances.

Vectors are cut into equal consecutive parts, and every part position has a codebook that two rounds
of assigning and averaging improve. A few pivots of each position never change: the distances of
all parts to them are computed once and stored with the rows. In a round only the distances from pivots
to entries are new; their differences to the stored ones are lower bounds of all part-to-entry distances. A
part tries entries from the lowest bound up, in whole numbers, until the next bound exceeds the best.

A round reads the rows once and shuffles one row of sums for each task, part, entry and component.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage_columns
from barloom.llm.whole_vectors import MOST, as_kind, exact_kind, largest, matrix, whole_rows

PIVOTS = 4
ROUNDS = 2
#: Covers the rounding of distances, as a share of the two whose difference is a bound.
SLACK = 1e-9
LIMB = 32

#: One codebook a part position, each a list of entries of whole numbers.
Codebooks = list[list[list[int]]]


def pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those taken."""
    taken = [0]
    gaps = distances(entries, entries[:1])[:, 0]
    while len(taken) < min(count, len(entries)):
        taken.append(int(np.argmax(gaps)))
        gaps = np.minimum(gaps, distances(entries, entries[taken[-1:]])[:, 0])
    return entries[taken]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded distances of all rows of ``a`` from all rows of ``b``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def nearest(parts: np.ndarray, near: np.ndarray, entries: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, exact squared distance) of each part, ties to the lower entry, and how many distances were computed.

    ``near`` are the distances of parts from pivots, ``between`` those of pivots from entries.
    """
    kind = exact_kind(parts.shape[1] * (largest(parts) + largest(entries)) ** 2)
    own, book = as_kind(parts, kind), as_kind(entries, kind)
    bounds = np.zeros((len(parts), len(entries)))
    with np.errstate(over="ignore", invalid="ignore"):
        for pivot in range(between.shape[0]):
            far, away = near[:, pivot, None], between[pivot]
            gap = np.abs(far - away) - SLACK * (far + away)
            bounds = np.fmax(bounds, np.where(np.isfinite(gap), gap, 0))
        bounds *= bounds
    order = np.argsort(bounds, axis=1, kind="stable")
    best = ((own - book[order[:, 0]]) ** 2).sum(axis=1)
    chosen = order[:, 0].copy()
    computed = len(parts)
    active = np.arange(len(parts))
    for step in range(1, len(entries)):
        tried = order[active, step]
        # a bound equal to the best may still hide a tie with a lower entry
        going = bounds[active, tried] <= best[active].astype(np.float64)
        active, tried = active[going], tried[going]
        if not len(active):
            break
        found = ((own[active] - book[tried]) ** 2).sum(axis=1)
        computed += len(active)
        better = (found < best[active]) | ((found == best[active]) & (tried < chosen[active]))
        at = active[better]
        best[at], chosen[at] = found[better], tried[better]
    return chosen, best, computed


def _as_array(entries: list[list[int]]) -> np.ndarray:
    return np.array(entries, np.float64)


def _parts(raws: list[bytes], count: int, width: int) -> np.ndarray:
    return matrix(raws, count * width)[:, : count * width].reshape(len(raws), count, width)


def _exact_entries(entries: list[list[int]]) -> np.ndarray:
    # averages of doubles need not be doubles: beyond their range entries stay Python integers
    wide = max((abs(x) for e in entries for x in e), default=0) >= 1 << 52
    return np.array(entries, object if wide else np.float64)


def _assigned(batch: pa.RecordBatch, books: Codebooks, fixed: list[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, parts, chosen entries, squared distances) of a batch."""
    count = len(books)
    parts = _parts(batch.column("vector").to_pylist(), count, width)
    near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float64).reshape(len(parts), count, -1)
    for position, (entries, pivot) in enumerate(zip(books, fixed, strict=True)):
        between = distances(pivot, _as_array(entries))
        own = parts[:, position]
        book = _exact_entries(entries)
        # rows with large numbers apart: only they need Python integers
        large = np.abs(own).max(axis=1, initial=0) >= 1 << 24
        chosen = np.zeros(len(own), np.int64)
        errors = np.zeros(len(own), object if large.any() or book.dtype == object else np.float64)
        for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
            if len(rows):
                chosen[rows], errors[rows], _ = nearest(own[rows], near[rows, position], book, between)
        yield position, own, chosen, errors


def _limbs(value: int) -> list[int]:
    """A whole number as digits of ``LIMB`` bits, the last one signed, so that sums of digits fit a long."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _improved(rows: DataFrame, books: Codebooks, fixed: list[np.ndarray], width: int) -> Codebooks:
    """Codebooks of the floored means of the parts that each entry is nearest to; unused entries stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for position, own, chosen, _ in _assigned(batch, books, fixed, width):
                counts = np.bincount(chosen, minlength=len(books[position]))
                if largest(own) * len(own) < 1 << 52:
                    columns = [np.bincount(chosen, own[:, i], len(counts)) for i in range(width)]
                else:
                    columns = [np.zeros(len(counts), object) for _ in range(width)]
                    for i, column in enumerate(columns):
                        np.add.at(column, chosen, as_kind(own[:, i], object))
                for entry in np.flatnonzero(counts):
                    total = totals.setdefault((position, int(entry)), [0] * (width + 1))
                    for i, column in enumerate(columns):
                        total[i] += int(column[entry])
                    total[width] += int(counts[entry])
        out = [(p, e, i, n, limb) for (p, e), total in totals.items() for i, value in enumerate(total) for n, limb in enumerate(_limbs(value))]
        columns = zip(*out, strict=True) if out else [()] * 5
        names = ["position", "entry", "place", "digit", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    partial = rows.select("vector", "near").mapInArrow(sums, "position long, entry long, place long, digit long, value long")
    # as many rows as the codebooks have numbers (times the digits of a sum)
    found: dict[tuple[int, int, int], int] = {}
    for r in partial.groupBy("position", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect():
        key = (r.position, r.entry, r.place)
        found[key] = found.get(key, 0) + (r.value << LIMB * r.digit)
    return [
        [
            [found[p, e, i] // found[p, e, width] for i in range(width)] if (p, e, width) in found else entry
            for e, entry in enumerate(entries)
        ]
        for p, entries in enumerate(books)
    ]


def _near(rows: DataFrame, fixed: list[np.ndarray], width: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts(batch.column("vector").to_pylist(), len(fixed), width)
            near = np.stack([distances(parts[:, p], pivot) for p, pivot in enumerate(fixed)], axis=1)
            yield batch.append_column("near", pa.array([n.tobytes() for n in near], pa.binary()))

    return rows.mapInArrow(measure, "vec_id long, label long, vector binary, near binary")


def _codes(rows: DataFrame, books: Codebooks, fixed: list[np.ndarray], width: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = np.zeros((batch.num_rows, len(books)), np.uint8)
            errors = np.zeros(batch.num_rows, object)
            for position, _, own, error in _assigned(batch, books, fixed, width):
                chosen[:, position] = own
                errors += as_kind(error, object)
            if max(errors, default=0) > MOST:
                raise OverflowError("the squared distance of a vector from its code does not fit 64 bits")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in chosen], pa.string()), pa.array(list(errors), pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return rows.mapInArrow(code, "vec_id long, label long, code string, error long")


def fit_codebooks(rows: DataFrame, parts: int, entries: int) -> tuple[Codebooks, DataFrame, list[np.ndarray], int]:
    """Codebooks of ``rows`` (``vec_id, label, vector``), the rows with their pivot distances, the pivots, a part's width."""
    bytes_ = rows.agg(F.max(F.length("vector"))).first()[0] or 0
    width = max(1, math.ceil(bytes_ / 8 / parts))
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    first = _parts([r.vector for r in seeds], parts, width)
    books = [[[int(x) for x in e] for e in first[:, p]] for p in range(parts)]
    if not seeds:
        return books, rows.withColumn("near", F.lit(b"")), [np.zeros((0, width))] * parts, width
    fixed = [pivots(first[:, p]) for p in range(parts)]
    measured = stage_columns(_near(rows, fixed, width), "codes-rows")
    for _ in range(ROUNDS):
        books = _improved(measured, books, fixed, width)
    return books, measured, fixed, width


def product_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a usable vector.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``. A row takes no part if its vector is null or
    holds a null or non-finite component; components become ``floor(scale * x)``. Codebooks start with
    the vectors of the ``entries`` smallest ids (null ids last, equal ids by their vectors; all rows if
    fewer). Vectors whose length is not that of the longest, or no multiple of ``parts``, count as padded
    with zeros. Repeated rows count and are returned as often as they come; null labels form one
    group; an empty table gives no rows; other columns are ignored. ``code`` has two hexadecimal digits for each
    part (``entries`` is 256 at most), ``error`` is the squared distance from the code's entries,
    ``label_error`` its sum over the rows of one label. Numbers of any size are computed exactly; an error
    outside 64 bits fails the job.
    """
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    rows = stage_columns(whole_rows(own, scale, "vec_id", "label"), "codes-vectors")
    books, measured, fixed, width = fit_codebooks(rows, parts, entries)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = stage_columns(_codes(measured, books, fixed, width), "codes-coded")
    # a table of one row for each label, joined from the right: no window over the rows of a hot label
    by_label = stage_columns(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    by_label = by_label.withColumnRenamed("label", "own_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("own_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
