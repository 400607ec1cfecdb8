"""Hard negatives by rotated one-bit codes with deterministic score intervals.

Vectors are rotated, stand in an order in which similar ones are close, and are cut into cells of
blocks. Against the centre of its block a vector keeps one sign bit a component, the alignment of
that code with the vector, and the length of what the code leaves over. An anchor's rotated vector is cut
into bit planes, so popcounts give its product with every code. As the rest is orthogonal to the
code, Cauchy-Schwarz on the anchor's part orthogonal to the code bounds the rest's share: every score
lies in a known interval. Vectors whose interval cannot reach a place among the wanted ones are
dropped; the others are scored with whole numbers.

A first pass lets every anchor meet the cell it stands in, which fixes a score that its hits
elsewhere must reach. Then every anchor meets every cell in bounded units (cell, group of anchors).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage_columns
from barloom.llm.whole_vectors import LEAST, MOST, as_kind, checked, in_long, matrix, score_kind, whole_rows

BLOCK = 256
#: A cell holds this many vectors and numbers at most.
CELL_VECTORS, CELL_NUMBERS = 8192, 1 << 19
GROUP_ANCHORS = 8192
#: Anchors whose intervals a task holds at a time.
TOGETHER = 128
PLANES = 6
ORDER_BITS = 14
#: Covers the rounding of rotated vectors, as a share of the product of lengths.
SLACK = 1e-9

_CELL = "cell long, ids binary, labels binary, asked binary, marks binary, width int, vectors binary, codes binary, align binary, rest binary, length binary, centres binary"


def rotated(vectors: np.ndarray, size: int) -> np.ndarray:
    """The rows under a fixed rotation of ``size`` (a power of two) dimensions."""
    out = np.zeros((len(vectors), size))
    out[:, : vectors.shape[1]] = vectors
    signs = np.random.RandomState(11).choice([-1.0, 1.0], (3, size))
    for flip in signs:
        out *= flip
        half = 1
        while half < size:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def _bits(positive: np.ndarray) -> np.ndarray:
    """Rows of truth values as 64-bit words."""
    return np.packbits(positive, axis=-1, bitorder="little").view(np.uint64)


@dataclass
class Cell:
    """Vectors with their codes; ``block`` tells each vector's row of ``centres``."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    align: np.ndarray
    rest: np.ndarray
    length: np.ndarray
    centres: np.ndarray
    block: np.ndarray


def coded(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, size: int, block: int = BLOCK) -> Cell:
    turned = rotated(vectors, size)
    of = np.arange(len(ids)) // block
    centres = np.add.reduceat(turned, np.arange(0, len(ids), block), axis=0) / np.bincount(of)[:, None]
    own = turned - centres[of]
    align = np.abs(own).mean(axis=1)
    rest = np.sqrt(np.maximum((own**2).sum(axis=1) - size * align**2, 0))
    length = np.sqrt((own**2).sum(axis=1)) + np.sqrt((centres**2).sum(axis=1))[of]
    return Cell(ids, labels, vectors, _bits(own >= 0), align, rest, length, centres, of)


def intervals(anchors: np.ndarray, cell: Cell) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [anchor, vector] of all inner products; a bound may be NaN where numbers overflow."""
    size = cell.centres.shape[1]
    turned = rotated(anchors, size)
    top = np.abs(turned).max(axis=1, keepdims=True)
    step = np.where(top > 0, 2 * top / (2**PLANES - 1), 1.0)
    level = np.rint((turned + top) / step).astype(np.int64)
    off = np.abs(turned - (level * step - top)).sum(axis=1, keepdims=True)
    counts = np.zeros((len(turned), len(cell.ids)))
    for plane in range(PLANES):
        words = _bits((level >> plane & 1).astype(bool))
        for word in range(words.shape[1]):
            counts += np.bitwise_count(words[:, word, None] & cell.codes[None, :, word]) * float(1 << plane)
    ones = np.bitwise_count(cell.codes).sum(axis=1, dtype=np.int64)
    product = step * (2 * counts - level.sum(axis=1, keepdims=True)) - top * (2 * ones - size)
    square = (turned**2).sum(axis=1, keepdims=True)
    inside = np.maximum(np.abs(product) - off, 0)
    across = np.sqrt(np.maximum(square - inside**2 / size, 0))
    middle = (turned @ cell.centres.T)[:, cell.block] + cell.align * product
    half = cell.align * off + cell.rest * across + SLACK * (np.sqrt(square) * cell.length + 1)
    return middle - half, middle + half


def search_cell(
    anchor_ids: np.ndarray, anchor_labels: np.ndarray, anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray, floors: np.ndarray, cell: Cell, k: int, same: bool
) -> tuple[list[np.ndarray], int]:
    """(anchor row, wish, vec_id, score) of the ``k`` best vectors of the cell for each wish, and how many were scored.

    ``lows, highs, floors`` are [anchor, wish]: a hit of a wish has a score from low to high, of floor
    at least. ``same`` asks for the anchor's label, else for other ones. A wish with low above high has no hits.
    """
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        low, high = intervals(anchors, cell)
    low = np.where(np.isnan(low), -np.inf, low)
    fitting = ((anchor_labels[:, None] == cell.labels) == same) & (anchor_ids[:, None] != cell.ids)
    wanted = []
    for wish in range(lows.shape[1]):
        least, most = lows[:, wish, None].astype(float), highs[:, wish, None].astype(float)
        reach = np.maximum(least, floors[:, wish, None].astype(float))
        if len(cell.ids) > k:
            sure = np.where(fitting & (low >= least) & ~(high > most), low, -np.inf)
            reach = np.maximum(reach, np.partition(sure, -k, axis=1)[:, -k, None])
        wanted.append(fitting & ~(high < reach) & (low <= most) & (lows[:, wish] <= highs[:, wish])[:, None])
    any_wish = np.logical_or.reduce(wanted)
    scores = np.zeros(low.shape, np.int64)
    scored = 0
    starts = np.flatnonzero(np.diff(cell.block, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], len(cell.ids)], strict=True):
        rows = np.flatnonzero(any_wish[:, start:stop].any(axis=1))
        if not len(rows):
            continue
        columns = start + np.flatnonzero(any_wish[rows, start:stop].any(axis=0))
        kind = score_kind(anchors[rows], cell.vectors[columns])
        found = as_kind(anchors[rows], kind) @ as_kind(cell.vectors[columns], kind).T
        scores[np.ix_(rows, columns)] = in_long(found)
        scored += int(any_wish[np.ix_(rows, columns)].sum())
    out = []
    for wish, mask in enumerate(wanted):
        mask &= (scores >= np.maximum(lows, floors)[:, wish, None]) & (scores <= highs[:, wish, None])
        row, place = np.nonzero(mask)
        order = np.lexsort((cell.ids[place], ~scores[row, place], row))  # ~s falls as s rises, and never overflows
        row, place = row[order], place[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, place = row[nth < k], place[nth < k]
        out.append((row, np.full(len(row), wish), cell.ids[place], scores[row, place]))
    return [np.concatenate(c) for c in zip(*out, strict=True)], scored


def _in_chunks(ids, labels, vectors, lows, highs, floors, cell, k, same):
    # large anchors together: only their scores need Python integers
    order = np.argsort(np.abs(vectors).max(axis=1, initial=0), kind="stable")
    for at in range(0, len(order), TOGETHER):
        own = order[at : at + TOGETHER]
        (row, wish, found, score), _ = search_cell(ids[own], labels[own], vectors[own], lows[own], highs[own], floors[own], cell, k, same)
        yield own[row], wish, found, score


def _limit(size: int) -> int:
    return max(BLOCK, min(CELL_VECTORS, CELL_NUMBERS // size // BLOCK * BLOCK))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")


def _percent(score: Column, percent: int, up: int) -> Column:
    """``percent`` hundredths of a score of 0 or more, rounded up with ``up`` 99 and down with 0."""
    rest = F.pmod(score, F.lit(100))
    hundreds = F.call_function("div", score - rest, F.lit(100))
    return hundreds * percent + F.call_function("div", rest * percent + up, F.lit(100))


def _placed(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``place``: vectors of one direction get numbers close to each other."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(ORDER_BITS)[::-1]
        for batch in batches:
            if batch.num_rows:
                turned = rotated(matrix(batch.column("vector").to_pylist()), size)[:, :ORDER_BITS]
                yield batch.append_column("place", pa.array((turned > 0) @ powers, pa.int64()))

    return rows.mapInArrow(place, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "place long"]))


def _cells(rows: DataFrame, size: int) -> DataFrame:
    limit = _limit(size)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= limit:
                table = pa.Table.from_batches(held)
                yield _packed_cell(table.slice(0, limit), made, size)
                made += 1
                held, count = table.slice(limit).to_batches(), count - limit
        if count:
            yield _packed_cell(pa.Table.from_batches(held), made, size)

    ordered = rows.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id", "mark")
    return ordered.drop("place").mapInArrow(build, _CELL)


def _packed_cell(table: pa.Table, number: int, size: int) -> pa.RecordBatch:
    vectors = matrix(table.column("vector").to_pylist())
    labels = table.column("label").to_numpy()
    cell = coded(table.column("vec_id").to_numpy(), labels, vectors, size)
    kept = vectors.astype(np.int16) if np.abs(vectors).max(initial=0) < 1 << 15 else vectors
    asked = np.asarray(table.column("asked").to_pylist(), bool)
    parts = [cell.ids, labels, asked, table.column("mark").to_numpy(), None, kept, cell.codes, cell.align, cell.rest, cell.length, cell.centres]
    names = [c.split(" ")[0] for c in _CELL.split(", ")]
    columns = [pa.array([number], pa.int64())]
    columns += [pa.array([vectors.shape[1]], pa.int32()) if p is None else pa.array([p.tobytes()], pa.binary()) for p in parts]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _unpacked(row: dict, size: int) -> tuple[Cell, np.ndarray, np.ndarray]:
    """The cell of a row, and its asked and mark values."""
    ids = np.frombuffer(row["ids"], np.int64)
    kind = np.int16 if len(row["vectors"]) == 2 * len(ids) * row["width"] else np.float64
    vectors = np.frombuffer(row["vectors"], kind).reshape(len(ids), row["width"]).astype(np.float64)
    of = lambda name, kind=np.float64: np.frombuffer(row[name], kind)
    cell = Cell(
        ids, of("labels", np.int64), vectors, of("codes", np.uint64).reshape(len(ids), -1), of("align"), of("rest"), of("length"),
        of("centres").reshape(-1, size), np.arange(len(ids)) // BLOCK,
    )
    return cell, of("asked", bool), of("marks", np.int64)


def _level(cell: Cell, anchors: np.ndarray) -> np.ndarray:
    """Anchors and cell of one width: shorter vectors count as padded with zeros."""
    width = max(cell.vectors.shape[1], anchors.shape[1])
    cell.vectors = np.pad(cell.vectors, ((0, 0), (0, width - cell.vectors.shape[1])))
    return np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))


def _homes(cells: DataFrame, size: int, k: int) -> DataFrame:
    """``vec_id, mark, cell, floor`` of every anchor: the k-th score of its label within its own cell, if there is one."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cell, asked, marks = _unpacked(row, size)
                at = np.flatnonzero(asked)
                floors = np.full(len(at), LEAST)
                open_ = np.full((len(at), 1), LEAST)
                seen = np.zeros(len(at), np.int64)
                for own, _, _, score in _in_chunks(cell.ids[at], cell.labels[at], cell.vectors[at], open_, np.full_like(open_, MOST), open_, cell, k, True):
                    seen += np.bincount(own, minlength=len(at))
                    last = np.flatnonzero(np.diff(own, append=-1))
                    floors[own[last]] = score[last]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.ids[at]),
                        pa.array(marks[at]),
                        pa.array(np.full(len(at), row["cell"])),
                        pa.array(np.where(seen >= k, floors, LEAST)),
                    ],
                    names=["vec_id", "mark", "cell", "floor"],
                )

    return cells.mapInArrow(search, "vec_id long, mark long, cell long, floor long")


def _hits(left: DataFrame, right: DataFrame, keys: list[str], size: int, k: int, same: bool) -> DataFrame:
    """``vec_id, mark, wish, hit, score``: cells on the left meet anchors on the right that share ``keys``."""
    names = ["vec_id", "mark", "wish", "hit", "score"]

    def search(cells: pa.Table, anchors: pa.Table) -> pa.Table:
        best = [np.zeros(0, np.int64)] * 4
        ids = marks = best[0]
        if cells.num_rows and anchors.num_rows:
            ids, marks, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "mark", "label"))
            vectors = matrix(anchors.column("vector").to_pylist())
            wishes = [_wishes(anchors.column(c).to_pylist(), fill) for c, fill in (("lows", 1), ("highs", 0), ("floors", LEAST))]
            for row in cells.to_pylist():
                cell, _, _ = _unpacked(row, size)
                best = _merged([best, *_in_chunks(ids, labels, _level(cell, vectors), *wishes, cell, k, same)], wishes[2], k)
        own, wish, hit, score = best
        return pa.table([pa.array(c, pa.int64()) for c in (ids[own], marks[own], wish, hit, score)], names=names)

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return pairs.applyInArrow(search, ", ".join(f"{n} long" for n in names))


def _merged(found: list, floors: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` best hits of every (anchor row, wish); raises ``floors`` to the k-th score where there are so many."""
    own, wish, hit, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((hit, ~score, wish, own))
    own, wish, hit, score = own[order], wish[order], hit[order], score[order]
    first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(wish, prepend=-1) != 0))
    nth = np.arange(len(own)) - np.repeat(first, np.diff([*first, len(own)]))
    last = nth == k - 1
    floors[own[last], wish[last]] = np.maximum(floors[own[last], wish[last]], score[last])
    return [c[nth < k] for c in (own, wish, hit, score)]


def _wishes(values: list[list[int]], fill: int) -> np.ndarray:
    width = max(map(len, values))
    return np.array([v + [fill] * (width - len(v)) for v in values], np.int64)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_id", "mark", "wish").orderBy(F.desc("score"), "hit")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows that ``anchors`` selects.

    An anchor's positives are its ``positives`` best other rows of the same label by inner product of
    ``floor(scale * x)``; a positive's negatives are the ``negatives`` best rows of other labels whose
    score is ``low`` to ``high`` percent of the positive's. Ties go to the smaller id.

    ``vectors`` has ``vec_id`` and ``embedding``. Rows with a null id or label, a null vector or a null or
    non-finite component take no part. Shorter vectors count as padded with zeros. Repeated rows of
    one id are no partners of each other, each is a partner of other ids, and as anchors equal ones
    count once. Fewer partners give fewer rows, an empty table none. Other columns are ignored.
    A score outside 64 bits is compared right but fails the job if it belongs to the result.
    """
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where("vec_id is not null and label is not null")
    facts = own.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("vector"))).first()
    size = 64
    while size < (facts[2] or 0):
        size *= 2
    rows = whole_rows(own, scale, "vec_id", "label", "asked").withColumn("mark", F.xxhash64("label", "vector"))
    rows = stage_columns(_placed(rows, size), "negatives-rows")
    cells = stage_columns(_cells(rows, size), "negatives-cells")
    homes = _homes(cells, size, positives).groupBy("vec_id", "mark").agg(F.max("cell").alias("cell"), F.max("floor").alias("floor"))
    asked = rows.where("asked").select("vec_id", "label", "mark", "vector").dropDuplicates(["vec_id", "mark", "label", "vector"])
    asked = stage_columns(asked.join(homes, ["vec_id", "mark"]), "negatives-anchors")
    meets = max(1, -(-facts[0] // (_limit(size) // 2)))
    groups = max(1, -(-facts[1] // GROUP_ANCHORS))

    def everywhere(wishes: DataFrame, k: int, same: bool) -> DataFrame:
        # the anchors against all rows, in blocks: every group of anchors meets every cell once
        left = cells.withColumn("meet", F.pmod(F.xxhash64("cell"), F.lit(meets))).withColumn("part", F.explode(_numbers(groups)))
        right = wishes.withColumn("part", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(groups))).withColumn("meet", F.explode(_numbers(meets)))
        return _best(_hits(left, right, ["meet", "part"], size, k, same), k)

    first = asked.select("*", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"), F.array("floor").alias("floors"))
    found = everywhere(first, positives, True).select(
        "vec_id", "mark", F.col("hit").alias("positive_id"), checked(F.col("score")).alias("positive_score")
    )
    # a negative score has no window; positives of one score share theirs
    same_score = Window.partitionBy("vec_id", "mark").orderBy("positive_score")
    found = stage_columns(found.where("positive_score >= 0").withColumn("wish", F.dense_rank().over(same_score) - 1), "negatives-positives")
    scores = found.groupBy("vec_id", "mark").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    wishes = asked.drop("floor").join(scores, ["vec_id", "mark"]).select(
        *["vec_id", "label", "mark", "vector", "cell"],
        F.transform("scores", lambda s: _percent(s, low, 99)).alias("lows"),
        F.transform("scores", lambda s: _percent(s, high, 0)).alias("highs"),
    )
    wishes = stage_columns(wishes, "negatives-wishes")
    lowest = F.transform("lows", lambda _: F.lit(LEAST))
    at_home = _best(_hits(cells, wishes.withColumn("floors", lowest), ["cell"], size, negatives, False), negatives)
    floors = at_home.where(F.col("rank") == negatives).groupBy("vec_id", "mark").agg(
        F.map_from_entries(F.collect_list(F.struct("wish", "score"))).alias("known")
    )
    floor = F.transform("lows", lambda _, i: F.coalesce(F.try_element_at("known", i.cast("long")), F.lit(LEAST)))
    second = wishes.join(floors, ["vec_id", "mark"], "left").withColumn("floors", floor).drop("known", "cell")
    best = everywhere(second, negatives, False)
    return best.join(found, ["vec_id", "mark", "wish"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("hit").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
