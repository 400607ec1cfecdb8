"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are put into an order in which similar ones stand together and cut into range blocks. A
block keeps its vectors (forward index) and the largest and smallest value of every component. For
a query, the component-wise best of those sums to a bound of all scores in the block; blocks are
scored from the highest bound down until the next bound is below the query's k-th score.

Blocks and queries meet in cells: a cell holds a bounded number of vectors, a query group a bounded
number of queries, and every (cell, group) is one task-sized unit. Each yields k rows a query at
most, and those are ranked in a second, small step.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.whole_vectors import LEAST, MOST, as_kind, checked, in_long, largest, matrix, score_kind, whole_vectors

BLOCK = 256
CELL_VECTORS = 8192
GROUP_QUERIES = 8192
ORDER_BITS = 14
#: Covers the rounding of bounds, as a share of the sum of their terms' sizes.
SLACK = 1e-9
NONE = MOST


def _whole(df: DataFrame, scale: int, ordered: bool) -> DataFrame:
    """``vec_id, vector`` (whole components as packed 64-bit floats), and ``code`` to order by."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, raws, codes = [], [], []
            for vec_id, own in zip(batch.column("vec_id").to_pylist(), whole_vectors(batch.column("vector").to_pylist(), scale), strict=True):
                if own is None or vec_id is None:
                    continue
                ids.append(vec_id)
                raws.append(own.tobytes())
                if ordered:
                    d = len(own)
                    if d not in axes:
                        axes[d] = np.random.RandomState(7 + d).standard_normal((ORDER_BITS, d))
                    bits = (axes[d] @ own > 0).astype(np.int64)
                    codes.append(int(bits @ (1 << np.arange(ORDER_BITS)[::-1])))
            columns = [pa.array(ids, pa.int64()), pa.array(raws, pa.binary())]
            if ordered:
                columns.append(pa.array(codes, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "code"][: len(columns)])

    return df.mapInArrow(convert, "vec_id long, vector binary" + ", code int" * ordered)


def _blocks(whole: DataFrame, block: int) -> DataFrame:
    """One row for each range block: ids and vectors, padded with zeros to one length."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 33, 0
        ids: list[int] = []
        raws: list[bytes] = []

        def close(n: int):
            nonlocal made
            made += 1
            vectors = matrix(raws[:n])
            small = largest(vectors) < 1 << 15
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([base + made], pa.int64()),
                    "ids": pa.array([np.array(ids[:n], np.int64).tobytes()], pa.binary()),
                    "width": pa.array([vectors.shape[1]], pa.int32()),
                    "vectors": pa.array([vectors.astype(np.int16 if small else np.float64).tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            ids.extend(batch.column("vec_id").to_pylist())
            raws.extend(batch.column("vector").to_pylist())
            while len(ids) >= block:
                yield close(block)
                del ids[:block], raws[:block]
        if ids:
            yield close(len(ids))

    ordered = whole.repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id")
    return ordered.select("vec_id", "vector").mapInArrow(build, "block long, ids binary, width int, vectors binary")


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def search_blocks(
    query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) [query, k] of the best vectors in ``blocks``, and how many scores were computed.

    Ties go to the smaller id; places without a vector have the id ``NONE``. Vectors with the query's own
    id are left out.
    """
    n, queries = len(queries), np.asarray(queries, np.float64)
    high = np.array([v.max(axis=0) for _, v in blocks])
    low = np.array([v.min(axis=0) for _, v in blocks])
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = above @ high.T + below @ low.T
        # rounded sums: never below the true bound
        bounds += SLACK * (above @ np.abs(high).T - below @ np.abs(low).T)
    bounds[np.isnan(bounds)] = np.inf
    order = np.argsort(-bounds, axis=1, kind="stable")
    best_ids = np.full((n, k), NONE, np.int64)
    best = np.full((n, k), LEAST, np.int64)
    active = np.arange(n)
    scored = 0
    for step in range(len(blocks)):
        at = order[active, step]
        # a bound equal to the k-th score may still hide a tie with a smaller id
        going = (bounds[active, at] >= best[active, -1]) | (best_ids[active, -1] == NONE)
        active, at = active[going], at[going]
        if not len(active):
            break
        for number in np.unique(at):
            rows = active[at == number]
            ids, vectors = blocks[number]
            scores = _scores(queries[rows], vectors)
            scored += scores.size
            places = np.broadcast_to(ids, scores.shape)
            mine = places == query_ids[rows, None]
            all_ids = np.concatenate([best_ids[rows], np.where(mine, NONE, places)], axis=1)
            all_scores = np.concatenate([best[rows], np.where(mine, LEAST, scores)], axis=1)
            pick = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~s falls as s rises, and never overflows
            best_ids[rows] = np.take_along_axis(all_ids, pick, axis=1)
            best[rows] = np.take_along_axis(all_scores, pick, axis=1)
    return best_ids, np.where(best_ids != NONE, best, 0), scored


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products, held at the ends of a long; only rows with large numbers need slower types."""
    out = np.empty((len(queries), len(vectors)), np.int64)
    for rows in _by_size(queries):
        for columns in _by_size(vectors):
            kind = score_kind(queries[rows], vectors[columns])
            out[np.ix_(rows, columns)] = in_long(as_kind(queries[rows], kind) @ as_kind(vectors[columns], kind).T)
    return out


def _by_size(vectors: np.ndarray) -> list[np.ndarray]:
    large = np.abs(vectors).max(axis=1, initial=0) >= 1 << 20
    return [rows for rows in (np.flatnonzero(~large), np.flatnonzero(large)) if len(rows)]


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best other rows for each row that ``queries`` selects.

    ``vectors`` has ``vec_id`` and ``embedding``. A vector takes no part if it or its id is null or if a
    component is null or not finite. Numbers of any size are computed exactly; a score outside 64 bits
    is ranked right and fails the job if it belongs to the result. Shorter vectors count as padded with zeros. Of rows that repeat a
    ``vec_id`` each is a candidate for other ids; as queries, equal ones count once. Fewer than
    ``k`` candidates give as many rows; an empty table gives none. Other columns are ignored.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), queries.alias("asked"))
    asked = _whole(own.where("asked").select("vec_id", "vector"), scale, ordered=False).distinct()
    whole = _whole(own.select("vec_id", "vector"), scale, ordered=True)
    size = own.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    cells = max(1, -(-size[0] // CELL_VECTORS))
    groups = max(1, -(-size[1] // GROUP_QUERIES))
    # the query set against all rows, in blocks: every query group meets every cell once
    left = _blocks(whole, block).select(
        F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
        "ids",
        "width",
        "vectors",
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(groups)).cast("int").alias("part"),
        "vec_id",
        "vector",
    )

    def search(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "query", "vec_id", "score"]
        if not blocks.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        found = matrix(queries.column("vector").to_pylist())
        query_ids = queries.column("vec_id").to_numpy()
        widths = blocks.column("width").to_pylist()
        width = max(found.shape[1], *widths)
        own_blocks = []
        for ids, w, raw in zip(blocks.column("ids").to_pylist(), widths, blocks.column("vectors").to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            kind = np.int16 if len(raw) == 2 * len(ids) * w else np.float64
            own_blocks.append((ids, _widened(np.frombuffer(raw, kind).reshape(len(ids), w).astype(np.float64), width)))
        out = []
        for at in range(0, len(found), 512):
            ids, scores, _ = search_blocks(query_ids[at : at + 512], _widened(found[at : at + 512], width), own_blocks, k)
            row, place = np.nonzero(ids != NONE)
            out.append((query_ids[at : at + 512][row], _hashes(found[at : at + 512])[row], ids[row, place], scores[row, place]))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    hits = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(
        search, "query_id long, query long, vec_id long, score long"
    )
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", checked(F.col("score")).alias("score"))


def _hashes(vectors: np.ndarray) -> np.ndarray:
    """Tells queries apart that share an id but not their vector."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(v.tobytes()) >> 1 for v in vectors], np.int64)
