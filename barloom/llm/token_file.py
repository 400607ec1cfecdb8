"""Token-id files of patched frame-of-reference blocks.

A corpus becomes a folder of shards in ascending ``doc_id`` order. A shard is one binary value that
can be read alone: a header, the document table, the block index and the blocks.

Layout of a shard, all integers little-endian:

* header, 8 x uint32: magic, block length B, documents D, ids N (low, high), blocks K, payload words P (low, high)
* document table: int64[D] doc_id, uint8[D] 1 where doc_id is null (padded to 8 bytes), uint64[D] ids of the document
* block index: uint64[K] word at which each block starts
* payload, uint32 words. A block holds B ids (the last of a shard maybe fewer): its minimum, then
  ``width | exceptions << 8``, then ids minus minimum packed at ``width`` bits, then the exceptions'
  positions (two uint16 to a word) and their full differences.

``width`` is the smallest number of bits that holds the chosen percentile of the block's
differences; larger ones are stored in the exception list and their low bits are packed as usual.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import documents, sliced
from barloom.llm.encoding import piece_encoder
from barloom.session import fresh_path

MAGIC = 0x52464650
BLOCK = 128
PERCENTILE = 90.0
#: Ids after which a shard is closed (a longer document has a shard of its own).
SHARD_IDS = 1 << 18


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(payload words, first word of each block) of an array of ids."""
    full = len(ids) // block
    payload, starts = _pack_rows(ids[: full * block].reshape(full, block).astype(np.uint32), percentile)
    if len(ids) > full * block:
        tail, _ = _pack_rows(ids[None, full * block :].astype(np.uint32), percentile)
        payload, starts = np.concatenate([payload, tail]), np.append(starts, len(payload))
    return payload, starts.astype(np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    """Binary digits of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack_rows(table: np.ndarray, percentile: float) -> tuple[np.ndarray, np.ndarray]:
    """The blocks in the rows of ``table``, one after the other, and their first words."""
    rows, length = table.shape
    if not rows:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    low = table.min(axis=1)
    diffs = table - low[:, None]
    rank = min(length - 1, int(np.ceil(length * percentile / 100)) - 1)
    widths = _bits(np.partition(diffs, rank, axis=1)[:, rank])
    outliers = (diffs.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    exceptions = outliers.sum(axis=1)
    words = -(-length * widths // 32)
    half = -(-exceptions // 2)
    sizes = 2 + words + half + exceptions
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), "<u4")
    payload[starts] = low
    payload[starts + 1] = widths | exceptions << 8
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        packed = _pack_bits(diffs[own], width)
        payload[(starts[own] + 2)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(outliers)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    after = starts[row] + 2 + words[row]
    payload.view("<u2")[2 * after + nth] = place
    payload[after + half[row] + nth] = diffs[row, place]
    return payload, starts


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of the values of each row, side by side in 32-bit words."""
    rows, length = values.shape
    n_words = -(-length * width // 32)
    columns = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    sums = np.zeros((n_words + 1, rows), np.uint64)
    for k in range(length):
        word, shift = divmod(k * width, 32)
        sums[word] |= columns[k] << np.uint64(shift)
    sums[1:] |= sums[:-1] >> np.uint64(32)
    return (sums[:n_words] & np.uint64(0xFFFFFFFF)).astype("<u4").T


def _unpack_bits(words: np.ndarray, width: int, length: int) -> np.ndarray:
    """[row, value] from the words of each row."""
    columns = np.zeros((words.shape[1] + 1, len(words)), np.uint64)
    columns[:-1] = words.T
    columns[:-1] |= columns[1:] << np.uint64(32)
    out = np.empty((length, len(words)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(length):
        word, shift = divmod(k * width, 32)
        out[k] = (columns[word] >> np.uint64(shift)) & mask
    return out.T


def unpack_block(words: np.ndarray, length: int) -> np.ndarray:
    """Ids of one block, whose words may be followed by others."""
    low, width, exceptions = int(words[0]), int(words[1]) & 0xFF, int(words[1]) >> 8
    n_words = -(-length * width // 32)
    ids = _unpack_bits(words[None, 2 : 2 + n_words], width, length)[0] if width else np.zeros(length, np.uint32)
    if exceptions:
        at = 2 + n_words
        half = -(-exceptions // 2)
        where = words[at : at + half].view("<u2")[:exceptions]
        ids = ids.copy()
        ids[where] = words[at + half : at + half + exceptions]
    return ids + np.uint32(low)


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    payload, starts = pack_blocks(ids, block)
    n, p = len(ids), len(payload)
    head = np.array([MAGIC, block, len(doc_ids), n & 0xFFFFFFFF, n >> 32, len(starts), p & 0xFFFFFFFF, p >> 32], "<u4")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [
            head.tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.pad(nulls, (0, -len(nulls) % 8)).tobytes(),
            np.array(counts, "<u8").tobytes(),
            starts.astype("<u8").tobytes(),
            payload.astype("<u4").tobytes(),
        ]
    )


class Shard:
    """A shard opened for reading: any range of ids through the block index."""

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, "<u4", 8)
        if head[0] != MAGIC:
            raise ValueError("not a token shard")
        self.block, docs = int(head[1]), int(head[2])
        self.n_ids, blocks = int(head[3]) | int(head[4]) << 32, int(head[5])
        at = 32
        own = np.frombuffer(raw, "<i8", docs, at).tolist()
        at += 8 * docs
        nulls = np.frombuffer(raw, np.uint8, docs, at)
        at += docs + -docs % 8
        self.doc_ids = [None if null else d for d, null in zip(own, nulls, strict=True)]
        self.counts = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.starts = np.frombuffer(raw, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        self.payload = np.frombuffer(raw, "<u4", (int(head[6]) | int(head[7]) << 32), at)

    def read(self, start: int, length: int) -> np.ndarray:
        if not length:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + length - 1) // self.block
        found = [
            unpack_block(self.payload[self.starts[k] :], min(self.block, self.n_ids - k * self.block))
            for k in range(first, last + 1)
        ]
        return np.concatenate(found)[start - first * self.block :][:length]

    def read_all(self) -> np.ndarray:
        """All ids, whole blocks of one width at a time."""
        out = np.zeros(len(self.starts) * self.block, np.uint32)
        full = self.n_ids // self.block
        heads = self.payload[self.starts[:full] + 1]
        widths, exceptions = heads & 0xFF, heads >> 8
        table = out[: full * self.block].reshape(full, self.block)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            n_words = -(-self.block * width // 32)
            if width:
                words = self.payload[(self.starts[rows] + 2)[:, None] + np.arange(n_words)]
                table[rows] = _unpack_bits(words, width, self.block)
            many = exceptions[rows].astype(np.int64)
            row = np.repeat(rows, many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            after = self.starts[row] + 2 + n_words
            place = self.payload.view("<u2")[2 * after + nth]
            table[row, place] = self.payload[after + np.repeat(-(-many // 2), many) + nth]
        table += self.payload[self.starts[:full]][:, None]
        if full < len(self.starts):
            rest = self.n_ids - full * self.block
            out[full * self.block :][:rest] = unpack_block(self.payload[self.starts[full] :], rest)
        return out[: self.n_ids]


_SHARDS = "part int, shard int, n_ids long, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Write the shards of ``docs`` (``doc_id``, ``text``) in ascending ``doc_id`` order to ``path``.

    Rows are range-partitioned and sorted by ``doc_id`` (text orders repeated ids, null ids come
    first), so a shard needs nothing from another task. Null texts count as empty; ``end_id`` is
    appended to every document. An empty table gives an empty folder.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder = piece_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        raws: list[bytes] = []
        size = 0

        def close():
            ids = np.frombuffer(b"".join(raws), "<u4")
            data = write_shard(doc_ids, [len(r) // 4 for r in raws], ids)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_ids": [len(ids)], "data": [data]}
            )

        for batch in sliced(batches):
            own = batch.column("doc_id").to_pylist()
            for doc_id, raw in zip(own, encoder.encode(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(doc_id)
                raws.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= SHARD_IDS:
                    yield close()
                    doc_ids, raws, size, shard = [], [], 0, shard + 1
        if doc_ids:
            yield close()

    placed = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(encode, _SHARDS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a folder of shards: ``doc_id, start, n_tokens, ids_crc32``, checksums over ids read back."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("data")[row].as_py())
                raw = memoryview(shard.read_all().astype("<u4").tobytes())
                stops = np.cumsum(shard.counts)
                starts = stops - shard.counts
                many = len(starts)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([batch.column("part")[row].as_py()] * many, pa.int32()),
                        "shard": pa.array([batch.column("shard")[row].as_py()] * many, pa.int32()),
                        "doc_id": pa.array(shard.doc_ids, pa.int64()),
                        "at": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(shard.counts, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    shards = spark.read.schema(_SHARDS).parquet(path)
    # one row for each task that wrote, then the shards of that task: small windows over a summary
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        shards.select("part", "shard", "n_ids")
        .withColumn("shard_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(totals, "part")
        .select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("first"))
    )
    rows = shards.mapInArrow(decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "shard"], "left").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_index(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared staging area and read it back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-shards")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
