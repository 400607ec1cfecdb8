"""Encode texts chunk by chunk, encoding chunks shared between documents once, and decode them again.

* A rolling hash over the UTF-8 bytes decides where a text is cut, so equal passages give equal
  chunks wherever they stand.
* Documents are range-partitioned by (smallest chunk hash, doc_id). Documents that share that chunk
  meet in one task, or in neighbouring ones where they are too many for one: a hot group is split
  by doc_id, never gathered. A task encodes each distinct chunk once.
* A cut may split a word, so ids at a join can be wrong. The join is re-encoded over a window of
  words around it, widened until the window's outer words have exactly the ids that the two chunks
  have there; with no such window the whole text is encoded as one.
"""

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from barloom.llm.common import documents, sliced
from barloom.llm.encoding import PieceEncoder, piece_encoder

WINDOW = 16
#: A cut every 1,024 bytes on average, none closer than 256 bytes to the one before.
CUT_BITS, LEAST_BYTES = 10, 256
#: Bytes of ids a task remembers for chunks; the least recently used go first.
CACHE_BYTES = 24_000_000
_BASE = np.uint32(0x01000193)


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """Polynomial hash of the ``WINDOW`` bytes that end at each byte (fewer at the start)."""
    h = raw.astype(np.uint32) + np.uint32(1)
    step, factor = 1, _BASE
    while step < WINDOW:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] * factor
        h = h + shifted
        with np.errstate(over="ignore"):
            factor = factor * factor
        step *= 2
    return h


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of a UTF-8 text, the last one at its length; none inside a character."""
    n = len(raw)
    if n <= LEAST_BYTES:
        return [n]
    mixed = rolling_hash(raw) * np.uint32(2654435761)
    found = np.flatnonzero(mixed >> np.uint32(32 - CUT_BITS) == 0) + 1
    found = found[found < n]
    found = found[raw[found] & 0xC0 != 0x80]
    ends, last = [], 0
    for end in found.tolist():
        if end - last >= LEAST_BYTES and n - end >= LEAST_BYTES:
            ends.append(end)
            last = end
    return [*ends, n]


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(np.frombuffer(raw, np.uint8))
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _anchor(raw: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return min(xxh3_64_intdigest(c) for c in chunks(raw)) - (1 << 63)


class ChunkEncoder:
    def __init__(self, encoder: PieceEncoder, cache_bytes: int = CACHE_BYTES):
        self.encoder, self.cache_bytes = encoder, cache_bytes
        self.known: OrderedDict[bytes, bytes] = OrderedDict()
        self.held = 0
        self.encoded = 0  # chunks that were really encoded

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (packed) of each UTF-8 text."""
        parts = [chunks(t) for t in texts]
        ids = self._chunk_ids({c for own in parts for c in own})
        return [self._join(own, [ids[c] for c in own]) for own in parts]

    def _chunk_ids(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        found = {}
        new = []
        for chunk in wanted:
            own = self.known.get(chunk)
            if own is None:
                new.append(chunk)
            else:
                self.known.move_to_end(chunk)
                found[chunk] = own
        self.encoded += len(new)
        for chunk, ids in zip(new, self.encoder.encode([c.decode() for c in new]), strict=True):
            found[chunk] = self.known[chunk] = ids
            self.held += len(ids) + len(chunk)
        while self.held > self.cache_bytes:
            chunk, ids = self.known.popitem(last=False)
            self.held -= len(ids) + len(chunk)
        return found

    def _join(self, parts: list[bytes], ids: list[bytes]) -> bytes:
        if len(parts) == 1:
            return ids[0]
        ids = list(ids)
        for at in range(len(parts) - 1):
            mended = self._mend(parts[at], ids[at], parts[at + 1], ids[at + 1])
            if mended is None:
                return self.encoder.encode([b"".join(parts).decode()])[0]
            ids[at], ids[at + 1] = mended
        return b"".join(ids)

    def _mend(self, left: bytes, left_ids: bytes, right: bytes, right_ids: bytes) -> tuple[bytes, bytes] | None:
        """The two id strings with the join put right, or None without an agreeing window."""
        words = 1
        while True:
            outer, inner = _last_spaces(left, words)
            near, far = _first_spaces(right, words)
            if outer < 0 or far < 0:
                return None
            context, tail = left[outer:inner], left[inner:]
            head, follow = right[:near], right[near:far]
            window, a, b, ab, cd = self.encoder.encode(
                [t.decode() for t in (context + tail + head + follow, context, follow, context + tail, head + follow)]
            )
            if (
                window.startswith(a)
                and window.endswith(b)
                and len(window) >= len(a) + len(b)
                and left_ids.endswith(ab)
                and right_ids.startswith(cd)
            ):
                return left_ids[: len(left_ids) - len(ab)] + window, right_ids[len(cd) :]
            words *= 2


def _last_spaces(raw: bytes, words: int) -> tuple[int, int]:
    """(start of ``words`` whole words before the last space, that space); -1 if there are fewer."""
    inner = at = raw.rfind(b" ")
    for _ in range(words):
        at = raw.rfind(b" ", 0, at) if at > 0 else -1
    return at, inner


def _first_spaces(raw: bytes, words: int) -> tuple[int, int]:
    near = at = raw.find(b" ")
    for _ in range(words):
        at = raw.find(b" ", at + 1) if at >= 0 else -1
    return near, at


def decode(encoder: PieceEncoder, ids: bytes) -> str:
    """As the library's ``decode(ids, skip_special_tokens=False)`` of a vocabulary without a decoder:
    the tokens with a space between them (unknown ids are passed over)."""
    if encoder.spaced:
        return encoder.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    tokens = encoder.tokens
    return " ".join([t for t in map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()) if t is not None])


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, decoded`` as digests: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row.

    A null text counts as empty; repeated rows give repeated results; other columns are ignored.
    """

    def digests(raws: list[bytes], coder: ChunkEncoder):
        for ids in coder.encode(raws):
            text = decode(coder.encoder, ids)
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _through_chunks(docs, tokenizer, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row."""

    def lists(raws: list[bytes], coder: ChunkEncoder):
        for ids in coder.encode(raws):
            yield (np.frombuffer(ids, "<u4").tolist(),)

    return _through_chunks(docs, tokenizer, lists, "ids array<int>")


def _through_chunks(docs: DataFrame, tokenizer: str, results, columns: str) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches):
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array([_anchor(r) for r in raws], pa.int64()),
                    "doc_id": batch.column("doc_id"),
                    "body": pa.array([squeeze(r) for r in raws], pa.binary()),
                }
            )

    names = [c.split(" ")[0] for c in columns.split(", ")]
    schema = f"doc_id long, {columns}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = zstandard.ZstdDecompressor().decompress
        coder = ChunkEncoder(piece_encoder(tokenizer))
        for batch in sliced(batches, "body"):
            rows = list(results([restore(b) for b in batch.column("body").to_pylist()], coder))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], _arrow(columns.split(", ")[i])) for i in range(len(names)))],
                names=["doc_id", *names],
            )

    placed = documents(docs).mapInArrow(place, "anchor long, doc_id long, body binary")
    return placed.repartitionByRange("anchor", "doc_id").mapInArrow(encode, schema)


def _arrow(column: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[column.split(" ")[1]]
