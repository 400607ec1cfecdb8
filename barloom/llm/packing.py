"""Pack documents of any length into training sequences of a few context sizes.

Sizes are powers of two up to the longest (256, 512, 1,024 and 2,048 for 2,048). Every task packs
the documents it reads, pool by pool, so nothing is shuffled and a hot source is as good as any:

1. whole longest windows are cut off a long document; the rest is routed to the smallest size that
   holds it (its tier);
2. from the longest tier down, each window opens with a document of its tier;
3. its gap is filled from shorter documents, always the longest that fits; when none fits, the
   longest one at hand is cut and its rest goes to the tier of its new length. So windows come out
   exactly full;
4. documents that can't fill a window wait for the next pool. The last few of a task are cut into
   shorter full windows, and only what is under the shortest size at the end of a task is padded;
5. sequences are dealt into step groups of about equal attention cost: the costliest first, always
   to the group with the least so far.
"""

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import documents, sliced
from barloom.llm.encoding import piece_encoder

LONGEST, SHORTEST = 2048, 256
#: Tokens of one step group, in longest windows.
STEP_WINDOWS = 16
#: Tokens that a pool holds before it is packed.
POOL_TOKENS = 2_000_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context long, step_group long"
)


class _Waiting:
    """Document rests by length; finds the longest that fits in constant time."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple]] = [[] for _ in range(longest + 1)]
        self.mask = 0
        self.tokens = 0

    def put(self, length: int, item: tuple) -> None:
        self.by_length[length].append(item)
        self.mask |= 1 << length
        self.tokens += length

    def take(self, most: int) -> tuple[int, tuple] | None:
        """The longest item of at most ``most`` tokens."""
        length = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if length < 0:
            return None
        own = self.by_length[length]
        item = own.pop()
        if not own:
            self.mask &= ~(1 << length)
        self.tokens -= length
        return length, item


class TierPacker:
    """Packs a stream of documents; ``pack`` gives finished sequences as lists of (document, start, length)."""

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST):
        if longest & (longest - 1) or shortest & (shortest - 1) or not 0 < shortest <= longest:
            raise ValueError("context sizes are powers of two")
        self.sizes = [s for s in (longest >> k for k in range(longest.bit_length())) if s >= shortest]
        self.longest = longest
        self.waiting = _Waiting(longest)

    def add(self, doc, n_tokens: int) -> Iterator[list[tuple]]:
        start = 0
        while n_tokens - start >= self.longest:
            yield [(doc, start, self.longest)]
            start += self.longest
        if n_tokens > start:
            self.waiting.put(n_tokens - start, (doc, start))

    def _fill(self, size: int, most: int) -> list[tuple]:
        """One full window of ``size`` whose first document has at most ``most`` tokens."""
        gap, pieces = size, []
        while gap:
            found = self.waiting.take(min(gap, most)) or self.waiting.take(self.longest)
            length, (doc, start) = found
            used = min(length, gap)
            pieces.append((doc, start, used))
            if length > used:
                self.waiting.put(length - used, (doc, start + used))
            gap -= used
            most = gap
        return pieces

    def pack(self) -> Iterator[list[tuple]]:
        """Every window that the waiting documents fill, from the longest tier down."""
        for tier, size in enumerate(self.sizes):
            below = self.sizes[tier + 1] if tier + 1 < len(self.sizes) else 0
            # windows of this tier while it has documents of its own; shorter tiers keep theirs
            while self.waiting.tokens >= size and self.waiting.mask >> (below + 1):
                yield self._fill(size, size)

    def rest(self) -> Iterator[list[tuple]]:
        """What is left at the end: full windows of falling size, then one short sequence."""
        for size in self.sizes:
            while self.waiting.tokens >= size:
                yield self._fill(size, size)
        if self.waiting.tokens:
            yield self._fill(self.waiting.tokens, self.longest)


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence, of about ``step_tokens`` tokens and even attention cost (sum of squares)."""
    groups = max(1, round(sum(lengths) / step_tokens))
    load = [(0, 0, g) for g in range(groups)]
    out = [0] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        cost, tokens, group = heapq.heappop(load)
        out[at] = group
        heapq.heappush(load, (cost + lengths[at] ** 2, tokens + lengths[at], group))
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 1,
    longest: int = LONGEST,
    shortest: int = SHORTEST,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """One row for each piece (``PIECES``) of the packed ``docs`` (``doc_id``, ``text``).

    A null text counts as empty and still has ``end_id``; without ``end_id`` an empty document has
    no piece. Repeated rows are packed as documents of their own. Sequence and group numbers hold
    the number of the task in their upper bits. ``context`` is the size a sequence is padded to:
    its own length where that is a power of two, else ``longest``. Other columns are ignored.
    """
    step = STEP_WINDOWS * longest

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        encoder = piece_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        packer = TierPacker(longest, shortest)
        sequences = groups = pooled = 0
        ready: list[list[tuple]] = []

        def emit() -> pa.RecordBatch:
            nonlocal sequences, groups
            lengths = [sum(p[2] for p in own) for own in ready]
            dealt = step_groups(lengths, step)
            rows = []
            for own, length, group in zip(ready, lengths, dealt, strict=True):
                offset = 0
                context = length if length & (length - 1) == 0 else longest
                for (doc_id, raw), start, size in own:
                    crc = zlib.crc32(memoryview(raw)[4 * start : 4 * (start + size)])
                    rows.append((doc_id, start, size, crc, len(raw) // 4, base + sequences, offset, context, base + groups + group))
                    offset += size
                sequences += 1
            groups += max(dealt, default=-1) + 1
            ready.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            names = [c.split(" ")[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in sliced(batches):
            raws = encoder.encode(batch.column("text").to_pylist())
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws, strict=True):
                raw += end
                ready.extend(packer.add((doc_id, raw), len(raw) // 4))
                pooled += len(raw) // 4
            if pooled >= pool_tokens:
                ready.extend(packer.pack())
                pooled = 0
                yield emit()
        ready.extend(packer.pack())
        ready.extend(packer.rest())
        yield emit()

    return documents(docs).mapInArrow(pack, PIECES)
