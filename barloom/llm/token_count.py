"""Token counts of a byte-level vocabulary by heap-driven pair merging, without producing ids.

A text is cut into pieces by the vocabulary's pattern. A piece starts as its bytes in a linked list;
a heap holds the ranks of its adjacent pairs. Popping the lowest rank (leftmost first) merges that
pair and pushes the two pairs it creates; stale entries are skipped. The count of a piece is its
bytes minus its merges. Counts of distinct pieces are remembered in the Python worker.
"""

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import documents, kept, plain_latin, sliced

#: Fixed value: the cutting pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_PIECES = 700_000
#: Plain texts are cut by a cheaper pattern of the built-in module with the same result.
_PLAIN_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies: printable Latin-1
    characters for themselves, the others in order from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairMerger:
    """Counts tokens with the merge ranks of a tokenizers file (byte-level pair encoding)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {c: b for b, c in byte_symbols().items()}
        raw = lambda token: bytes(back[c] for c in token)
        symbols = {bytes([b]): b for b in range(256)}
        #: (left symbol, right symbol) -> (rank, merged symbol); symbols are small integers
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (raw(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            merged = symbols.setdefault(left + right, len(symbols))
            pair = (symbols[left], symbols[right])
            self.ranks.setdefault(pair, (rank, merged))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def merges(self, piece: bytes) -> int:
        """Merges that pair encoding applies to one piece."""
        symbol = list(piece)
        size = len(symbol)
        ranks = self.ranks
        heap = []
        for i in range(size - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found is not None:
                heap.append((found[0], i, found[1], i + 1))
        heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        done = 0
        while heap:
            rank, i, merged, j = heappop(heap)
            left = symbol[i]
            if left < 0 or j >= size or after[i] != j or ranks.get((left, symbol[j]), (-1,))[0] != rank:
                continue
            done += 1
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = ranks.get((merged, symbol[k]))
                if found is not None:
                    heappush(heap, (found[0], i, found[1], k))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], merged))
                if found is not None:
                    heappush(heap, (found[0], h, found[1], i))
        return done

    def count_piece(self, piece: str) -> int:
        raw = piece.encode()
        return len(raw) - self.merges(raw)

    def count(self, text: str) -> int:
        """Tokens of a whole text; an added special token inside it counts one."""
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
        else:
            parts = [text]
        total = len(parts) - 1
        known = self.known
        for part in parts:
            pieces = self.cut(part) if plain_latin(part) is None else _PLAIN_PIECES.findall(part)
            try:
                total += sum(map(known.__getitem__, pieces))
            except KeyError:
                if len(known) > MAX_PIECES:
                    known.clear()
                for piece in pieces:
                    if piece not in known:
                        known[piece] = self.count_piece(piece)
                total += sum(map(known.__getitem__, pieces))
        return total


def pair_merger(path: str) -> PairMerger:
    """The worker's merger of a tokenizers file."""
    return kept(("merges", path), lambda: PairMerger(path))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``; no shuffle.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; other
    columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = pair_merger(tokenizer)
        for batch in sliced(batches):
            tokens = [merger.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([t > limit for t in tokens], pa.bool_()),
                }
            )

    return documents(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
