"""Exact encoding and decoding with a merge-type piece vocabulary, by backtracking.

Merging repeats the best-scored adjacent pair (leftmost first) until none is left. Its result is the
only sequence of pieces in which every two neighbours stay as they are when their joined text is
merged again. So a word is read from the left: a place takes the longest piece that starts there
(all pieces of all places come from one Aho-Corasick pass over the reversed word) and that fits the
piece before it, checked by re-merging the two. Where nothing fits, the last piece is taken back and
the place is noted in a bit field: a prefix has one encoding only, so a failed place stays failed.

No piece of such a vocabulary goes on with a word mark after another character (checked on loading),
so words are encoded one by one and a Python worker remembers those it met.
"""

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import documents, kept, sliced

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters that line up words of different lines; split there before a word is looked up again.
_LINES = re.compile(r"[^\n]+|\n+")
MAX_WORDS = 350_000
MAX_PAIRS = 400_000


class PieceCoder:
    """Encodes and decodes with the pieces and scores of a sentencepiece model file.

    The model must be of the merge type, fall back to bytes and have no user-defined pieces.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.shown: list[str] = []
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                self.shown.append("")
                continue
            if self.library.is_byte(i):
                self.shown.append("")
                self.bytes[i] = int(piece[1:-1], 16)
                continue
            self.shown.append(piece.replace(MARK, " "))
            self.ids[piece] = i
            self.scores[piece] = -self.library.get_score(i)
        for piece in self.ids:
            # lengths of the pieces that start where this one does, longest first; a character alone always may
            lengths = [n for n in range(len(piece), 1, -1) if piece[:n] in self.ids]
            self.automaton.add_word(piece[::-1], (*lengths, 1))
        self.automaton.make_automaton()
        self.of_byte = {b: i for i, b in self.bytes.items()}
        if len(self.of_byte) < 256:
            raise ValueError(f"{path} has no pieces for all bytes")
        self.names = [str(i) for i in range(size)]
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.by_line = not any("\n" in piece for piece in self.ids)
        #: word without its mark, or any other stretch -> ids
        self.plain: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces (or single characters) that merging leaves of a text."""
        symbol = list(text)
        size = len(symbol)
        scores = self.scores
        heap = []
        for i in range(size - 1):
            joined = symbol[i] + symbol[i + 1]
            if joined in scores:
                heap.append((scores[joined], i, joined, i + 1))
        heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        while heap:
            _, i, joined, j = heappop(heap)
            if not symbol[i] or j >= size or after[i] != j or symbol[i] + symbol[j] != joined:
                continue
            symbol[i], symbol[j] = joined, ""
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                more = joined + symbol[k]
                if more in scores:
                    heappush(heap, (scores[more], i, more, k))
            h = before[i]
            if h >= 0:
                more = symbol[h] + joined
                if more in scores:
                    heappush(heap, (scores[more], h, more, i))
        return [s for s in symbol if s]

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbours stay as they are when merged again (``left`` empty: the first piece)."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return found

    def pieces(self, word: str) -> list[str]:
        """The pieces of one word by backtracking."""
        size = len(word)
        # the automaton reports the longest piece of a place first, so in reverse order that one stays
        starts = dict(reversed(list(self.automaton.iter(word[::-1]))))
        failed = bytearray((size >> 3) + 1)
        taken: list[str] = []
        choices: list[int] = []
        at, choice, last = 0, 0, ""
        pairs = self.pairs
        while at < size:
            own = starts.get(size - 1 - at, (1,))
            while choice < len(own):
                end = at + own[choice]
                if not failed[end >> 3] >> (end & 7) & 1:
                    token = word[at:end]
                    good = pairs.get((last, token))
                    if self.fits(last, token) if good is None else good:
                        break
                choice += 1
            if choice < len(own):
                taken.append(token)
                choices.append(choice)
                at, choice, last = end, 0, token
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(taken.pop())
                choice = choices.pop() + 1
                last = taken[-1] if taken else ""
        return taken

    def _word_ids(self, word: str) -> tuple[int, ...]:
        if not self.by_line or "\n" not in word:
            return self._part_ids(word)
        return tuple(chain.from_iterable(map(self._part_ids, _LINES.findall(word))))

    def _part_ids(self, part: str) -> tuple[int, ...]:
        found = self.words.get(part)
        if found is None:
            try:
                found = tuple([self.ids[piece] for piece in self.pieces(part)])
            except KeyError:
                found = tuple(chain.from_iterable([self._piece_ids(piece) for piece in self.pieces(part)]))
            if len(self.words) < MAX_WORDS:
                self.words[part] = found
        return found

    def _piece_ids(self, piece: str) -> list[int]:
        own = self.ids.get(piece)
        return [own] if own is not None else [self.of_byte[b] for b in piece.encode()]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without begin or end."""
        normal = self.library.normalize(text)
        if not normal:
            return []
        if not self.by_word:
            return list(self._word_ids(normal))
        if normal[0] == MARK and MARK * 2 not in normal:
            words = normal[1:].split(MARK)
            plain = self.plain
            try:
                return list(chain.from_iterable(map(plain.__getitem__, words)))
            except KeyError:
                new = {w: self._word_ids(MARK + w) for w in set(words).difference(plain)}
                if len(plain) + len(new) <= MAX_WORDS:
                    plain.update(new)
                    return list(chain.from_iterable(map(plain.__getitem__, words)))
                return list(chain.from_iterable([new[w] if w in new else plain[w] for w in words]))
        return list(chain.from_iterable(map(self._word_ids, _WORDS.findall(normal))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces side by side, runs of byte pieces read as UTF-8, marks as spaces, the
        space in front of the first piece dropped; control ids have no text."""
        if self.bytes.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                byte = self.bytes.get(i)
                if byte is not None:
                    run.append(byte)
                    continue
                if run:
                    parts.append(run.decode(errors="replace"))
                    run.clear()
                parts.append(self.shown[i])
            parts.append(run.decode(errors="replace"))
            text = "".join(parts)
        return text[1:] if text[:1] == " " else text


def piece_coder(path: str) -> PieceCoder:
    """The worker's coder of a model file."""
    return kept(("merge pieces", path), lambda: PieceCoder(path))


def encode_and_decode(docs: DataFrame, model: str, end_id: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: digests of the ids in decimal, joined
    by spaces, and of the text decoded from them.

    ``end_id`` (default: the model's) is put behind the ids of every row. A null text counts as
    empty and has the end id alone; repeated rows give repeated results, an empty table none; ids
    may be null or repeat; other columns are ignored. Texts of any length are encoded whole.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        end = coder.library.eos_id() if end_id is None else end_id
        for batch in sliced(batches):
            counts, digests, texts = [], [], []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text)
                ids.append(end)
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(coder.names.__getitem__, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(digests, pa.string()),
                    "decoded_sha256": pa.array(texts, pa.string()),
                }
            )

    return documents(docs).mapInArrow(code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` (array of int, without begin or end) of every row; rows as in ``encode_and_decode``."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        for batch in sliced(batches):
            ids = [coder.encode(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(code, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids decode to a null text, an unknown id fails."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(code, "doc_id long, text string")
