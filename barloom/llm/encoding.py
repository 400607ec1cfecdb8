"""Encode many texts with a tokenizers file, asking the library once for each distinct piece.

Both vocabularies cut a text into pieces first and then encode every piece on its own. Where a text
holds only plain Latin characters, the cuts are known: around runs of letters, with the space in
front of a run part of it in the byte-level vocabulary and dropped in the word vocabulary. Ids of
distinct pieces are remembered in the Python worker. Any other text goes to the library whole, so
results always equal the library's. For the byte-level vocabulary the texts of a call are cut together
as one array of bytes, and a piece is looked up once a call.
"""

import os
import re
from array import array
from itertools import chain, compress

import numpy as np
import pyarrow as pa

from barloom.llm.common import kept, plain_latin

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of letters, the rest of a word from an apostrophe on (contractions), or a run of other characters.
_WORD_PIECES = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}\s]*'\S*|[^{_LETTERS}\s]+")
#: Pieces that the word vocabulary never cuts again.
_ONE_WORD = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}\s0-9']+")
_AMBIGUOUS_SPACE = (b"  ", b"\n\n", b" \n", b"\n ")
_NEWLINE = "\n"
#: Of each Latin-1 byte of a plain text: letter, other character, space, line feed.
_LETTER, _OTHER, _SPACE, _LINE = range(4)
_KINDS = bytes({" ": _SPACE, "\n": _LINE}.get(c, _LETTER if re.match(rf"[{_LETTERS}]", c) else _OTHER) for c in map(chr, range(256)))


def cut_pieces(data: bytes, firsts: np.ndarray) -> np.ndarray:
    """First byte of each piece of the byte-level vocabulary in plain texts that stand side by side, themselves from ``firsts`` on.

    Pieces are line feeds, runs of letters, runs of other characters, and from an apostrophe on the rest of
    a word with the other characters before it (contractions); the space in front is part of a piece.
    """
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
    cut = np.ones(len(kinds), bool)
    cut[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE)
    cut[firsts[firsts < len(kinds)]] = True
    starts = np.flatnonzero(cut)
    if b"'" in data:
        quotes = np.flatnonzero(np.frombuffer(data, np.uint8) == ord("'"))
        breaks = np.union1d(firsts, np.flatnonzero(kinds >= _SPACE))
        quote = np.append(-1, quotes)[np.searchsorted(quotes, starts)]
        starts = starts[quote < breaks[np.searchsorted(breaks, starts, "right") - 1]]
    return starts


class BytePieces:
    """Ids of plain texts in a byte-level vocabulary, from those of their distinct pieces.

    Ids of known pieces stand side by side, those of slot k from ``stops[k]`` to ``stops[k + 1]``.
    """

    def __init__(self, library, max_pieces: int):
        from tokenizers import pre_tokenizers

        self.library, self.max_pieces = library, max_pieces
        self.slots: dict[bytes, int] = {}
        self.ids, self.stops = array("I"), array("q", [0])
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c, kind in enumerate(_KINDS) if kind in (_LETTER, _SPACE)]
        #: the library's names of the bytes that it calls otherwise than Latin-1
        named = (zip(c.encode().decode("latin-1"), level.pre_tokenize_str(c)[0][0], strict=True) for c in letters)
        self.names = {byte: name for pairs in named for byte, name in pairs if byte != name}

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each plain text, given as its Latin-1 bytes."""
        data = b"".join(raws)
        if not data:
            return [b""] * len(raws)
        sizes = np.array([len(r) for r in raws], np.int64)
        ends = np.cumsum(sizes)
        starts = cut_pieces(data, ends - sizes)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        kept = len(self.stops) - 1
        slots = self._learn(distinct)
        first, last = (np.frombuffer(self.stops, np.int64)[s] for s in (slots, slots + 1))
        codes = pieces.indices.to_numpy()
        lengths = (last - first)[codes]
        after = np.cumsum(lengths)
        places = np.repeat(first[codes] - (after - lengths), lengths) + np.arange(after[-1])
        raw = np.frombuffer(self.ids, np.uint32)[places].astype("<u4").tobytes()
        if len(self.slots) > self.max_pieces:
            self._forget([distinct[at] for at in np.flatnonzero(slots >= kept).tolist()], kept)
        bounds = [0, *(4 * np.append(0, after)[np.searchsorted(starts, ends)]).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of distinct pieces; the library is asked for new ones."""
        found = list(map(self.slots.get, pieces))
        new = [at for at, slot in enumerate(found) if slot is None]
        if new:
            # of plain Latin characters exactly the letters are alphabetic: such a piece is not cut again
            texts = [t.decode("latin-1") for t in map(pieces.__getitem__, new)]
            whole = [t.removeprefix(" ").isalpha() for t in texts]
            others = [not one for one in whole]
            asked = chain(
                self._letter_ids(list(compress(texts, whole))),
                (e.ids for e in self.library.encode_batch_fast(list(compress(texts, others)), add_special_tokens=False)),
            )
            for at, ids in zip(chain(compress(new, whole), compress(new, others)), asked, strict=True):
                found[at] = self.slots[pieces[at]] = len(self.stops) - 1
                self.ids.extend(ids)
                self.stops.append(len(self.ids))
        return np.array(found, np.int64)

    def _letter_ids(self, letters: list[str]):
        """The model's ids of pieces that the library's cuts leave whole."""
        tokenize = self.library.model.tokenize
        named = "\n".join(letters).encode().decode("latin-1")
        for byte, name in self.names.items():
            named = named.replace(byte, name)
        return ([t.id for t in tokenize(piece)] for piece in named.split("\n") if piece)

    def _forget(self, pieces: list[bytes], kept: int) -> None:
        for piece in pieces:
            del self.slots[piece]
        del self.stops[kept + 1 :]
        del self.ids[self.stops[-1] :]


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``max_pieces`` and ``max_words`` bound the memory: beyond them, what a call had to learn is
    forgotten after it (frequent words come early).
    """

    def __init__(self, path: str, max_pieces: int | None = None, max_words: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        newline = self.library.encode(_NEWLINE, add_special_tokens=False).ids
        self.spaced = bool(newline)  # white space has ids of its own: byte-level vocabulary
        self.byte_pieces = BytePieces(self.library, max_pieces or 1_000_000)
        self.word_end = np.array([t is not None and t.endswith("</w>") for t in self.tokens])
        self.max_pieces = max_pieces or 350_000
        self.max_words = max_words or 250_000
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own ids of each text."""
        return [_packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        raws = [self._plain(text) for text in texts]
        plain = [at for at, raw in enumerate(raws) if raw is not None]
        others = [at for at, raw in enumerate(raws) if raw is None]
        for at, ids in zip(others, self.whole([texts[at] for at in others]), strict=True):
            out[at] = ids
        found = self.byte_pieces.encode([raws[at] for at in plain]) if self.spaced else self._by_words([texts[at] for at in plain])
        for at, ids in zip(plain, found, strict=True):
            out[at] = ids
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        # the word vocabulary lowers its input: fewer distinct words to remember
        cut = [text.lower().split(" ") for text in texts]
        new_words = set().union(*cut).difference(self.words)
        new_pieces = self._learn(new_words)
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in cut]
        if len(self.words) > self.max_words:
            for word in new_words:
                del self.words[word]
        if len(self.pieces) > self.max_pieces:
            for piece in new_pieces:
                del self.pieces[piece]
        return out

    def _plain(self, text: str) -> bytes | None:
        raw = plain_latin(text)
        if raw is None or b"<|" in raw:
            return None
        if self.spaced and (raw[-1:] in (b" ", b"\n") or any(s in raw for s in _AMBIGUOUS_SPACE)):
            return None
        return raw

    def _learn(self, words: set[str]) -> set[str]:
        # of plain Latin characters exactly the letters are alphabetic: such a word is one piece
        letters = [w for w in words if w.isalpha()]
        parts = {w: _WORD_PIECES.findall(w) for w in words.difference(letters)}
        new = set(letters).union(*parts.values()).difference(self.pieces)
        self._ask(list(new))
        pieces = self.pieces
        self.words.update(zip(letters, map(pieces.__getitem__, letters), strict=True))
        self.words.update((w, pieces[found[0]] if len(found) == 1 else b"".join([pieces[p] for p in found])) for w, found in parts.items())
        return new

    def _ask(self, new: list[str], group: int = 2000) -> None:
        """Encode new pieces; many are joined by line ends into one text, which separates them again."""
        alone = [p for p in new if not _ONE_WORD.fullmatch(p)]
        self.pieces.update(zip(alone, self.whole(alone), strict=True))
        new = [p for p in new if _ONE_WORD.fullmatch(p)]
        groups = [new[i : i + group] for i in range(0, len(new), group)]
        for own, ids in zip(groups, self.whole([_NEWLINE.join(g) for g in groups]), strict=True):
            ids = np.frombuffer(ids, "<u4")
            stops = np.flatnonzero(self.word_end[ids]) + 1
            starts = np.append(0, stops[:-1])
            if len(starts) != len(own):
                self.pieces.update(zip(own, self.whole(own), strict=True))
                continue
            raw = ids.tobytes()
            self.pieces.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(own, starts.tolist(), stops.tolist(), strict=True))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizers file."""
    return kept(("pieces", path), lambda: PieceEncoder(path))
