"""License notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice that may hold k edits is split into k + 1 pieces; by the pigeonhole principle one piece
stands unchanged in any match. An Aho-Corasick automaton finds all pieces in one pass over the
text; around each hit the ``regex`` library's bounded-error matching verifies the whole notice and
gives its span and edits.
"""

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import documents, sliced

#: Phrases counted exactly, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Opening words of public licenses, matched with edits.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the creative commons attribution sharealike": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "subject to the terms of the mozilla public license": "mpl-2",
    "free and unencumbered software released into the public domain": "unlicense",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, notices array<struct<label:string,start:int,stop:int,edits:int>>"
)
#: Everything but digits, letters and bytes above ASCII parts words; A-Z become a-z.
_TABLE = bytes(
    c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256)
)


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class NoticeScanner:
    def __init__(self, notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for notice, label in notices.items():
            edits = max(1, len(notice) // chars_per_edit)
            ends = [round(len(notice) * i / (edits + 1)) for i in range(edits + 2)]
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")
            for a, b in zip(ends, ends[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((len(self.notices), a))
            self.notices.append((notice, label, edits, pattern))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, stop, edits) of the notices in a normalised text, by place; overlapping
        hits of one notice are one."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for index, offset in places:
                notice, _, edits, _ = self.notices[index]
                start = last - size + 1 - offset - edits
                own = windows.setdefault(index, [])
                stop = start + len(notice) + 2 * edits
                if own and start <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], start)
                    own[-1][1] = max(own[-1][1], stop)
                else:
                    own.append([start, stop])
        found = []
        for index, own in windows.items():
            notice, label, edits, pattern = self.notices[index]
            # the best hit of a stretch comes first; others stand before and behind it
            parts = [(max(0, start), min(len(text), stop)) for start, stop in own]
            while parts:
                start, stop = parts.pop()
                if stop - start < len(notice) - edits or (match := pattern.search(text, start, stop)) is None:
                    continue
                found.append((label, match.start(), match.end(), sum(match.fuzzy_counts)))
                parts += [(start, match.start()), (max(match.end(), start + 1), stop)]
        return sorted(set(found), key=lambda f: (f[1], f[2], f[0], f[3]))


@lru_cache(maxsize=2)
def _scanner(notices: tuple, chars_per_edit: int) -> NoticeScanner:
    return NoticeScanner(dict(notices), chars_per_edit)


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(index of the first word, label) of each exact phrase."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        own = b" " + phrase.encode() + b" "
        at = joined.find(own)
        while at >= 0:
            found.append((joined.count(b" ", 0, at), label))
            at = joined.find(own, at + 1)
    return found


def scan_text(text: str, scanner: NoticeScanner, phrases: dict[str, str] = PHRASES) -> tuple:
    words = normal_words(text)
    base = phrase_places(words, phrases)
    normal = b" ".join(words).decode()
    fuzzy = scanner.scan(normal)
    base_labels = {label for _, label in base}
    labels = base_labels | {label for label, *_ in fuzzy}
    score = max([1.0 if base else 0.0, *(1.0 - edits / max(1, stop - start) for _, start, stop, edits in fuzzy)])
    starts = [at for at, _ in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        min(1.0, max(0.0, score)),
        [{"label": label, "start": a, "stop": b, "edits": e} for label, a, b, e in fuzzy],
    )


def license_scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT
) -> DataFrame:
    """``RESULT`` of every row of ``docs``; spans are characters of the text's words joined by spaces.

    A null text counts as empty: no words, empty labels, score 0, null word places. Repeated rows
    give repeated results; other columns are ignored. No shuffle.
    """
    key = tuple(notices.items())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, chars_per_edit)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
        for batch in sliced(batches):
            rows = [scan_text(t, scanner, phrases) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return documents(docs).mapInArrow(scan, RESULT)
