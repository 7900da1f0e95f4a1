"""Words of whole texts as 64-bit hashes, in numpy over Arrow buffers.

A word's hash mixes the sum of one random number for each (place, letter), so that no
pattern of letters makes sums agree.  Texts are read in chunks that end between words;
only a word that is longer than a chunk makes a chunk longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rasterloom.llm.common import mix64

#: Bytes of text looked at together.
CHUNK = 250_000
#: Places of a word with numbers of their own in the table; later blocks of places mix theirs.
PLACES = 64
_TABLE = np.random.default_rng(20_250_611).integers(0, 2**64, (PLACES, 256), np.uint64).ravel()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Letters:
    """Which bytes lie between words, and which of them also end a run of words."""

    word: np.ndarray
    ends_run: np.ndarray | None = None

    @classmethod
    def between(cls, gaps: bytes, ends_run: bytes = b"") -> Letters:
        word, ends = np.ones(256, bool), np.zeros(256, bool)
        word[list(gaps + ends_run)] = False
        ends[list(ends_run)] = True
        return cls(word, ends if ends_run else None)


@dataclass
class Words:
    """Words in order: text number, hash, whether in one run with the word before, bytes ``start`` to ``stop`` of ``raw``."""

    text: np.ndarray
    hash: np.ndarray
    follows: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    raw: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def spelled(self, which: np.ndarray) -> pa.Array:
        """The lower-cased words numbered ``which``."""
        size = self.stop[which] - self.start[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[which] - ends[:-1], size) + np.arange(ends[-1])
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(_LOWER[self.raw[at]].tobytes()))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and their borders; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _cut(raw: np.ndarray, ends: np.ndarray, low: int, letters: Letters) -> int:
    """Where the chunk from ``low`` ends: between words."""
    high = low + CHUNK
    if high >= len(raw):
        return len(raw)
    gaps = np.flatnonzero(~letters.word[raw[low:high]])
    border = int(ends[np.searchsorted(ends, high, "right") - 1])
    best = max(border, low + int(gaps[-1]) + 1 if len(gaps) else low)
    while best <= low:  # inside one long word
        border = int(ends[np.searchsorted(ends, high, "right")])
        gaps = np.flatnonzero(~letters.word[raw[high : min(high + CHUNK, border)]])
        if len(gaps):
            best = high + int(gaps[0]) + 1
        elif high + CHUNK >= border:
            best = border
        high += CHUNK
    return best


def hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the non-empty byte runs from ``start`` to ``stop``, which follow each other, A-Z as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    letter = _LOWER[raw[place + np.repeat(start, size)]]
    value = _TABLE[((place & (PLACES - 1)) << 8) | letter]
    if size.max() > PLACES:
        late = np.flatnonzero(place >= PLACES)
        value[late] = mix64(value[late] + (place[late] // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix64(np.add.reduceat(value, first))


def chunks(texts: pa.Array, letters: Letters) -> Iterator[Words]:
    """The words of all texts, chunk after chunk."""
    raw, ends = buffers(texts)
    low = runs = 0
    before = (-1, 0)  # text and run of the last word so far
    while low < len(raw):
        high = _cut(raw, ends, low, letters)
        part = raw[low:high]
        said = letters.word[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[ends[np.searchsorted(ends, low) : np.searchsorted(ends, high, "right")] - low] = True
        edge[0] = edge[-1] = True
        start = np.flatnonzero(said & (edge[:-1] | ~np.concatenate([[False], said[:-1]])))
        stop = np.flatnonzero(said & (edge[1:] | ~np.concatenate([said[1:], [False]]))) + 1
        text = np.searchsorted(ends, start + low, "right") - 1
        follows = np.zeros(len(start), bool)
        if len(start):
            run = np.zeros(len(start), np.int64)
            if letters.ends_run is not None:
                marks = np.cumsum(letters.ends_run[part])
                run = marks[start] + runs
                runs += int(marks[-1])
            follows[0] = before == (int(text[0]), int(run[0]))
            follows[1:] = (text[1:] == text[:-1]) & (run[1:] == run[:-1])
            before = int(text[-1]), int(run[-1])
        elif letters.ends_run is not None:
            runs += int(letters.ends_run[part].sum())
        yield Words(text, hashes(part, start, stop), follows, start, stop, part)
        low = high


def whole(texts: pa.Array, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, borders by text)."""
    found = [(w.text, w.hash) for w in chunks(texts, letters)]
    text = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)])
    return np.concatenate([np.zeros(0, np.uint64), *(h for _, h in found)]), np.searchsorted(text, np.arange(len(texts) + 1))
