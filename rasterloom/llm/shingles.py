"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased.  A
text's set holds the distinct hashes of its five-word runs; with fewer words, of
the whole sequence as one; without words it is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rasterloom.llm.common import mix64
from rasterloom.llm.words import hashes

WORDS = 5
#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 250_000
_rng = np.random.default_rng(20_240_514)
_PLACE = _rng.integers(1, 2**63, WORDS + 1, np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C55
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, CHUNK) + 1, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"]


def _chunk(raw: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The sets of consecutive texts; ``ends`` are their borders in ``raw``."""
    n = len(raw)
    with np.errstate(over="ignore"):
        said = ~_BLANK[raw]
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        before = np.concatenate([[False], said[:-1]]) & ~edge[:-1]
        behind = np.concatenate([said[1:], [False]]) & ~edge[1:]
        start, stop = np.flatnonzero(said & ~before), np.flatnonzero(said & ~behind) + 1
        word = hashes(raw, start, stop)
        runs = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
        for i in range(WORDS):
            runs += word[i : i + len(runs)] * _PLACE[i]
        runs = mix64(runs)
        border = np.searchsorted(start, ends)
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            if b - a >= WORDS:
                some = np.sort(runs[a : b - WORDS + 1])
                new = np.ones(len(some), bool)
                np.not_equal(some[1:], some[:-1], out=new[1:])
                yield some[new]
            elif b > a:
                few = (word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _PLACE[WORDS] * np.uint64(b - a)
                yield mix64(np.array([few], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of each text; a null text has an empty set."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        yield from _chunk(raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


def set_id(items: np.ndarray) -> int:
    """A 64-bit id of a set, the same whatever its order."""
    with np.errstate(over="ignore"):
        total = mix64(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(items))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])
