"""Byte-pair encoding: token counts (heap + linked list) and ids (segment tree).

A vocabulary file is read once on the driver and broadcast; its size is a fixed
property of the tokenizer (about 1.4 MB), not of the data.  Both operators cut a
text at the special strings of the file, then into pre-tokens, and merge inside
each pre-token.  A worker remembers merged pre-tokens in a bounded table.

Null texts count as empty.  Texts are never cut short; one very long pre-token
costs O(n log n) in either operator.  All other columns pass through unchanged.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import with_fields

#: Code points newer than the vocabulary library's Unicode tables,
#: which it takes as neither letters nor numbers.
NEW_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011df1\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3"
    "\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81"
    "\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e"
    "\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NEW_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"


def split_pattern(letter: str, number: str, space: str) -> str:
    """The split pattern of the public byte-level vocabulary over three classes."""
    return (
        rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


#: For texts whose code points are all under U+0250, and for any text.
NARROW = split_pattern(r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")
ANY = split_pattern(rf"[\p{{L}}--[{NEW_LETTERS}]]", rf"[\p{{N}}--[{NEW_NUMBERS}]]", r"\p{White_Space}")
#: Pre-tokens a worker remembers, and the longest it remembers.
MEMO, MEMO_LEN = 300_000, 48
_NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Vocabulary:
    """Merge table of a byte-level tokenizer JSON, by token id."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [ids[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        sizes = np.fromiter(map(len, self.bytes), np.int64, size)
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(sizes) - sizes, sizes
        self.narrow = re.compile(NARROW).findall
        self.any = regex.compile(ANY, regex.V1).findall
        self.wide = re.compile(r"[^\x00-\u024f]").search
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None

    def split(self, text: str) -> list[str]:
        return (self.any if self.wide(text) else self.narrow)(text)

    def words(self, text: str) -> list:
        """Pre-tokens in order; a special token stands as a tuple of its id."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list = []
        for k, part in enumerate(self.cut(text)):
            out += [(self.special[part],)] if k % 2 else self.split(part)
        return out


def count_merges(symbols: list[int], pairs: dict) -> int:
    """Merges until none applies: a heap of (rank, place) over a linked list."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        hit = pairs.get((symbols[i], symbols[i + 1]))
        if hit:
            heap.append((hit[0], i, hit[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i, made = heapq.heappop(heap)
        j = after[i] if symbols[i] >= 0 else n
        if j >= n:
            continue
        hit = pairs.get((symbols[i], symbols[j]))
        if hit is None or hit[0] != rank:  # an entry from before another merge
            continue
        symbols[i], symbols[j] = made, -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            hit = pairs.get((made, symbols[k]))
            if hit:
                heapq.heappush(heap, (hit[0], i, hit[1]))
        h = before[i]
        if h >= 0:
            hit = pairs.get((symbols[h], made))
            if hit:
                heapq.heappush(heap, (hit[0], h, hit[1]))
    return merges


class PairTable:
    """Rank and result of a pair of ids for whole arrays: a hash table with probing."""

    def __init__(self, pairs: dict):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks, self.made = np.full(1 << bits, _NONE), np.zeros(1 << bits, np.int64)
        key = np.array([(a << 32) | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        todo, at = np.arange(len(key)), self._place(key)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]
            won = self.keys[at] == key[todo]
            self.ranks[at[won]], self.made[at[won]] = value[todo[won]].T
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or ``_NONE``, resulting id); a negative id matches nothing."""
        key = (left << 32) | right
        at = self._place(key)
        while True:
            there = self.keys[at]
            more = (there != key) & (there != -1)
            if not more.any():
                break
            at = np.where(more, (at + 1) & self.mask, at)
        hit = (there == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.made[at]


def merge_rows(symbols: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Ids after all merges of many sequences at once, -1 where a symbol is gone.

    Each row has its own segment tree over the ranks of adjacent pairs.  A leaf is
    ``rank * width + place``, so a root is the row's leftmost pair of lowest rank; a
    merge renews three leaves and their ancestors.  Rows drop out when their root is
    empty.
    """
    rows, n = symbols.shape
    width = 1 << max(1, n - 1).bit_length()
    place = np.arange(n)
    symbols = np.where(place < sizes[:, None], symbols, -1)
    after = np.broadcast_to(place + 1, (rows, n)).copy()
    before = np.broadcast_to(place - 1, (rows, n)).copy()
    made = np.zeros((rows, width), np.int64)
    tree = np.full((rows, 2 * width), _NONE)

    def leaves(left, right, at):
        rank, new = pairs.find(left, right)
        return np.where(rank == _NONE, _NONE, rank * width + at), new

    tree[:, width : width + n - 1], made[:, : n - 1] = leaves(symbols[:, :-1], symbols[:, 1:], place[:-1])
    level = width
    while level > 1:
        tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(rows, -1, 2).min(axis=2)
        level //= 2
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        i = tree[live, 1] % width
        j = after[live, i]
        k = after[live, j]
        h = before[live, i]
        new = made[live, i]
        symbols[live, i], symbols[live, j] = new, -1
        after[live, i] = k
        last, first = k >= n, h < 0
        before[live[~last], k[~last]] = i[~last]
        right = np.where(last, -1, symbols[live, np.minimum(k, n - 1)])
        left = np.where(first, -1, symbols[live, np.maximum(h, 0)])
        here, made[live, i] = leaves(new, right, i)
        h0 = np.maximum(h, 0)
        there, by = leaves(left, new, h0)
        made[live[~first], h0[~first]] = by[~first]
        tree[live, width + j] = _NONE
        tree[live, width + i] = here
        tree[live[~first], width + h0[~first]] = there[~first]
        node, row = width + np.stack([i, j, h0]), np.broadcast_to(live, (3, len(live)))
        while node[0, 0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        live = live[tree[live, 1] != _NONE]
    return symbols


def merge_ids(words: list[bytes], first: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Ids (packed int32) after all merges of each word; words of like length go together."""
    out = [b""] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    wide = np.maximum(8, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for width in np.unique(wide):
        mine = np.flatnonzero(wide == width)
        step = max(1, 32_000 // int(width))
        for start in range(0, len(mine), step):
            some = mine[start : start + step]
            grid = np.full((len(some), int(sizes[some].max(initial=1)) + 1), -1, np.int64)
            inside = np.arange(grid.shape[1]) < sizes[some][:, None]
            grid[inside] = first[np.frombuffer(b"".join(words[s] for s in some), np.uint8)]
            grid = merge_rows(grid, sizes[some], pairs)
            kept = grid >= 0
            flat, ends = grid[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            for s, a, b in zip(some.tolist(), [0, *ends], ends, strict=False):
                out[s] = flat[a:b]
    return out


class Memo(dict):
    """Results by pre-token; forgets all when full, so memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= MEMO_LEN:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


class Encoder(dict):
    """Ids (packed int32) by pre-token; merges the new pre-tokens of a batch together.

    Remembered are the pre-tokens met last: when half of ``MEMO`` is full it becomes
    the older half, and what isn't met again before the next turn is forgotten.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.table = vocabulary, PairTable(vocabulary.pairs)
        self.first = np.array(vocabulary.first, np.int64)
        self.older: dict = {}

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.vocabulary.words(t) if t else [] for t in texts]
        if len(self) > MEMO // 2:
            self.older = dict(self)
            self.clear()
        new = set(chain.from_iterable(split)).difference(self)
        met = new.intersection(self.older)
        self.update(zip(met, map(self.older.__getitem__, met), strict=True))
        new -= met
        plain = [w for w in new if type(w) is str]
        self.update((w, np.array(w, np.int32).tobytes()) for w in new if type(w) is tuple)
        self.update(zip(plain, merge_ids([w.encode() for w in plain], self.first, self.table), strict=True))
        out = [np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32) for words in split]
        for word in plain:
            if len(word) > MEMO_LEN:
                del self[word]
        return out


_loaded: dict[tuple[str, int], object] = {}


def _tables(raw: bytes) -> tuple[Vocabulary, Memo, Encoder]:
    key = ("bpe", hash(raw))
    if key not in _loaded:
        v = Vocabulary(raw)

        def symbols(word):
            return [v.first[b] for b in word.encode()]

        def count(word):
            if type(word) is tuple:
                return 1
            s = symbols(word)
            n = len(s)
            return n - count_merges(s, v.pairs)

        _loaded[key] = (v, Memo(count), Encoder(v))
    return _loaded[key]


def _raw(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` plus the token count of column ``text`` (0 for null and empty texts)."""
    raw = df.sparkSession.sparkContext.broadcast(_raw(tokenizer))

    def count(texts: pa.Array) -> pa.Array:
        vocabulary, counts, _ = _tables(raw.value)
        get = counts.__getitem__
        return pa.array([sum(map(get, vocabulary.words(t))) if t else 0 for t in texts.to_pylist()], pa.int64())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(count, T.LongType())(F.col(text)))


def _id_lists(encoder: Encoder, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids of each text as lists, and their borders and values."""
    flat = encoder.batch(texts.to_pylist())
    ends = np.cumsum([0, *map(len, flat)])
    values = np.concatenate([*flat, np.empty(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), ends, values


def _decoded(vocabulary: Vocabulary, ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """The texts of consecutive runs of ids, cut from the pool of all tokens' bytes."""
    pool, starts, sizes = vocabulary.pool
    values = values[: ends[-1]]
    many = sizes[values]
    borders = np.concatenate([[0], np.cumsum(many)])
    raw = pool[np.repeat(starts[values] - borders[:-1], many) + np.arange(borders[-1])]
    borders = borders[ends]
    inside = borders[borders < len(raw)]
    joined = raw.tobytes()
    try:
        joined.decode()
        whole = not (raw[inside] & 0xC0 == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole:
        return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(joined)).cast(pa.string())
    return pa.array([joined[a:b].decode("utf-8", "replace") for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)], pa.string())


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` plus the token ids of column ``text`` (an empty array for null)."""
    raw = df.sparkSession.sparkContext.broadcast(_raw(tokenizer))

    def ids(texts: pa.Array) -> pa.Array:
        return _id_lists(_tables(raw.value)[2], texts)[0]

    ids.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(ids, T.ArrayType(T.IntegerType()))(F.col(text)))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus the text of the token ids, special tokens kept; null ids give ''.

    Bytes that are not UTF-8 come out as U+FFFD; ids outside the vocabulary are skipped.
    """
    raw = df.sparkSession.sparkContext.broadcast(_raw(tokenizer))

    def texts(rows: pa.Array) -> pa.Array:
        vocabulary = _tables(raw.value)[0]
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        values = rows.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        known = (values >= 0) & (values < len(vocabulary.bytes))
        return _decoded(vocabulary, np.concatenate([[0], np.cumsum(known)])[ends], values[known])

    texts.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(texts, T.StringType())(F.col(ids)))


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` plus ids and their text, as ``decode(encode(df))`` in one pass over the texts.

    Chained, the two make the plan encode each text once for either column.
    """
    raw = df.sparkSession.sparkContext.broadcast(_raw(tokenizer))

    def both(texts: pa.Array) -> pa.Array:
        vocabulary, _, encoder = _tables(raw.value)
        lists, ends, values = _id_lists(encoder, texts)
        return pa.StructArray.from_arrays([lists, _decoded(vocabulary, ends, values)], ["ids", "decoded"])

    both.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(both, "ids array<int>, decoded string")(F.col(text))
    return with_fields(df, made, {"ids": ids, "decoded": decoded})
