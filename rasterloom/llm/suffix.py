"""Repeated-substring removal with difference-cover suffix arrays.

Removes each byte of a text that a ``LENGTH``-byte string covers which also starts in
a document with a smaller id; overlaps count, and strings are judged on the input.

1. *Equal texts* count once, under the smallest id; the others are wholly covered.
   Texts are equal when two 64-bit hashes are.
2. *Anchors.*  The anchor of a string is its ``GRAM``-byte gram of lowest hash, leftmost
   on ties, so equal strings have equal anchors.  Consecutive strings with the same
   anchor form a segment.  Tasks deal anchors as 32-bit prints into buckets sized by
   the data; texts sharing no print with another text drop out.  A print that several
   texts of a chunk share is settled there and goes to its bucket once a chunk, so
   that an anchor in every text fills no bucket.
3. *Segments.*  Equal segments (by anchor and content hash, 128 bits) merge to their
   smallest document by a partial aggregate: later documents lose them whole, however
   many there are.
4. *Suffix arrays.*  Different segments with one anchor may still share strings.  One
   copy of each goes, by anchor, to a task that builds the suffix array of its share
   by the difference-cover algorithm: it sorts sampled triples, recurses on their
   names, merges the remaining suffixes, and compares the prefixes of neighbours.
   Anchors of more than ``SHARE`` segments are dealt over several tasks, which send
   the least document of each string on to a partial aggregate over all of them.
5. *Spans* join the texts last, which move twice in all: with the prints and here.

The difference-cover sort is thus distributed over anchors, rather than one global
sort: a global one moves every suffix of the corpus at every level of the recursion.

Defined cases: a null text counts as empty; texts under ``LENGTH`` bytes lose
nothing; rows with a null id lose nothing and take nothing; repeated rows keep what
the first keeps; several texts of one id take nothing from each other; kept bytes need
not be UTF-8; other columns pass through, but for those of the output's names, which
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import shingles
from rasterloom.llm.common import fresh, mix64, save, with_fields

LENGTH, GRAM = 50, 20
#: Anchors in one bucket of the screen, bytes of text per anchor, and fewest buckets.
BUCKET, SPACING, LEAST = 4_000_000, 16, 32
#: Segments of one anchor, and bytes of segments, in one suffix array.
SHARE, ARRAY = 8192, 250_000
_rng = np.random.default_rng(20_240_807)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer in their order; zeros past the end."""
    out = np.concatenate([text, np.zeros(7, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        out = (out[:-k] << np.uint64(8 * k)) | out[k:]
    return out


def suffix_array(text: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of bytes by the difference cover {1, 2} modulo 3.

    Symbols are the ranks of 16-byte prefixes, which order suffixes as bytes do, so
    the first names cover 48 bytes and few levels of recursion follow.  The bytes at
    ``ends`` (ascending, the last byte among them) close pieces and count as different
    from each other, by place, so that no comparison runs past a piece.
    """
    n = len(text)
    words, place = _words(text), np.arange(n)
    if ends is not None:
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - place
        past = (8 * np.maximum(7 - left, 0)).astype(np.uint64)
        words = words >> past << past
    half = np.unique(words, return_inverse=True)[1] + 1
    later = np.concatenate([half[8:], np.zeros(min(8, n), np.int64)])
    key = half * (n + 2) + later
    if ends is not None:
        key = np.where(left < 8, half * (n + 2), key) * (n + 1) + np.where(left < 16, place + 1, 0)
    return _order(np.unique(key, return_inverse=True)[1] + 1, 16)


def _order(text: np.ndarray, step: int) -> np.ndarray:
    """Suffix order of positive integers; names are of triples ``step`` places apart."""
    n = len(text)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(2 * step + 3, np.int64)])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    base = int(text.max()) + 1
    triples = (t[sample] * base + t[sample + step]) * base + t[sample + 2 * step]
    known, names = np.unique(triples, return_inverse=True)
    names = names.astype(np.int64) + 1
    if len(known) < len(sample):
        names[_order(names, 1)] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    order = np.empty(len(sample), np.int64)
    order[names - 1] = sample
    order = order[order < n]
    size = len(sample) + 1
    one, two = order[order % 3 == 1], order[order % 3 == 2]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * size + rank[rest + 1])]
    # a suffix at 0 mod 3 meets those at 1 by (symbol, rank), those at 2 by two symbols and a rank
    under_one = np.searchsorted(t[one] * size + rank[one + 1], t[rest] * size + rank[rest + 1])
    under_two = np.searchsorted((t[two] * base + t[two + 1]) * size + rank[two + 2], (t[rest] * base + t[rest + 1]) * size + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = under_one + under_two + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, order
    return out


def _pieces(texts: pa.Array, most: int = 2**31) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, borders) of the texts, a few (``most`` at most) at a time; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = min(first + most, max(first + 1, int(np.searchsorted(ends, ends[first] + shingles.CHUNK, "right")) - 1))
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


class Segments:
    """The segments of a few texts: arrays by segment."""

    def __init__(self, raw: np.ndarray, borders: np.ndarray):
        n, grams = len(raw), LENGTH - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.text, self.start, self.size, self.anchor = empty, empty, empty, np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        up, down = shingles._power(n)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up, out=self.sums[1:])
            self.down = down
            low = mix64((self.sums[GRAM:] - self.sums[:-GRAM]) * down[: n - GRAM + 1])
        # least by the upper half of the hash, then by place, whatever the chunk
        hashes, span = low, 1
        low = (low & ~np.uint64(0xFFFFFFFF)) | np.arange(len(low), dtype=np.uint64)
        while span < grams:
            step = min(span, grams - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, bool)  # strings that lie in one text
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            inside[a : max(a, b - LENGTH + 1)] = True
        begin = np.flatnonzero(inside[: len(at)])
        if not len(begin):
            return
        at = at[begin]
        new = np.ones(len(begin), bool)
        new[1:] = (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(begin)]]) - 1
        self.start, self.size = begin[first], begin[last] - begin[first] + LENGTH
        self.anchor = hashes[at[first]]
        self.text = np.searchsorted(borders, self.start, "right") - 1

    def content(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[self.start + self.size] - self.sums[self.start]) * self.down[self.start] + self.size.astype(np.uint64))


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """The 128-bit ids of a batch's texts, 16 bytes a row."""
    return np.stack([batch.column(c).to_numpy() for c in ("sid", "sid2")], axis=1)


PRINTS = "bucket int, sids binary, counts binary, prints binary, sid long, sid2 long"
#: Stands for "several texts" among the ids of a bucket.
SEVERAL = np.full((1, 2), -1, np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _slices(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of the runs of ``values`` that start at ``begin``."""
    ends = (np.append(begin, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _print_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of packed prints: for a few texts and a bucket, their ids, counts and prints.

    Prints that two of the texts share go to their bucket once, under ``SEVERAL``; rows
    without a bucket hold, by text, the keys (bucket << 32 | print) of such prints.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            # bucket, text and print share one 64-bit sorting key
            for first, raw, borders in _pieces(batch.column("text"), max(1, 2**31 // buckets - 1)):
                s = Segments(raw, borders)
                if not len(s.text):
                    continue
                # equal texts of the chunk count once
                own = ids[first : first + len(borders) - 1]
                _, unique, same = np.unique(own, axis=0, return_index=True, return_inverse=True)
                once = (unique[same.ravel()] == np.arange(len(own)))[s.text]
                text, anchor = s.text[once], s.anchor[once]
                key = (anchor % np.uint64(buckets)).astype(np.int64) << 32 | (anchor >> np.uint64(32)).astype(np.int64)
                pair = np.sort(key * len(own) + text)
                key, text = np.divmod(pair[_starts(pair)], len(own))
                begin = np.flatnonzero(_starts(key))
                many = np.diff(np.append(begin, len(key)))
                known = np.repeat(many > 1, many)
                sent = np.concatenate([key[~known], key[begin[many > 1]]])
                sender = np.concatenate([text[~known], np.full((many > 1).sum(), len(own))])
                yield _packed(sent, sender, np.concatenate([own, SEVERAL]))
                pair = np.sort((text[known] * buckets << 32) + key[known])
                text, key = np.divmod(pair, buckets << 32)
                begin = np.flatnonzero(_starts(text))
                none = pa.nulls(len(begin), pa.binary())
                columns = [pa.nulls(len(begin), pa.int32()), none, none, _slices(key, begin), *map(pa.array, own[text[begin]].T)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PRINTS.split(", ")])

    return docs.select("sid", "sid2", "text").mapInArrow(scan, PRINTS)


def _packed(key: np.ndarray, text: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Rows of (bucket, print) keys with the texts that have them, by bucket and text."""
    pair = np.sort((((key >> 32) * len(ids) + text) << 32) | (key & 0xFFFFFFFF))
    bucket, text = np.divmod(pair >> 32, len(ids))
    key = bucket << 32 | (pair & 0xFFFFFFFF)
    out: dict[str, list] = {n: [] for n in ("bucket", "sids", "counts", "prints")}
    prints = (key & 0xFFFFFFFF).astype(np.uint32)
    begin = np.flatnonzero(_starts(key >> 32, text))
    many = np.diff(np.append(begin, len(key))).astype(np.uint32)
    row = np.flatnonzero(_starts(key[begin] >> 32))
    for a, b in zip(row.tolist(), [*row[1:].tolist(), len(begin)], strict=False):
        x, y = begin[a], begin[b] if b < len(begin) else len(key)
        out["bucket"].append(int(key[x] >> 32))
        out["sids"].append(ids[text[begin[a:b]]].tobytes())
        out["counts"].append(many[a:b].tobytes())
        out["prints"].append(prints[x:y].tobytes())
    return _batch(out | {"sid": [None] * len(row), "sid2": [None] * len(row)}, PRINTS)


SHARED = "sid long, sid2 long, keys binary"


def _shared_prints(rows: DataFrame, buckets: int) -> DataFrame:
    """(sid, sid2, keys): the prints of a text that another text has too."""

    def solve(bucket: int, parts: list) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(s for s, _, _ in parts), np.int64).reshape(-1, 2)
        many = np.frombuffer(b"".join(c for _, c, _ in parts), np.uint32)
        prints = np.frombuffer(b"".join(p for *_, p in parts), np.uint32)
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        new = _starts(*ids[order].T)
        who = np.empty(len(ids), np.int64)
        who[order] = np.cumsum(new) - 1
        ids = ids[order][new]
        who = np.repeat(who, many)
        pair = np.sort(prints.astype(np.uint64) << np.uint64(32) | who.astype(np.uint64))
        prints, who = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(_starts(prints))
        several = (ids == SEVERAL).all(axis=1)[who]
        mixed = (np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)) | np.logical_or.reduceat(several, begin)
        shared = np.repeat(mixed, np.diff(np.append(begin, len(prints)))) & ~several
        found = np.unique(who[shared] << 32 | prints[shared])
        who = found >> 32
        begin = np.flatnonzero(_starts(who))
        columns = [pa.array(ids[who[begin], k]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, _slices(bucket << 32 | (found & 0xFFFFFFFF), begin)], ["sid", "sid2", "keys"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and bucket != key:
                    yield solve(key, parts)
                    parts = []
                key = bucket
                parts.append(row)
        if parts:
            yield solve(key, parts)

    dealt = rows.filter("bucket is not null").select("bucket", "sids", "counts", "prints")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(scan, SHARED)
    return dealt.unionByName(rows.filter("bucket is null").select("sid", "sid2", F.col("prints").alias("keys")))


PLACES = "content long, anchor long, sid long, doc long, start int, size int"


def _places(active: DataFrame, buckets: int) -> DataFrame:
    """The segments of each text whose anchors another text may share."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, docs = batch.column("sid").to_numpy(), batch.column("doc").to_numpy()
            lists = batch.column("shared")
            for first, raw, borders in _pieces(batch.column("text")):
                s = Segments(raw, borders)
                if not len(s.text):
                    continue
                # whether a print is shared doesn't depend on the text
                wanted = np.frombuffer(b"".join(lists.slice(first, len(borders) - 1).flatten().to_pylist()), np.uint64)
                key = ((s.anchor % np.uint64(buckets)) << np.uint64(32)) | (s.anchor >> np.uint64(32))
                wanted = np.unique(np.append(wanted, np.uint64(2**64 - 1)))
                keep = wanted[np.searchsorted(wanted, key)] == key
                at = first + s.text[keep]
                columns = {"content": s.content()[keep].view(np.int64), "anchor": s.anchor[keep].view(np.int64), "sid": sids[at], "doc": docs[at]}
                yield _batch(columns | {"start": s.start[keep] - borders[s.text[keep]], "size": s.size[keep]}, PLACES)

    return active.select("sid", "doc", "text", "shared").mapInArrow(scan, PLACES)


def _gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many runs of ``raw``, one after the other."""
    ends = np.cumsum(sizes)
    return raw[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


CUT = "anchor long, cell long, sid long, doc long, start int, bytes binary"


def _cut_out(rows: DataFrame) -> DataFrame:
    """(anchor, cell, sid, doc, start, bytes) of the segments wanted of a text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, docs, lists = batch.column("sid").to_numpy(), batch.column("doc").to_numpy(), batch.column("wanted")
            for first, raw, borders in _pieces(batch.column("text")):
                part = lists.slice(first, len(borders) - 1)
                text = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                held = part.flatten()
                get = {n: held.field(n).to_numpy() for n in ("anchor", "cell", "start", "size")}
                sizes = get["size"].astype(np.int64)
                taken = _gather(raw, borders[text] + get["start"], sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                cut = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(taken)])
                columns = [pa.array(get[n]) for n in ("anchor", "cell")] + [pa.array(sids[first + text]), pa.array(docs[first + text]), pa.array(get["start"], pa.int32()), cut]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CUT.split(", ")])

    return rows.mapInArrow(scan, CUT)


def string_classes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, class) of all ``LENGTH``-byte strings: equal strings, equal class.

    One suffix array over all pieces; neighbours in it are compared by their prefixes.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)  # no UTF-8 text has this byte
    ends = np.cumsum(sizes + 1) - 1
    order = suffix_array(raw, ends)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)[order]
    whole = ends[piece] - order >= LENGTH
    order, piece = order[whole], piece[whole]
    words, same = _words(raw), np.ones(max(0, len(order) - 1), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[order + k]
        same &= w[1:] == w[:-1]
    return piece, order - (ends - sizes)[piece], np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(~same)])


FOUND = "sid long, doc long, start int, size int, anchor long, hash long, owner long, split int"


def _runs(piece: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first byte, bytes) that strings at consecutive offsets cover together."""
    wide = int(offset.max(initial=0)) + 2
    place = np.sort(piece * wide + offset)
    piece, offset = np.divmod(place, wide)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1] + 1
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(piece)) - 1
    return piece[begin], offset[begin], offset[last[: len(begin)]] - offset[begin] + LENGTH


def _compare(rows: DataFrame) -> DataFrame:
    """Runs of strings of segments that an earlier document has.

    Of whole anchors, only those come out (split 0); of anchors dealt over several
    tasks, each string with its least document, for the aggregate (split 1).
    """

    def solve(held: list[tuple]) -> pa.RecordBatch:
        pieces = [h[5] for h in held]
        piece, offset, same = string_classes(pieces)
        anchors, cells, sids, docs, starts = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2, 3, 4))
        doc = docs[piece]
        owner = np.minimum.reduceat(doc, np.flatnonzero(_starts(same)))[same] if len(piece) else doc
        split = cells[piece] >= 0
        early = ~split & (owner < doc)
        run, begin, size = _runs(piece[early], offset[early])
        piece, offset, owner = piece[split], offset[split], owner[split]
        hashes = np.zeros(len(piece), np.int64)
        for k in np.unique(piece):
            mine = np.flatnonzero(piece == k)
            raw = np.frombuffer(pieces[k], np.uint8)
            up, down = shingles._power(len(raw))
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up, dtype=np.uint64)])
                at = offset[mine]
                hashes[mine] = mix64((sums[at + LENGTH] - sums[at]) * down[at]).view(np.int64)
        none, every = np.zeros(len(run), np.int64), np.concatenate([run, piece])
        columns = {"sid": sids[every], "doc": docs[every], "start": starts[every] + np.concatenate([begin, offset]), "anchor": anchors[every]}
        columns |= {"size": np.concatenate([size, np.full(len(piece), LENGTH)]), "hash": np.concatenate([none, hashes])}
        return _batch(columns | {"owner": np.concatenate([none, owner]), "split": np.concatenate([none, np.ones(len(piece), np.int64)])}, FOUND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > ARRAY and row[:2] != key:
                    yield solve(held)
                    held, size = [], 0
                key = row[:2]
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return rows.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(scan, FOUND)


def spans(docs: DataFrame) -> DataFrame:
    """(sid, sid2, least, spans) of each distinct text of (doc, sid, sid2, text) rows.

    ``least`` is its smallest document, ``spans`` what that loses (null: nothing).
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST, -(-total // (SPACING * BUCKET)))
    rows = save(_print_rows(docs, buckets), "op10-prints")
    shared = save(_shared_prints(rows, buckets), "op10-shared", [rows])
    shared = shared.groupBy("sid", "sid2").agg(F.collect_list("keys").alias("shared"))
    texts = docs.groupBy("sid", "sid2").agg(F.min(F.struct("doc", "text")).alias("one"))
    # from here on a text is known by its smallest document and one hash
    active = texts.join(shared, ["sid", "sid2"]).select("one.doc", "sid", "sid2", "one.text", "shared")
    active = save(active, "op10-active", [shared])
    places = save(_places(active, buckets), "op10-places")
    contents = save(places.groupBy("anchor", "content").agg(F.min("doc").alias("owner")), "op10-contents")
    several = contents.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1")
    cell = F.when(F.col("k") <= SHARE, F.lit(-1)).otherwise(F.pmod(F.xxhash64("content"), F.ceil(F.col("k") / SHARE)))
    told = contents.join(several, "anchor", "left").select("anchor", "content", "owner", cell.cast("long").alias("cell"))
    marked = places.join(told, ["anchor", "content"]).filter("doc > owner or cell is not null")
    marked = marked.withColumn("cell", F.when(F.col("doc") == F.col("owner"), F.col("cell")))
    marked = save(marked.drop("owner", "content"), "op10-marked", [places, contents])
    later = marked.filter("cell is null").select("doc", "sid", "start", "size")
    one = marked.filter("cell is not null").groupBy("doc", "sid").agg(F.collect_list(F.struct("anchor", "cell", "start", "size")).alias("wanted"))
    cut = _cut_out(active.select("sid", "doc", "text").join(one, ["doc", "sid"]))
    found = save(_compare(cut), "op10-strings", [active])
    across = found.filter("split = 1")
    first = across.groupBy("anchor", "hash").agg(F.min("owner").alias("first"))
    early = across.join(first, ["anchor", "hash"]).filter("first < doc").unionByName(found.filter("split = 0").withColumn("first", F.col("owner")))
    gone = later.unionByName(early.select("doc", "sid", "start", "size"))
    gone = gone.groupBy("doc", "sid").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    least = docs.groupBy("sid", "sid2").agg(F.min("doc").alias("least"))
    return save(least.join(gone.withColumnRenamed("doc", "least"), ["least", "sid"], "left"), "op10-spans", [marked, found])


CUTS = "kept binary, n_removed long, n_spans long"


def _cut(text: Column, spans: Column) -> Column:
    """What is left of each text without its ``spans``; null texts stay null."""

    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        kept, sizes, removed, runs = [], [], [], []
        for first, raw, borders in _pieces(texts):
            part = lists.slice(first, len(borders) - 1)
            text = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy())
            held = part.flatten()
            start = borders[text] + held.field("start").to_numpy()
            depth = np.zeros(len(raw) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + held.field("size").to_numpy(), -1)
            gone = np.cumsum(depth[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[borders[:-1][borders[:-1] < len(raw)]] |= gone[borders[:-1][borders[:-1] < len(raw)]]
            begun = np.concatenate([[0], np.cumsum(begins)])
            kept.append(raw[~gone])
            removed.append(np.diff(sums[borders]))
            runs.append(np.diff(begun[borders]))
            sizes.append(np.diff(borders) - removed[-1])
        none = np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))])
        whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *kept]))])
        columns = [whole.cast(pa.binary()), *(pa.array(np.concatenate([none, *x]), pa.int64()) for x in (removed, runs))]
        return pa.StructArray.from_arrays(columns, [x.split()[0] for x in CUTS.split(", ")])

    cut.__annotations__ = {"texts": pa.Array, "lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, CUTS)(text, spans)


def remove_repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", kept: str = "kept", n_removed: str = "n_removed", n_spans: str = "n_spans") -> DataFrame:
    """``df`` plus ``kept`` (binary), ``n_removed`` and ``n_spans``."""
    names = {n: fresh(f"__{n}", df) for n in ("sid", "sid2", "least", "spans", "own", "kept", "n_removed", "n_spans")}
    said, zero = F.coalesce(F.col(text), F.lit("")), F.lit(0).cast("long")
    keyed = df.withColumns({names["sid"]: F.xxhash64(said), names["sid2"]: F.xxhash64(F.lit(7), said)})
    docs = keyed.select(F.col(doc).cast("long").alias("doc"), F.col(names["sid"]).alias("sid"), F.col(names["sid2"]).alias("sid2"), said.alias("text"))
    told = spans(docs.filter("doc is not null").filter(F.octet_length("text") >= LENGTH))
    both = keyed.join(told.withColumnsRenamed({n: names[n] for n in told.columns}), [names["sid"], names["sid2"]], "left")
    least, found = F.col(names["least"]), F.col(names["spans"])
    copy, own = least < F.col(doc), found.isNotNull() & (least == F.col(doc))
    both = both.withColumn(names["own"], F.when(own, F.col(text)))
    both = with_fields(both, _cut(F.col(names["own"]), F.when(own, found)), {n: names[n] for n in ("kept", "n_removed", "n_spans")})
    both = both.withColumns(
        {
            kept: F.when(copy, F.lit(b"")).when(own, F.col(names["kept"])).otherwise(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))),
            n_removed: F.when(copy, F.octet_length(F.col(text)).cast("long")).when(own, F.col(names["n_removed"])).otherwise(zero),
            n_spans: F.when(copy, F.lit(1).cast("long")).when(own, F.col(names["n_spans"])).otherwise(zero),
        }
    )
    return both.drop(*names.values())
