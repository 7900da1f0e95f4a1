"""Near-duplicate components: n-gram Jaccard join over a count-vector R-tree.

Two texts link when 100 * |A & B| >= 75 * |A | B| for their sets of five-word
shingles.  The steps, all over whole texts and without any cap:

1. *Signatures.*  Equal sets get one id; only one of them goes on.  Tasks also count
   shingles, and those of more than a share ``HOT`` of all sets form a list (at most
   average set size / ``HOT`` entries) that only serves to order shingles: rare ones
   by hash first, frequent ones last.
2. *Prefixes.*  Linked sets share their first common shingle within a prefix of each.
   A quarter of the set plus one always suffices; as hashes are random, so does a
   prefix in which a common shingle is missing with probability below exp(-``miss``),
   by default 2^-48: within the rare shingles, or all of these and some frequent ones.
   The shorter is taken; an infinite ``miss`` takes the sure one.
   Shingles in the prefixes of two sets or more are the blocks that the tree works on;
   of blocks with the same members one goes on.
3. *Points.*  Shingles are hashed into groups, 64 or one for each 4 to 8 shingles; the
   counts by group, folded to 64, index an R-tree in each block.  Overlap is bounded by
   the sum of coordinate minima, against boxes, then points, then points in full; sets
   that the bound lets link with none of their blocks drop out before any set is moved.
4. *Sets.*  Each set left goes, whole, to the block of its first shared shingle, where
   the tree finds pairs again and the sets verify them.  Boxes whose members are all in
   the query's component already are passed over, so a group of thousands of near
   copies costs about one verification a member.
5. *Rounds.*  Blocks that still hold several components, not all compared with each
   other, go again.  Blocks over one task's load (``BLOCK`` sets or ``WEIGHT`` shingles)
   are dealt over several: first members of each component meet, and then whatever is
   not in the block's largest component meets the whole block, in a grid of tasks of
   bounded size.  After that every pair of every block is in one component or compared.
   Sets carry the other blocks they go to in a round, and a pair is compared in the first
   it has in common: texts cut from one template share nearly all their blocks.

Defined cases: null and empty texts have no shingles and are their own component;
rows with a null id take no part (null component); repeated rows link with each
other; one id with several texts links by all of them; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import shingles
from rasterloom.llm.common import drop, fresh, save, scratch
from rasterloom.llm.graph import components

#: Groups of the tree's points (log2), shingles to a group at most, children of a box.
LOW, PER_GROUP, FAN = 6, 8, 8
#: Share of sets from which a shingle counts as frequent, and the least count.
HOT, HOT_LEAST = 0.0005, 64
#: Sets, and shingles of sets, in one block of one task; sets of a block that points are compared in.
BLOCK, WEIGHT, NEAR_BLOCK = 1024, 4_000_000, 256
#: Sets from which a block's shingles are numbered, bytes of their bits, and pairs counted at once.
NUMBERED, BITS, AT_ONCE = 8, 1 << 26, 64
#: -log of the probability that a prefix misses: 48 binary digits.
MISS = 48 * math.log(2)
#: Entries of a task's counter before rare ones are dropped (lossy counting).
COUNTER = 1_000_000


def prefix_length(size: int, hot: int, miss: float = MISS) -> int:
    """Shingles of the prefix, for a set of which ``hot`` shingles are frequent."""
    sure = size // 4 + 1
    rare = size - hot
    if math.isinf(miss):
        return sure
    if 4 * rare > size:
        return min(sure, math.ceil(miss / math.log(4 * rare / size)))
    # at worst all rare ones are missing, and of the frequent ones as many as a quarter of the set still allows
    gone = size // 4 - rare
    return min(sure, rare + (math.ceil(miss / math.log(hot / gone)) if gone > 0 else 1))


def group_counts(items: np.ndarray) -> np.ndarray:
    """A set's point: how many of its shingles each group has.

    Groups are the leading bits of a hash, so points fold onto fewer groups.
    """
    bits = max(LOW, (max(0, len(items) - 1) // PER_GROUP).bit_length())
    return np.bincount((items >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(groups, -1).sum(axis=1)


def pack(point: np.ndarray) -> bytes:
    most = point.max(initial=0)
    wide = 1 if most < 256 else 2 if most < 65536 else 4
    return bytes([wide]) + point.astype(f"u{wide}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1)


class _Counter:
    """Counts of shingles in bounded memory."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.wait: list[np.ndarray] = []
        self.waiting = self.folds = 0

    def add(self, items: np.ndarray) -> None:
        self.wait.append(items)
        self.waiting += len(items)
        if self.waiting >= COUNTER // 2:
            self.fold()

    def fold(self) -> None:
        keys, counts = np.unique(np.concatenate([*self.wait, np.zeros(0, np.uint64)]), return_counts=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        self.counts[at[known]] += counts[known]
        keys, counts = np.concatenate([self.keys, keys[~known]]), np.concatenate([self.counts, counts[~known]])
        self.folds += 1
        if len(keys) > COUNTER:
            many = counts > self.folds
            keys, counts = keys[many], counts[many]
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.wait, self.waiting = [], 0


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc, size, sid, counts) of every text, and (token, n) of each task's frequent shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _Counter(), set()
        names = ["doc", "size", "sid", "counts", "token", "n"]
        for batch in batches:
            sizes, sids, counts = [], [], []
            for items in shingles.sets(batch.column("text")):
                sid = shingles.set_id(items)
                counts.append(pack(group_counts(items)))
                sizes.append(len(items))
                sids.append(sid)
                if sid not in seen:
                    seen.add(sid)
                    counter.add(items)
            none = pa.nulls(len(sids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(counts, pa.binary()), none, none], names)
        counter.fold()
        many = counter.counts >= max(8, HOT * len(seen))
        tokens, none = pa.array(counter.keys[many].view(np.int64)), pa.nulls(int(many.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(none), pa.binary()), tokens, pa.array(counter.counts[many])], names)

    return docs.mapInArrow(scan, "doc long, size long, sid long, counts binary, token long, n long")


def _prefixes(docs: DataFrame, hot, miss: float) -> DataFrame:
    """(token, sid, pos): the prefix of each distinct set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = hot.value, set()
        for batch in batches:
            tokens, sids, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for items in shingles.sets(batch.column("text")):
                sid = shingles.set_id(items)
                if not len(items) or sid in seen:
                    continue
                seen.add(sid)
                at = np.searchsorted(frequent, items)
                is_hot = np.zeros(len(items), bool)
                inside = at < len(frequent)
                is_hot[inside] = frequent[at[inside]] == items[inside]
                k = prefix_length(len(items), int(is_hot.sum()), miss)
                rare = items[~is_hot][:k]
                tokens += [rare, items[is_hot][: k - len(rare)]]
                sids.append(np.full(k, sid))
                places.append(np.arange(k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(places))], ["token", "sid", "pos"])

    return docs.mapInArrow(scan, "token long, sid long, pos int")


def _sets(docs: DataFrame) -> DataFrame:
    """(sid, token, cell, seen, items): the set of each text whose id is the one wanted for it."""

    names = ["sid", "token", "cell", "seen"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, items = [], []
            for k, (sid, found) in enumerate(zip(batch.column("sid").to_pylist(), shingles.sets(batch.column("text")), strict=True)):
                if shingles.set_id(found) == sid:
                    places.append(k)
                    items.append(found.tobytes())
            kept = [batch.column(c).take(pa.array(places, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(items, pa.binary())], [*names, "items"])

    return docs.mapInArrow(scan, "sid long, token long, cell long, seen long, items binary")


class CountTree:
    """R-tree over the points of sets that come sorted by size."""

    def __init__(self, points: list[np.ndarray]):
        low = np.stack([fold(p, 1 << LOW) for p in points]).astype(np.int32)
        self.points, self.sizes = points, low.sum(axis=1)
        self.levels, self.least = [low], [self.sizes]
        while len(self.levels[-1]) > FAN:
            starts = np.arange(0, len(self.levels[-1]), FAN)
            self.levels.append(np.maximum.reduceat(self.levels[-1], starts))
            self.least.append(np.minimum.reduceat(self.least[-1], starts))

    def search(self, i: int, other: np.ndarray) -> np.ndarray:
        """Points before ``i`` with ``other`` set that may link with it, closest first."""
        point, size = self.levels[0][i], self.sizes[i]
        nodes = np.arange(len(self.levels[-1]))
        for height in reversed(range(len(self.levels))):
            span = FAN**height
            nodes = nodes[nodes * span < i]
            if span > 1:
                open_ = np.logical_or.reduceat(other, np.arange(0, len(other), span))
                nodes = nodes[open_[nodes]]
            else:
                nodes = nodes[other[nodes]]
            bound = np.minimum(point, self.levels[height][nodes]).sum(axis=1)
            near = 7 * bound >= 3 * (size + self.least[height][nodes])
            nodes, bound = nodes[near], bound[near]
            if not len(nodes):
                return nodes
            if height:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[height - 1])]
        if len(self.points[i]) > 1 << LOW:
            bound = np.array([self._bound(i, j) for j in nodes.tolist()])
            near = 7 * bound >= 3 * (size + self.sizes[nodes])
            nodes, bound = nodes[near], bound[near]
        return nodes[np.argsort(-bound, kind="stable")]

    def _bound(self, i: int, j: int) -> int:
        """The bound over all groups that both points have."""
        a, b = self.points[i], self.points[j]
        if len(a) != len(b):
            groups = min(len(a), len(b))
            a, b = fold(a, groups), fold(b, groups)
        return int(np.minimum(a, b).sum(dtype=np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The contract's condition, on whole sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def repeated_bits(sets: list[np.ndarray], most: float = math.inf) -> np.ndarray | None:
    """A row of bits for each set, one bit for each item that several sets hold; None over ``most`` bytes."""
    items, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(items, kind="stable")
    new = np.ones(len(items), bool)
    new[1:] = items[order][1:] != items[order][:-1]
    number = np.cumsum(new) - 1
    several = np.bincount(number, minlength=1) > 1
    width = int(several.sum())
    if len(sets) * width > 8 * most:
        return None
    held = several[number]
    column, owner = (np.cumsum(several) - 1)[number[held]], owner[order][held]
    step, parts = 1 << 16, []
    for low in range(0, width, step):
        start, end = np.searchsorted(column, [low, low + step])
        bits = np.zeros((len(sets), (min(step, width - low) + 63) // 64 * 64), bool)
        bits[owner[start:end], column[start:end] - low] = True
        parts.append(np.packbits(bits, axis=1).view(np.uint64))
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(sets), 1), np.uint64)


def link_block(sids: np.ndarray, sets: list[np.ndarray], comps: np.ndarray, seen: np.ndarray, others: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Stars (member, smallest) of the block's components that gained a link.

    ``seen`` pairs are compared already; pairs with one of ``others`` in common are left to it.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sids, comps, seen, sets = sids[order], comps[order].copy(), seen[order], [sets[i] for i in order]
    away = repeated_bits([others[i] for i in order]) if others else np.zeros((len(sets), 1), np.uint64)
    sizes, gained = np.array([len(x) for x in sets]), np.zeros(len(sets), bool)
    tree = bits = None
    for i in range(1, len(sets)):
        other = (comps != comps[i]) & ((seen != seen[i]) | (seen == 0))
        other[i:] = False
        if other.any() and away[i].any():
            other[other] = ~(away[other] & away[i]).any(axis=1)
        if not other.any():
            continue
        if tree is None:
            tree = CountTree([group_counts(x) for x in sets])
            bits = repeated_bits(sets, BITS) if len(sets) >= NUMBERED else None
        near, at_once = tree.search(i, other), 1
        while len(near):
            some, near = near[:at_once], near[at_once:]
            if bits is None:
                found = [j for j in some if linked(sets[i], sets[j])]
            else:
                both = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64)
                found = some[(both > 0) & (100 * both >= 75 * (sizes[i] + sizes[some] - both))]
            for j in found:
                comps[comps == comps[j]] = comps[i]
            if len(found):
                gained |= comps == comps[i]
                near = near[comps[near] != comps[i]]
            at_once = 1 if bits is None else AT_ONCE
    out = []
    for comp in np.unique(comps[gained]):
        members = sids[comps == comp]
        out += [(int(x), int(members.min())) for x in members if x != members.min()]
    return out


NEAR = "token long, sid long, pos int, size long"


def _near(rows: DataFrame) -> DataFrame:
    """(token, sid, pos, size) of the sets that the bound lets link with another of their block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def solve() -> pa.RecordBatch:
            points = [unpack(x) for *_, x in held]
            sizes = np.array([p.sum(dtype=np.int64) for p in points], np.int64)
            order, near = np.argsort(sizes, kind="stable"), np.zeros(len(held), bool)
            if len(held) > 1:
                tree, every = CountTree([points[i] for i in order]), np.ones(len(held), bool)
                for i in range(1, len(held)):
                    # what is near already only looks for what isn't yet
                    other = ~near if near[i] else every
                    found = tree.search(i, other) if other[:i].any() else []
                    if len(found):
                        near[i] = near[found] = True
            kept = order[near]
            sids, places = (np.array([h[c] for h in held], np.int64)[kept] for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([key] * len(kept), pa.int64()), pa.array(sids), pa.array(places, pa.int32()), pa.array(sizes[kept])], ["token", "sid", "pos", "size"])

        for batch in batches:
            for token, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != token:
                    if len(held) > 1:
                        yield solve()
                    key, held = token, []
                held.append(row)
        if len(held) > 1:
            yield solve()

    return rows.select("token", "sid", "pos", "counts").repartition("token").sortWithinPartitions("token", "sid").mapInArrow(scan, NEAR)


def _link(rows: DataFrame) -> DataFrame:
    """Links (a, b) inside the blocks (token, cell) of (sid, items, comp, seen, others)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def solve() -> pa.RecordBatch:
            links = []
            if len(held) > 1:
                sids, items, comps, seen, others = zip(*held, strict=True)
                sets = [np.frombuffer(x, np.uint64) for x in items]
                links = link_block(np.array(sids), sets, np.array(comps), np.array(seen), [np.array(x, np.int64).view(np.uint64) for x in others])
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("token", "cell", "sid", "items", "comp", "seen", "others")]
            for token, cell, *row in zip(*columns, strict=True):
                if key != (token, cell):
                    yield solve()
                    key, held = (token, cell), []
                if not held or held[-1][0] != row[0]:
                    held.append(row)
        yield solve()

    dealt = rows.select("token", "cell", "sid", "items", "comp", "seen", "others").repartition("token", "cell").sortWithinPartitions("token", "cell", "sid")
    return dealt.mapInArrow(scan, "a long, b long")


def _others(rows: DataFrame) -> DataFrame:
    """Adds ``others``, the lesser of the tokens that each row's set has in ``rows``."""
    every = rows.groupBy("sid").agg(F.collect_set("token").alias("__all"))
    return rows.join(every, "sid").withColumn("others", F.filter("__all", lambda t: t < F.col("token"))).drop("__all")


def _cell(load: Column, of: str = "sid") -> Column:
    """The number of a row's cell, of as many as the block's ``load`` needs."""
    return F.pmod(F.xxhash64(of, F.lit(11)), F.ceil(load))


def _blocks(rows: DataFrame) -> DataFrame:
    """(token, k): of the tokens with the same members, in (token, sid) rows, one with its number of members."""
    marks = rows.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(5))).alias("y"))
    return marks.groupBy("k", "x", "y").agg(F.min("token").alias("token")).filter("k > 1").select("token", "k")


def links(docs: DataFrame, signed: DataFrame, hot, miss: float = MISS) -> DataFrame:
    """(node, comp) over the ids of sets that link with another set."""
    prefixes = save(_prefixes(docs, hot, miss), "op6-prefixes")
    shared = prefixes.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high").select("token")
    shared = save(shared, "op6-shared")
    held = prefixes.join(shared, "token").repartition("token", "sid").dropDuplicates(["token", "sid"])
    held = save(held, "op6-held", [prefixes, shared])
    blocks = save(_blocks(held), "op6-blocks")
    points = signed.groupBy("sid").agg(F.first("counts").alias("counts"), F.first("size").alias("size"))
    placed = save(held.join(blocks, "token"), "op6-placed", [held, blocks]).join(points, "sid")
    near = _near(placed.filter(F.col("k") <= NEAR_BLOCK)).unionByName(placed.filter(F.col("k") > NEAR_BLOCK).select("token", "sid", "pos", "size"))
    near = save(near, "op6-near")
    blocks = save(_blocks(near).select("token"), "op6-blocks")
    load = F.lit(1 / BLOCK) + F.col("size") / F.lit(WEIGHT)
    near = near.join(blocks, "token").withColumn("load", load).drop("size")
    held = save(near.join(near.groupBy("token").agg(F.sum("load").alias("k")), "token"), "op6-members", [near, blocks])
    first = held.groupBy("sid").agg(F.min_by(F.struct("token", "k"), "pos").alias("first")).select("sid", "first.*")
    first = first.withColumn("cell", _cell(F.col("k"))).withColumn("seen", F.xxhash64("token", "cell").bitwiseOR(F.lit(1).cast("long")))
    first = save(first, "op6-first")
    wanted = signed.filter("size > 0").groupBy("sid").agg(F.min("doc").alias("doc")).join(first, "sid")
    dealt = save(_sets(docs.join(wanted, "doc").select("sid", "token", "cell", "seen", "text")), "op6-sets")
    sets = dealt.select("sid", "items")

    found = save(_link(dealt.withColumn("comp", F.col("sid")).withColumn("seen", F.lit(0).cast("long")).withColumn("others", F.array().cast("array<bigint>"))), "op6-links")
    # a set is in one cell so far: the stars are the components
    comps = found.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())

    def open_blocks(comps: DataFrame) -> DataFrame:
        """(token, k, load, sid, comp, seen) of blocks whose pairs aren't all settled."""
        known = first.select("sid", "seen").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        members = save(held.select("token", "k", "load", "sid").join(known, "sid"), "op6-known")
        mixed = members.groupBy("token").agg(*(f("comp").alias(n + "_comp") for n, f in (("low", F.min), ("high", F.max))), *(f("seen").alias(n + "_seen") for n, f in (("low", F.min), ("high", F.max))))
        mixed = save(mixed.filter("low_comp <> high_comp and low_seen <> high_seen").select("token"), "op6-mixed")
        return save(members.join(mixed, "token"), "op6-open", [members, mixed])

    again = open_blocks(comps)
    few = again.filter("k <= 1").withColumn("cell", F.lit(0).cast("long"))
    large = again.filter("k > 1")
    mark, who = F.xxhash64("sid", "token"), F.struct("sid", "load")  # other members for other shingles
    ends = large.groupBy("token", "comp").agg(F.min_by(who, mark).alias("low"), F.max_by(who, mark).alias("high"))
    ends = save(ends.select("token", "comp", F.explode(F.array_distinct(F.array("low", "high"))).alias("end")).select("token", "comp", "end.*"), "op6-ends")
    parts = save(ends.groupBy("token").agg(F.sum("load").alias("k")), "op6-parts")
    ends = ends.join(parts, "token").withColumn("cell", _cell(F.col("k")))
    # only blocks that compare all their pairs stand in for others
    met = _others(few.select("token", "cell", "sid", "comp", "seen")).unionByName(_others(ends.select("token", "cell", "sid", "comp", F.lit(0).cast("long").alias("seen"))))
    found = found.unionByName(save(_link(met.join(sets, "sid")), "op6-links", [again]))
    comps = components(found)

    rest = open_blocks(comps).filter("k > 1")
    if not rest.isEmpty():
        counts = rest.groupBy("token", "comp").agg(F.sum("load").alias("n"))
        main = counts.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        main = save(main, "op6-main")
        grid = rest.join(main, "token").withColumn("across", F.ceil(F.col("all"))).withColumn("down", F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("most"))))
        i, j = F.pmod(F.xxhash64("sid", F.lit(11)), F.col("across")), F.pmod(F.xxhash64("sid", F.lit(13)), F.col("down"))
        home = grid.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("down") - 1), lambda d: i * F.col("down") + d)))
        guest = grid.filter("comp <> main").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("across") - 1), lambda a: a * F.col("down") + j)))
        met = _others(home.unionByName(guest).select("token", "cell", "sid", "comp", F.lit(0).cast("long").alias("seen")))
        comps = components(found.unionByName(save(_link(met.join(sets, "sid")), "op6-links")))
    drop(dealt, held, first)
    return comps


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """(doc, n_shingles, component_id): the smallest id reachable by links, per row.

    ``miss``: see the prefixes above; infinite for prefixes that can't miss.
    """
    with scratch(docs.sparkSession):
        return save(_near_duplicates(docs, doc, text, miss), "op6-components", keep=True)


def _near_duplicates(docs: DataFrame, doc: str, text: str, miss: float) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    made = save(_signatures(rows), "op6-signed")
    signed = made.filter("size is not null").select("doc", "size", "sid", "counts")
    named = signed.filter("doc is not null")
    n = signed.count()
    counts = made.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(HOT_LEAST, HOT * n))
    hot = spark.sparkContext.broadcast(np.sort(counts.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)))
    comps = links(rows.filter("doc is not null"), named, hot, miss)

    least = named.filter("size > 0").groupBy("sid").agg(F.min("doc").alias("low"))
    # one id with several texts joins their sets
    several = named.filter("size > 0").groupBy("doc").agg(F.min("sid").alias("a"), F.max("sid").alias("b"), F.count("*").alias("n")).filter("a <> b")
    if not several.isEmpty():
        joined = named.filter("size > 0").join(several.select("doc", "a"), "doc").select("a", F.col("sid").alias("b"))
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(joined))
    by_comp = comps.join(least, comps.node == least.sid).groupBy("comp").agg(F.min("low").alias("component_id"))
    place = least.join(comps, least.sid == comps.node, "left").join(by_comp, "comp", "left")
    place = place.select("sid", F.coalesce("component_id", "low").alias("component_id"))
    out = signed.join(place, "sid", "left")
    own = F.when(F.col("doc").isNull(), F.lit(None).cast("long")).when(F.col("size") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(doc), F.col("size").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Texts without shingles all stay, as do rows with a null id; repeated rows of the
    smallest id stay too.
    """
    gone = fresh("__doc", docs)
    found = near_duplicates(docs, doc, text).filter(F.col("component_id") < F.col(doc)).select(F.col(doc).alias(gone)).distinct()
    return docs.join(found, F.col(doc) == F.col(gone), "left_anti")
