"""Quality classifier: histogram gradient-boosted trees over document statistics.

``features`` turns a text into statistics of its bytes, words and lines; labels,
language, source and id are never among them.  ``fit`` grows trees on a bounded
sample of labelled rows: at most ``max_rows``, those whose id hashes lowest.
The forest is flattened into arrays, and scoring walks all rows down all trees at
once in numpy.

Defined cases: null and empty texts have all-zero statistics and are scored like
any other; labels that are null, or whose document is missing, aren't learnt; of
several labels of one document the lowest counts, of several texts the least; without labels every score is
0.5, and with one class only its rate; extra columns pass through, but for one of the output's name, which is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = (
    "log_bytes", "log_words", "word_length", "long_words", "upper", "digits", "spaces", "marks", "symbols", "pipes", "shouts",
    "high_bytes", "entropy", "distinct_words", "top_word", "distinct_pairs", "line_words", "distinct_lines", "ended_lines", "capital_words", "marked_words",
)


def _group(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


_GROUPS = np.stack(
    [
        _group(bytes(range(65, 91))),
        _group(b"0123456789"),
        _group(b" \t\n\r\x0b\x0c"),
        _group(b".,;:'\"()-"),
        _group(b"#$%&*@^~+=<>{}[]\\/_`"),
        _group(b"|"),
        _group(b"!?"),
        _group(bytes(range(128, 256))),
    ],
    axis=1,
)


def features(text: str | None) -> list[float]:
    """The statistics in ``NAMES`` of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        float(lengths.sum()) / m,
        float((lengths > 18).sum()) / m,
        *(counts @ _GROUPS / n),
        float(-(share * np.log2(share)).sum()),
        len(seen) / m,
        max(seen.values(), default=0) / m,
        len(set(zip(words, words[1:], strict=False))) / m,
        len(words) / k,
        len(set(lines)) / k,
        sum(x.rstrip()[-1] in ".!?:" for x in lines) / k,
        sum(map(str.istitle, words)) / m,
        sum(not w[-1].isalnum() for w in words) / m,
    ]


@dataclass
class Forest:
    """Trees in flat arrays; a leaf points at itself."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``."""
        raw = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            rows = np.arange(len(x))[:, None]
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.low[node], self.high[node])
            raw = raw + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit_arrays(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, min_rows: int = 20, ridge: float = 1.0) -> Forest:
    """Grows the trees level by level from histograms of gradients."""
    n, width = x.shape
    if not n:
        return Forest()
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    forest = Forest(base=float(np.log(mean / (1 - mean))), depth=depth)
    if y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    offsets = np.arange(width) * bins
    feature, cut, low, high, value, roots = [], [], [], [], [], []

    def leaf() -> int:
        at = len(feature)
        for part, v in ((feature, 0), (cut, np.inf), (low, at), (high, at), (value, 0.0)):
            part.append(v)
        return at

    raw = np.full(n, forest.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        roots.append(leaf())
        node, slots = np.zeros(n, np.int64), [roots[-1]]
        for level in range(depth + 1):
            size = len(slots)
            key = (node[:, None] * (width * bins) + offsets + binned).ravel()
            live = np.repeat(node >= 0, width)
            total = size * width * bins
            sums = [np.bincount(key[live], np.repeat(w, width)[live], minlength=total).reshape(size, width, bins) for w in (grad, hess, np.ones(n))]
            g, h, c = (s.cumsum(axis=2) for s in sums)
            gt, ht, ct = (s[:, :, -1:] for s in (g, h, c))
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(c < min_rows) | (ct - c < min_rows)] = -np.inf
            best = gain.reshape(size, -1).argmax(axis=1)
            move = np.full((size, 3), -1)
            new: list[int] = []
            for s, at in enumerate(slots):
                j, b = divmod(int(best[s]), bins)
                if level == depth or b >= len(cuts[j]) or not gain[s, j, b] > 1e-6:
                    value[at] = rate * float(gt[s, 0, 0] / (ht[s, 0, 0] + ridge))
                    continue
                feature[at], cut[at] = j, float(cuts[j][b])
                low[at], high[at] = leaf(), leaf()
                move[s] = (j, b, len(new))
                new += [low[at], high[at]]
            for s, at in enumerate(slots):
                if move[s, 0] < 0:
                    raw[node == s] += value[at]
            inside = node >= 0
            m = move[np.where(inside, node, 0)]
            goes = inside & (m[:, 0] >= 0)
            right = binned[np.arange(n), np.where(goes, m[:, 0], 0)] > m[:, 1]
            node = np.where(goes, m[:, 2] + right, -1)
            slots = new
            if not slots:
                break
    forest.feature, forest.cut = np.array(feature, np.int32), np.array(cut)
    forest.low, forest.high = np.array(low, np.int32), np.array(high, np.int32)
    forest.value, forest.roots = np.array(value), np.array(roots, np.int32)
    return forest


def _rows(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in texts.to_pylist()], float).reshape(-1, len(NAMES))


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    def make(texts: pa.Array) -> pa.Array:
        return pa.array(list(_rows(texts)), pa.list_(pa.float64()))

    make.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(make, T.ArrayType(T.DoubleType()))(F.col(text)))


def held_out(doc: Column) -> Column:
    """Rows that are never learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc: str = "doc_id", text: str = "text", label: str = "quality") -> Forest:
    """Trees learnt from at most ``max_rows`` labelled documents outside the held-out fold."""
    known = labels.select(F.col(doc).alias("doc"), F.col(label).alias("label")).filter("doc is not null and label is not null")
    known = known.filter(~held_out(F.col("doc"))).groupBy("doc").agg(F.min("label").alias("label"))
    some = known.orderBy(F.xxhash64("doc"), "doc").limit(max_rows)
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(F.broadcast(some), "doc")
    texts = texts.groupBy("doc", "label").agg(F.min("text").alias("text"))  # repeated rows count once
    got = with_features(texts).select("doc", "label", "features").orderBy("doc", "features").toPandas()
    x = np.array(got["features"].tolist(), float).reshape(-1, len(NAMES))
    return fit_arrays(x, (got["label"].to_numpy() > 0).astype(float))


def score(df: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` plus the probability that a document is of good quality."""
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def rate(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(_rows(texts)), pa.float64())

    rate.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(rate, T.DoubleType())(F.col(text)))
