"""Scores of a segmentation against truth: confusion, IoU, optimal matching, ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "session_id"


def confusion(df: DataFrame, pred: str = "pred", truth: str = "truth", key: str = KEY) -> DataFrame:
    """(key, pred, truth, n) over rows where both labels are at least 0."""
    both = df.filter((F.col(pred) >= 0) & (F.col(truth) >= 0))
    return both.groupBy(key, F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.count("*").alias("n"))


def iou(matrix: DataFrame, key: str = KEY) -> DataFrame:
    """Adds ``iou`` with marginals of the confusion matrix itself."""
    row, column = (F.sum("n").over(Window.partitionBy(key, c)) for c in ("pred", "truth"))
    return matrix.withColumn("iou", F.col("n") / (row + column - F.col("n")))


def unmatched(labels: DataFrame, other: DataFrame, label: str, key: str = KEY) -> DataFrame:
    """Labels of ``labels`` that ``other`` doesn't pair."""
    return labels.select(key, label).distinct().join(other, [key, label], "left_anti")


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of highest total gain (shortest augmenting paths)."""
    rows, columns = gain.shape
    if rows > columns:
        return sorted((r, c) for c, r in assignment(gain.T))
    cost = gain.max(initial=0) - gain
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    owner, way = np.zeros(columns + 1, int), np.zeros(columns + 1, int)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        least, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool)
        while owner[j]:
            used[j] = True
            k = owner[j]
            slack = np.where(used[1:], np.inf, cost[k - 1] - u[k] - v[1:])
            better = slack < least[1:]
            least[1:][better], way[1:][better] = slack[better], j
            nxt = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
        while j:
            owner[j], j = owner[way[j]], way[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, columns + 1) if owner[j])


def score(df: DataFrame, pred: str = "pred", truth: str = "truth", key: str = KEY) -> DataFrame:
    """One row per scan: mean, least and area-weighted IoU of the best one-to-one match.

    A truth label without a match counts 0 in mean and least and not in the weighted
    one.  The matrix of a scan is tiny (labels by labels), so one group holds it.
    """
    return score_matrix(confusion(df, pred, truth, key), key)


def score_matrix(counts: DataFrame, key: str = KEY, group: str | None = None) -> DataFrame:
    """``score`` from a confusion (key, pred, truth, n).

    Rows of one ``group``, a column that ``key`` decides, are solved together: matrices are so
    small that a group of its own costs more than the match.
    """
    group = group or key
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrix = iou(counts, key).repartition(tasks, group)  # few bytes and much work, which coalescing goes by
    kind = counts.schema[key].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(part) for _, part in pdf.groupby(key, sort=False, dropna=False)])

    def one(pdf: pd.DataFrame) -> dict:
        preds, truths = np.unique(pdf["pred"]), np.unique(pdf["truth"])
        gain = np.zeros((len(preds), len(truths)))
        at = np.searchsorted(preds, pdf["pred"]), np.searchsorted(truths, pdf["truth"])
        gain[at] = pdf["iou"]
        area = np.zeros(len(truths))
        np.add.at(area, at[1], pdf["n"])
        pairs = [(i, j) for i, j in assignment(gain) if gain[i, j] > 0]
        got = np.zeros(len(truths))
        for i, j in pairs:
            got[j] = gain[i, j]
        hit = [j for _, j in pairs]
        weighted = float((got[hit] * area[hit]).sum() / area[hit].sum()) if hit else 0.0
        return {key: pdf[key].iloc[0], "mean_iou": got.mean(), "min_iou": got.min(), "weighted_iou": weighted, "n_pred": len(preds), "n_truth": len(truths), "n_matched": len(pairs)}

    return matrix.groupBy(group).applyInPandas(solve, f"{key} {kind}, mean_iou double, min_iou double, weighted_iou double, n_pred long, n_truth long, n_matched long")


def leaderboard(scores: DataFrame, by: str, position: str, top: int | None = None) -> DataFrame:
    """Adds ``rank``: descending, ties in input order; ``top`` keeps so many."""
    ranked = scores.orderBy(F.desc(by), position)
    ranked = ranked.limit(top) if top else ranked
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), position)))
