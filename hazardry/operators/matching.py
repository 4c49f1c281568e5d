"""Matching of predicted and true boxes within a frame.

All-pairs overlaps are an equi-join on the frame. The one-to-one assignment of largest total overlap is the engine's one algorithm that is not
relational: it runs in Arrow batches over frames that hold both box lists, so no shuffle is needed beyond the one that brought
the lists together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardry.functions.geometry import iou


def overlaps(predicted: DataFrame, true: DataFrame, frame: str = "frame_id") -> DataFrame:
    """(frame, pred_idx, true_idx, iou) of every two boxes of a frame. Inputs: frame, idx, box."""
    a = predicted.select(frame, F.col("idx").alias("pred_idx"), F.col("box").alias("_hz_p"))
    b = true.select(frame, F.col("idx").alias("true_idx"), F.col("box").alias("_hz_t"))
    return a.join(b, frame).select(frame, "pred_idx", "true_idx", iou(F.col("_hz_p"), F.col("_hz_t")).alias("iou"))


def iou_matrix(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Overlaps of two arrays of boxes."""
    low, high = np.maximum(p[:, None, :2], t[None, :, :2]), np.minimum(p[:, None, 2:], t[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    union = size(p)[:, None] + size(t)[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of largest total weight, one to one: shortest augmenting paths with potentials, O(n^2 m)."""
    if 0 in weights.shape:
        return []
    flipped = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flipped else weights).astype(float)
    n, m = cost.shape
    if n == 1:
        pairs = [(0, int(cost[0].argmin()))]
    else:
        u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
        for row in range(1, n + 1):
            match[0], column = row, 0
            least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
            while match[column]:
                used[column] = True
                reduced = cost[match[column] - 1] - u[match[column]] - v[1:]
                better = ~used[1:] & (reduced < least[1:])
                least[1:][better], way[1:][better] = reduced[better], column
                free = np.where(used[1:], np.inf, least[1:])
                following = int(free.argmin()) + 1
                step = free[following - 1]
                u[match[used]] += step
                v[used] -= step
                least[~used] -= step
                column = following
            while column:
                match[column], column = match[way[column]], way[column]
        pairs = [(int(match[c]) - 1, c - 1) for c in range(1, m + 1) if match[c]]
    return sorted((c, r) for r, c in pairs) if flipped else sorted(pairs)


def greedy(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs by descending weight, ties by row then column."""
    out, rows, columns = [], set(), set()
    for flat in np.argsort(-weights, axis=None, kind="stable"):
        r, c = divmod(int(flat), weights.shape[1])
        if r not in rows and c not in columns:
            out.append((r, c))
            rows.add(r)
            columns.add(c)
    return sorted(out)


def match_frames(frames: DataFrame, frame: str = "frame_id", predicted: str = "pred_boxes", true: str = "true_boxes", threshold: float = 0.5, method: str = "optimal") -> DataFrame:
    """(frame, pred_idx, true_idx, iou) of the matched boxes of each frame: assigned first, then kept if the overlap reaches the threshold."""
    choose = {"optimal": assign, "greedy": greedy}[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, p, t in zip(rows[frame], rows[predicted], rows[true], strict=True):
                if p is None or t is None or not len(p) or not len(t):
                    continue
                overlap = iou_matrix(np.array([list(x) for x in p], float), np.array([list(x) for x in t], float))
                out += [(key, i, j, float(overlap[i, j])) for i, j in choose(overlap) if overlap[i, j] >= threshold]
            yield pd.DataFrame(out, columns=[frame, "pred_idx", "true_idx", "iou"])

    kind = frames.schema[frame].dataType.simpleString()
    return frames.select(frame, predicted, true).mapInPandas(run, f"`{frame}` {kind}, pred_idx int, true_idx int, iou double")
