"""The greatest values of each row of a score matrix, with ties settled by id; plain NumPy."""

from __future__ import annotations

import numpy as np


def best(rows: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` greatest values of each row number, equal ones by the smaller id; sorted by row and rank."""
    order = np.lexsort((ids, -values, rows))
    sorted_rows = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def reaching(scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all finite scores that reach the k-th greatest of their row, or miss it by ``slack`` at most."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero((scores >= kth[:, None] - slack) & np.isfinite(scores))
    return np.nonzero(np.isfinite(scores))
