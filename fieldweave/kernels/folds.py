"""Folds over one key's ordered rows, where each step depends on what the steps before it kept."""

from __future__ import annotations

import numpy as np


def thinned_to_best(at: np.ndarray, score: np.ndarray, least: float) -> np.ndarray:
    """Numbers of the rows kept: each at least so far after the last one, whose place a nearer row takes if its score is greater."""
    kept: list[int] = []
    for i, t in enumerate(at):
        if kept and t - at[kept[-1]] < least:
            if score[i] > score[kept[-1]]:
                kept[-1] = i
        else:
            kept.append(i)
    return np.array(kept, int)


def clustered(offset: np.ndarray, reach: float) -> np.ndarray:
    """Group numbers of sorted offsets: each joins the group before it if it lies within reach of that group's mean so far."""
    out, total, n, group = np.zeros(len(offset), int), 0.0, 0, -1
    for i, x in enumerate(offset):
        if n and abs(x - total / n) <= reach:
            total, n = total + x, n + 1
        else:
            group, total, n = group + 1, x, 1
        out[i] = group
    return out


def longest_apart(length: np.ndarray, offset: np.ndarray, least: float) -> np.ndarray:
    """Numbers of the rows kept, longest first, each at least so far from all kept before."""
    kept: list[int] = []
    for i in np.lexsort((offset, -length)):
        if all(abs(offset[i] - offset[j]) >= least for j in kept):
            kept.append(int(i))
    return np.array(sorted(kept), int)
