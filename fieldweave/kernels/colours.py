"""Clusters of the colours of one clip's detections: two teams, and the officials where they stand out as few."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class UniformOptions:
    """Rounds of k-means, how few officials are, and how clear a row's cluster must be."""

    rounds: int = 20
    few_share: float = 0.18
    few_rows: int = 2
    sure: float = 0.15
    around: float = 0.02
    least_rows: int = 4
    least_for_officials: int = 9


def apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.linalg.norm(points[:, None] - centres[None], axis=2)


def spread_out(points: np.ndarray, k: int, by: int) -> np.ndarray:
    """k rows of the points: the least in column `by`, then each time the one farthest from all before it."""
    chosen = [int(points[:, by].argmin())]
    for _ in range(k - 1):
        chosen.append(int(apart(points, points[chosen]).min(axis=1).argmax()))
    return points[chosen]


def settled(points: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres after k-means from the given ones, and how many points each has; a centre without points stays."""
    for _ in range(rounds):
        own = apart(points, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=c, minlength=len(centres)) for c in points.T], axis=1)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(means, centres):
            break
        centres = means
    return centres, np.bincount(apart(points, centres).argmin(axis=1), minlength=len(centres))


def uniforms(colours: np.ndarray, away: np.ndarray | None, options: UniformOptions = UniformOptions()) -> tuple[np.ndarray, np.ndarray]:
    """A name for each row (team_0, team_1, official or unknown) and how clear it is.

    colours: scaled, with lab_a as the second column. away: how far each row is from the anchor's time, or
    None. Three clusters are fitted around an anchor with enough rows; the smallest are the officials unless
    it is no smaller than a team can be, when the two largest go on alone.
    """
    name, clear = np.full(len(colours), "unknown", object), np.zeros(len(colours))
    known = np.flatnonzero(np.isfinite(colours).all(axis=1))
    if len(known) < options.least_rows:
        return name, clear
    every = colours[known]
    near = every if away is None else every[away[known] <= away[known].min() + options.around]
    k = 3 if away is not None and len(near) >= options.least_for_officials else 2
    if len(near) < k:
        near, k = every, 2
    centres, sizes = settled(near, spread_out(near, k, by=1), options.rounds)
    largest = np.argsort(-sizes, kind="stable")[:2]
    if k == 3 and sizes.min() > max(options.few_rows, int(options.few_share * len(near))):
        centres, sizes = settled(near, centres[largest], options.rounds)
        largest = np.argsort(-sizes, kind="stable")[:2]
    label = np.full(len(centres), "official", object)
    label[np.sort(largest)] = ["team_0", "team_1"][: len(largest)]
    d = apart(every, centres)
    two = np.sort(d, axis=1)[:, :2]
    clear[known] = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-6)
    sure = clear[known] >= options.sure
    name[known[sure]] = label[d.argmin(axis=1)[sure]]
    return name, clear
