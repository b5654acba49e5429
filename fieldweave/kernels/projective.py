"""Projective maps of the plane from pairs of points."""

from __future__ import annotations

import numpy as np


def apply(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ np.asarray(matrix).T
    return p[:, :2] / p[:, 2:]


def _scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = points.mean(axis=0)
    scale = np.sqrt(2) / max(np.linalg.norm(points - mean, axis=1).mean(), 1e-12)
    t = np.array([[scale, 0, -scale * mean[0]], [0, scale, -scale * mean[1]], [0, 0, 1]])
    return apply(t, points), t


def fit(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The least-squares map of four or more pairs, or None if they do not give one."""
    if len(source) < 4:
        return None
    a, ta = _scaled(np.asarray(source, float))
    b, tb = _scaled(np.asarray(target, float))
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    rows = np.concatenate([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])
    _, s, vt = np.linalg.svd(rows)
    if s[-2 if len(s) > 8 else -1] < 1e-12:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def robust_fit(source: np.ndarray, target: np.ndarray, reach: float, tries: int = 200, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """A map that as many pairs as possible follow within reach, fitted to these, and which they are; the same at every run."""
    n = len(source)
    inside = np.zeros(n, bool)
    if n < 4:
        return None, inside
    random = np.random.default_rng(seed)
    for _ in range(tries):
        four = random.choice(n, 4, replace=False)
        h = fit(source[four], target[four])
        if h is None:
            continue
        with np.errstate(all="ignore"):
            near = np.linalg.norm(apply(h, source) - target, axis=1) <= reach
        if near.sum() > inside.sum():
            inside = near
            if inside.all():
                break
    if inside.sum() < 4:
        return None, inside
    h = fit(source[inside], target[inside])
    if h is None:
        return None, inside
    with np.errstate(all="ignore"):
        near = np.linalg.norm(apply(h, source) - target, axis=1) <= reach
    return (fit(source[near], target[near]), near) if near.sum() >= inside.sum() else (h, inside)
