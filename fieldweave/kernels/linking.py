"""Greedy one-to-one choices among candidate pairs of one key."""

from __future__ import annotations

import numpy as np


def chains(left: list, right: list, cost: np.ndarray) -> dict:
    """The root of each id after the cheapest links are taken first, each id with one successor and one predecessor.

    Ties go by the ids. Links lead forward in time, so a chain never overlaps itself.
    """
    after, before = {}, {}

    def root(x):
        while x in before:
            x = before[x]
        return x

    for i in sorted(range(len(left)), key=lambda i: (cost[i], left[i], right[i])):
        a, b = left[i], right[i]
        if a not in after and b not in before and root(a) != b:
            after[a], before[b] = b, a
    return {x: root(x) for x in {*left, *right}}


def paired_in_order(order: list[int], other: list[int], cost: list[float], most: float, margin: float) -> dict[int, tuple[int, float, str]]:
    """For each position its partner, cost and status, positions in ascending order.

    A position takes its cheapest free candidate if that is cheap and clearly cheaper than the next;
    if it is not clear, the position stays single and ambiguous, and its candidates stay free. What stays single
    costs its cheapest candidate, or `most` without any.
    """
    by: dict[int, list[tuple[float, int]]] = {}
    for a, b, c in zip(order, other, cost):
        by.setdefault(a, []).append((c, b))
    used: set[int] = set()
    out: dict[int, tuple[int, float, str]] = {}
    for a in sorted(by):
        if a in used:
            continue
        free = sorted(x for x in by[a] if x[1] not in used)
        if not free or free[0][0] > most:
            out[a] = (-1, free[0][0] if free else most, "single")
            continue
        gap = free[1][0] - free[0][0] if len(free) > 1 else np.inf
        if gap >= margin:
            used |= {a, free[0][1]}
            out[a] = (free[0][1], free[0][0], "paired")
        else:
            out[a] = (-1, free[0][0], "ambiguous")
    return out
