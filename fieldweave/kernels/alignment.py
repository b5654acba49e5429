"""Monotone alignment of two sequences by dynamic programming over a cost matrix."""

from __future__ import annotations

import numpy as np

MATCH, MISSING, EXTRA = "match", "missing", "extra"


def align(cost: np.ndarray, skip_row: float, skip_column: float, gate: float = np.inf) -> list[tuple[str, int, int]]:
    """Steps (kind, row, column) of a cheapest path through all rows and columns in order, -1 for what a step skips.

    A row without a column is missing, a column without a row extra. Matches over the gate are not allowed.
    Of equally cheap steps into a place a match comes first, then a missing row, then an extra column.
    """
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    step = np.zeros((n + 1, m + 1), np.int8)
    total[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j and cost[i - 1, j - 1] <= gate and total[i - 1, j - 1] + cost[i - 1, j - 1] < total[i, j]:
                total[i, j], step[i, j] = total[i - 1, j - 1] + cost[i - 1, j - 1], 1
            if i and total[i - 1, j] + skip_row < total[i, j]:
                total[i, j], step[i, j] = total[i - 1, j] + skip_row, 2
            if j and total[i, j - 1] + skip_column < total[i, j]:
                total[i, j], step[i, j] = total[i, j - 1] + skip_column, 3
    out, i, j = [], n, m
    while i or j:
        kind = step[i, j]
        i, j = i - (kind != 3), j - (kind != 2)
        out.append(((MATCH, i, j), (MISSING, i, -1), (EXTRA, -1, j))[kind - 1])
    return out[::-1]


def path_cost(steps: list[tuple[str, int, int]], cost: np.ndarray, skip_row: float, skip_column: float) -> float:
    return sum(cost[i, j] if kind == MATCH else skip_row if kind == MISSING else skip_column for kind, i, j in steps)


def least_cost(rows: np.ndarray, columns: np.ndarray, scale: float, skip_row: float, skip_column: float) -> float:
    """The cost of a cheapest path where matching costs the values' difference over `scale`; one row of the matrix is held at a time. NaN is matched with nothing."""
    skipped = skip_column * np.arange(len(columns) + 1)
    total = skipped
    for value in rows:
        match = np.abs(columns - value) / scale
        reached = total + skip_row
        reached[1:] = np.minimum(reached[1:], total[:-1] + np.where(np.isnan(match), np.inf, match))
        total = np.minimum.accumulate(reached - skipped) + skipped
    return float(total[-1])


#: Places of a matrix up to which plain numbers are faster than arrays of a diagonal's.
FEW_PLACES = 600


def _short_steps(n: int, m: int, price: dict[tuple[int, int], float], skip_row: float, skip_column: float) -> list[list[int]]:
    """The step into each place: 1 a match, 2 a missing row, 3 an extra column."""
    total = [0.0]
    for _ in range(m):
        total.append(total[-1] + skip_column)
    steps = [[0] + [3] * m]
    for i in range(n):
        line, kinds = [total[0] + skip_row], [2]
        for j in range(m):
            kind, best, match = 2, total[j + 1] + skip_row, price.get((i, j))
            if match is not None and total[j] + match <= best:
                kind, best = 1, total[j] + match
            extra = line[j] + skip_column
            if extra < best:
                kind, best = 3, extra
            line.append(best)
            kinds.append(kind)
        total = line
        steps.append(kinds)
    return steps


def _diagonal_steps(n: int, m: int, row: np.ndarray, column: np.ndarray, cost: np.ndarray, skip_row: float, skip_column: float) -> np.ndarray:
    order = np.argsort(row + column, kind="stable")
    row, column, cost = row[order], column[order], cost[order]
    starts = np.searchsorted(row + column, np.arange(n + m + 2))
    step = np.zeros((n + 1, m + 1), np.int8)
    last, before = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    last[0] = 0.0
    for d in range(1, n + m + 1):
        low, high = max(0, d - m), min(n, d)
        i = np.arange(low, high + 1)
        match = np.full(n + 1, np.inf)
        if d >= 2:
            a, b = starts[d - 2], starts[d - 1]
            match[row[a:b] + 1] = before[row[a:b]] + cost[a:b]
        total, kind = match[i], np.ones(len(i), np.int8)
        missing = np.where(i > 0, last[i - 1] + skip_row, np.inf)
        kind[missing < total] = 2
        total = np.minimum(total, missing)
        extra = np.where(i < d, last[i] + skip_column, np.inf)
        kind[extra < total] = 3
        total = np.minimum(total, extra)
        step[i, d - i] = kind
        before, last = last, np.full(n + 1, np.inf)
        last[i] = total
    return step


def listed_path(n: int, m: int, row: np.ndarray, column: np.ndarray, cost: np.ndarray, skip_row: float, skip_column: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cost) of the steps of align()'s path, -1 for what a step skips, where only listed cells can match.

    Short sequences are worked out place by place. Else a diagonal of places is worked out at once, with the additions and the order of choices of align(), so that ties come
    out the same. A byte for each place is all that is held of the matrix.
    """
    price = dict(zip(zip(row.tolist(), column.tolist()), cost.tolist()))
    steps = _short_steps(n, m, price, skip_row, skip_column) if (n + 1) * (m + 1) <= FEW_PLACES else _diagonal_steps(n, m, row, column, cost, skip_row, skip_column)
    out, i, j = [], n, m
    while i or j:
        kind = steps[i][j]
        i, j = i - (kind != 3), j - (kind != 2)
        out.append((i, j, price[i, j]) if kind == 1 else (i, -1, skip_row) if kind == 2 else (-1, j, skip_column))
    rows, columns, prices = zip(*out[::-1]) if out else ((), (), ())
    return np.array(rows, int), np.array(columns, int), np.array(prices, float)
