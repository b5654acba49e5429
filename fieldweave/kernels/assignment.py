"""Minimum-cost assignment of the rows of a small matrix to its columns."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of a cheapest matching of all of the shorter side, rows in ascending order.

    Shortest augmenting paths with potentials, one row at a time; entries must be finite. Most rows find their column free.
    """
    cost = np.ascontiguousarray(cost, float)
    if cost.ndim != 2 or 0 in cost.shape:
        return np.empty(0, int), np.empty(0, int)
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    # Up to the first row that doesn't, all find the cheapest column free, and no potential of a column has changed.
    cheapest = cost.argmin(axis=1).tolist()
    if len(set(cheapest)) == n:
        return np.arange(n), np.array(cheapest)
    taken = next(i for i in range(1, n) if cheapest[i] in cheapest[:i])
    u[:taken], row_of[cheapest[:taken]] = cost[np.arange(taken), cheapest[:taken]], np.arange(taken)
    for new in range(taken, n):
        best = cost[new] - v
        at = int(best.argmin())
        length = best[at]
        if row_of[at] < 0:
            u[new], row_of[at] = length, new
            continue
        via, ahead = np.full(m, -1), best.copy()  # ahead: best, but infinite where it is done
        done, lengths = [at], [length]
        while row_of[at] >= 0:
            row, ahead[at] = row_of[at], np.inf
            reduced = length + cost[row] - u[row] - v
            reduced[done] = np.inf
            closer = (reduced < ahead).nonzero()[0]
            ahead[closer], via[closer] = reduced[closer], at
            at = int(ahead.argmin())
            length = ahead[at]
            done.append(at)
            lengths.append(length)
        over = length - np.array(lengths)
        u[new] += length
        u[row_of[done[:-1]]] += over[:-1]
        v[done] -= over
        while at >= 0:
            before = via[at]
            row_of[at] = row_of[before] if before >= 0 else new
            at = before
    columns = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[columns])
    return row_of[columns][order], columns[order]


def assign_many(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest matching of every matrix of a stack (b, n, m) with n <= m.

    The same steps as assign(), taken for all matrices at once: each pass of the loops advances all those
    that are not done yet.
    """
    b, n, m = cost.shape
    u, v = np.zeros((b, n)), np.zeros((b, m))
    row_of = np.full((b, m), -1)
    for new in range(n):
        best, via, done = np.full((b, m), np.inf), np.full((b, m), -1), np.zeros((b, m), bool)
        row, at, length, end = np.full(b, new), np.full(b, -1), np.zeros(b), np.zeros(b, int)
        live = np.arange(b)
        while len(live):
            r, fixed, near, back = row[live], done[live], best[live], via[live]
            reduced = length[live][:, None] + cost[live, r] - u[live, r][:, None] - v[live]
            closer = ~fixed & (reduced < near)
            near, back = np.where(closer, reduced, near), np.where(closer, at[live][:, None], back)
            best[live], via[live] = near, back
            next_ = np.where(fixed, np.inf, near).argmin(axis=1)
            length[live], at[live] = near[np.arange(len(live)), next_], next_
            done[live, next_] = True
            owner = row_of[live, next_]
            free = owner < 0
            end[live[free]] = next_[free]
            row[live] = owner
            live = live[~free]
        u[:, new] += length
        which, column = np.nonzero(done & (row_of >= 0))
        u[which, row_of[which, column]] += length[which] - best[which, column]
        v -= np.where(done, length[:, None] - best, 0.0)
        live, at = np.arange(b), end
        while len(live):
            before = via[live, at[live]]
            row_of[live, at[live]] = np.where(before >= 0, row_of[live, before], new)
            at[live] = before
            live = live[before >= 0]
    which, column = np.nonzero(row_of >= 0)
    out = np.empty((b, n), int)
    out[which, row_of[which, column]] = column
    return out


def assign_listed(frame: np.ndarray, left: np.ndarray, right: np.ndarray, cost: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """Numbers of the entries chosen in a cheapest matching of as many as there can be of each frame's listed (left, right).

    frame is sorted; left and right are numbers. Frames are matrices padded to one size, where what is not
    listed costs more than all that is; they are solved in stacks of about so many cells.
    """
    if not len(frame):
        return np.empty(0, int)
    starts = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
    n_entries = np.diff(np.append(starts, len(frame)))
    number = np.repeat(np.arange(len(starts)), n_entries)

    def ranked(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((side, number))
        new = np.append(False, (side[order][1:] != side[order][:-1]) & (number[order][1:] == number[order][:-1]))
        count = np.cumsum(new)
        rank = np.empty(len(side), int)
        rank[order] = count - count[starts][number[order]]
        return rank, np.maximum.reduceat(rank, starts) + 1

    (i, rows), (j, columns) = ranked(left), ranked(right)
    tall = rows > columns
    i, j = np.where(tall[number], j, i), np.where(tall[number], i, j)
    rows, columns = np.minimum(rows, columns), np.maximum(rows, columns)
    high, low = np.maximum.reduceat(cost, starts), np.minimum.reduceat(cost, starts)
    dear = high + (high - low + 1.0) * (rows + columns)
    order, chosen = np.lexsort((columns, rows)), []
    stacks = np.cumsum(rows[order] * np.maximum.accumulate(columns[order])) // cells
    for part in np.split(order, np.flatnonzero(np.diff(stacks)) + 1):
        n, m = rows[part].max(), max(columns[part].max(), rows[part].max())
        stack = np.broadcast_to(dear[part][:, None, None], (len(part), n, m)).copy()
        entry = np.full(stack.shape, -1)
        at = np.concatenate([np.arange(starts[f], starts[f] + n_entries[f]) for f in part])
        which = np.repeat(np.arange(len(part)), n_entries[part])
        # Of an entry that is listed twice, the cheaper one stands.
        at_order = np.argsort(-cost[at], kind="stable")
        at, which = at[at_order], which[at_order]
        stack[which, i[at], j[at]] = cost[at]
        entry[which, i[at], j[at]] = at
        found = np.take_along_axis(entry, assign_many(stack)[:, :, None], axis=2).ravel()
        chosen.append(found[found >= 0])
    return np.sort(np.concatenate(chosen))
