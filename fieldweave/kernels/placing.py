"""Where along the field a frame's lines stand, from the numbers read next to some of them."""

from __future__ import annotations

import numpy as np

STEP, ENDS = 5.0, (5.0, 115.0)
_SAME = 1e-9


class _Search:
    """Best meanings of the numbers for lines that go on by `step`: depth first, with the part that no choice can undo as bound."""

    def __init__(self, n: int, step: float, options: np.ndarray, weight: np.ndarray) -> None:
        self.options, self.weight, self.total = options, weight, weight.sum()
        self.lines = step * np.arange(n)
        self.least, self.most = options.min(axis=1), options.max(axis=1)
        self.turns = np.unique(np.concatenate([options.ravel(), *(e - self.lines for e in ENDS)]))
        self.best: tuple[float, tuple[int, ...]] = (np.inf, ())
        for at in self.turns:  # the meanings nearest to some offset: a good beginning
            self._offer(tuple(np.argmin(np.abs(options - at), axis=1).tolist()))
        self._go((), 0.0)

    def _beyond(self, offset: np.ndarray) -> np.ndarray:
        values = np.asarray(offset)[..., None] + self.lines
        return (np.maximum(0, ENDS[0] - values) + np.maximum(0, values - ENDS[1])).sum(axis=-1)

    def _offer(self, picks: tuple[int, ...]) -> None:
        offsets = self.options[np.arange(len(picks)), picks]
        offset = (offsets * self.weight).sum() / self.total
        score = float((np.abs(offsets - offset) * self.weight).sum() / self.total + self._beyond(offset))
        if score < self.best[0] - _SAME or score <= self.best[0] + _SAME and picks < self.best[1]:
            self.best = (min(score, self.best[0]) if picks and score > self.best[0] else score, picks)

    def _bound(self, picks: tuple[int, ...], sum_: float) -> float:
        """No choice for the rest scores less: the score is linear in the offset between the places where it turns."""
        k, w = len(picks), self.weight
        low, high = ((sum_ + (side[k:] * w[k:]).sum()) / self.total for side in (self.least, self.most))
        at = np.concatenate([[low, high], self.turns[(self.turns > low) & (self.turns < high)]])
        taken = np.abs(self.options[np.arange(k), list(picks)][:, None] - at) if k else np.zeros((0, len(at)))
        free = np.abs(self.options[k:, :, None] - at).min(axis=1)
        return float(((np.concatenate([taken, free]) * w[:, None]).sum(axis=0) / self.total + self._beyond(at)).min())

    def _go(self, picks: tuple[int, ...], sum_: float) -> None:
        k = len(picks)
        if k == len(self.options):
            self._offer(picks)
            return
        for pick in range(1 if self.least[k] == self.most[k] else 2):
            further, more = (*picks, pick), sum_ + float(self.options[k, pick] * self.weight[k])
            bound = self._bound(further, more)
            if bound < self.best[0] - _SAME or bound <= self.best[0] + _SAME and further <= self.best[1][: k + 1]:
                self._go(further, more)


def placed(n: int, index: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[list[float], float]:
    """(places of the n lines, score). A number stands on either half, 50 in the middle; lines go on by five up or down.

    The score is the weighted mean of how far the numbers disagree on where the first line is, and how far lines are
    beyond the field. Of equally good choices, the one with the first number nearest to the near end counts, then the
    second and so on; then lines that go down.
    """
    found = []
    for step in (-STEP, STEP):
        options = np.column_stack([10.0 + value, np.where(value == 50, 60.0, 110.0 - value)]) - step * index[:, None]
        search = _Search(n, step, options, weight)
        offset = (options[np.arange(len(index)), list(search.best[1])] * weight).sum() / weight.sum()
        found.append((search.best[0], search.best[1], step, offset))
    least = min(f[0] for f in found)
    score, _, step, offset = min((f for f in found if f[0] <= least + _SAME), key=lambda f: (f[1], f[2]))
    return [float(offset + step * i) for i in range(n)], score
