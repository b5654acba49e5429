import itertools

import numpy as np
import pytest

from fieldweave.kernels import folds, projective
from fieldweave.kernels.alignment import align, path_cost
from fieldweave.kernels.assignment import assign
from fieldweave.kernels.linking import chains, paired_in_order
from fieldweave.kernels.tracker import BoxTracker, Detections, FieldTracker, TrackerOptions


def test_assignment_is_as_cheap_as_any_permutation():
    random = np.random.default_rng(0)
    for _ in range(200):
        cost = np.round(random.random(random.integers(1, 6, 2)) * 10, random.integers(0, 3))
        rows, columns = assign(cost)
        short = cost if cost.shape[0] <= cost.shape[1] else cost.T
        best = min(sum(short[i, p[i]] for i in range(len(short))) for p in itertools.permutations(range(short.shape[1]), len(short)))
        assert len(rows) == min(cost.shape) == len(set(columns)) and cost[rows, columns].sum() == pytest.approx(best)
    assert len(assign(np.empty((0, 3)))[0]) == 0


def brute_force(cost, skip_row, skip_column, gate):
    n, m = cost.shape

    def walk(i, j):
        if (i, j) == (n, m):
            return 0.0
        options = []
        if i < n and j < m and cost[i, j] <= gate:
            options.append(cost[i, j] + walk(i + 1, j + 1))
        if i < n:
            options.append(skip_row + walk(i + 1, j))
        if j < m:
            options.append(skip_column + walk(i, j + 1))
        return min(options)

    return walk(0, 0)


def test_alignment_is_as_cheap_as_any_path():
    random = np.random.default_rng(1)
    for _ in range(100):
        cost = random.random(random.integers(0, 5, 2)) * 3
        steps = align(cost, 1.1, 0.9, 1.75)
        assert path_cost(steps, cost, 1.1, 0.9) == pytest.approx(brute_force(cost, 1.1, 0.9, 1.75))
        assert [s[1] for s in steps if s[1] >= 0] == list(range(cost.shape[0]))


def test_alignment_prefers_a_match_and_then_a_missing_row():
    assert [s[0] for s in align(np.array([[2.0]]), 1.0, 1.0)] == ["match"]
    assert [s[0] for s in align(np.array([[9.0]]), 1.0, 1.0)] == ["missing", "extra"] or [s[0] for s in align(np.array([[9.0]]), 1.0, 1.0)] == ["extra", "missing"]


def test_chains_take_cheap_links_first_and_keep_one_successor():
    assert chains(["a", "a", "b"], ["b", "c", "c"], np.array([1.0, 0.5, 2.0])) == {"a": "a", "c": "a", "b": "b"}


def test_ambiguous_positions_leave_their_partner_free():
    got = paired_in_order([0, 0, 1], [1, 2, 2], [1.0, 1.1, 0.2], 1.55, 0.2)
    assert got[0][2] == "ambiguous" and got[1] == (2, 0.2, "paired")


def test_folds():
    assert folds.thinned_to_best(np.array([0, 0.2, 2]), np.array([1, 3, 1]), 0.65).tolist() == [1, 2]
    assert folds.clustered(np.array([0, 1, 1.4, 5]), 1.0).tolist() == [0, 0, 0, 1]
    assert folds.longest_apart(np.array([5, 9, 4]), np.array([0, 1, 10]), 3).tolist() == [1, 2]


def test_projective_maps_survive_outliers():
    h = np.array([[1.1, 0.1, 3], [0.05, 0.9, -2], [0.001, 0.0005, 1]])
    source = np.random.default_rng(2).random((40, 2)) * 50
    target = projective.apply(h, source)
    target[:6] += 30
    found, inside = projective.robust_fit(source, target, 0.5)
    assert inside.sum() == 34 and np.abs(found - h).max() < 1e-6


def frame(at, xs, confidence=None):
    return Detections(at, np.array([[x, 10.0] for x in xs]), np.array(confidence or [0.9] * len(xs)), ["unknown"] * len(xs))


def test_tracker_bridges_a_miss_and_follows_velocity():
    t = FieldTracker()
    ids = [t.update(frame(i / 10, [10 + i, 50])).tolist() for i in range(3)]
    assert ids == [[1, 2]] * 3
    t.update(frame(0.3, [50]))
    assert t.update(frame(0.4, [14, 50])).tolist() == [1, 2]


def test_weak_detections_only_recover_tracks():
    t = FieldTracker()
    assert t.update(frame(0.0, [10, 40], [0.9, 0.3])).tolist() == [1, -1]
    assert t.update(frame(0.1, [10, 10.1], [0.3, 0.9])).tolist() == [-1, 1]


def test_bursts_give_birth_to_no_track():
    t = FieldTracker(TrackerOptions(crowd_floor=4, crowd_factor=1.0))
    t.update(frame(0.0, [0, 20, 40]))
    ids = t.update(frame(0.1, [0, 20, 40, 60, 80, 100, 110, 118]))
    assert t.burst and sorted(ids[ids > 0].tolist()) == [1, 2, 3]


def test_boxes_follow_overlap():
    t = BoxTracker()
    a = np.array([[0, 0, 10, 10], [50, 50, 60, 60.0]])
    assert t.update(a).tolist() == [1, 2] and t.update(a[::-1] + 1).tolist() == [2, 1]
