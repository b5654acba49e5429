"""Queries over small tables of their own, against brute force over all rows: none may leave rows out."""

import functools
import itertools

import numpy as np
import pandas as pd
import pytest

from fieldweave.kernels.alignment import align, least_cost, path_cost
from fieldweave.queries.registry import QUERIES


def written_events(folder, rows):
    """rows: user, kind, value and hour, in the order of their events."""
    table = pd.DataFrame(rows, columns=["user_id", "event_type", "value", "hour"])
    table["event_id"], table["ts"] = range(len(table)), pd.Timestamp("2024-01-01") + pd.to_timedelta(table.pop("hour"), "h")
    table.assign(props='{"k": 1}').to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


def least_alignment(v, c):
    @functools.cache
    def go(i, j):
        ways = [go(i + 1, j) + 1.1] if i < len(v) else []
        ways += [go(i, j + 1) + 0.9] if j < len(c) else []
        ways += [go(i + 1, j + 1) + abs(v[i] - c[j]) / 20] if i < len(v) and j < len(c) else []
        return min(ways, default=0.0)

    return go(0, 0)


def test_dp_align_cost_takes_whole_sequences(spark, tmp_path):
    rng, rows, sides = np.random.default_rng(1), [], {}
    for user, (n, m) in enumerate([(5, 4), (4, 7), (1, 6), (6, 0), (0, 5), (3, 3), (9, 9)]):
        kinds = rng.permutation(["view"] * n + ["click"] * m)
        rows += [(user, k, float(x), 0) for k, x in zip(kinds, rng.uniform(0, 100, n + m).round(2))]
        sides[user] = [tuple(r[2] for r in rows if r[0] == user and r[1] == k) for k in ("view", "click")]
    found = {r.user_id: r.total for r in QUERIES["dp_align_cost"](spark, written_events(tmp_path, rows)).collect()}
    assert found == {u: pytest.approx(least_alignment(*s), abs=2e-6) for u, s in sides.items()}


def test_least_cost_is_that_of_the_path():
    rng = np.random.default_rng(2)
    for n, m in [(0, 0), (0, 3), (4, 0), (7, 5), (20, 31)]:
        a, b = rng.uniform(0, 100, n), rng.uniform(0, 100, m)
        cost = np.abs(a[:, None] - b[None, :]) / 20
        assert least_cost(a, b, 20.0, 1.1, 0.9) == pytest.approx(path_cost(align(cost, 1.1, 0.9), cost, 1.1, 0.9))
    assert least_cost(np.array([np.nan]), np.array([1.0]), 20.0, 1.1, 0.9) == pytest.approx(2.0)


def test_aligned_actions_takes_every_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    o = pd.DataFrame({"o_orderkey": range(1, 91), "o_custkey": rng.choice([7, 107, 12], 90), "o_orderstatus": rng.choice(["F", "O", "P"], 90), "o_totalprice": rng.uniform(0, 100, 90).round(2)})
    o.to_parquet(tmp_path / "orders.parquet")
    found = QUERIES["aligned_actions"](spark, str(tmp_path)).toPandas()
    assert set(found.game_id) == {"g7", "g107", "g12"}
    seconds = {"F": 6.0, "O": 7.5, "P": 8.0}
    for customer, rows in o.groupby("o_custkey"):
        rows = rows.sort_values("o_orderkey")
        in_plays, in_units = rows.o_orderkey % 3 != 0, (rows.o_orderkey % 5 != 0) | (rows.o_orderkey % 3 == 0)
        assert (in_plays | in_units).all()
        plays, units = rows[in_plays].to_dict("records"), rows[in_units].to_dict("records")

        @functools.cache
        def go(i, j):
            ways = [go(i + 1, j) + 1.1] if i < len(plays) else []
            ways += [go(i, j + 1) + 1.1] if j < len(units) else []
            if i < len(plays) and j < len(units):
                a, b = plays[i]["o_orderstatus"], units[j]["o_orderstatus"]
                cost = 3.0 * (a != b) + min(2.5, abs(units[j]["o_totalprice"] % 10 - seconds[a]) / seconds[a])
                ways += [go(i + 1, j + 1) + cost] if cost <= 1.75 else []
            return min(ways, default=0.0)

        game = found[found.game_id == f"g{customer}"]
        assert (game.i.notna().sum(), game.j.notna().sum()) == (len(plays), len(units))
        assert game.cost.sum() == pytest.approx(go(0, 0))


def test_optimal_match_small_matches_whole_bins(spark, tmp_path):
    rng, rows, sides = np.random.default_rng(4), [], {}
    for user, hour, n, m in [(0, 1, 3, 3), (0, 8, 5, 4), (1, 1, 2, 6), (1, 14, 6, 1), (2, 1, 1, 1), (2, 8, 3, 0), (3, 20, 2, 2)]:
        kinds = rng.permutation(["view"] * n + ["click"] * m)
        new = [(user, k, float(x), hour) for k, x in zip(kinds, rng.uniform(0, 100, n + m).round(2))]
        rows += new
        if n and m:
            sides[user, hour // 6] = sorted(([r[2] for r in new if r[1] == k] for k in ("view", "click")), key=len)
    found = QUERIES["optimal_match_small"](spark, written_events(tmp_path, rows)).collect()
    start = min(r.bin for r in found)
    least = {k: (len(a), min(sum(abs(x - y) for x, y in zip(a, p)) for p in itertools.permutations(b, len(a)))) for k, (a, b) in sides.items()}
    assert {(r.user_id, r.bin - start): (r.pairs, r.total) for r in found} == {k: (n, pytest.approx(t, abs=2e-6)) for k, (n, t) in least.items()}
