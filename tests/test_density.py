import math
import random

import pytest

from fillsight.ml import density as DE
from fillsight.operators import scan
from fillsight.operators.components import components


def expected(points, eps, min_points=5):
    """Plain DBSCAN: core points, components by search, border points to the smallest cluster."""
    ok = [p for p in points if all(c is not None and math.isfinite(c) for c in p[1:])]
    near = {p[0]: [q[0] for q in ok if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= eps * eps] for p in ok}
    core = {i for i, n in near.items() if len(n) >= min_points}
    cluster = {}
    for i in sorted(core):
        todo = [] if i in cluster else [i]
        while todo:
            j = todo.pop()
            if j not in cluster:
                cluster[j] = i
                todo += [k for k in near[j] if k in core and k not in cluster]
    out = {}
    for i, *_ in points:
        if i in core:
            out[i] = ("core", cluster[i])
        else:
            names = [cluster[j] for j in near.get(i, []) if j in core]
            out[i] = ("border", min(names)) if names else ("noise", None)
    return out


def result(spark, points, eps, min_points=5):
    rows = DE.dbscan(spark.createDataFrame(points, "id bigint, x double, y double"), eps, min_points).collect()
    assert len(rows) == len(points)
    return {r.id: (r.kind, r.cluster) for r in rows}


def scattered(seed, n):
    rng = random.Random(seed)
    spots = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(12)]
    out = []
    for i in range(n):
        if i % 3 == 0:  # a third of all rows in one small spot
            out.append((i, 1.0 + rng.gauss(0, 0.01), 1.0 + rng.gauss(0, 0.01)))
        else:
            a, b = spots[i % 12]
            out.append((i, a + rng.gauss(0, 0.35), b + rng.gauss(0, 0.35)))
    return out


@pytest.mark.parametrize("eps", [0.05, 0.2])
def test_scattered_points_match_plain_dbscan(spark, monkeypatch, eps):
    monkeypatch.setattr(scan, "JOIN_ROWS", 50)  # the hot cell is dealt out
    points = scattered(3, 2_000)
    want = expected(points, eps)
    assert {k for k, _ in want.values()} == {"core", "border", "noise"}
    assert result(spark, points, eps) == want


def test_lattice_ties_and_repeated_points(spark):
    """Distances of exactly eps, and many equal points."""
    points = [(i * 40 + j, i * 0.25, j * 0.25) for i in range(12) for j in range(12)]
    points += [(10_000 + i, 9.0, 9.0) for i in range(300)] + [(20_000, 9.25, 9.0), (20_001, None, 1.0), (20_002, float("nan"), 1.0), (20_003, 50.0, 50.0)]
    for eps in (0.25, 0.3):
        assert result(spark, points, eps) == expected(points, eps)


def test_facing_cells_are_decided_point_by_point(spark):
    """Two walls a little more, and a little less, than eps apart, with points all along them."""
    for gap, parts in ((0.1001, 2), (0.0999, 1)):
        left = [(i, 0.0, i * 0.0004) for i in range(700)]
        right = [(1_000 + i, gap, 0.00013 + i * 0.0004) for i in range(700)]
        found = result(spark, left + right, 0.1)
        assert found == expected(left + right, 0.1)
        assert len({c for _, c in found.values()}) == parts


def test_edges(spark):
    assert result(spark, [], 1.0) == {}
    assert result(spark, [(1, 0.0, 0.0)], 1.0) == {1: ("noise", None)}
    assert result(spark, [(i, 0.0, 0.0) for i in range(5)], 1.0) == {i: ("core", 0) for i in range(5)}
    with pytest.raises(ValueError):
        DE.dbscan(spark.createDataFrame([], "id bigint, x double, y double"), 0.0)


def test_distance_percentiles(spark):
    points = scattered(8, 600) + [(9_000 + i, 3.0, 3.0) for i in range(7)]
    frame = DE.materialize(spark.createDataFrame(points, "id bigint, x double, y double"))
    fifth = sorted(sorted(math.dist(p[1:], q[1:]) for q in points)[4] for p in points)
    for share, value in DE.distance_percentiles(frame, (0.5, 0.75, 0.9)).items():
        assert value == pytest.approx(fifth[math.ceil(share * len(points)) - 1], rel=1e-6)
    assert math.isnan(DE.distance_percentiles(frame.limit(3), (0.5,))[0.5])


def test_percentiles_ask_few_questions(spark, monkeypatch):
    """A percentile puts each point's question a few times, not once for each radius of each round."""
    asked, ask = [], DE._ask
    monkeypatch.setattr(DE, "_ask", lambda points, sparse, *more: asked.append(sparse.count()) or ask(points, sparse, *more))
    points = scattered(8, 600)
    frame = DE.materialize(spark.createDataFrame(points, "id bigint, x double, y double"))
    DE.distance_percentiles(frame, (0.75,))
    assert 0 < sum(asked) <= 6 * len(points)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(50)] + [(500, i) for i in range(501, 700)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    alone = {n for n in parent if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: find(n) for n in parent if n not in alone}
