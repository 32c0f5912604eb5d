import random

import numpy as np
import pytest
from test_routing import plain

from wayloom.operators import paths, present, routing
from wayloom.operators.raster import Grid


def world(seed=3, width=40, height=30):
    rng = random.Random(seed)
    cells = {(x, y): rng.choice([1, 1, 1, 2, 3, 7, 9, 0]) for x in range(width) for y in range(height)}
    for at in ((2, 2), (36, 25), (5, 27)):
        cells[at] = 1
    return cells


def spent(path, cells, mode):
    cost, out = routing.costs(mode), 0.0
    for (px, py), (x, y) in zip(path, path[1:]):
        assert max(abs(x - px), abs(y - py)) == 1
        out += (2**0.5 if px != x and py != y else 1.0) * cost[cells[x, y]]
    return out


@pytest.mark.parametrize("size", [7, 16, 64])
def test_paths_cost_what_the_search_found(spark, size):
    cells = world()
    df = spark.createDataFrame([(x, y, c) for (x, y), c in cells.items()], "cx int, cy int, cls int")
    goals = [(1, 36, 25), (2, 5, 27), (3, 2, 2)]
    ends = spark.createDataFrame([(k, m, 9, 2, 2, x, y) for k, x, y in goals for m in ("foot", "carriage")], "k long, mode string, origin long, ax int, ay int, gx int, gy int")
    found = routing.search(ends.selectExpr("mode", "origin", "ax as cx", "ay as cy").distinct(), df, size).persist()
    traced = paths.route_path(ends, found, df, size).persist()
    best = {m: plain(cells, m, (2, 2)) for m in ("foot", "carriage")}
    goal = {k: (x, y) for k, x, y in goals}
    rows = traced.collect()
    assert {(r.k, r.mode) for r in rows} == {(k, m) for k, x, y in goals for m in best if (x, y) in best[m]}
    for r in rows:
        path = [(c.x, c.y) for c in r.path]
        assert path[0] == (2, 2) and path[-1] == goal[r.k]
        assert spent(path, cells, r.mode) == pytest.approx(best[r.mode][goal[r.k]][0])
    for r in paths.straighten_path(traced, df, size).collect():
        path = [(c.x, c.y) for c in r.path]
        assert path[0] == (2, 2) and path[-1] == goal[r.k]
        assert spent(path, cells, r.mode) == pytest.approx(r.weighted) and r.weighted == pytest.approx(best[r.mode][goal[r.k]][0])


def test_a_staircase_over_open_ground_becomes_a_line():
    stairs = np.array([(x, min(x, 4)) for x in range(11)])
    line = paths.straight(stairs, lambda c: np.ones(len(c), int), {1: 1.0})
    # a line of the same number of steps spreads its diagonals: equal cost, so it is taken
    assert tuple(line[0]) == (0, 0) and tuple(line[-1]) == (10, 4)
    assert np.abs(line[:, 1] - line[:, 0] * 0.4).max() <= 0.5
    barred = paths.straight(stairs, lambda c: np.where((c[:, 0] == 5) & (c[:, 1] == 2), 0, 1), {1: 1.0})
    assert not any((barred == (5, 2)).all(axis=1))


def test_routes_of_all_kinds(spark):
    cells = spark.createDataFrame([(x, y, 0 if x == 30 else 1) for x in range(61) for y in range(3)], "cx int, cy int, cls int")
    grid = Grid(0.0, 0.0, 1.0, 61, 3)
    j = spark.createDataFrame(
        [(1, "foot", 0.5, 0.5, 3.5, 0.5), (2, "foot", 0.5, 0.5, 60.5, 0.5), (3, "ship", 0.5, 0.5, 30.5, 0.5), (4, "dragon", 0.0, 0.0, 3.0, 4.0), (5, "foot", 1.5, 1.5, 1.5, 1.5)],
        "k long, mode string, x1 double, y1 double, x2 double, y2 double",
    )
    routes = paths.routes(j, cells, grid, 10.0, 16).persist()
    got = {r.k: r for r in routes.collect()}
    assert [tuple(p) for p in got[1].path] == [(0.5, 0.5), (1.5, 0.5), (2.5, 0.5), (3.5, 0.5)] and got[1].miles == pytest.approx(30)
    assert (got[2].error, got[2].path) == ("no-route", None) and got[3].error == "unreachable-origin"
    assert got[4].days == pytest.approx(0.1) and len(got[4].path) == 2
    assert got[5].miles == 0 and got[5].days == 0 and len(got[5].path) == 1
    assert {r.k for r in paths.routes_to_features(routes).collect()} == {1, 4, 5}
    named = j.selectExpr("k", "mode", "'a' as origin", "'b' as destination").join(routes, ["k", "mode"])
    fixtures = {r.mode + str(r.pathPoints): r.blocked for r in routing.route_fixtures(named).collect()}
    assert fixtures == {"foot4": False, "footNone": True, "shipNone": True, "dragon2": False, "foot1": False}


def test_fixtures_of_the_golden_kind(spark):
    """On one terrain, days are weighted miles by speed: horse and foot on the same path differ as their speeds do."""
    cells = spark.createDataFrame([(x, y, 9 if y == 1 else 3) for x in range(50) for y in range(3)], "cx int, cy int, cls int")
    j = spark.createDataFrame([(1, m, 0.5, 1.5, 48.5, 1.5) for m in routing.MODES], "k long, mode string, x1 double, y1 double, x2 double, y2 double")
    got = {r["mode"]: r for r in paths.routes(j, cells, Grid(0.0, 0.0, 1.0, 50, 3), 64.9346).collect()}
    assert got["foot"].days == pytest.approx(got["carriage"].days) == pytest.approx(got["foot"].miles / 20)
    assert got["horse"].days == pytest.approx(got["foot"].days * 20 / 35) and got["dragon"].days == pytest.approx(got["dragon"].miles / 500)
    assert got["ship"].error == "unreachable-origin"


def plain_thinning(boxes):
    kept = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        if not any(b[2] < o[4] and o[2] < b[4] and b[3] < o[5] and o[3] < b[5] for o in kept):
            kept.append(b)
    return {b[0] for b in kept}


def test_thinning_is_greedy(spark):
    rng = random.Random(1)
    boxes = []
    for i in range(400):
        x, y = rng.uniform(0, 900), rng.uniform(0, 900)
        boxes.append((i, float(rng.randint(0, 4)), x, y, x + rng.uniform(5, 90), y + 14))
    df = spark.createDataFrame(boxes, "id long, priority double, x1 double, y1 double, x2 double, y2 double")
    assert {r.id for r in present.thin_labels(df).collect()} == plain_thinning(boxes)


def test_thinning_writes_no_pairs_of_crowded_boxes(spark, monkeypatch):
    """Some 700 neighbours a box, and many boxes at one place: what is written stays in proportion to the boxes."""
    rng, written, keep = random.Random(2), [], present.checkpoint
    spots = [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(2500)] + [(40.0, 50.0)] * 1500
    boxes = [(i, float(rng.randint(0, 4)), x, y, x + 90, y + 40) for i, (x, y) in enumerate(spots)]

    def counted(df):
        written.append(keep(df))
        return written[-1]

    monkeypatch.setattr(present, "checkpoint", counted)
    df = spark.createDataFrame(boxes, "id long, priority double, x1 double, y1 double, x2 double, y2 double")
    got = [r.id for r in present.thin_labels(df.union(df.limit(1).selectExpr("-1L", "priority", "null", "y1", "x2", "y2"))).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_thinning(boxes) | {-1}
    assert max(t.count() for t in written) < 10 * len(boxes)
