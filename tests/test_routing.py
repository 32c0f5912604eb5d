import heapq
import random

import pytest

from wayloom.operators import routing
from wayloom.operators.raster import Grid


def plain(cells, mode, start):
    cost = routing.costs(mode)
    best, queue = {start: (0.0, 0.0)}, [(0.0, 0.0, start)]
    while queue:
        w, m, (x, y) = heapq.heappop(queue)
        if (w, m) > best[x, y]:
            continue
        for dx, dy in routing.STEPS:
            c = cost.get(cells.get((x + dx, y + dy)))
            d = 2**0.5 if dx and dy else 1.0
            if c is not None and (w + d * c, m + d) < best.get((x + dx, y + dy), (float("inf"),) * 2):
                best[x + dx, y + dy] = (w + d * c, m + d)
                heapq.heappush(queue, (w + d * c, m + d, (x + dx, y + dy)))
    return best


@pytest.mark.parametrize("size", [5, 64])
def test_search_is_optimal_for_any_block_size(spark, size):
    rng = random.Random(5)
    cells = {(x, y): rng.choice([0, 1, 1, 2, 3, 7, 9]) for x in range(14) for y in range(11)}
    cells[2, 2] = 1
    df = spark.createDataFrame([(x, y, c) for (x, y), c in cells.items()], "cx int, cy int, cls int")
    starts = spark.createDataFrame([("foot", 1, 2, 2), ("carriage", 1, 2, 2)], "mode string, origin long, cx int, cy int")
    found = {}
    for r in routing.search(starts, df, size).collect():
        found.setdefault(r.mode, {})[r.cx, r.cy] = (r.weighted, r.miles)
    for mode in ("foot", "carriage"):
        want = plain(cells, mode, (2, 2))
        assert found[mode].keys() == want.keys()
        assert all(found[mode][k] == pytest.approx(want[k]) for k in want)


def test_snap_prefers_the_first_of_a_ring(spark):
    cells = spark.createDataFrame([(x, y, 1 if (x, y) in ((4, 5), (6, 5), (5, 4)) else 0) for x in range(11) for y in range(11)], "cx int, cy int, cls int")
    ends = spark.createDataFrame([(1, "foot", 5, 5), (2, "ship", 5, 5), (3, "foot", 4, 5)], "k long, mode string, cx int, cy int")
    got = {r.k: (r.sx, r.sy) for r in routing.snap_cell(ends, cells).collect()}
    assert got == {1: (5, 4), 2: (5, 5), 3: (4, 5)}


def test_journeys_fail_with_a_reason(spark):
    cells = spark.createDataFrame([(x, y, 0 if x == 30 else 1) for x in range(61) for y in range(3)], "cx int, cy int, cls int")
    grid = Grid(0.0, 0.0, 1.0, 61, 3)
    j = spark.createDataFrame([(1, "foot", 0.5, 0.5, 3.5, 0.5), (2, "foot", 0.5, 0.5, 60.5, 0.5), (3, "ship", 0.5, 0.5, 30.5, 0.5), (4, "dragon", 0.0, 0.0, 3.0, 4.0)], "k long, mode string, x1 double, y1 double, x2 double, y2 double")
    got = {r.k: (r.error, r.miles) for r in routing.shortest_days(j, cells, grid, 10.0, 16).collect()}
    assert got[1] == (None, pytest.approx(30)) and got[4] == (None, pytest.approx(50))
    assert got[2][0] == "no-route" and got[3][0] == "unreachable-origin"


#: Ten journeys of the kind that later versions are held to: mode, miles, days, and the days they should take.
GOLDEN = [
    ("horse", 1637.2502749204523, 46.778579283441495, 30, 55), ("carriage", 1637.2502749204523, 81.86251374602261, 55, 110), ("horse", 662.8933669474964, 19.333373592731057, 12, 25),
    ("horse", 1177.1375669077208, 33.632501911649165, 22, 45), ("horse", 435.0454219554521, 12.429869198727204, 8, 20), ("horse", 699.5385479570424, 20.294748854461922, 12, 30),
    ("horse", 888.7718399443133, 25.754247324073237, 15, 35), ("dragon", 1420.16982158676, 2.84033964317352, 2, 6), ("ship", 1170.512339864764, 9.754269498873034, 5, 20),
    ("foot", 1637.2502749204523, 81.86251374602261, 55, 100),
]


def test_golden_routes(spark):
    rows = [(k, m, miles, days, None) for k, (m, miles, days, _, _) in enumerate(GOLDEN)] + [(10, "horse", None, None, "no-route"), (11, "ship", None, None, "unreachable-origin")]
    routes = spark.createDataFrame(rows, "k long, mode string, miles double, days double, error string")
    bounds = spark.createDataFrame([(k, m, low, high) for k, (m, _, _, low, high) in enumerate(GOLDEN)] + [(10, "horse", 1, 2), (11, "ship", 1, 2)], "k long, mode string, low int, high int")
    assert [r.verdict for r in routing.check_routes(routes, bounds).orderBy("k").collect()] == ["ok"] * 10 + ["no-route", "unreachable-origin"]
    moved = routes.withColumn("miles", routes.miles * (1 + (routes.k == 3).cast("double") * 0.0011)).withColumn("days", routes.days * (1 + (routes.k == 4).cast("double") * 0.0009))
    assert [r.k for r in routing.compare_fixtures(moved, routes).where("NOT same").collect()] == [3]
    for mode, miles, days, _, _ in GOLDEN:  # a mile costs what a road costs, or more; a flight and the sea cost just that
        spent = days * routing.MODES[mode]["miles_per_day"] / miles
        assert spent == pytest.approx(1.0) if mode in ("dragon", "ship") else spent >= 1 - 1e-9


def test_golden_ratios_of_one_road(spark):
    """The first, second and last golden journeys follow one road: equal miles, days by the speeds of their modes."""
    n, scale = 60, 1637.2502749204523 / 59
    cells = spark.createDataFrame([(x, y, 9 if y == 1 else 7) for x in range(n) for y in range(3)], "cx int, cy int, cls int")
    j = spark.createDataFrame([(1, m, 0.5, 1.5, n - 0.5, 1.5) for m in ("horse", "carriage", "foot")], "k long, mode string, x1 double, y1 double, x2 double, y2 double")
    got = {r["mode"]: (r.miles, r.days) for r in routing.shortest_days(j, cells, Grid(0.0, 0.0, 1.0, n, 3), scale, 16).collect()}
    assert all(got[m] == pytest.approx((miles, days)) for m, miles, days, _, _ in (GOLDEN[0], GOLDEN[1], GOLDEN[9]))


def test_connections_by_mode(spark):
    """Two islands and a swamp: who gets where, with ends that snap; stretches and rows of many runs."""
    def cls(x, y):
        return 0 if 60 <= x <= 70 else 5 if x == 30 else 1 if (x * 7 + y) % 13 else 7

    cells = spark.createDataFrame([(x, y, cls(x, y)) for x in range(150) for y in range(4)], "cx int, cy int, cls int")
    ends = {1: (2.5, 1.5, 50.5, 1.5), 2: (2.5, 1.5, 100.5, 1.5), 3: (62.5, 1.5, 69.5, 2.5), 4: (61.5, 0.5, 20.5, 1.5)}
    j = spark.createDataFrame([(k, m, *e) for k, e in ends.items() for m in routing.MODES], "k long, mode string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.k, r["mode"]) for r in routing.connections(j, cells, Grid(0.0, 0.0, 1.0, 150, 4)).collect() if r.reachable}
    found = {(r.k, r["mode"]) for r in routing.shortest_days(j, cells, Grid(0.0, 0.0, 1.0, 150, 4), 1.0, 32).collect() if r.error is None}
    assert got == found
    assert {m for k, m in got if k == 1} == {"foot", "horse", "dragon"} and (3, "ship") in got and (2, "foot") not in got


def test_searches_end_at_their_goals(spark):
    """With goals the far end of a long strip is not settled, and the goals cost the same."""
    cells = spark.createDataFrame([(x, y, 1) for x in range(400) for y in range(4)], "cx int, cy int, cls int")
    starts = spark.createDataFrame([("foot", 1, 2, 2)], "mode string, origin long, cx int, cy int")
    goals = spark.createDataFrame([("foot", 1, 30, 1), ("foot", 1, 40, 3)], "mode string, origin long, cx int, cy int")
    whole = {(r.cx, r.cy): r.weighted for r in routing.search(starts, cells, 16).collect()}
    state, reached = routing.explore(starts, cells, 16, goals)
    assert {(r.cx, r.cy): r.weighted for r in reached.collect()} == {at: whole[at] for at in ((30, 1), (40, 3))}
    near = routing.unpacked(state, 16).collect()
    assert len(whole) == 1600 and max(r.cx for r in near) < 80
