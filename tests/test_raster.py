"""Painting and land-locked water against a plain painter, on grids of many bands and on the fine grid."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wayloom.operators import raster as r
from wayloom.plans import w3

SF = "/root/testdata/sf0.001"


def plain_terrain(edges, grid):
    """{(cx, cy): cls} by painting cell by cell and flooding from the border."""
    cells = [[0] * grid.width for _ in range(grid.height)]
    clamp = lambda v, n: min(max(int(v), 0), n - 1)
    for layer, over in r.STACK:
        own = [e for e in edges if e.layer == layer]
        seen = {}
        for e in own:
            seen[e.cls] = min(seen.get(e.cls, 1 << 40), e.feature_idx)
        for cls in sorted(seen, key=lambda c: (seen[c], c)):
            at = set()
            for e in own:
                if layer == "roads" and e.cls == cls:
                    steps = max(1, int(max(abs(e.x2 - e.x1), abs(e.y2 - e.y1)) / (grid.cell / 2)))
                    for i in range(steps + 1):
                        x, y = e.x1 + (e.x2 - e.x1) * (i / steps), e.y1 + (e.y2 - e.y1) * (i / steps)
                        at.add((clamp((x - grid.min_lon) / grid.cell, grid.width), clamp((y - grid.min_lat) / grid.cell, grid.height)))
            for row in range(grid.height) if layer != "roads" else ():
                lat = (row + 0.5) * grid.cell + grid.min_lat
                xs = sorted(e.x1 + (lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) for e in own if e.cls == cls and e.y1 != e.y2 and min(e.y1, e.y2) <= lat < max(e.y1, e.y2))
                for a, b in zip(xs[::2], xs[1::2]):
                    at |= {(x, row) for x in range(clamp((a - grid.min_lon) / grid.cell, grid.width), clamp((b - grid.min_lon) / grid.cell, grid.width) + 1)}
            for x, y in at:
                if over >> cells[y][x] & 1:
                    cells[y][x] = cls
    return flooded({(x, y): c for y, line in enumerate(cells) for x, c in enumerate(line)}, grid)


def flooded(cells, grid):
    sea = deque(at for at, c in cells.items() if c == 0 and (at[0] in (0, grid.width - 1) or at[1] in (0, grid.height - 1)))
    open_ = set(sea)
    while sea:
        x, y = sea.popleft()
        for at in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if cells.get(at) == 0 and at not in open_:
                open_.add(at)
                sea.append(at)
    return {at: 8 if c == 0 and at not in open_ else c for at, c in cells.items()}


def test_fine_terrain(spark):
    got = {(c.cx, c.cy): c.cls for c in w3.build_terrain_fine(spark, SF).collect()}
    assert got == plain_terrain(w3.edges(spark, SF).collect(), w3.FINE)
    assert len(got) == 614_400 and set(got.values()) > {0, 1, 8}


@pytest.mark.parametrize("seed", [1, 2])
def test_water_in_a_maze(spark, seed):
    """Ocean that winds through many bands of rows, by four neighbours, and components by eight."""
    rng = random.Random(seed)
    grid = r.Grid(0.0, 0.0, 1.0, 90, 75)
    cells = {(x, y): 0 if rng.random() < 0.6 else 1 for x in range(grid.width) for y in range(grid.height)}
    df = spark.createDataFrame([(x, y, c) for (x, y), c in cells.items()], "cx int, cy int, cls int")
    assert {(c.cx, c.cy): c.cls for c in r.reclass_landlocked(df, grid).collect()} == flooded(cells, grid)
    runs = r.labelled_runs(df, F.col("cls") == 1, 1)
    label = {(x, run.cy): run.label for run in runs.collect() for x in range(run.xa, run.xb + 1)}
    assert label.keys() == {at for at, c in cells.items() if c == 1}
    parts, todo = 0, set(label)
    while todo:
        start = todo.pop()
        part, queue = {start}, [start]
        while queue:
            x, y = queue.pop()
            for at in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if at in todo:
                    todo.discard(at)
                    part.add(at)
                    queue.append(at)
        assert len({label[at] for at in part}) == 1
        parts += 1
    assert parts == len(set(label.values()))
