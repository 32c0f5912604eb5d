"""Point in polygon against a plain ray cast."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import joins

SCHEMA = "layer string, fid string, feature_idx int, part int, ring int, x1 double, y1 double, x2 double, y2 double"


def ring(rng, cx, cy, size, n):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + math.cos(a) * size * rng.uniform(0.4, 1), cy + math.sin(a) * size * rng.uniform(0.4, 1)) for a in at]


def edges_of(fid, part, number, points):
    return [("l", f"f{fid}", fid, part, number, float(x1), float(y1), float(x2), float(y2)) for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1])]


def polygons(seed):
    rng = random.Random(seed)
    out = []
    for fid in range(12):
        for part in range(rng.choice((1, 1, 2))):
            cx, cy = rng.uniform(-20, 20), rng.uniform(-15, 15)
            out += edges_of(fid, part, 0, ring(rng, cx, cy, 9, rng.choice((3, 7, 40))))
            out += [e for h in range(rng.choice((0, 1, 2))) for e in edges_of(fid, part, h + 1, ring(rng, cx, cy, 3, 6))]
    box = [(-3, -3), (4, -3), (4, 5), (-3, 5)]
    out += edges_of(20, 0, 0, box) + edges_of(20, 0, 1, [(0, 0), (1, 0), (1, 1), (0, 1)])
    out += edges_of(21, 0, 0, [(0, 0), (30, 0), (60, 0)])  # horizontal alone: nothing is inside
    return out


def plain(points, edges):
    found = set()
    for k, x, y in points:
        odd = {}
        for _, fid, _, part, number, x1, y1, x2, y2 in edges:
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd[fid, part, number] = not odd.get((fid, part, number), False)
        for (fid, part, number), inside in odd.items():
            if number == 0 and inside and not any(i and f == fid and p == part and n for (f, p, n), i in odd.items()):
                found.add((k, fid))
    return found


@pytest.mark.parametrize("size", [0.5, 1.0, 7.3])
def test_pairs_are_those_of_a_plain_ray_cast(spark, size):
    rng = random.Random(8)
    edges = polygons(3)
    points = [(float(x), float(y)) for x in range(-6, 7) for y in range(-6, 7)] + [(e[5], e[6]) for e in edges]
    points += [(rng.uniform(-32, 32), rng.uniform(-26, 26)) for _ in range(1500)]
    points = [(k, x, y) for k, (x, y) in enumerate(points)]
    df, cut = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(edges, SCHEMA)
    got = [(r.k, r.fid) for r in joins.pip_pairs(df, cut, size).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(points, edges)


def test_rays_are_cast_in_touched_cells_alone(spark):
    """A polygon of many vertices and 40 000 points: nearly all are decided by their cell."""
    n = 4000
    shape = [(50 * math.cos(2 * math.pi * k / n), 50 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    cut = spark.createDataFrame(edges_of(1, 0, 0, shape), SCHEMA)
    points = spark.range(40_000).select(F.col("id").alias("k"), (F.rand(1) * 100 - 50).alias("x"), (F.rand(2) * 100 - 50).alias("y")).cache()
    rows = joins.edge_rows(cut, 1.0)
    grid = joins.location_grid(rows, 1.0).cache()
    met = points.select("k", F.floor("x").alias("i"), F.floor("y").alias("j")).join(grid, ["i", "j"])
    cast, found = met.where("NOT inside").count(), joins.pip_pairs(points, cut).count()
    assert cast < 0.06 * 40_000  # some 400 of 7 854 cells are touched
    assert rows.count() < 2 * n and found == pytest.approx(points.where("x * x + y * y < 2500").count(), abs=5)


def test_no_points_and_no_polygons(spark):
    points, edges = spark.createDataFrame([(1, 0.0, 0.0)], "k long, x double, y double"), spark.createDataFrame(polygons(1), SCHEMA)
    assert joins.pip_pairs(points, edges.limit(0)).count() == 0 and joins.pip_pairs(points.limit(0), edges).count() == 0


def test_pairs_found_by_cells_are_neither_written_nor_shuffled(spark, monkeypatch):
    """Each point lies in ten polygons of two parts that overlap: what is written is the points, once."""
    written, keep = [], joins.checkpoint
    box = [(-8, -8), (8, -8), (8, 8), (-8, 8)]
    cut = spark.createDataFrame([e for fid in range(10) for part in (0, 1) for e in edges_of(fid, part, 0, box)], SCHEMA)
    points = spark.range(4000).select(F.col("id").alias("k"), (F.rand(1) * 14 - 7).alias("x"), (F.rand(2) * 14 - 7).alias("y"))
    monkeypatch.setattr(joins, "checkpoint", lambda df: written.append(keep(df)) or written[-1])
    pairs = joins.pip_pairs(points, cut)
    assert pairs.count() == pairs.distinct().count() == 40_000
    assert max(t.count() for t in written) < 10_000


def plain_nearest(points, vertices, most=math.inf):
    found = {}
    for k, x, y in points:
        if x is not None and y is not None and not math.isnan(x):
            d, idx, fid = min((math.hypot(x - vx, y - vy), idx, fid) for fid, idx, vx, vy in vertices if vx is not None)
            if d <= most:
                found[k] = (fid, idx, pytest.approx(d))
    return found


@pytest.mark.parametrize("most", [None, 1.5])
def test_nearest_of_dense_and_sparse_vertices(spark, most):
    rng = random.Random(4)
    at = [(rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(300)] + [(rng.uniform(-60, 60), rng.uniform(-40, 40)) for _ in range(60)]
    vertices = [(f"f{i % 9}", i % 9, x, y) for i, (x, y) in enumerate(at + at[:50])] + [("f0", 0, None, 1.0)]
    points = at[::7] + [(rng.gauss(0, 0.02), rng.gauss(0, 0.02)) for _ in range(200)] + [(rng.uniform(-90, 90), rng.uniform(-60, 60)) for _ in range(100)]
    points = [(k, x, y) for k, (x, y) in enumerate([*points, (None, 0.0), (float("nan"), 0.0)])]
    df, targets = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(vertices, "fid string, feature_idx int, x double, y double")
    got = joins.nearest_vertex(df, targets, most=most).collect()
    assert len(got) == len({r.k for r in got})
    assert {r.k: (r.fid, r.feature_idx, r.degrees) for r in got} == plain_nearest(points, vertices, most or math.inf)


def joined_rows(spark, first):
    """The most rows that a join has given in the executions from the first on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for e in range(first, store.executionsCount()):
        nodes, values = store.planGraph(store.executionsList().apply(e).executionId()).allNodes(), store.executionMetrics(store.executionsList().apply(e).executionId())
        for node in (nodes.apply(i) for i in range(nodes.size()) if "Join" in nodes.apply(i).name()):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_a_point_meets_few_vertices_however_dense_they_lie(spark):
    n = 3000
    vertices = spark.range(n).select(F.lit("f").alias("fid"), F.lit(1).alias("feature_idx"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    points = spark.range(n).select(F.col("id").alias("k"), F.rand(3).alias("x"), F.rand(4).alias("y"))
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert joins.nearest_vertex(points, vertices).count() == n
    assert n <= joined_rows(spark, first) < 30 * n
