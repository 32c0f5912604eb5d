"""Spatial joins as equi-joins on cells and buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpoint


POLYGON = ["layer", "fid", "feature_idx", "part"]
#: Cells this near to an edge count as touched by it.
NEAR = 1e-9
#: Vertices that share a bucket, on average, when points look for the nearest.
FEW = 4


def edge_rows(edges: DataFrame, size: float) -> DataFrame:
    """edges (POLYGON, ring, x1, y1, x2, y2) with j, once for each row of cells that they pass."""
    at = lambda c: F.floor(c / size)
    own = edges.select(*POLYGON, "ring", "x1", "y1", "x2", "y2")
    return own.withColumn("j", F.explode(F.sequence(at(F.least("y1", "y2") - NEAR), at(F.greatest("y1", "y2") + NEAR))))


def location_grid(rows: DataFrame, size: float) -> DataFrame:
    """(POLYGON, i, j, inside) from edge_rows(): the cells wholly inside a part, decided once, and those that its edges touch (inside false).

    A cell that no edge touches is inside if its middle is: in the shell, and in no hole.
    """
    at = lambda c: F.floor(c / size)
    rise = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    x_at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / rise
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    ends = [x_at(F.least(F.greatest(F.col("j") * size, low), high)), x_at(F.least(F.greatest((F.col("j") + 1) * size, low), high))]
    ends = [F.coalesce(c, F.col(x)) for c, x in zip(ends, ("x1", "x2"))]
    touched = rows.select(*POLYGON, "j", F.explode(F.sequence(at(F.least(*ends) - NEAR), at(F.greatest(*ends) + NEAR))).alias("i")).distinct()

    middle = (F.col("j") + 0.5) * size
    crossed = rows.where((F.col("y1") > middle) != (F.col("y2") > middle)).select(*POLYGON, "ring", "j", x_at(middle).alias("x"))
    order = Window.partitionBy(*POLYGON, "ring", "j").orderBy("x")
    spans = crossed.withColumns({"to": F.lead("x").over(order), "n": F.row_number().over(order)}).where("n % 2 = 1 AND to IS NOT NULL")
    first = lambda c: F.ceil(F.col(c) / size - 0.5)
    spans = spans.where(first("x") < first("to")).select(*POLYGON, "ring", "j", F.explode(F.sequence(first("x"), first("to") - 1)).alias("i"))
    filled = spans.groupBy(*POLYGON, "i", "j").agg(F.max(F.col("ring") == 0).alias("shell"), F.max(F.col("ring") > 0).alias("hole")).where("shell AND NOT hole")
    inner = filled.join(touched, [*POLYGON, "i", "j"], "left_anti")
    return inner.select(*POLYGON, "i", "j", F.lit(True).alias("inside")).union(touched.select(*POLYGON, "i", "j", F.lit(False)))


def pip_pairs(points: DataFrame, edges: DataFrame, size: float = 1.0) -> DataFrame:
    """(k, layer, fid, feature_idx) for each point (k, x, y) that lies in a polygon of edges.

    edges: layer, fid, feature_idx, part, ring, x1, y1, x2, y2. A point is in a ring if a ray to the right crosses its
    edges an odd number of times; it is in a polygon if it is in the shell of any part and in none of that part's
    holes. Polygons are dealt into square cells of that size: points in cells wholly inside are found by their cell
    alone, and only those in cells that an edge touches meet the edges of that part in their row of cells.

    k tells points apart. A cell names a polygon that holds all of it once, and its other parts are not looked at there,
    so pairs found by cells alone need no shuffle to come once.
    """
    rows = checkpoint(edge_rows(edges, size))
    grid, whole = checkpoint(location_grid(rows, size)), ["i", "j", *POLYGON[:-1]]
    held = checkpoint(grid.where("inside").select(*whole).distinct())
    touched = grid.where("NOT inside").join(held, whole, "left_anti")
    at = checkpoint(points.select("k", "x", "y", F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")))
    sure = at.join(held, ["i", "j"]).select("k", *POLYGON[:-1])
    met = at.join(touched, ["i", "j"]).select("k", "x", "y", "j", *POLYGON)
    return sure.union(ray_cast(met, rows).distinct())


def ray_cast(met: DataFrame, rows: DataFrame) -> DataFrame:
    """(k, layer, fid, feature_idx) of the points met (k, x, y, j, POLYGON) that are in the part they have met."""
    rise = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossing = F.expr("(y1 > y) <> (y2 > y)") & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / rise + F.col("x1"))
    crossed = met.join(rows.where("y1 <> y2"), [*POLYGON, "j"]).where(crossing)
    rings = crossed.groupBy("k", *POLYGON, "ring").count().where(F.col("count") % 2 == 1)
    parts = rings.groupBy("k", *POLYGON).agg(F.max(F.col("ring") == 0).alias("shell"), F.max(F.col("ring") > 0).alias("hole"))
    return parts.where("shell AND NOT hole").select("k", *POLYGON[:-1])


def pip_first(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(k, layer, feature attributes) of the first polygon in feature order for each point and layer."""
    first = pairs.groupBy("k", "layer").agg(F.min_by("fid", "feature_idx").alias("fid"))
    return first.join(features.select("layer", "fid", "name", "type", "claimedby"), ["layer", "fid"])


def pip_all_names(pairs: DataFrame, features: DataFrame, value: str) -> DataFrame:
    """(k, found): the sorted distinct non-null values of all polygons that hold a point."""
    met = pairs.join(features.select("layer", "fid", value), ["layer", "fid"])
    return met.groupBy("k").agg(F.sort_array(F.collect_set(value)).alias("found"))


def bucket_size(targets: DataFrame, size: float, least: float) -> float:
    """size, halved until a target (vx, vy) shares its square bucket with FEW on average, itself included, or least is passed."""
    while size > least:
        counts = targets.groupBy(F.floor(F.col("vx") / size).alias("i"), F.floor(F.col("vy") / size).alias("j")).agg(F.count("*").cast("double").alias("n"))
        mean = counts.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        if mean <= FEW:
            break
        size /= 2 ** max(1, round(math.log2(mean / FEW) / 2))
    return size


def nearest_vertex(points: DataFrame, vertices: DataFrame, first_size: float = 2.0, most: float | None = None) -> DataFrame:
    """(k, fid, feature_idx, degrees) of the nearest vertex of vertices (fid, feature_idx, x, y) for each point (k, x, y).

    The lowest feature wins ties. Points and vertices meet in square buckets and their neighbours; a find within the
    bucket size is certain, the other points try again with buckets twice as large. The first size is first_size or, where
    vertices lie dense, so much smaller that a bucket has few of them: a point meets as many in a larger table. Vertices
    at one place count once. With most, only finds within that distance count. Points that find nothing have no row, as
    have those without coordinates.
    """
    real = lambda *names: " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names)
    targets = vertices.select("fid", "feature_idx", F.col("x").alias("vx"), F.col("y").alias("vy")).where(real("vx", "vy"))
    targets = targets.groupBy("vx", "vy").agg(F.min(F.struct("feature_idx", "fid")).alias("v"))
    targets = checkpoint(targets.select("v.fid", "v.feature_idx", "vx", "vy"))
    spans = targets.agg(F.min("vx"), F.max("vx"), F.min("vy"), F.max("vy")).first()
    if spans[0] is None:
        return points.select("k", F.lit(None).cast("string").alias("fid"), F.lit(None).cast("int").alias("feature_idx"), F.lit(None).cast("double").alias("degrees")).limit(0)
    left, found = points.select("k", "x", "y").where(real("x", "y")), None
    edge = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    widest = 1.0 if edge[0] is None else 1.0 + max(max(edge[1], spans[1]) - min(edge[0], spans[0]), max(edge[3], spans[3]) - min(edge[2], spans[2]))
    if most is not None:
        first_size = widest = most
    size = bucket_size(targets, first_size, widest * 1e-9)
    while True:
        near = F.array(F.lit(-1), F.lit(0), F.lit(1)).cast("array<long>")
        spread = targets.withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
        spread = spread.withColumn("i", F.col("i") + F.floor(F.col("vx") / size)).withColumn("j", F.col("j") + F.floor(F.col("vy") / size))
        met = left.withColumn("i", F.floor(F.col("x") / size)).withColumn("j", F.floor(F.col("y") / size)).join(spread, ["i", "j"])
        d = F.hypot(F.col("x") - F.col("vx"), F.col("y") - F.col("vy"))
        met = met.withColumn("degrees", d).where(F.col("degrees") <= size)
        best = met.groupBy("k").agg(F.min(F.struct("degrees", "feature_idx", "fid")).alias("b")).select("k", "b.fid", "b.feature_idx", "b.degrees")
        best = checkpoint(best)
        found = best if found is None else found.union(best)
        if most is not None and size >= most:
            return found
        left = checkpoint(left.join(best, "k", "left_anti"))
        if size > widest or left.isEmpty():
            return found
        size = size * 2 if most is None else min(size * 2, most)
