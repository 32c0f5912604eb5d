"""Planar geometry as column expressions.

A geometry is struct<type, parts: array<part>>; a part is an array of rings, a ring an array of points {x, y}. A line
is a part of one ring, a point a ring of one vertex; ring 0 of a polygon's part is its shell, the others are holes.
Coordinates are planar degrees; no projection and no great circles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GEOMETRY = "struct<type:string,parts:array<array<array<struct<x:double,y:double>>>>>"


def planar_miles(x1: Column, y1: Column, x2: Column, y2: Column, miles_per_degree: Column | float) -> Column:
    scale = miles_per_degree if isinstance(miles_per_degree, Column) else F.lit(float(miles_per_degree))
    return F.hypot(x2 - x1, y2 - y1) * scale


def flat_points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry["parts"]))


def bbox(geometry: Column) -> Column:
    """struct<min_x, min_y, max_x, max_y>."""
    xs = F.transform(flat_points(geometry), lambda p: p["x"])
    ys = F.transform(flat_points(geometry), lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")
    )


def line_degrees(geometry: Column) -> Column:
    """Sum of the lengths between consecutive vertices of each ring."""

    def length(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        steps = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        return F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)

    rings = F.flatten(geometry["parts"])
    return F.aggregate(F.transform(rings, length), F.lit(0.0), lambda acc, d: acc + d)


def line_length_miles(geometry: Column, miles_per_degree: float) -> Column:
    return line_degrees(geometry) * F.lit(float(miles_per_degree))


def explode_vertices(features: DataFrame, keep: list[str]) -> DataFrame:
    """keep, part, ring, seq, x, y: one row a vertex, in the order of the geometry."""
    parts = features.select(*keep, F.posexplode("geometry.parts").alias("part", "__rings"))
    rings = parts.select(*keep, "part", F.posexplode("__rings").alias("ring", "__points"))
    return rings.select(*keep, "part", "ring", F.posexplode("__points").alias("seq", "__p")).select(*keep, "part", "ring", "seq", "__p.x", "__p.y")


def explode_edges(features: DataFrame, keep: list[str], close: bool = True) -> DataFrame:
    """keep, part, ring, seq, x1, y1, x2, y2: consecutive vertices; close adds the edge back to an open ring's start."""
    parts = features.select(*keep, F.posexplode("geometry.parts").alias("part", "__rings"))
    rings = parts.select(*keep, "part", F.posexplode("__rings").alias("ring", "__r"))
    r = F.col("__r")
    ends = F.slice(r, F.lit(2), F.size(r))
    open_ring = (F.element_at(r, 1)["x"] != F.element_at(r, -1)["x"]) | (F.element_at(r, 1)["y"] != F.element_at(r, -1)["y"])
    if close:
        ends = F.when(open_ring, F.concat(ends, F.slice(r, 1, 1))).otherwise(ends)
    pairs = F.zip_with(F.slice(r, F.lit(1), F.size(ends)), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rings = rings.where(F.size(r) > 1)
    out = rings.select(*keep, "part", "ring", F.posexplode(pairs).alias("seq", "__e"))
    e = F.col("__e")
    return out.select(*keep, "part", "ring", "seq", e["a"]["x"].alias("x1"), e["a"]["y"].alias("y1"), e["b"]["x"].alias("x2"), e["b"]["y"].alias("y2"))


def join_vertices(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """explode_edges() of features that come as vertices (keys, part, ring, seq, x, y), without building them; rings stay as open as they are."""
    ring = Window.partitionBy(*keys, "part", "ring").orderBy("seq")
    ends = vertices.select(*keys, "part", "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(ring).alias("x2"), F.lead("y").over(ring).alias("y2"))
    return ends.where("x2 IS NOT NULL")


def assemble(vertices: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """Rows of keys with their geometry, from vertices (keys, part, ring, seq, x, y)."""
    rings = vertices.groupBy(*keys, "part", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct("x", "y").alias("p")))).alias("v"))
    parts = rings.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("ring", F.transform("v", lambda s: s["p"]).alias("r")))).alias("v"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", F.transform("v", lambda s: s["r"]).alias("r")))).alias("v"))
    return whole.select(*keys, F.struct(kind.alias("type"), F.transform("v", lambda s: s["r"]).alias("parts")).alias("geometry"))


def cell_of(value: Column, low: float, cell: float, count: int) -> Column:
    """Grid index: truncated towards zero, clamped to the grid."""
    return F.least(F.greatest(((value - low) / cell).cast("int"), F.lit(0)), F.lit(count - 1))


def cell_center(index: Column, low: float, cell: float) -> Column:
    return (index + 0.5) * cell + low


def hsl_to_hex(hue: Column, saturation: float, lightness: float) -> Column:
    """#rrggbb of a hue in degrees."""
    chroma = (1 - abs(2 * lightness - 1)) * saturation

    def channel(offset: int) -> Column:
        k = F.pmod(hue / 30 + offset, F.lit(12.0))
        value = F.lit(lightness) - chroma / 2 * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.bround(value * 255, 0).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))
