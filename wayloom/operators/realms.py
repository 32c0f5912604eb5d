"""Realms: where their labels stand, their colours, and how large their names are written."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bbox, explode_edges, explode_vertices, hsl_to_hex
from ..functions.scan import running
from ..functions.text import slugify
from .present import thin_labels

#: Steps of the coarse grid over a realm's box and of the fine one round its best point.
COARSE, FINE = 40, 10
#: The name of the realm without one; spread, saturation and lightness of the palette.
NAMELESS = "Beyond the Wall"
HUES, FILL, LABEL = 300.0, (0.62, 0.48), (0.72, 0.30)
#: Pixels of the largest and the smallest label, of the lowest realm, width of a letter and of the text in its box.
LARGEST, SMALLEST, LOWEST, LETTER, SHARE = 23.0, 8.5, 26.0, 0.62, 0.74
WORLD_PIXELS, MAX_LATITUDE = 512.0, 85.05112878


def candidates(boxes: DataFrame, steps: int) -> DataFrame:
    """(fid, i, j, x, y): the points of a grid of steps by steps over each box (fid, x0, y0, x1, y1)."""
    every = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    cut = boxes.withColumn("i", every).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    at = lambda low, high, n: F.col(low) + (F.col(high) - F.col(low)) * F.col(n) / F.lit(float(steps))
    return cut.select("fid", "i", "j", at("x0", "x1", "i").alias("x"), at("y0", "y1", "j").alias("y"))


def within_own(points: DataFrame, edges: DataFrame, band: float = 2.0) -> DataFrame:
    """Those points (fid, i, j, x, y) that lie in the polygon of their own feature; features and bands are joined as equals."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    cut = edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    met = points.withColumn("band", F.floor(F.col("y") / band)).join(cut.select("fid", "band", "part", "ring", "x1", "y1", "x2", "y2"), ["fid", "band"])
    rise = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossed = met.where(F.expr("(y1 > y) <> (y2 > y)") & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / rise + F.col("x1")))
    rings = crossed.groupBy("fid", "i", "j", "x", "y", "part", "ring").count().where(F.col("count") % 2 == 1)
    parts = rings.groupBy("fid", "i", "j", "x", "y", "part").agg(F.max(F.col("ring") == 0).alias("shell"), F.max(F.col("ring") > 0).alias("hole"))
    return parts.where("shell AND NOT hole").select("fid", "i", "j", "x", "y").distinct()


def clearest(boxes: DataFrame, edges: DataFrame, vertices: DataFrame, steps: int) -> DataFrame:
    """(fid, x, y) of the grid's inner point that is farthest from any vertex, the first in order of i, then j, of equals."""
    inner = within_own(candidates(boxes, steps), edges)
    corners = vertices.select("fid", F.col("x").alias("vx"), F.col("y").alias("vy")).distinct()
    dx, dy = F.col("vx") - F.col("x"), F.col("vy") - F.col("y")
    near = inner.join(corners, "fid").groupBy("fid", "i", "j", "x", "y").agg(F.min(dx * dx + dy * dy).alias("d"))
    best = near.groupBy("fid").agg(F.max_by(F.struct("x", "y"), F.struct("d", -F.col("i"), -F.col("j"))).alias("p"))
    return best.select("fid", "p.x", "p.y")


def label_anchor(features: DataFrame) -> DataFrame:
    """(fid, lon, lat): a point well inside each polygon (fid, geometry), found on a grid and once more round the best of it.

    A polygon that holds no point of the grid has the centre of its box.
    """
    box = features.select("fid", bbox(F.col("geometry")).alias("b"))
    boxes = box.select("fid", F.col("b.min_x").alias("x0"), F.col("b.min_y").alias("y0"), F.col("b.max_x").alias("x1"), F.col("b.max_y").alias("y1"))
    edges, vertices = explode_edges(features, ["fid"]), explode_vertices(features, ["fid"])
    coarse = clearest(boxes, edges, vertices, COARSE)
    step = lambda a, b: (F.col(b) - F.col(a)) / F.lit(float(COARSE))
    around = boxes.join(coarse, "fid").select(
        "fid", (F.col("x") - step("x0", "x1")).alias("x0"), (F.col("y") - step("y0", "y1")).alias("y0"),
        (F.col("x") + step("x0", "x1")).alias("x1"), (F.col("y") + step("y0", "y1")).alias("y1"),
    )
    fine = around.join(clearest(around, edges, vertices, FINE), "fid", "left")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    fine = fine.select("fid", F.coalesce("x", middle("x0", "x1")).alias("lon"), F.coalesce("y", middle("y0", "y1")).alias("lat"))
    out = boxes.join(fine, "fid", "left")
    return out.select("fid", F.coalesce("lon", middle("x0", "x1")).alias("lon"), F.coalesce("lat", middle("y0", "y1")).alias("lat"))


def realm_palette(realms: DataFrame) -> DataFrame:
    """realms (lat, feature_idx) with hue, colour and labelColour: the rainbow from north to south.

    Realms are numbered over sorted ranges; none has to hold them all.
    """
    ranked = running(realms.withColumn("__map", F.lit(0)), ["__map"], [F.col("lat").desc(), F.col("feature_idx")], {"__at": F.lit(1)})
    hue = F.lit(HUES) * (F.col("__at") - 1) / F.greatest(F.col("__at_total") - 1, F.lit(1))
    ranked = ranked.withColumn("hue", hue).drop("__map", "__at", "__at_total")
    colours = {"colour": hsl_to_hex(F.col("hue"), *FILL), "labelColour": hsl_to_hex(F.col("hue"), *LABEL)}
    return ranked.withColumns(colours).withColumn("hue", F.bround("hue", 1))


def build_realms(features: DataFrame) -> DataFrame:
    """Realms of polygons (fid, feature_idx, name, claimedby, geometry): name, sourceName, claimedBy, bbox, lon, lat, slug, hue, colours."""
    source = F.trim(F.coalesce("name", F.lit("")))
    b = bbox(F.col("geometry"))
    corners = F.array(*(F.bround(b[c], 4) for c in ("min_x", "min_y", "max_x", "max_y")))
    named = features.select("fid", "feature_idx", F.coalesce(F.nullif(source, F.lit("")), F.lit(NAMELESS)).alias("name"), source.alias("sourceName"), F.col("claimedby").alias("claimedBy"), corners.alias("bbox"))
    placed = named.join(label_anchor(features), "fid").withColumns({"lon": F.bround("lon", 5), "lat": F.bround("lat", 5), "slug": slugify(F.col("name"))})
    return realm_palette(placed)


def world_x(lon: Column, zoom: Column) -> Column:
    """Pixels from the world's west edge."""
    return (lon + 180) / 360 * WORLD_PIXELS * F.pow(F.lit(2.0), zoom)


def world_y(lat: Column, zoom: Column) -> Column:
    """Pixels from the world's north edge, in Mercator's projection."""
    held = F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))
    return (0.5 - F.ln(F.tan(math.pi / 4 + F.radians(held) / 2)) / (2 * math.pi)) * WORLD_PIXELS * F.pow(F.lit(2.0), zoom)


def realm_label_size(realms: DataFrame, zoom: float) -> DataFrame:
    """(fid, pixels, area, shown): the size of each realm's label, and whether it shows at this zoom.

    A label that is too small for its realm is hidden; of labels that overlap, that of the larger realm stays.
    """
    z = F.lit(float(zoom))
    side = lambda k: F.element_at("bbox", k)
    width = world_x(side(3), z) - world_x(side(1), z)
    height = world_y(side(2), z) - world_y(side(4), z)
    pixels = F.least(F.lit(LARGEST), width * SHARE / F.greatest(F.lit(4.0), F.length("name") * F.lit(LETTER)))
    sized = realms.select("fid", "name", "lon", "lat", pixels.alias("pixels"), (width * height).alias("area"), height.alias("height"))
    fits = sized.where((F.col("pixels") >= SMALLEST) & (F.col("height") >= LOWEST))
    half = F.length("name") * F.lit(LETTER) * F.col("pixels") / 2
    x, y = world_x(F.col("lon"), z), world_y(F.col("lat"), z)
    boxes = fits.select(
        F.col("fid").alias("id"), (-F.col("area")).alias("priority"), (x - half).alias("x1"), (y - F.col("pixels") / 2).alias("y1"), (x + half).alias("x2"), (y + F.col("pixels") / 2).alias("y2")
    )
    stays = thin_labels(boxes).select(F.col("id").alias("fid"), F.lit(True).alias("stays"))
    return sized.join(stays, "fid", "left").select("fid", "pixels", "area", F.coalesce("stays", F.lit(False)).alias("shown"))
