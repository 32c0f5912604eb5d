"""Queries on elevations, colours and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles as t
from .fixtures import fixture, oracle
from .w3 import FLOOD, GRID, recursive, terrain

QUERIES, SQL = {}, {}
ELEV = f"CASE cls {' '.join(f'WHEN {c} THEN {t.FEET[n]}::DOUBLE' for n, c in t.CODES.items())} END"
#: Elevations that need no blur: a function of the key of each point.
POINTS = "pts AS (SELECT k, CAST(k % 100 AS INT) AS cx, CAST((k * 7) % 96 AS INT) AS cy, CAST(k % 10 AS INT) AS cls, CAST(k % 5200 AS DOUBLE) - 600 AS elev FROM {points})"
W = [w for w in t.kernel(9)]
KERNEL = "(VALUES " + ", ".join(f"({i - 9}, {w!r}::DOUBLE)" for i, w in enumerate(W)) + ") AS kk(o, w)"
FOLD = lambda p, n: f"(CASE WHEN (({p}) % {2 * n} + {2 * n}) % {2 * n} < {n} THEN (({p}) % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - (({p}) % {2 * n} + {2 * n}) % {2 * n} END)"
BLUR = f"""{FLOOD}, e0 AS (SELECT cx, cy, {ELEV} AS e FROM land),
 e1 AS (SELECT a.cx, a.cy, sum(w * b.e) AS e FROM e0 AS a, {KERNEL} JOIN e0 AS b ON b.cy = a.cy AND b.cx = {FOLD('a.cx + o', 100)} GROUP BY a.cx, a.cy),
 e2 AS (SELECT a.cx, a.cy, sum(w * b.e) AS e FROM e1 AS a, {KERNEL} JOIN e1 AS b ON b.cx = a.cx AND b.cy = {FOLD('a.cy + o', 96)} GROUP BY a.cx, a.cy)"""


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = recursive(sql) if "RECURSIVE" in sql else oracle(sql)
        return f

    return keep


def points(spark, sf):
    k = F.col("k")
    return fixture(spark, sf, "points").select(
        "k", (k % 100).cast("int").alias("cx"), (k * 7 % 96).cast("int").alias("cy"), (k % 10).cast("int").alias("cls"), ((k % 5200).cast("double") - 600).alias("elev")
    )


@query("base_elevation", f"WITH {POINTS} SELECT k, {ELEV} AS elev FROM pts")
def base_elevation(spark, sf):
    return points(spark, sf).select("k", t.base_elevation(F.col("cls")).alias("elev"))


@query("blur_field", f"WITH {BLUR} SELECT cx, cy, round(e, 5) AS elev FROM e2")
def blur_field(spark, sf):
    return t.elevation(terrain(spark, sf), GRID).select("cx", "cy", F.bround("elev", 5).alias("elev"))


@query("elevation_range", f"WITH {BLUR} SELECT round(min(e)) AS min_feet, round(max(e)) AS max_feet, round(min(e) * 0.3048) AS min_metres, round(max(e) * 0.3048) AS max_metres FROM e2")
def elevation_range(spark, sf):
    return t.elevation_range(t.elevation(terrain(spark, sf), GRID))


@query("terrain_rgb", f"WITH {POINTS}, c AS (SELECT k, CAST(trunc((elev * 0.3048::DOUBLE + 10000.0::DOUBLE) * 10.0::DOUBLE) AS INT) AS c FROM pts) SELECT k, (c >> 16) & 255 AS r, (c >> 8) & 255 AS g, c & 255 AS b FROM c")
def terrain_rgb(spark, sf):
    return points(spark, sf).select("k", t.terrain_rgb(F.col("elev")).alias("c")).select("k", "c.*")


NOISE = "((m2 ^ (m2 >> 16)) & 65535) / 32767.5::DOUBLE - 1.0".replace("^", "#")
N1 = "((cx::BIGINT * 374761393 + cy::BIGINT * 668265263) & 4294967295)"
M2 = f"((xor({N1}, {N1} >> 13) * 1274126177) & 4294967295)"
NOISE = f"((xor({M2}, {M2} >> 16) & 65535) / 32767.5::DOUBLE - 1.0::DOUBLE)"


@query("cell_noise", f"WITH {POINTS} SELECT k, round({NOISE}, 9) AS noise FROM pts")
def cell_noise(spark, sf):
    return points(spark, sf).select("k", F.bround(t.cell_noise(F.col("cx"), F.col("cy")), 9).alias("noise"))


CL = lambda e: f"least(greatest({e}, 0.0::DOUBLE), 1.0::DOUBLE)"
LAT = "(cy + 0.5::DOUBLE - 48.0::DOUBLE)"
FACTORS = f"""{CL(f'({LAT} - 8) / 30')} AS cold, {CL(f'(6 - {LAT}) / 22')} AS warm, {CL(f'({LAT} - 32) / 14')} AS snow_lat,
  6500::DOUBLE - 5000::DOUBLE * {CL(f'({LAT} + 5) / 45')} AS snowline"""


@query("latitude_factors", f"SELECT cy, round(cold, 9) AS cold, round(warm, 9) AS warm, round(snow_lat, 9) AS snow_lat, round(snowline, 6) AS snowline FROM (SELECT DISTINCT cy, {FACTORS} FROM (SELECT CAST((k * 7) % 96 AS INT) AS cy FROM {{points}}) AS q) AS p")
def latitude_factors(spark, sf):
    f = t.latitude_factors((F.col("cy") + 0.5) * GRID.cell + GRID.min_lat)
    rows = points(spark, sf).select("cy").distinct()
    return rows.select("cy", *(F.bround(c, 6 if n == "snowline" else 9).alias(n) for n, c in f.items()))


SHADE = """sh AS (SELECT *, least(greatest(1 + ((coalesce(lead(e) OVER x, e) - coalesce(lag(e) OVER x, e)) * -0.6::DOUBLE + (coalesce(lead(e) OVER y, e) - coalesce(lag(e) OVER y, e)) * 0.8::DOUBLE) * 0.00055::DOUBLE, 0.62::DOUBLE), 1.32::DOUBLE) AS shade
  FROM e0 WINDOW x AS (PARTITION BY cy ORDER BY cx), y AS (PARTITION BY cx ORDER BY cy))"""
E0 = f"{FLOOD}, e0 AS (SELECT cx, cy, cls, {ELEV} AS e FROM land)"


@query("relief_shade", f"WITH {E0}, {SHADE} SELECT cx, cy, round(shade, 8) AS shade FROM sh")
def relief_shade(spark, sf):
    field = terrain(spark, sf).withColumn("elev", t.base_elevation(F.col("cls")))
    return t.relief_shade(field).select("cx", "cy", F.bround("shade", 8).alias("shade"))


def _mix(a, b, x):
    return f"({a} + ({b} - ({a})) * {x})"


def _colour(k):
    d = lambda v: f"{float(v)}::DOUBLE"
    water = _mix(_mix(d(t.SEA_SHALLOW[k]), d(t.SEA_DEEP[k]), "dp"), d(t.ICE[k]), "(snow_lat * 0.55::DOUBLE)")
    base = "CASE cls " + " ".join(f"WHEN {t.CODES[n]} THEN {d(v[k])}" for n, v in t.BIOME.items()) + f" ELSE {d(t.BIOME['plains'][k])} END"
    land = _mix(_mix(_mix(base, d(t.SNOW[k]), "snow"), d(t.COLD[k]), "(cold * 0.20::DOUBLE * (1 - snow))"), d(t.WARM[k]), "(warm * 0.22::DOUBLE * (1 - snow))")
    return f"CAST(trunc(least(greatest((CASE WHEN cls = 0 THEN {water} ELSE {land} END) * light, 0), 255)) AS INT) AS {'rgb'[k]}"


COLOUR = f"""fa AS (SELECT *, {FACTORS} FROM sh), sn AS (SELECT *, greatest(snow_lat * 0.9::DOUBLE, {CL('(e - snowline) / 1800')}) * CASE WHEN cls = 8 THEN 0.4::DOUBLE ELSE 1 END AS snow,
  pow({CL('-e / 600')}, 0.65::DOUBLE) AS dp, CASE WHEN cls = 0 THEN 1.0::DOUBLE ELSE shade * (1 + round_even({NOISE} * 3, 0) / 3 * 0.045::DOUBLE) END AS light FROM fa),
  rgb AS (SELECT cx, cy, {_colour(0)}, {_colour(1)}, {_colour(2)} FROM sn)"""


def colours(spark, sf):
    field = terrain(spark, sf).withColumn("elev", t.base_elevation(F.col("cls")))
    return t.satellite_colour(t.relief_shade(field), GRID)


@query("satellite_colour", f"WITH {E0}, {SHADE}, {COLOUR} SELECT cx, cy, r, g, b FROM rgb")
def satellite_colour(spark, sf):
    return colours(spark, sf)


TROW = lambda lat: f"CAST(trunc((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2, z)) AS INT)"
TCOL = lambda lon: f"CAST(trunc(({lon} + 180) / 360 * pow(2, z)) AS INT)"
#: The tiles under the realms' boxes.
TILES = f"""tb AS (SELECT fid, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north FROM {{political}} GROUP BY fid), zs AS (SELECT unnest([2, 3, 4]) AS z),
  tiles AS (SELECT DISTINCT z, tx, ty FROM (SELECT z, tx, unnest(range({TROW('north')}, {TROW('south')} + 1)) AS ty
   FROM (SELECT z, north, south, unnest(range({TCOL('west')}, {TCOL('east')} + 1)) AS tx FROM tb, zs) AS q) AS q2)"""
ZOOMS = (2, 3, 4)


def the_tiles(spark, sf):
    """The tiles of zoom 2 to 4 under the realms' boxes."""
    sides = {"west": F.min("x"), "east": F.max("x"), "south": F.min("y"), "north": F.max("y")}
    boxes = fixture(spark, sf, "political").groupBy("fid").agg(*(c.alias(n) for n, c in sides.items()))
    return t.tile_range(boxes.withColumn("z", F.explode(F.array(*map(F.lit, ZOOMS)))))


@query("tile_range", f"WITH {TILES} SELECT z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM tiles")
def tile_range(spark, sf):
    return the_tiles(spark, sf)


@query(
    "pixel_to_cell_nearest",
    f"""WITH {TILES}, xs AS (SELECT z, tx AS tile, px AS pixel, 'x' AS axis, least(greatest(CAST(trunc((tx / pow(2, z) * 360 - 180) + (360 / pow(2, z)) * (px + 0.5) / 256 + 4.0) AS INT), 0), 99) AS cell
  FROM (SELECT DISTINCT z, tx FROM tiles) AS q, (SELECT unnest(range(256)) AS px) AS p),
  ys AS (SELECT z, ty AS tile, py AS pixel, 'y' AS axis, least(greatest(CAST(trunc(degrees(atan(sinh(pi() * (1 - 2 * ((ty + (py + 0.5) / 256) / pow(2, z)))))) + 48.0) AS INT), 0), 95) AS cell
  FROM (SELECT DISTINCT z, ty FROM tiles) AS q, (SELECT unnest(range(256)) AS py) AS p)
  SELECT z, CAST(tile AS INT) AS tile, CAST(pixel AS INT) AS pixel, axis, cell FROM (SELECT * FROM xs UNION ALL SELECT * FROM ys) AS u""",
)
def pixel_to_cell_nearest(spark, sf):
    xs, ys = t.pixel_to_cell_nearest(the_tiles(spark, sf), GRID)
    names = lambda df, tile, pixel, cell, axis: df.select("z", F.col(tile).alias("tile"), F.col(pixel).alias("pixel"), F.lit(axis).alias("axis"), F.col(cell).alias("cell"))
    return names(xs, "tx", "px", "cx", "x").union(names(ys, "ty", "py", "cy", "y"))


#: Pixels on the grid: where their columns and rows lie, in cells.
AXES = f"""{TILES}, px AS (SELECT z, tx, px, (tx / pow(2, z) * 360 - 180) + (360 / pow(2, z)) * (px + 0.5) / 256 + 4.0 AS v FROM (SELECT DISTINCT z, tx FROM tiles) AS q, (SELECT unnest(range(256)) AS px) AS p),
  py AS (SELECT z, ty, py, degrees(atan(sinh(pi() * (1 - 2 * ((ty + (py + 0.5) / 256) / pow(2, z)))))) + 48.0 AS v FROM (SELECT DISTINCT z, ty FROM tiles) AS q, (SELECT unnest(range(256)) AS py) AS p)"""
SIDE = lambda n: f"least(greatest(CAST(floor(v - 0.5) AS INT) + o, 0), {n - 1})"
SHARE = "CASE o WHEN 0 THEN 1 - ((v - 0.5) - floor(v - 0.5)) ELSE (v - 0.5) - floor(v - 0.5) END"


@query(
    "bilinear_pixels",
    f"""WITH {E0}, {SHADE}, {COLOUR}, {AXES}, bx AS (SELECT z, tx, px, {SIDE(100)} AS cx, {SHARE} AS wx FROM px, (VALUES (0), (1)) AS oo(o)), by_ AS (SELECT z, ty, py, {SIDE(96)} AS cy, {SHARE} AS wy FROM py, (VALUES (0), (1)) AS oo(o)),
  pix AS (SELECT tiles.z, tiles.tx, tiles.ty, px, py, {', '.join(f'CAST(trunc(sum({c} * (wy * wx)) + 1e-9) AS BIGINT) AS {c}' for c in 'rgb')} FROM tiles JOIN bx ON bx.z = tiles.z AND bx.tx = tiles.tx JOIN by_ ON by_.z = tiles.z AND by_.ty = tiles.ty
   JOIN rgb ON rgb.cx = bx.cx AND rgb.cy = by_.cy GROUP BY ALL)
  SELECT z, tx, CAST(ty AS INT) AS ty, py, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum((r + 256 * g + 65536 * b) * (px + 1)) AS BIGINT) AS check_ FROM pix GROUP BY ALL""",
)
def bilinear_pixels(spark, sf):
    """All pixels, told row by row: sums of the colours, and one sum that also weighs where each stands."""
    found = t.bilinear_pixels(the_tiles(spark, sf), colours(spark, sf), GRID)
    whole = (F.col("r") + 256 * F.col("g") + 65536 * F.col("b")).cast("long") * (F.col("px") + 1)
    return found.groupBy("z", "tx", "ty", F.col("py").cast("long").alias("py")).agg(*(F.sum(c).alias(c) for c in "rgb"), F.sum(whole).alias("check_"))


@query(
    "pack_tiles",
    f"""WITH {BLUR}, {AXES}, cd AS (SELECT cx, cy, CAST(trunc((e * 0.3048::DOUBLE + 10000.0::DOUBLE) * 10.0::DOUBLE) AS INT) AS c FROM e2),
  nx AS (SELECT z, tx, px, least(greatest(CAST(trunc(v) AS INT), 0), 99) AS cx FROM px), ny AS (SELECT z, ty, py, least(greatest(CAST(trunc(v) AS INT), 0), 95) AS cy FROM py)
  SELECT tiles.z, tiles.tx, CAST(tiles.ty AS INT) AS ty, count(*) * 3 AS bytes, sha256(unhex(string_agg(printf('%06x', c), '' ORDER BY py, px))) AS rgb_sha256 FROM tiles JOIN nx ON nx.z = tiles.z AND nx.tx = tiles.tx JOIN ny ON ny.z = tiles.z AND ny.ty = tiles.ty
  JOIN cd ON cd.cx = nx.cx AND cd.cy = ny.cy GROUP BY ALL""",
)
def pack_tiles(spark, sf):
    field = t.elevation(terrain(spark, sf), GRID)
    packed = t.pack_tiles(the_tiles(spark, sf), field, GRID)
    return packed.select("z", "tx", "ty", F.octet_length("rgb").cast("long").alias("bytes"), F.sha2("rgb", 256).alias("rgb_sha256"))
