"""Queries on the terrain grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster as r
from .fixtures import fixture, oracle

QUERIES, SQL = {}, {}
GRID = r.Grid(-4.0, -48.0, 1.0, 100, 96)
#: The same extent in cells of an eighth of a degree: 614 400 cells.
FINE = r.Grid(-4.0, -48.0, 0.125, 800, 768)
LAYERS = ("continents", "islands", "regions", "landscape", "lakes", "roads")
CLS = """CASE WHEN layer IN ('continents', 'islands') THEN 1 WHEN layer = 'lakes' THEN 8 WHEN layer = 'roads' THEN 9
  WHEN layer = 'regions' THEN CASE lower(type) WHEN 'forest' THEN 3 WHEN 'mountain' THEN 7 WHEN 'desert' THEN 4 WHEN 'water' THEN 0 END
  ELSE CASE lower(type) WHEN 'forest' THEN 3 WHEN 'mountain' THEN 7 WHEN 'swamp' THEN 5 WHEN 'stepp' THEN 2 END END"""
ALL = " UNION ALL ".join(f"SELECT * FROM {{{n}}}" for n in LAYERS)
EDGES = f"""ed AS (SELECT layer, feature_idx, {CLS} AS cls, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({ALL}) AS v
  WINDOW w AS (PARTITION BY layer, fid, part, ring ORDER BY seq))"""
CELL = lambda v, low, n: f"least(greatest(CAST(trunc(({v} - ({low}))) AS INT), 0), {n - 1})"
SPANS = f"""{EDGES}, cr AS (SELECT layer, cls, row, x1 + (row + 0.5 - 48.0 - y1) * (x2 - x1) / (y2 - y1) AS x
  FROM ed, (SELECT unnest(range(96))::DOUBLE AS row) AS rr WHERE layer <> 'roads' AND x2 IS NOT NULL AND y1 <> y2 AND cls IS NOT NULL
  AND least(y1, y2) <= row + 0.5 - 48.0 AND row + 0.5 - 48.0 < greatest(y1, y2)),
  pr AS (SELECT layer, cls, row, x AS a, lead(x) OVER w AS b, row_number() OVER w AS n FROM cr WINDOW w AS (PARTITION BY layer, cls, row ORDER BY x)),
  spans AS (SELECT layer, cls, CAST(row AS INT) AS row, {CELL('a', -4.0, 100)} AS xa, {CELL('b', -4.0, 100)} AS xb FROM pr WHERE n % 2 = 1 AND b IS NOT NULL)"""
STROKES = f"""st AS (SELECT *, greatest(1, CAST(trunc(greatest(abs(x2 - x1), abs(y2 - y1)) / 0.5) AS INT)) AS steps FROM ed WHERE layer = 'roads' AND x2 IS NOT NULL),
  strokes AS (SELECT DISTINCT layer, cls, {CELL('(x1 + (x2 - x1) * (i::DOUBLE / steps))', -4.0, 100)} AS cx, {CELL('(y1 + (y2 - y1) * (i::DOUBLE / steps))', -48.0, 96)} AS cy
  FROM (SELECT *, unnest(range(steps + 1)) AS i FROM st) AS q)"""
PAINT = f"""{SPANS}, {STROKES}, seen AS (SELECT layer, cls, min(feature_idx) AS seen FROM ed WHERE cls IS NOT NULL AND x2 IS NOT NULL GROUP BY ALL),
  pc AS (SELECT DISTINCT * FROM (SELECT layer, cls, unnest(range(xa, xb + 1)) AS cx, row AS cy FROM spans UNION ALL SELECT layer, cls, cx, cy FROM strokes) AS q),
  rk AS (SELECT cx, cy, cls, row_number() OVER (PARTITION BY cx, cy ORDER BY k, seen, cls) AS n, over_ FROM pc JOIN seen USING (layer, cls)
  JOIN (VALUES ('continents', 0, 1023), ('islands', 1, 1023), ('regions', 2, 2), ('landscape', 3, 94), ('lakes', 4, 1023), ('roads', 5, 254)) AS o(layer, k, over_) USING (layer)),
  ls AS (SELECT cx, cy, list(cls ORDER BY n) AS cs, list(over_ ORDER BY n) AS os FROM rk GROUP BY cx, cy),
  cells AS (SELECT g.cx, g.cy, coalesce(list_reduce(list_transform(range(1, len(cs) + 1), lambda i: [cs[i], os[i]]), lambda a, b: [CASE WHEN (b[2] >> a[1]) & 1 = 1 THEN b[1] ELSE a[1] END, 0], [0, 0])[1], 0)::INT AS cls
  FROM (SELECT CAST(c % 100 AS INT) AS cx, CAST(c // 100 AS INT) AS cy FROM (SELECT unnest(range(9600)) AS c) AS q) AS g LEFT JOIN ls USING (cx, cy))"""
#: The flood from the border over ocean.
FLOOD = f"""RECURSIVE {PAINT}, fl AS (SELECT cx, cy FROM cells WHERE cls = 0 AND (cx IN (0, 99) OR cy IN (0, 95))
  UNION SELECT c.cx, c.cy FROM fl JOIN cells AS c ON c.cls = 0 AND ((abs(c.cx - fl.cx) = 1 AND c.cy = fl.cy) OR (abs(c.cy - fl.cy) = 1 AND c.cx = fl.cx))),
  land AS (SELECT c.cx, c.cy, CASE WHEN c.cls = 0 AND fl.cx IS NULL THEN 8 ELSE c.cls END AS cls FROM cells AS c LEFT JOIN fl USING (cx, cy))"""


def recursive(sql: str) -> str:
    """Moves RECURSIVE to the front of the one WITH."""
    return oracle(sql.replace("RECURSIVE ", "", 1)).replace("WITH ", "WITH RECURSIVE ", 1)


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = recursive(sql) if "RECURSIVE" in sql else oracle(sql)
        return f

    return keep


def edges(spark, sf):
    vertices = fixture(spark, sf, LAYERS[0])
    for layer in LAYERS[1:]:
        vertices = vertices.unionByName(fixture(spark, sf, layer))
    cut = geo.join_vertices(vertices, ["layer", "fid", "feature_idx", "type"])
    return cut.withColumn("cls", r.classify_layer(F.col("layer"), F.col("type"))).where("cls IS NOT NULL")


def painted(spark, sf):
    e = edges(spark, sf)
    seen = e.groupBy("layer", "cls").agg(F.min("feature_idx").alias("seen"))
    return r.paint_stack(r.fill_polygons(e.where("layer <> 'roads'"), GRID), r.stroke_lines(e.where("layer = 'roads'"), GRID), seen, GRID)


def terrain(spark, sf, grid=GRID):
    return r.build_terrain(edges(spark, sf), grid)


@query("grid_extent", f"SELECT min(x) - 1 AS min_lon, min(y) - 1 AS min_lat, CAST(trunc((max(x) - min(x) + 2) / 0.125) AS INT) + 1 AS width, CAST(trunc((max(y) - min(y) + 2) / 0.125) AS INT) + 1 AS height FROM (SELECT * FROM {{continents}} UNION ALL SELECT * FROM {{islands}}) AS v".replace("{{", "{").replace("}}", "}"))
def grid_extent(spark, sf):
    g = r.grid_extent(fixture(spark, sf, "continents").unionByName(fixture(spark, sf, "islands")), 0.125)
    return spark.range(1).select(F.lit(g.min_lon).alias("min_lon"), F.lit(g.min_lat).alias("min_lat"), F.lit(g.width).alias("width"), F.lit(g.height).alias("height"))


@query("classify_layer", f"SELECT layer, type, {CLS} AS cls, count(*) AS n FROM ({ALL}) AS v GROUP BY ALL")
def classify_layer(spark, sf):
    vertices = fixture(spark, sf, LAYERS[0])
    for layer in LAYERS[1:]:
        vertices = vertices.unionByName(fixture(spark, sf, layer))
    return vertices.groupBy("layer", "type", r.classify_layer(F.col("layer"), F.col("type")).alias("cls")).agg(F.count("*").alias("n"))


@query("cell_of", f"SELECT k, {CELL('x', -4.0, 100)} AS cx, {CELL('y', -48.0, 96)} AS cy FROM {{points}}")
def cell_of(spark, sf):
    p = fixture(spark, sf, "points")
    return p.select("k", geo.cell_of(F.col("x"), -4.0, 1.0, 100).alias("cx"), geo.cell_of(F.col("y"), -48.0, 1.0, 96).alias("cy"))


@query("fill_polygons", f"WITH {SPANS} SELECT layer, cls, row, xa, xb FROM spans")
def fill_polygons(spark, sf):
    return r.fill_polygons(edges(spark, sf).where("layer <> 'roads'"), GRID)


@query("stroke_lines", f"WITH {EDGES}, {STROKES} SELECT layer, cls, cx, cy FROM strokes")
def stroke_lines(spark, sf):
    return r.stroke_lines(edges(spark, sf).where("layer = 'roads'"), GRID)


@query("paint_stack", f"WITH {PAINT} SELECT cx, cy, cls FROM cells")
def paint_stack(spark, sf):
    return painted(spark, sf)


@query("reclass_landlocked", f"WITH {FLOOD} SELECT cx, cy, cls FROM land")
def reclass_landlocked(spark, sf):
    return r.reclass_landlocked(painted(spark, sf), GRID)


@query("build_terrain", f"WITH {FLOOD} SELECT cx, cy, cls FROM land")
def build_terrain(spark, sf):
    return terrain(spark, sf)


@query("build_terrain_fine")
def build_terrain_fine(spark, sf):
    """Cells of an eighth of a degree; recursive SQL over so many is slow, so tests hold it against a plain painter."""
    return terrain(spark, sf, FINE)


NAMES = ", ".join(f"({c}, '{n}')" for n, c in r.CODES.items())


@query("terrain_histogram", f"WITH {FLOOD} SELECT l.cls, l.name, count(land.cx) AS n FROM (VALUES {NAMES}) AS l(cls, name) LEFT JOIN land USING (cls) GROUP BY ALL")
def terrain_histogram(spark, sf):
    return r.terrain_histogram(terrain(spark, sf))


@query(
    "terrain_shares",
    f"""WITH {FLOOD}, h AS (SELECT l.name, count(land.cx) AS n FROM (VALUES {NAMES}) AS l(cls, name) LEFT JOIN land USING (cls) WHERE l.name NOT IN ('ocean', 'lake') GROUP BY ALL)
  SELECT name, round(100.0::DOUBLE * n / (SELECT sum(n) FROM h), 2) AS percent FROM h""",
)
def terrain_shares(spark, sf):
    return r.terrain_shares(terrain(spark, sf))
