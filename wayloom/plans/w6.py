"""Queries on realms, named journeys, connections and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scratch import checkpoint
from ..operators import gazetteer as g
from ..operators import paths, realms, routing
from .fixtures import fixture, oracle
from .w1 import MPD
from .w3 import FLOOD, GRID, recursive, terrain
from .w5 import J, RELAX, journeys, routes

QUERIES, SQL = {}, {}
#: Realms: the nations' shapes on three maps side by side, so that there are nameless ones and equal shapes.
REALMS = """SELECT fid, feature_idx, CASE WHEN feature_idx % 9 = 4 THEN '' ELSE name END AS name, claimedby, part, ring, seq, x, y FROM {political}"""
BOXES = "bx AS (SELECT fid, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM rv GROUP BY fid)"


def anchor_sql(out: str, boxes: str, steps: int) -> str:
    """Common table expressions whose last, named out, is the clearest point of each box."""
    return f"""{out}_c AS (SELECT fid, i, j, x0 + (x1 - x0) * i / {steps}::DOUBLE AS x, y0 + (y1 - y0) * j / {steps}::DOUBLE AS y FROM {boxes},
   (SELECT unnest(range({steps + 1}))::DOUBLE AS i) AS ii, (SELECT unnest(range({steps + 1}))::DOUBLE AS j) AS jj),
  {out}_r AS (SELECT c.fid, i, j, x, y, part, ring FROM {out}_c AS c JOIN re ON re.fid = c.fid AND re.x2 IS NOT NULL AND (re.y1 > y) <> (re.y2 > y)
   AND x < (re.x2 - re.x1) * (y - re.y1) / nullif(re.y2 - re.y1, 0) + re.x1 GROUP BY ALL HAVING count(*) % 2 = 1),
  {out}_i AS (SELECT DISTINCT fid, i, j, x, y FROM (SELECT fid, i, j, x, y, part FROM {out}_r GROUP BY ALL HAVING bool_or(ring = 0) AND NOT bool_or(ring > 0)) AS q),
  {out}_d AS (SELECT p.fid, i, j, p.x, p.y, min((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y)) AS d FROM {out}_i AS p JOIN rv AS v ON v.fid = p.fid GROUP BY ALL),
  {out} AS (SELECT fid, x, y FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d DESC, i, j) AS n FROM {out}_d) AS q WHERE n = 1)"""


ANCHOR = f"""rv AS ({REALMS}), {BOXES},
  re AS (SELECT fid, part, ring, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM rv WINDOW w AS (PARTITION BY fid, part, ring ORDER BY seq)),
  {anchor_sql('ca', 'bx', realms.COARSE)},
  fb AS (SELECT fid, x - (x1 - x0) / 40 AS x0, y - (y1 - y0) / 40 AS y0, x + (x1 - x0) / 40 AS x1, y + (y1 - y0) / 40 AS y1 FROM bx JOIN ca USING (fid)),
  {anchor_sql('fa', 'fb', realms.FINE)},
  an AS (SELECT bx.fid, coalesce(fa.x, (fb.x0 + fb.x1) / 2, (bx.x0 + bx.x1) / 2) AS lon, coalesce(fa.y, (fb.y0 + fb.y1) / 2, (bx.y0 + bx.y1) / 2) AS lat
   FROM bx LEFT JOIN fb USING (fid) LEFT JOIN fa USING (fid))"""


def hex_sql(s: float, lightness: float) -> str:
    """#rrggbb of hue in degrees."""
    chroma = (1 - abs(2 * lightness - 1)) * s
    k = lambda n: f"((hue / 30 + {n}) - 12 * floor((hue / 30 + {n}) / 12))"
    one = lambda n: f"printf('%02x', CAST(round_even(({lightness}::DOUBLE - {chroma / 2!r}::DOUBLE * greatest(-1, least({k(n)} - 3, 9 - {k(n)}, 1))) * 255, 0) AS INT))"
    return f"concat('#', {one(0)}, {one(8)}, {one(4)})"


REALM = f"""{ANCHOR}, rl AS (SELECT DISTINCT fid, feature_idx, coalesce(nullif(trim(name), ''), 'Beyond the Wall') AS name, trim(name) AS sourceName, claimedby AS claimedBy FROM rv),
  ro AS (SELECT rl.*, round(x0, 4) AS w, round(y0, 4) AS s, round(x1, 4) AS e, round(y1, 4) AS n, round(lon, 5) AS lon, round(lat, 5) AS lat FROM rl JOIN bx USING (fid) JOIN an USING (fid)),
  rh AS (SELECT *, 300.0::DOUBLE * (row_number() OVER (ORDER BY lat DESC, feature_idx) - 1) / greatest(count(*) OVER () - 1, 1) AS hue FROM ro),
  rp AS (SELECT *, {hex_sql(0.62, 0.48)} AS colour, {hex_sql(0.72, 0.30)} AS labelColour FROM rh)"""
ZOOM = 3.5
MERCATOR = lambda lat: f"((0.5 - ln(tan(pi() / 4 + radians({lat}) / 2)) / (2 * pi())) * 512.0 * pow(2.0, {ZOOM}))"
X = lambda lon: f"(({lon} + 180) / 360 * 512.0 * pow(2.0, {ZOOM}))"
#: Labels that hide each other, largest first: one step of the recursion takes one label.
SIZED = f"""sz AS (SELECT fid, name, lon, lat, w_ * h_ AS area, h_, least(23.0::DOUBLE, w_ * 0.74 / greatest(4.0, length(name) * 0.62::DOUBLE)) AS pixels
   FROM (SELECT *, {X('e')} - {X('w')} AS w_, {MERCATOR('s')} - {MERCATOR('n')} AS h_ FROM rp) AS q),
  lb AS (SELECT fid, row_number() OVER (ORDER BY area DESC, fid) AS n, {X('lon')} - length(name) * 0.62::DOUBLE * pixels / 2 AS a1, {MERCATOR('lat')} - pixels / 2 AS b1,
   {X('lon')} + length(name) * 0.62::DOUBLE * pixels / 2 AS a2, {MERCATOR('lat')} + pixels / 2 AS b2 FROM sz WHERE pixels >= 8.5 AND h_ >= 26)"""
TAKEN = """tk AS (SELECT 0::BIGINT AS n, []::STRUCT(fid VARCHAR, a1 DOUBLE, b1 DOUBLE, a2 DOUBLE, b2 DOUBLE)[] AS taken UNION ALL
   SELECT lb.n, CASE WHEN len(list_filter(taken, lambda t: t.a1 < lb.a2 AND lb.a1 < t.a2 AND t.b1 < lb.b2 AND lb.b1 < t.b2)) > 0 THEN taken
   ELSE list_append(taken, {'fid': fid, 'a1': a1, 'b1': b1, 'a2': a2, 'b2': b2}) END FROM tk JOIN lb ON lb.n = tk.n + 1),
  st AS (SELECT unnest(taken).fid AS fid FROM (SELECT taken FROM tk ORDER BY n DESC LIMIT 1) AS q)""".replace("{'fid'", "{{'fid'").replace("b2})", "b2}})")


def braces(sql: str) -> str:
    """oracle() takes {name} for a table; a literal struct is written with double braces."""
    held = sql.replace("{{", "\x01").replace("}}", "\x02")
    out = recursive(held) if "RECURSIVE" in held else oracle(held)
    return out.replace("\x01", "{").replace("\x02", "}")


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = braces(sql)
        return f

    return keep


def political(spark, sf):
    vertices = fixture(spark, sf, "political").withColumn("name", F.when(F.col("feature_idx") % 9 == 4, "").otherwise(F.col("name")))
    return geo.assemble(vertices, ["fid", "feature_idx", "name", "claimedby"], F.lit("Polygon"))


@query("label_anchor", f"WITH {ANCHOR} SELECT fid, round(lon, 6) AS lon, round(lat, 6) AS lat FROM an")
def label_anchor(spark, sf):
    return realms.label_anchor(political(spark, sf)).select("fid", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"))


@query("build_realms", f"WITH {REALM} SELECT fid, name, \"sourceName\", \"claimedBy\", w, s, e, n, lon, lat, lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, round(hue, 1) AS hue, colour, \"labelColour\" FROM rp")
def build_realms(spark, sf):
    r = realms.build_realms(political(spark, sf))
    sides = (F.element_at("bbox", k + 1).alias(c) for k, c in enumerate("wsen"))
    return r.select("fid", "name", "sourceName", "claimedBy", *sides, "lon", "lat", "slug", "hue", "colour", "labelColour")


@query(
    "realm_palette",
    f"""WITH rh AS (SELECT place_idx AS feature_idx, lat, 300.0::DOUBLE * (row_number() OVER (ORDER BY lat DESC, place_idx) - 1) / greatest(count(*) OVER () - 1, 1) AS hue FROM {{{{places}}}})
  SELECT feature_idx, round(hue, 1) AS hue, {hex_sql(0.62, 0.48)} AS colour, {hex_sql(0.72, 0.30)} AS "labelColour" FROM rh""".replace("{{places}}", "{places}"),
)
def realm_palette(spark, sf):
    p = fixture(spark, sf, "places").select(F.col("place_idx").alias("feature_idx"), "lat")
    return realms.realm_palette(p).select("feature_idx", "hue", "colour", "labelColour")


@query("realm_label_size", f"WITH RECURSIVE {REALM}, {SIZED}, {TAKEN} SELECT sz.fid, round(pixels, 4) AS pixels, round(area, 2) AS area, st.fid IS NOT NULL AS shown FROM sz LEFT JOIN st ON st.fid = sz.fid")
def realm_label_size(spark, sf):
    r = realms.build_realms(political(spark, sf))
    sized = realms.realm_label_size(r, ZOOM)
    return sized.select("fid", F.bround("pixels", 4).alias("pixels"), F.bround("area", 2).alias("area"), "shown")


#: Journeys between places by name; every tenth ends nowhere, every thirteenth begins there.
NAMED = """SELECT k, CASE WHEN k % 13 = 0 THEN 'Nowhere' ELSE p_name END AS origin, CASE WHEN k % 10 = 0 THEN concat('Nowhere ', CAST(k AS VARCHAR(20))) ELSE concat(left(p_name, 0), lead_name) END AS destination
  FROM (SELECT p_partkey AS k, p_name, coalesce(lead(p_name) OVER (ORDER BY p_partkey), p_name) AS lead_name FROM {part}) AS t"""


@query(
    "od_pairs",
    f"""WITH j AS ({NAMED}), p AS (SELECT name, arg_max(lon, place_idx) AS lon, arg_max(lat, place_idx) AS lat FROM {{many_places}} GROUP BY name)
  SELECT k, origin, destination, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2, CASE WHEN a.name IS NULL THEN 'unknown-origin' WHEN b.name IS NULL THEN 'unknown-destination' END AS error
  FROM j LEFT JOIN p AS a ON a.name = origin LEFT JOIN p AS b ON b.name = destination""",
)
def od_pairs(spark, sf):
    named = spark.sql(NAMED.replace("VARCHAR(20)", "STRING"), part=fixture(spark, sf, "part"))
    return routing.od_pairs(named, fixture(spark, sf, "many_places"))


@query("append_patches", "SELECT place_idx, name, source FROM {places} UNION ALL SELECT place_idx + 1000000, name, 'custom' FROM {many_places}")
def append_patches(spark, sf):
    patches = fixture(spark, sf, "many_places").select((F.col("place_idx") + 1_000_000).alias("place_idx"), "name", F.lit("custom").alias("source"))
    return g.append_patches(fixture(spark, sf, "places"), patches).select("place_idx", "name", "source")


PROPERTIES = "SELECT p_partkey AS i, CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE p_name END AS name, p_type AS type, CASE WHEN p_partkey % 5 = 0 THEN 'many' ELSE concat(' ', CAST(p_size AS VARCHAR(20)), '.7') END AS size, p_partkey % 11 = 3 AS bare FROM {part}"


@query(
    "normalise_features",
    f"""WITH f AS ({PROPERTIES}) SELECT 'roads' AS layer, concat('roads-', i) AS fid, coalesce(nullif(trim(name), ''), 'Unnamed road') AS name, type,
  CAST(trunc(try_cast(trim(size) AS DOUBLE)) AS INT) AS size, concat('kept=', i) AS rest FROM f WHERE NOT bare""",
)
def normalise_features(spark, sf):
    rows = spark.sql(PROPERTIES.replace("VARCHAR(20)", "STRING"), part=fixture(spark, sf, "part"))
    text = F.col("i").cast("string")
    properties = F.create_map(F.lit("gid"), text, F.lit("__gid"), text, F.lit("name"), F.col("name"), F.lit("type"), F.col("type"), F.lit("size"), F.col("size"), F.lit("kept"), text)
    point = F.array(F.array(F.array(F.struct(F.col("i").cast("double").alias("x"), F.lit(0.0).alias("y")))))
    nothing = F.lit(None).cast("array<array<array<struct<x:double,y:double>>>>")
    geometry = F.struct(F.lit("Point").alias("type"), F.when(F.col("bare"), nothing).otherwise(point).alias("parts"))
    features = rows.select(F.col("i").alias("feature_idx"), properties.alias("properties"), geometry.alias("geometry"))
    out = g.normalise_features(features, "roads")
    rest = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("layer", "fid", "name", "type", "size", rest.alias("rest"))


def connected(spark, sf):
    return routing.connections(routing.compare_modes(journeys(spark, sf)), checkpoint(terrain(spark, sf)), GRID)


@query("reachable", f"WITH {RELAX} SELECT k, mode, error IS NULL AS reachable FROM zt")
def reachable(spark, sf):
    return connected(spark, sf)


@query(
    "check_connectivity",
    f"""WITH {RELAX} SELECT k, mode, k % 3 <> 0 AS expected, error IS NULL AS reachable,
  CASE WHEN (error IS NULL) = (k % 3 <> 0) THEN 'as expected' WHEN error IS NULL THEN 'reachable but should not be' ELSE 'unreachable' END AS verdict FROM zt""",
)
def check_connectivity(spark, sf):
    expected = routing.compare_modes(journeys(spark, sf)).select("k", "mode", (F.col("k") % 3 != 0).alias("expected"))
    return routing.check_connectivity(expected, connected(spark, sf))


@query("check_routes", f"WITH {RELAX} SELECT k, mode, coalesce(error, CASE WHEN days BETWEEN k % 3 AND 20 + k * 7 % 90 THEN 'ok' ELSE 'out of range' END) AS verdict FROM zt")
def check_routes(spark, sf):
    pairs, found = routes(spark, sf)
    return routing.check_routes(found, pairs.select("k", "mode", (F.col("k") % 3).alias("low"), (20 + F.col("k") * 7 % 90).alias("high")))


#: What journeys on foot would be in the other modes if all went by road: the same miles, days by speed.
SPEED = "CASE {} WHEN 'foot' THEN 20 WHEN 'horse' THEN 35 WHEN 'carriage' THEN 20 WHEN 'dragon' THEN 500 ELSE 120 END"


@query(
    "compare_fixtures",
    f"""WITH {RELAX}, wn AS (SELECT f.k, m.mode, f.miles, f.days * 20.0::DOUBLE / {SPEED.format("m.mode")} AS days FROM zt AS f JOIN (SELECT DISTINCT k, mode FROM zt) AS m ON m.k = f.k WHERE f.mode = 'foot')
  SELECT wn.k, wn.mode, coalesce((wn.days IS NULL AND zt.days IS NULL) OR (abs(zt.miles - wn.miles) <= 0.001 * abs(wn.miles) AND abs(zt.days - wn.days) <= 0.001 * abs(wn.days)), false) AS same FROM wn JOIN zt ON zt.k = wn.k AND zt.mode = wn.mode""",
)
def compare_fixtures(spark, sf):
    found = checkpoint(routes(spark, sf)[1])
    foot = found.where("mode = 'foot'").select("k", "miles", (F.col("days") * 20.0).alias("d"))
    speeds = F.create_map(*(F.lit(x) for name, m in routing.MODES.items() for x in (name, m["miles_per_day"])))
    wanted = found.select("k", "mode").join(foot, "k").select("k", "mode", "miles", (F.col("d") / speeds[F.col("mode")]).alias("days"))
    return routing.compare_fixtures(found, wanted)


def traced(spark, sf):
    pairs = routing.compare_modes(journeys(spark, sf))
    return pairs, paths.routes(pairs, checkpoint(terrain(spark, sf)), GRID, MPD, 32)


@query("route_path")
def route_path(spark, sf):
    """Each step of every journey's cell path."""
    pairs = routing.compare_modes(journeys(spark, sf))
    cells = checkpoint(terrain(spark, sf))
    ends = routing.ends_of(pairs, cells, GRID).where("ax IS NOT NULL AND bx IS NOT NULL")
    found = checkpoint(routing.search_from(ends, cells, 32))
    path = paths.route_path(ends.select("k", "mode", "origin", "ax", "ay", F.col("bx").alias("gx"), F.col("by").alias("gy")), found, cells, 32)
    return path.select("k", "mode", F.posexplode("path").alias("seq", "c")).select("k", "mode", "seq", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query("straighten_path")
def straighten_path(spark, sf):
    found = traced(spark, sf)[1]
    return found.select("k", "mode", "miles", "weighted_miles", "days", "error", F.size("path").alias("points"))


@query("ground_routes_to_features")
def ground_routes_to_features(spark, sf):
    """Every journey that is possible, in every mode, as a line of its straightened path."""
    return paths.routes_to_features(traced(spark, sf)[1])


@query("route_fixtures")
def route_fixtures(spark, sf):
    pairs, found = traced(spark, sf)
    return routing.route_fixtures(pairs.select("k", "mode", "origin", "destination").join(found, ["k", "mode"]))


@query("routes_to_features", f"WITH {J} SELECT k, 'dragon' AS mode, concat('{{{{\"type\":\"Feature\",\"properties\":{{{{\"mode\":\"dragon\",\"colour\":\"#a8323a\",\"straightLine\":true}}}},\"geometry\":{{{{\"type\":\"LineString\",\"coordinates\":[[', x1, ',', y1, '],[', x2, ',', y2, ']]}}}}}}}}') AS feature FROM jn")
def routes_to_features(spark, sf):
    j = journeys(spark, sf)
    point = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    flown = j.select("k", F.lit("dragon").alias("mode"), F.array(point("x1", "y1"), point("x2", "y2")).alias("path"), F.lit(None).cast("string").alias("error"))
    return paths.routes_to_features(flown)
