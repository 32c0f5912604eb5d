"""Queries on places, polygons and scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import gazetteer as g
from ..operators import joins
from .fixtures import fixture, oracle

MPD = 64.9346
QUERIES, SQL = {}, {}
#: The ray cast of joins.pip_pairs as SQL; r: rings with an odd number of crossings.
EDGES = """edges AS (SELECT layer, fid, feature_idx, part, ring, x AS x1, y AS y1,
  lead(x) OVER (PARTITION BY layer, fid, part, ring ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY layer, fid, part, ring ORDER BY seq) AS y2 FROM {polygons})"""
PAIRS = f"""{EDGES}, r AS (SELECT k, layer, fid, feature_idx, part, ring FROM pts JOIN edges ON x2 IS NOT NULL AND (y1 > y) <> (y2 > y)
  AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
  pairs AS (SELECT DISTINCT k, layer, fid, feature_idx FROM (SELECT k, layer, fid, feature_idx, part FROM r GROUP BY ALL
  HAVING bool_or(ring = 0) AND NOT bool_or(ring > 0)) AS q)"""
PLACE_POINTS = "pts AS (SELECT place_idx AS k, lon AS x, lat AS y FROM {places})"
FEATURES = "feats AS (SELECT DISTINCT layer, fid, feature_idx, name, type, claimedby FROM {polygons} UNION ALL SELECT DISTINCT layer, fid, feature_idx, name, type, claimedby FROM {roads})"
NEAREST = """SELECT k, fid, feature_idx, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM (SELECT k, x AS px, y AS py FROM pts) AS p, (SELECT fid, feature_idx, x, y FROM {%s}) AS v"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return keep


def features(spark, sf):
    """All layers as features with geometries, from the vertex fixtures."""
    vertices = fixture(spark, sf, "polygons").unionByName(fixture(spark, sf, "roads").where("x IS NOT NULL"))
    keys = ["layer", "fid", "feature_idx", "name", "type", "claimedby"]
    return geo.assemble(vertices, keys, F.when(F.col("layer") == "roads", "LineString").otherwise("Polygon"))


def attributes(df):
    return df.select("layer", "fid", "feature_idx", "name", "type", "claimedby")


def polygon_edges(spark, sf):
    return geo.explode_edges(features(spark, sf).where("layer <> 'roads'"), ["layer", "fid", "feature_idx"])


def place_points(spark, sf):
    return fixture(spark, sf, "places").select(F.col("place_idx").alias("k"), F.col("lon").alias("x"), F.col("lat").alias("y"))


def gazetteer(spark, sf):
    f = features(spark, sf)
    keys = ["layer", "fid", "feature_idx"]
    return g.build_gazetteer(fixture(spark, sf, "places"), attributes(f), geo.explode_edges(f.where("layer <> 'roads'"), keys), geo.explode_vertices(f, keys), MPD)


@query("explode_vertices", "SELECT layer, fid, part, ring, seq, x, y FROM {polygons}")
def explode_vertices(spark, sf):
    return geo.explode_vertices(features(spark, sf).where("layer <> 'roads'"), ["layer", "fid"]).select("layer", "fid", "part", "ring", "seq", "x", "y")


@query("explode_edges", f"WITH {EDGES} SELECT layer, fid, part, ring, x1, y1, x2, y2 FROM edges WHERE x2 IS NOT NULL")
def explode_edges(spark, sf):
    return polygon_edges(spark, sf).select("layer", "fid", "part", "ring", "x1", "y1", "x2", "y2")


@query("bbox", "SELECT layer, fid, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM {polygons} GROUP BY layer, fid")
def bbox(spark, sf):
    f = features(spark, sf).where("layer <> 'roads'")
    return f.select("layer", "fid", geo.bbox(F.col("geometry")).alias("b")).select("layer", "fid", "b.*")


@query("drop_unnamed", "SELECT DISTINCT layer, fid, name FROM {polygons} WHERE name IS NOT NULL AND name <> ''")
def drop_unnamed(spark, sf):
    return g.drop_unnamed(fixture(spark, sf, "polygons")).select("layer", "fid", "name").distinct()


@query("planar_miles", f"SELECT k, round(sqrt((x - 10) * (x - 10) + (y - 5) * (y - 5)) * {MPD}, 4) AS miles FROM {{points}}")
def planar_miles(spark, sf):
    p = fixture(spark, sf, "points")
    return p.select("k", F.bround(geo.planar_miles(F.lit(10.0), F.lit(5.0), F.col("x"), F.col("y"), MPD), 4).alias("miles"))


@query(
    "line_length_miles",
    f"""SELECT fid, round(coalesce(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 0) * {MPD}, 4) AS miles FROM (SELECT fid, x, y,
  lead(x) OVER (PARTITION BY fid ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY fid ORDER BY seq) AS y2 FROM {{roads}}) AS t GROUP BY fid""",
)
def line_length_miles(spark, sf):
    roads = features(spark, sf).where("layer = 'roads'")
    return roads.select("fid", F.bround(geo.line_length_miles(F.col("geometry"), MPD), 4).alias("miles"))


@query("pip_pairs", f"WITH pts AS (SELECT k, x, y FROM {{points}}), {PAIRS} SELECT k, layer, fid FROM pairs")
def pip_pairs(spark, sf):
    return joins.pip_pairs(fixture(spark, sf, "points"), polygon_edges(spark, sf)).select("k", "layer", "fid")


@query("pip_first", f"WITH pts AS (SELECT k, x, y FROM {{points}}), {PAIRS} SELECT k, layer, arg_min(fid, feature_idx) AS fid FROM pairs GROUP BY k, layer")
def pip_first(spark, sf):
    pairs = joins.pip_pairs(fixture(spark, sf, "points"), polygon_edges(spark, sf))
    return joins.pip_first(pairs, attributes(features(spark, sf))).select("k", "layer", "fid")


@query(
    "pip_all_names",
    f"""WITH {PLACE_POINTS}, {PAIRS}, {FEATURES} SELECT k, array_to_string(list_sort(list(DISTINCT name)), '|') AS found
  FROM pairs JOIN feats USING (layer, fid) WHERE layer = 'regions' GROUP BY k""",
)
def pip_all_names(spark, sf):
    pairs = joins.pip_pairs(place_points(spark, sf), polygon_edges(spark, sf)).where("layer = 'regions'")
    return joins.pip_all_names(pairs, attributes(features(spark, sf)), "name").select("k", F.array_join("found", "|").alias("found"))


@query(
    "nearest_vertex",
    f"WITH {PLACE_POINTS}, n AS ({NEAREST % 'roads'}) SELECT k, arg_min(fid, (d, feature_idx)) AS fid, round(min(d), 6) AS degrees FROM n GROUP BY k",
)
def nearest_vertex(spark, sf):
    near = joins.nearest_vertex(place_points(spark, sf), fixture(spark, sf, "roads"))
    return near.select("k", "fid", F.bround("degrees", 6).alias("degrees"))


@query(
    "coast_snap",
    f"""WITH pts AS (SELECT k, x, y FROM {{points}}), {PAIRS}, n AS ({NEAREST % 'continents'}) SELECT k, arg_min(fid, (d, feature_idx)) AS fid, round(min(d) * {MPD}, 3) AS miles FROM n
  WHERE d * {MPD} <= 120 AND k NOT IN (SELECT k FROM pairs WHERE layer IN ('continents', 'islands')) GROUP BY k""",
)
def coast_snap(spark, sf):
    points = fixture(spark, sf, "points")
    pairs = joins.pip_pairs(points, polygon_edges(spark, sf).where("layer IN ('continents', 'islands')"))
    near = g.coast_snap(points.join(pairs, "k", "left_anti"), fixture(spark, sf, "continents"), MPD)
    return near.select("k", "fid", F.bround("miles", 3).alias("miles"))


#: The gazetteer in SQL, without slugs.
GAZETTEER = f"""{PLACE_POINTS}, {PAIRS}, {FEATURES},
 fst AS (SELECT k, layer, arg_min(fid, feature_idx) AS fid FROM pairs GROUP BY k, layer),
 nam AS (SELECT k, layer, name, claimedby FROM fst JOIN feats USING (layer, fid)),
 poly AS (SELECT k, max(name) FILTER (layer = 'continents') AS polygon, max(name) FILTER (layer = 'islands') AS island,
  max(name) FILTER (layer = 'political') AS politicalRegion, max(claimedby) FILTER (layer = 'political') AS claimedBy FROM nam GROUP BY k),
 reg AS (SELECT k, array_to_string(list_sort(list(DISTINCT name)), '|') AS regions FROM pairs JOIN feats USING (layer, fid) WHERE layer = 'regions' GROUP BY k),
 ter AS (SELECT k, array_to_string(list_sort(list(DISTINCT type)), '|') AS terrain FROM pairs JOIN feats USING (layer, fid) WHERE layer = 'landscape' GROUP BY k),
 rd AS (SELECT k, arg_min(fid, (d, feature_idx)) AS fid, round(min(d) * {MPD}, 1) AS milesToRoad FROM ({NEAREST % 'roads'}) AS n GROUP BY k),
 cst AS (SELECT k, arg_min(fid, (d, feature_idx)) AS fid FROM ({NEAREST % 'continents'}) AS n WHERE d * {MPD} <= 120
  AND k NOT IN (SELECT k FROM pairs WHERE layer IN ('continents', 'islands')) GROUP BY k),
 gaz AS (SELECT p.place_idx, p.name, coalesce(p.type, 'Other') AS type, p.size, p.confirmed = 1 AS confirmed, p.lon, p.lat,
  coalesce(polygon, island, c.name) AS continent,
  CASE WHEN polygon IS NOT NULL THEN 'polygon' WHEN island IS NOT NULL THEN 'island' WHEN c.name IS NOT NULL THEN 'coast-snap' END AS continentSource,
  island, politicalRegion, poly.claimedBy, coalesce(regions, '') AS regions, coalesce(terrain, '') AS terrain, r.name AS nearestRoad, milesToRoad
  FROM {{places}} AS p LEFT JOIN poly ON poly.k = p.place_idx LEFT JOIN reg ON reg.k = p.place_idx LEFT JOIN ter ON ter.k = p.place_idx
  LEFT JOIN rd ON rd.k = p.place_idx LEFT JOIN feats AS r ON r.layer = 'roads' AND r.fid = rd.fid
  LEFT JOIN cst ON cst.k = p.place_idx LEFT JOIN feats AS c ON c.layer = 'continents' AND c.fid = cst.fid)"""


@query("build_gazetteer", f"WITH {GAZETTEER} SELECT *, 'map' AS source FROM gaz")
def build_gazetteer(spark, sf):
    lists = {c: F.array_join(c, "|") for c in ("regions", "terrain")}
    return gazetteer(spark, sf).withColumns(lists).drop("slug")


@query("resolve_continent", f"WITH {GAZETTEER} SELECT place_idx, continent, continentSource FROM gaz")
def resolve_continent(spark, sf):
    return gazetteer(spark, sf).select("place_idx", "continent", "continentSource")


@query(
    "gazetteer_summary",
    f"""WITH {GAZETTEER} SELECT 'type' AS measure, type AS key, count(*) AS n FROM gaz GROUP BY type
  UNION ALL SELECT 'continent', coalesce(continent, 'unplaced'), count(*) FROM gaz GROUP BY continent
  UNION ALL SELECT 'near road', '< 15 miles', count(*) FILTER (milesToRoad < 15) FROM gaz""",
)
def gazetteer_summary(spark, sf):
    return g.gazetteer_summary(gazetteer(spark, sf))


@query("places_by_continent_and_type", f"WITH {GAZETTEER} SELECT continent, type, count(*) AS n, grouping_id(continent, type) AS level FROM gaz GROUP BY ROLLUP (continent, type)")
def places_by_continent_and_type(spark, sf):
    return g.places_by_continent_and_type(gazetteer(spark, sf))


@query("places_by_realm", f"WITH {GAZETTEER} SELECT coalesce(politicalRegion, 'outside any realm') AS realm, coalesce(claimedBy, '') AS holder, count(*) AS n FROM gaz GROUP BY ALL")
def places_by_realm(spark, sf):
    return g.places_by_realm(gazetteer(spark, sf))


@query("confirmed_share", f"WITH {GAZETTEER} SELECT count(*) AS places, count(*) FILTER (confirmed) AS confirmed, round(100.0::DOUBLE * count(*) FILTER (confirmed) / count(*), 2) AS percent FROM gaz")
def confirmed_share(spark, sf):
    return g.confirmed_share(gazetteer(spark, sf))


@query("sort_gazetteer", f"WITH {GAZETTEER} SELECT place_idx, name, size FROM gaz ORDER BY size DESC, name, place_idx")
def sort_gazetteer(spark, sf):
    return g.sort_gazetteer(gazetteer(spark, sf)).select("place_idx", "name", "size")


SLUG = "coalesce(nullif(lower(trim(regexp_replace(regexp_replace(strip_accents(coalesce(name, '')), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'unnamed')"


@query("slugify", f"SELECT place_idx, {SLUG} AS slug FROM {{many_places}}")
def slugify(spark, sf):
    return fixture(spark, sf, "many_places").select("place_idx", text.slugify(F.col("name")).alias("slug"))


@query(
    "dedupe_slugs",
    f"""SELECT place_idx, CASE WHEN n > 1 THEN concat(s, '-', n) ELSE s END AS slug FROM (SELECT place_idx, s,
  row_number() OVER (PARTITION BY s ORDER BY place_idx) AS n FROM (SELECT place_idx, {SLUG} AS s FROM {{many_places}}) AS a) AS b""",
)
def dedupe_slugs(spark, sf):
    return g.dedupe_slugs(fixture(spark, sf, "many_places")).select("place_idx", "slug")


@query("coerce_int", "SELECT p_partkey, CAST(trunc(p_retailprice) AS INT) AS n FROM {part}")
def coerce_int(spark, sf):
    return fixture(spark, sf, "part").select("p_partkey", text.coerce_int(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).alias("n"))


ANCHORS = "SELECT c_custkey AS label, CAST(1 + c_custkey % 97 AS DOUBLE) AS degrees, CAST(60 + (1 + c_custkey % 97) * 65 + c_custkey % 13 AS DOUBLE) AS canon_miles, CAST(1 + c_custkey % 3 AS DOUBLE) AS weight FROM {customer}"


def anchors(spark, sf):
    k = F.col("c_custkey")
    return fixture(spark, sf, "customer").select(
        k.alias("label"), (1 + k % 97).cast("double").alias("degrees"), (60 + (1 + k % 97) * 65 + k % 13).cast("double").alias("canon_miles"), (1 + k % 3).cast("double").alias("weight")
    )


@query("fit_scale", f"SELECT round(sum(weight * degrees * canon_miles) / sum(weight * degrees * degrees), 6) AS milesPerDegree FROM ({ANCHORS}) AS a")
def fit_scale(spark, sf):
    return g.fit_scale(anchors(spark, sf)).select(F.bround("milesPerDegree", 6).alias("milesPerDegree"))


@query(
    "scale_report",
    f"""WITH a AS ({ANCHORS}), f AS (SELECT sum(weight * degrees * canon_miles) / sum(weight * degrees * degrees) AS m FROM a),
  e AS (SELECT *, degrees * m AS fit, 100 * (degrees * m - canon_miles) / canon_miles AS err FROM a, f)
  SELECT label, degrees, canon_miles, weight, round(fit, 1) AS fittedMiles, round(err, 1) AS errorPct, (SELECT round(max(abs(err)), 1) FROM e) AS worstErrorPct FROM e""",
)
def scale_report(spark, sf):
    return g.scale_report(anchors(spark, sf))


@query(
    "anchor_degrees",
    """WITH l AS (SELECT fid AS label, coalesce(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 0) AS d, avg(y) AS m FROM (SELECT fid, x, y,
  lead(x) OVER (PARTITION BY fid ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY fid ORDER BY seq) AS y2 FROM {roads}) AS t GROUP BY fid),
  p AS (SELECT name, arg_max(lon, place_idx) AS x, arg_max(lat, place_idx) AS y FROM {many_places} GROUP BY name)
  SELECT label, round(d, 6) AS degrees FROM l UNION ALL SELECT concat(label, ' north'), round(m + 43, 6) FROM l
  UNION ALL SELECT concat(a.name, ' to ', b.name), round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) FROM p AS a JOIN p AS b ON a.name < b.name AND left(a.name, 2) = left(b.name, 2)""",
)
def anchor_degrees(spark, sf):
    roads = features(spark, sf).where("layer = 'roads'").select(F.col("fid").alias("label"), "geometry")
    south = F.lit(None).cast("string")
    corner = F.array(F.array(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(-43.0).alias("y")))))
    bays = roads.select(F.concat("label", F.lit(" north")).alias("label"), "geometry", F.struct(south.alias("type"), corner.alias("parts")).alias("region"))
    places = fixture(spark, sf, "many_places")
    names = places.select("name").distinct()
    a, b = names.select(F.col("name").alias("a"), F.left("name", F.lit(2)).alias("h")), names.select(F.col("name").alias("b"), F.left("name", F.lit(2)).alias("h"))
    pairs = a.join(b, "h").where("a < b").select(F.concat("a", F.lit(" to "), "b").alias("label"), "a", "b")
    out = g.anchor_degrees(roads, bays, pairs, places)
    return out.select("label", F.bround("degrees", 6).alias("degrees"))
