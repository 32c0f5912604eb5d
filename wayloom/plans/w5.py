"""Queries on travel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import checkpoint
from ..operators import present, routing
from .fixtures import fixture, oracle
from .w1 import MPD
from .w3 import FINE, FLOOD, GRID, recursive, terrain

QUERIES, SQL = {}, {}
J = "jn AS (SELECT CAST(row_number() OVER (ORDER BY origin, destination) AS BIGINT) AS k, * FROM {journeys})"
COST = "CASE cls WHEN 9 THEN 1.0 WHEN 2 THEN 1.45 WHEN 1 THEN 1.55 WHEN 6 THEN 2.0 WHEN 3 THEN 2.2 WHEN 4 THEN 2.4 WHEN 5 THEN 3.0 WHEN 7 THEN 3.6 END"


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = recursive(sql) if "RECURSIVE" in sql else oracle(sql)
        return f

    return keep


def journeys(spark, sf):
    j = fixture(spark, sf, "journeys")
    # the few journeys are numbered by name
    from pyspark.sql import Window

    return j.withColumn("k", F.row_number().over(Window.orderBy("origin", "destination")).cast("long"))


@query("compare_modes", f"WITH {J} SELECT k, unnest(['foot', 'horse', 'carriage', 'dragon', 'ship']) AS mode FROM jn")
def compare_modes(spark, sf):
    return routing.compare_modes(journeys(spark, sf).select("k"))


@query("fly_route", f"WITH {J} SELECT k, round(d * {MPD}, 4) AS miles, round(d * {MPD} / 500, 6) AS days FROM (SELECT k, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS d FROM jn) AS q")
def fly_route(spark, sf):
    r = routing.fly_route(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), MPD, 500.0)
    return journeys(spark, sf).select("k", r.alias("r")).select("k", F.bround("r.miles", 4).alias("miles"), F.bround("r.days", 6).alias("days"))


@query("passable", f"WITH {FLOOD} SELECT cls, mode, CASE WHEN mode = 'ship' THEN cls = 0 ELSE cls NOT IN (0, 8) AND NOT (mode = 'carriage' AND cls IN (5, 7)) END AS passable FROM (SELECT DISTINCT cls FROM land) AS c, (SELECT unnest(['foot', 'horse', 'carriage', 'ship']) AS mode) AS m")
def passable(spark, sf):
    classes = terrain(spark, sf).select("cls").distinct().withColumn("mode", F.explode(F.array(*map(F.lit, ("foot", "horse", "carriage", "ship")))))
    return classes.select("cls", "mode", routing.passable(F.col("mode"), F.col("cls")).alias("passable"))


@query("move_cost", f"WITH {FLOOD} SELECT cls, CAST({COST} * CASE WHEN cls = 9 THEN 1 ELSE 1.9 END AS DOUBLE) AS cost FROM (SELECT DISTINCT cls FROM land) AS c WHERE cls NOT IN (0, 5, 7, 8)")
def move_cost(spark, sf):
    c = terrain(spark, sf).select("cls").distinct().select("cls", routing.move_cost(F.lit("carriage"), F.col("cls")).alias("cost"))
    return c.where("cost IS NOT NULL").withColumn("cost", F.bround("cost", 9))


#: Where journeys on the ground begin and end: the first passable cell by square rings, in a ring by its top and bottom, then its sides.
OPEN = "CASE WHEN mode = 'ship' THEN cls = 0 ELSE cls NOT IN (0, 8) AND NOT (mode = 'carriage' AND cls IN (5, 7)) END"
SNAP = f"""{J}, gm AS (SELECT unnest(['foot', 'horse', 'carriage', 'ship']) AS mode),
  ge AS (SELECT k, mode, 0 AS side, CAST(trunc(x1 + 4) AS INT) AS cx, CAST(trunc(y1 + 48) AS INT) AS cy FROM jn, gm UNION ALL SELECT k, mode, 1, CAST(trunc(x2 + 4) AS INT), CAST(trunc(y2 + 48) AS INT) FROM jn, gm),
  gn AS (SELECT k, mode, side, land.cx AS sx, land.cy AS sy, land.cx - ge.cx AS dx, land.cy - ge.cy AS dy, greatest(abs(land.cx - ge.cx), abs(land.cy - ge.cy)) AS r FROM ge JOIN land ON {OPEN}),
  gs AS (SELECT k, mode, side, sx, sy FROM (SELECT *, row_number() OVER (PARTITION BY k, mode, side ORDER BY r, abs(dy) <> r, CASE WHEN abs(dy) = r THEN dx ELSE dy END, CASE WHEN abs(dy) = r THEN dy ELSE dx END) AS n
   FROM gn WHERE r <= CASE WHEN mode = 'ship' THEN 5 ELSE 24 END) AS q WHERE n = 1)"""
#: Relaxation from every start at once, by (weighted miles, miles); horses find the same ways as feet.
RELAX = f"""{FLOOD}, {SNAP}, zs AS (SELECT DISTINCT CASE a.mode WHEN 'horse' THEN 'foot' ELSE a.mode END AS mode, a.sx * 1000 + a.sy AS o, a.sx AS cx, a.sy AS cy FROM gs AS a JOIN gs AS b ON b.k = a.k AND b.mode = a.mode AND b.side = 1 WHERE a.side = 0),
  zc AS (SELECT mode, cx, cy, CASE WHEN mode = 'ship' THEN 1.0 ELSE {COST} * CASE WHEN mode = 'carriage' AND cls <> 9 THEN 1.9 ELSE 1 END END::DOUBLE AS c FROM land, gm WHERE mode <> 'horse' AND {OPEN}),
  zo AS (SELECT dx, dy, CASE WHEN dx <> 0 AND dy <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END AS d FROM (SELECT unnest([-1, 0, 1]) AS dx) AS a, (SELECT unnest([-1, 0, 1]) AS dy) AS b WHERE dx <> 0 OR dy <> 0),
  zd(mode, o, cx, cy, w, m) USING KEY (mode, o, cx, cy) AS (SELECT mode, o, cx, cy, 0.0::DOUBLE, 0.0::DOUBLE FROM zs UNION
   SELECT n.mode, n.o, n.cx, n.cy, n.wm[1], n.wm[2] FROM (SELECT zd.mode, zd.o, zc.cx, zc.cy, min([zd.w + d * c, zd.m + d]) AS wm FROM zd, zo JOIN zc ON zc.mode = zd.mode AND zc.cx = zd.cx + dx AND zc.cy = zd.cy + dy GROUP BY ALL) AS n
   LEFT JOIN recurring.zd AS old ON old.mode = n.mode AND old.o = n.o AND old.cx = n.cx AND old.cy = n.cy WHERE old.w IS NULL OR n.wm[1] < old.w OR (n.wm[1] = old.w AND n.wm[2] < old.m)),
  zt AS (SELECT jn.k, gm.mode, m * {MPD} AS miles, w * {MPD} AS weighted_miles, w * {MPD} / CASE gm.mode WHEN 'foot' THEN 20 WHEN 'horse' THEN 35 WHEN 'carriage' THEN 20 ELSE 120 END AS days,
    CASE WHEN a.sx IS NULL THEN 'unreachable-origin' WHEN b.sx IS NULL THEN 'unreachable-destination' WHEN w IS NULL THEN 'no-route' END AS error FROM jn CROSS JOIN gm
    LEFT JOIN gs AS a ON a.k = jn.k AND a.mode = gm.mode AND a.side = 0 LEFT JOIN gs AS b ON b.k = jn.k AND b.mode = gm.mode AND b.side = 1
    LEFT JOIN zd ON zd.mode = CASE gm.mode WHEN 'horse' THEN 'foot' ELSE gm.mode END AND zd.o = a.sx * 1000 + a.sy AND zd.cx = b.sx AND zd.cy = b.sy
   UNION ALL SELECT k, 'dragon', d * {MPD}, d * {MPD}, d * {MPD} / 500, NULL FROM (SELECT k, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS d FROM jn) AS q)"""


def routes(spark, sf, size=64):
    pairs = routing.compare_modes(journeys(spark, sf))
    return pairs, routing.shortest_days(pairs, checkpoint(terrain(spark, sf)), GRID, MPD, size)


@query("shortest_days", f"WITH {RELAX} SELECT k, mode, round(miles, 5) AS miles, round(weighted_miles, 5) AS weighted_miles, round(days, 6) AS days, error FROM zt")
def shortest_days(spark, sf):
    found = routes(spark, sf)[1]
    return found.select("k", "mode", F.bround("miles", 5).alias("miles"), F.bround("weighted_miles", 5).alias("weighted_miles"), F.bround("days", 6).alias("days"), "error")


@query("shortest_days_fine")
def shortest_days_fine(spark, sf):
    """All journeys in all modes on cells of an eighth of a degree; tests hold the search against a plain one."""
    return routing.shortest_days(routing.compare_modes(journeys(spark, sf)), checkpoint(terrain(spark, sf, FINE)), FINE, MPD)


@query(
    "rank_modes",
    f"""WITH {RELAX} SELECT k, mode, origin, destination, round(days, 6) AS days, error, CAST(row_number() OVER (PARTITION BY origin, destination ORDER BY error IS NOT NULL, round(days, 6), mode) AS INT) AS rank FROM zt JOIN jn USING (k)""",
)
def rank_modes(spark, sf):
    pairs, found = routes(spark, sf)
    named = pairs.select("k", "mode", "origin", "destination").join(found, ["k", "mode"])
    return present.rank_modes(named.select("k", "mode", "origin", "destination", F.bround("days", 6).alias("days"), "error"))


@query(
    "snap_cell",
    f"WITH {FLOOD}, {SNAP} SELECT ge.k, ge.mode, ge.cx, ge.cy, sx, sy FROM ge LEFT JOIN gs ON gs.k = ge.k AND gs.mode = ge.mode AND gs.side = 0 WHERE ge.side = 0",
)
def snap_cell(spark, sf):
    from ..functions.geo import cell_of

    ends = routing.compare_modes(journeys(spark, sf)).where("mode <> 'dragon'")
    ends = ends.select("k", "mode", cell_of(F.col("x1"), GRID.min_lon, GRID.cell, GRID.width).alias("cx"), cell_of(F.col("y1"), GRID.min_lat, GRID.cell, GRID.height).alias("cy"))
    return routing.snap_cell(ends, checkpoint(terrain(spark, sf)))
