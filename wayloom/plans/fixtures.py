"""Geometry, wiki text and routes made from the star-schema tables, as SQL that Spark and DuckDB both read.

Only whole numbers are computed before one cast and one division, so both give the same doubles. {name} stands for a
table or for another fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

#: Shapes as (shape, part, ring, seq, dx, dy): a square, a concave L, and a square with a hole.
SHAPES = """(VALUES
 (0,0,0,0,-11,-11),(0,0,0,1,11,-11),(0,0,0,2,11,11),(0,0,0,3,-11,11),(0,0,0,4,-11,-11),
 (1,0,0,0,-8,-8),(1,0,0,1,8,-8),(1,0,0,2,8,0),(1,0,0,3,0,0),(1,0,0,4,0,8),(1,0,0,5,-8,8),(1,0,0,6,-8,-8),
 (2,0,0,0,-10,-10),(2,0,0,1,10,-10),(2,0,0,2,10,10),(2,0,0,3,-10,10),(2,0,0,4,-10,-10),
 (2,0,1,0,-4,-4),(2,0,1,1,4,-4),(2,0,1,2,4,4),(2,0,1,3,-4,4),(2,0,1,4,-4,-4)
) AS s(shape, part, ring, seq, dx, dy)"""

#: The place formulas for a key column k.
LON = "CAST((k * 7919 + CAST(floor(CAST(k AS DOUBLE) / 9000) AS BIGINT) * 37) % 9000 AS DOUBLE) / 100"
LAT = "CAST((k * 104729) % 9000 - 4300 AS DOUBLE) / 100"


def _places(name: str, key: str, table: str, first: int) -> str:
    return f"""SELECT {first} + k AS place_idx, name, CASE k % 6 WHEN 0 THEN 'City' WHEN 1 THEN 'Town' WHEN 2 THEN 'Castle'
  WHEN 3 THEN 'Ruin' WHEN 4 THEN NULL ELSE 'Village' END AS type, CAST(1 + k % 5 AS INT) AS size,
  CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END AS confirmed, {LON} AS lon, {LAT} AS lat, 'map' AS source
  FROM (SELECT CAST({key} AS BIGINT) AS k, {name} AS name FROM {{{table}}}) AS t"""


#: Layers of polygons: (layer, fid, feature_idx, name, type, claimedby, part, ring, seq, x, y).
_POLYGON = """SELECT '{layer}' AS layer, concat('{layer}-', CAST(i AS VARCHAR(9))) AS fid, i AS feature_idx, {name} AS name, {type} AS type,
  concat('House ', CAST(i % 7 AS VARCHAR(9))) AS claimedby, part, ring, seq, CAST(cx + {dx} + dx AS DOUBLE) AS x, CAST(cy + {dy} + dy AS DOUBLE) AS y
  FROM (SELECT n_nationkey AS i, n_name AS n, 9 + 18 * (n_nationkey % 5) AS cx, -34 + 18 * CAST(floor(n_nationkey / 5) AS INT) AS cy FROM {{nation}}) AS f
  JOIN {shapes} ON s.shape = i % 3 WHERE {keep}"""


def _layer(layer: str, name: str = "n", type: str = "NULL", shift: int = 0, keep: str = "1 = 1") -> str:
    return _POLYGON.format(layer=layer, name=name, type=type, dx=shift, dy=shift, shapes=SHAPES, keep=keep)


FIXTURES = {
    "places": _places("s_name", "s_suppkey", "supplier", 0),
    "many_places": _places("p_name", "p_partkey", "part", 0),
    "points": f"SELECT k, {LON} AS x, {LAT} AS y FROM (SELECT DISTINCT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS k FROM {{lineitem}}) AS t",
    "political": _layer("political"),
    "continents": _layer("continents", "concat('Land ', CAST(i % 4 AS VARCHAR(9)))", keep="i % 4 <> 3"),
    "islands": _layer("islands", "concat('Isle of ', n)", keep="i % 4 = 3 AND i % 8 = 3"),
    "regions": _layer("regions", type="CASE i % 4 WHEN 0 THEN 'Forest' WHEN 1 THEN 'Mountain' WHEN 2 THEN 'Desert' ELSE 'Water' END", shift=3),
    "landscape": _layer("landscape", "CASE WHEN i % 5 = 0 THEN NULL ELSE n END", "CASE i % 4 WHEN 0 THEN 'forest' WHEN 1 THEN 'mountain' WHEN 2 THEN 'swamp' ELSE 'stepp' END", shift=-2),
    "lakes": _layer("lakes", keep="i % 6 = 2"),
    "polygons": "SELECT * FROM {political} UNION ALL SELECT * FROM {continents} UNION ALL SELECT * FROM {islands} UNION ALL SELECT * FROM {regions} UNION ALL SELECT * FROM {landscape}",
    "roads": f"""SELECT 'roads' AS layer, concat('roads-', CAST(f AS VARCHAR(9))) AS fid, f AS feature_idx,
  CASE WHEN f % 3 = 0 THEN NULL ELSE concat('Road ', CAST(f AS VARCHAR(9))) END AS name, CAST(NULL AS VARCHAR(9)) AS type, CAST(NULL AS VARCHAR(9)) AS claimedby,
  0 AS part, 0 AS ring, CAST(row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS INT) AS seq, {LON} AS x, {LAT} AS y
  FROM (SELECT s_nationkey AS f, CAST(s_suppkey AS BIGINT) AS k FROM {{supplier}}) AS t""",
    "journeys": """SELECT a.n_name AS origin, b.n_name AS destination, CAST(9 + 18 * (a.n_nationkey % 5) AS DOUBLE) AS x1, CAST(-34 + 18 * CAST(floor(a.n_nationkey / 5) AS INT) AS DOUBLE) AS y1,
  CAST(9 + 18 * (b.n_nationkey % 5) AS DOUBLE) AS x2, CAST(-34 + 18 * CAST(floor(b.n_nationkey / 5) AS INT) AS DOUBLE) AS y2
  FROM {nation} AS a JOIN {nation} AS b ON a.n_nationkey < b.n_nationkey AND (a.n_nationkey * 7 + b.n_nationkey) % 11 = 0""",
    "revisions": """SELECT concat('Customer#', CAST(user_id AS VARCHAR(20))) AS title, event_id AS rev_no, ts,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE concat(event_type, ' ', CAST(event_id AS VARCHAR(20)), ': ', coalesce(d.text, '')) END AS text
  FROM {events} AS e LEFT JOIN {documents} AS d ON d.doc_id = e.event_id % (SELECT count(*) FROM {documents})""",
    "articles": """SELECT conv_id, turn, role, text FROM {conversations}""",
}


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def oracle(sql: str) -> str:
    """SQL for DuckDB in which every fixture that sql names stands as a common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name in FIXTURES and name not in order:
                visit(FIXTURES[name])
                order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{n} AS ({plain(FIXTURES[n])})" for n in order)
    body = plain(sql).strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name]
    used = {n: fixture(spark, sf_dir, n) for n in _names(sql)}
    return spark.sql(sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), **used)
