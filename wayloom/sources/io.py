"""Reading map layers, settings and wiki pages; writing products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "name string, type string, size int, confirmed int, lon double, lat double"
MODE = "label string, milesPerDay double, offRoadPenalty double, impassable array<string>, flies boolean, sails boolean, note string"


def read_features(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(layer, feature_idx, properties, geometry) of a feature collection in JSON, in input order.

    Coordinates are read as text, as their depth depends on the type, and brought to parts, rings and points.
    """
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("feature_idx", "f"))
    c, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    point = F.array(F.array(F.array(F.from_json(c, "array<double>"))))
    line = F.array(F.array(F.from_json(c, "array<array<double>>")))
    several = F.transform(F.from_json(c, "array<array<array<double>>>"), lambda x: F.array(x))
    polygon = F.array(F.from_json(c, "array<array<array<double>>>"))
    many = F.from_json(c, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Point", point).when(kind == "LineString", line).when(kind == "MultiLineString", several).when(kind == "Polygon", polygon).when(kind == "MultiPolygon", many)
    named = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))))
    return f.select(F.lit(layer).alias("layer"), "feature_idx", F.col("f.properties").alias("properties"), F.struct(kind.alias("type"), named.alias("parts")).alias("geometry"))


def read_places_patch(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made places with their defaults: type Other, size 3, confirmed, source custom."""
    rows = spark.read.schema(f"places array<struct<{PLACE.replace(' string', ': string').replace(' int', ': int').replace(' double', ': double')}>>").json(path, multiLine=True)
    p = rows.select(F.posexplode("places").alias("i", "p")).select("i", "p.*")
    return p.select(
        F.concat(F.lit("custom-"), F.col("i").cast("string")).alias("fid"), F.col("i").alias("place_idx"), "name", F.coalesce("type", F.lit("Other")).alias("type"),
        F.coalesce("size", F.lit(3)).alias("size"), F.coalesce("confirmed", F.lit(1)).alias("confirmed"), "lon", "lat", F.lit("custom").alias("source"),
    )


def read_modes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Modes of travel and costs of terrain from a settings file {modes: {...}, terrainCost: {...}}."""
    fields = ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in MODE.split(", ")))
    raw = spark.read.schema(f"modes map<string, struct<{fields}>>, terrainCost map<string, double>").json(path, multiLine=True)
    m = raw.select(F.explode("modes").alias("mode", "m")).select("mode", "m.*")
    m = m.withColumns({
        "offRoadPenalty": F.coalesce("offRoadPenalty", F.lit(1.0)), "impassable": F.coalesce("impassable", F.array().cast("array<string>")),
        "flies": F.coalesce("flies", F.lit(False)), "sails": F.coalesce("sails", F.lit(False)),
    })
    return m, raw.select(F.explode("terrainCost").alias("cls", "cost"))


def write_revisions(revisions: DataFrame, path: str) -> None:
    """A page export in compressed XML from (title, rev_no, text).

    A page may come in any number of elements, each of which says which revision it holds: no page has to fit into one
    row, and texts stay where they are.
    """
    element = revisions.select("title", F.col("rev_no").alias("first"), F.array(F.struct(F.struct(F.col("text").alias("_VALUE")).alias("text"))).alias("revision"))
    element.write.format("xml").option("rootTag", "export").option("rowTag", "page").option("compression", "gzip").save(path)


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """(title, rev_no, text) from a page export in XML; revisions are numbered in the order of the document.

    An element that holds a later piece of its page says in first what number its first revision has.
    """
    schema = "title string, first long, revision array<struct<text: struct<_VALUE: string>>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    number = F.coalesce("first", F.lit(0)) + F.col("at")
    return pages.select("title", "first", F.posexplode("revision").alias("at", "r")).select("title", number.cast("long").alias("rev_no"), F.coalesce("r.text._VALUE", F.lit("")).alias("text"))


def read_page_cache(spark: SparkSession, path: str) -> DataFrame:
    """(wiki, slug, found, title, wikitext) from files wiki/slug.json."""
    pages = spark.read.schema("found boolean, title string, wikitext string").json(path, multiLine=True, recursiveFileLookup=True)
    file = F.col("_metadata.file_path")
    return pages.select(F.regexp_extract(file, r"([^/]+)/[^/]+\.json$", 1).alias("wiki"), F.regexp_extract(file, r"([^/]+)\.json$", 1).alias("slug"), "found", "title", "wikitext")


def write_product(df: DataFrame, path: str, by: tuple[str, ...] = (), form: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_terrain(cells: DataFrame, path: str, rows_per_file_group: int = 256) -> None:
    """One row a grid row: its classes as bytes from west to east, south first, in folders of neighbouring rows."""
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cx", "cls"))), lambda c: F.lpad(F.hex(c["cls"]), 2, "0")), "")
    packed = cells.groupBy("cy").agg(F.unhex(row).alias("classes"))
    write_product(packed.withColumn("block", F.floor(F.col("cy") / rows_per_file_group)), path, ("block",))


def write_tiles(tiles: DataFrame, path: str) -> DataFrame:
    """Tiles (z, tx, ty, rgb) in folders by zoom; returns the one-row summary of the pyramid."""
    write_product(tiles, path, ("z",))
    written = tiles.sparkSession.read.parquet(path)
    return written.agg(F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"), F.count("*").alias("tiles"))
