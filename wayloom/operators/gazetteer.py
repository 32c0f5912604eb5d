"""From map features to a gazetteer of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import flat_points, line_degrees
from ..functions.scan import running
from ..functions.text import coerce_int, slugify
from .joins import nearest_vertex, pip_all_names, pip_first, pip_pairs

#: How far off the coast a place may lie, and a name that the map misspells.
SNAP_MILES = 120.0
NAME_FIXES = {"Sothyrios": "Sothoryos"}
#: The order of a gazetteer record.
COLUMNS = "slug name type size confirmed source lon lat continent continentSource island politicalRegion claimedBy regions terrain nearestRoad milesToRoad".split()


def drop_null_geometry(features: DataFrame) -> DataFrame:
    """Features with a type and coordinates; the others' indexes stay unused."""
    return features.where(F.col("geometry.type").isNotNull() & (F.size("geometry.parts") > 0))


def drop_bookkeeping(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, _: ~k.isin("gid", "__gid"))


def normalise_features(features: DataFrame, layer: str, int_fields: tuple[str, ...] = ("size", "confirmed")) -> DataFrame:
    """Attributes out of the property map, whole numbers coerced, roads named, and a slug for what has a name."""
    p = drop_bookkeeping(F.col("properties"))
    text = lambda name: F.nullif(F.trim(F.element_at(p, name)), F.lit(""))
    name = F.coalesce(text("name"), F.lit("Unnamed road")) if layer == "roads" else text("name")
    rest = F.map_filter(p, lambda k, _: ~k.isin("name", "type", "continent", "claimedby", *int_fields))
    out = drop_null_geometry(features).select(
        F.lit(layer).alias("layer"), F.concat(F.lit(f"{layer}-"), F.col("feature_idx").cast("string")).alias("fid"), "feature_idx",
        name.alias("name"), text("type").alias("type"), *(coerce_int(F.element_at(p, f)).alias(f) for f in int_fields),
        text("continent").alias("continent"), text("claimedby").alias("claimedby"), rest.alias("properties"), "geometry",
    )
    return out.withColumn("slug", F.when(F.col("name").isNotNull(), slugify(F.col("name"))))


def append_patches(features: DataFrame, patches: DataFrame) -> DataFrame:
    """Hand-written places after those of the map; columns that one side lacks are null."""
    return features.unionByName(patches, allowMissingColumns=True)


def drop_unnamed(features: DataFrame) -> DataFrame:
    return features.where("name IS NOT NULL AND name <> ''")


def dedupe_slugs(places: DataFrame) -> DataFrame:
    """Adds slug: the n-th place with a slug, in input order, gets '-n' from the second on.

    Places are numbered over sorted ranges, so a slug that very many share, such as that of the unnamed, is no hot group.
    """
    named = running(places.withColumn("slug", slugify(F.col("name"))), ["slug"], [F.col("place_idx")], {"__at": F.lit(1)})
    slug = F.when(F.col("__at") > 1, F.concat("slug", F.lit("-"), F.col("__at").cast("string"))).otherwise(F.col("slug"))
    return named.withColumn("slug", slug).drop("__at", "__at_total")


def resolve_continent(found: DataFrame) -> DataFrame:
    """Adds continent and continentSource from the columns polygon, island and coast, in that order of trust."""
    fixed = F.col("island")
    for wrong, right in NAME_FIXES.items():
        fixed = F.when(F.col("island") == wrong, right).otherwise(fixed)
    source = F.when(F.col("polygon").isNotNull(), "polygon").when(F.col("island").isNotNull(), "island").when(F.col("coast").isNotNull(), "coast-snap")
    return found.withColumn("continent", F.coalesce("polygon", fixed, "coast")).withColumn("continentSource", source)


def coast_snap(points: DataFrame, vertices: DataFrame, miles_per_degree: float, miles: float = SNAP_MILES) -> DataFrame:
    """(k, fid, miles) of the nearest coast vertex within range of points without a continent."""
    near = nearest_vertex(points, vertices, most=miles / miles_per_degree)
    return near.select("k", "fid", "feature_idx", (F.col("degrees") * miles_per_degree).alias("miles"))


def build_gazetteer(places: DataFrame, features: DataFrame, edges: DataFrame, vertices: DataFrame, miles_per_degree: float) -> DataFrame:
    """The gazetteer of places: COLUMNS and place_idx.

    features: layer, fid, feature_idx, name, type, claimedby; edges and vertices carry layer and fid. One pass joins
    the places with the polygons of all layers.
    """
    named = dedupe_slugs(drop_unnamed(places))
    points = named.select(F.col("place_idx").alias("k"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    pairs = pip_pairs(points, edges)
    first = pip_first(pairs, features)
    by_layer = first.groupBy("k").agg(
        F.max(F.when(F.col("layer") == "continents", F.col("name"))).alias("polygon"),
        F.max(F.when(F.col("layer") == "islands", F.col("name"))).alias("island"),
        F.max(F.when(F.col("layer") == "political", F.col("name"))).alias("politicalRegion"),
        F.max(F.when(F.col("layer") == "political", F.col("claimedby"))).alias("claimedBy"),
    )
    regions = pip_all_names(pairs.where("layer = 'regions'"), features, "name").withColumnRenamed("found", "regions")
    terrain = pip_all_names(pairs.where("layer = 'landscape'"), features, "type").withColumnRenamed("found", "terrain")
    homeless = points.join(by_layer.where("polygon IS NOT NULL OR island IS NOT NULL"), "k", "left_anti")
    names = features.where("layer = 'continents'").select("fid", F.col("name").alias("coast"))
    coast = coast_snap(homeless, vertices.where("layer = 'continents'"), miles_per_degree).join(names, "fid").select("k", "coast")
    road_names = features.where("layer = 'roads'").select("fid", F.col("name").alias("nearestRoad"))
    road = nearest_vertex(points, vertices.where("layer = 'roads'")).join(road_names, "fid")
    road = road.select("k", "nearestRoad", F.bround(F.col("degrees") * miles_per_degree, 1).alias("milesToRoad"))
    out = named.withColumnRenamed("place_idx", "k")
    for part in (by_layer, regions, terrain, coast, road):
        out = out.join(part, "k", "left")
    none = F.array().cast("array<string>")
    out = resolve_continent(out).select(
        F.col("k").alias("place_idx"), "slug", "name", F.coalesce(F.nullif("type", F.lit("")), F.lit("Other")).alias("type"),
        F.when(F.coalesce("size", F.lit(0)) == 0, 1).otherwise(F.col("size")).alias("size"), (F.coalesce("confirmed", F.lit(0)) == 1).alias("confirmed"),
        "source", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"), "continent", "continentSource", "island", "politicalRegion", "claimedBy",
        F.coalesce("regions", none).alias("regions"), F.coalesce("terrain", none).alias("terrain"), "nearestRoad", "milesToRoad",
    )
    return out


def sort_gazetteer(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.orderBy(F.col("size").desc(), "name", "place_idx")


def gazetteer_summary(gazetteer: DataFrame) -> DataFrame:
    """(measure, key, n): places by type, by continent, and near a road."""
    by_type = gazetteer.groupBy("type").count().select(F.lit("type").alias("measure"), F.col("type").alias("key"), F.col("count").alias("n"))
    continent = F.coalesce("continent", F.lit("unplaced")).alias("key")
    by_continent = gazetteer.groupBy(continent).count().select(F.lit("continent").alias("measure"), "key", F.col("count").alias("n"))
    near = gazetteer.agg(F.count_if(F.col("milesToRoad") < 15).alias("n")).select(F.lit("near road").alias("measure"), F.lit("< 15 miles").alias("key"), "n")
    return by_type.union(by_continent).union(near)


def places_by_continent_and_type(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.rollup("continent", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def places_by_realm(gazetteer: DataFrame) -> DataFrame:
    realm = F.coalesce("politicalRegion", F.lit("outside any realm")).alias("realm")
    return gazetteer.groupBy(realm, F.coalesce("claimedBy", F.lit("")).alias("holder")).agg(F.count("*").alias("n"))


def confirmed_share(gazetteer: DataFrame) -> DataFrame:
    n = F.count_if("confirmed")
    return gazetteer.agg(F.count("*").alias("places"), n.alias("confirmed"), F.bround(100.0 * n / F.nullif(F.count("*"), F.lit(0)), 2).alias("percent"))


def fit_scale(anchors: DataFrame) -> DataFrame:
    """One row with milesPerDegree: least squares through the origin over (degrees, canon_miles, weight)."""
    d, c, w = F.col("degrees"), F.col("canon_miles"), F.col("weight")
    return anchors.agg((F.sum(w * d * c) / F.sum(w * d * d)).alias("milesPerDegree"))


def scale_report(anchors: DataFrame) -> DataFrame:
    """Each anchor with fittedMiles, errorPct and the worst absolute error of all."""
    fit = F.broadcast(fit_scale(anchors))  # one row
    fitted = F.col("degrees") * F.col("milesPerDegree")
    out = anchors.join(fit).withColumn("error", 100 * (fitted - F.col("canon_miles")) / F.col("canon_miles"))
    worst = F.broadcast(out.agg(F.bround(F.max(F.abs("error")), 1).alias("worstErrorPct")))
    return out.join(worst).select("label", "degrees", "canon_miles", "weight", F.bround(fitted, 1).alias("fittedMiles"), F.bround("error", 1).alias("errorPct"), "worstErrorPct")


def anchor_degrees(lines: DataFrame, bays: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(label, degrees): lengths of lines (label, geometry), heights of a line's mean latitude above the south edge of a
    region (label, geometry, region), and distances of pairs (label, a, b) of named places; a missing place drops its pair."""
    long = lines.select("label", line_degrees(F.col("geometry")).alias("degrees"))
    ys = lambda g: F.transform(flat_points(F.col(g)), lambda p: p["y"])
    mean = F.aggregate(ys("geometry"), F.lit(0.0), lambda acc, y: acc + y) / F.size(ys("geometry"))
    high = bays.select("label", (mean - F.array_min(ys("region"))).alias("degrees"))
    at = places.groupBy("name").agg(F.max_by(F.struct("lon", "lat"), "place_idx").alias("at"))
    ends = pairs.join(at.select(F.col("name").alias("a"), F.col("at").alias("p")), "a").join(at.select(F.col("name").alias("b"), F.col("at").alias("q")), "b")
    apart = ends.select("label", F.hypot(F.col("p.lon") - F.col("q.lon"), F.col("p.lat") - F.col("q.lat")).alias("degrees"))
    return long.union(high).union(apart)
