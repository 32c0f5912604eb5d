"""What a map's panels show, as tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpoint
from ..functions.text import html_paragraphs

#: From which zoom a place of a size shows.
SHOWN_FROM = {5: 0.0, 4: 3.2, 3: 4.0, 2: 4.8, 1: 5.6}


def search_places(places: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, place_idx, name, rank): for each query of two letters or more the first k places whose name has it.

    Names that begin with the query come first, then larger places, then names in order. queries is broadcast: it is
    what one user types, checked here to be no more than 10 000 rows.
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).where(F.length("q") >= 2).distinct()
    if q.limit(10_001).count() > 10_000:
        raise ValueError("more than 10 000 queries at once")
    met = places.join(F.broadcast(q), F.contains(F.lower("name"), F.col("q")))
    order = Window.partitionBy("query").orderBy(F.startswith(F.lower("name"), F.col("q")).desc(), F.col("size").desc(), "name", "place_idx")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "place_idx", "name", "rank")


def visible_at_zoom(size: Column, zoom: Column) -> Column:
    least = F.lit(6.0)
    for s, z in SHOWN_FROM.items():
        least = F.when(size == s, z).otherwise(least)
    return zoom >= least


def place_facts(gazetteer: DataFrame) -> DataFrame:
    """(place_idx, facts): realm and holder, continent, island, terrain, distance of the road, as one text."""
    road = F.when(F.col("milesToRoad") < 20, F.concat(F.lit("on the "), F.coalesce("nearestRoad", F.lit("road")))).otherwise(
        F.concat(F.floor(F.col("milesToRoad") + 0.5).cast("string"), F.lit(" miles from the "), F.coalesce("nearestRoad", F.lit("road")))
    )
    realm = F.concat_ws(", ", "politicalRegion", F.concat(F.lit("held by "), "claimedBy"))
    terrain = F.nullif(F.array_join("terrain", ", "), F.lit(""))
    return gazetteer.select("place_idx", F.concat_ws("; ", F.nullif(realm, F.lit("")), "continent", "island", terrain, road).alias("facts"))


def place_caveats(gazetteer: DataFrame) -> DataFrame:
    """(place_idx, caveats): unconfirmed, custom, coast-snap, in that order."""
    flags = F.array(
        F.when(~F.col("confirmed"), "unconfirmed"), F.when(F.col("source") == "custom", "custom"), F.when(F.col("continentSource") == "coast-snap", "coast-snap")
    )
    return gazetteer.select("place_idx", F.array_compact(flags).alias("caveats"))


def place_sections(lore: DataFrame) -> DataFrame:
    """(slug, panels): the texts of a place's panels as HTML; the screen's history only where it differs."""
    panel = lambda title, text, n: F.when(F.nullif(text, F.lit("")).isNotNull(), F.struct(F.lit(title).alias("title"), html_paragraphs(text, n).alias("html")))
    other = F.when(~F.col("screenHistory").eqNullSafe(F.col("history")), F.col("screenHistory"))
    panels = F.array_compact(F.array(panel("Summary", F.col("summary"), 3), panel("Description", F.col("description"), 6), panel("History", F.col("history"), 14), panel("On screen", other, 8)))
    nothing = F.array(F.struct(F.lit("Nothing is written").alias("title"), F.lit("").alias("html")))
    return lore.select("slug", F.when(F.size(panels) > 0, panels).otherwise(nothing).alias("panels"))


def rank_modes(routes: DataFrame) -> DataFrame:
    """routes (origin, destination, mode, days, error) with rank: the fastest first, those that cannot go last."""
    order = Window.partitionBy("origin", "destination").orderBy(F.col("error").isNotNull(), "days", "mode")
    return routes.withColumn("rank", F.row_number().over(order))


BOX = ["id", "priority", "x1", "y1", "x2", "y2"]
#: Side of the square buckets in which boxes meet, and how many boxes of a bucket are weighed against each other in a round.
SIDE, FIRST = 64.0, 32
MEET = "x1 < o_x2 AND o_x1 < x2 AND y1 < o_y2 AND o_y1 < y2"


def dealt(boxes: DataFrame) -> DataFrame:
    """boxes, once for each bucket (bx, by) that they touch."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / SIDE), F.floor(F.col(b) / SIDE)))
    return boxes.withColumn("bx", span("x1", "x2")).withColumn("by", span("y1", "y2"))


def others(cut: DataFrame) -> DataFrame:
    return cut.select("bx", "by", *(F.col(c).alias(f"o_{c}") for c in BOX))


def certain(top: DataFrame) -> list[DataFrame]:
    """Ids, in parts, of the boxes that stay for certain; top has the first of each bucket (BOX, bx, by) among those undecided.

    A box among the first of every bucket that it touches has met there all more important ones that overlap it. Rounds:
    such a box without an undecided more important neighbour stays and hides the neighbours after it.
    """
    buckets = lambda a, b: F.abs(F.floor(F.col(b) / SIDE) - F.floor(F.col(a) / SIDE)) + 1
    whole = top.distinct().groupBy(*BOX).count().where(F.col("count") == buckets("x1", "x2") * buckets("y1", "y2"))
    met = top.join(others(top), ["bx", "by"]).where(f"{MEET} AND (priority < o_priority OR (priority = o_priority AND id < o_id))")
    ready, pairs, found = checkpoint(whole.select("id")), checkpoint(met.select(F.col("id").alias("hi"), F.col("o_id").alias("lo")).distinct()), []
    while True:
        stay = checkpoint(ready.join(pairs.select(F.col("lo").alias("id")), "id", "left_anti"))
        if stay.isEmpty():
            return found
        found.append(stay)
        hidden = pairs.join(stay.withColumnRenamed("id", "hi"), "hi", "left_semi").select(F.col("lo").alias("id"))
        gone = checkpoint(stay.union(hidden).distinct())
        ready = checkpoint(ready.join(gone, "id", "left_anti"))
        pairs = checkpoint(pairs.join(gone.withColumnRenamed("id", "hi"), "hi", "left_anti").join(gone.withColumnRenamed("id", "lo"), "lo", "left_anti"))


def thin_labels(boxes: DataFrame) -> DataFrame:
    """Ids of the boxes that stay when, from the most important on, each that overlaps one that stays is hidden.

    boxes (BOX) are told apart by their ids. In each round the first boxes of every bucket are weighed against each
    other, and those that stay hide all the boxes that they overlap. Boxes that stay do not overlap, so few share a
    bucket: the work grows with the boxes, not with the pairs that overlap. A box with nulls stays and hides nothing.
    """
    known = reduce(and_, (F.col(c).isNotNull() for c in BOX))
    kept, left = boxes.where(~known).select("id"), checkpoint(boxes.where(known).select(*BOX))
    first = Window.partitionBy("bx", "by").orderBy("priority", "id")
    while not left.isEmpty():
        cut = dealt(left)
        top = checkpoint(cut.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FIRST).drop("n"))
        stay = reduce(DataFrame.union, certain(top))
        kept = kept.union(stay)
        stayed = others(top.join(stay, "id", "left_semi"))
        hidden = cut.join(stayed, (cut["bx"] == stayed["bx"]) & (cut["by"] == stayed["by"]) & F.expr(MEET), "left_semi").select("id")
        left = checkpoint(left.join(stay.union(hidden), "id", "left_anti"))
    return kept
