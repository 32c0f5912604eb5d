"""From polygons and lines to a grid of terrain classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_of
from ..functions.scratch import checkpoint
from .components import components

#: The codes of the terrain classes.
CODES = {"ocean": 0, "plains": 1, "steppe": 2, "forest": 3, "desert": 4, "swamp": 5, "hills": 6, "mountain": 7, "lake": 8, "road": 9}
#: The class of a feature type in a layer.
TYPES = {
    "regions": {"forest": "forest", "mountain": "mountain", "desert": "desert", "water": "ocean"},
    "landscape": {"forest": "forest", "mountain": "mountain", "swamp": "swamp", "stepp": "steppe"},
}
#: The cost of a mile on land by class.
LAND_COST = {"road": 1.0, "steppe": 1.45, "plains": 1.55, "hills": 2.0, "forest": 2.2, "desert": 2.4, "swamp": 3.0, "mountain": 3.6}


#: Columns of a stretch in which runs of cells meet, and grid rows that one task paints and labels.
STRETCH, ROWS = 64, 16


def mask(*names: str) -> int:
    return sum(1 << CODES[n] for n in names)


ANY = (1 << len(CODES)) - 1
#: Painting order: layer, and which classes it may paint over.
STACK = (
    ("continents", ANY), ("islands", ANY), ("regions", mask("plains")),
    ("landscape", mask("plains", "steppe", "forest", "desert", "hills")), ("lakes", ANY), ("roads", mask(*LAND_COST) & ~mask("road")),
)


@dataclass(frozen=True)
class Grid:
    min_lon: float
    min_lat: float
    cell: float
    width: int
    height: int


def grid_extent(vertices: DataFrame, cell: float, pad: float = 1.0) -> Grid:
    """The grid over all vertices with a margin: one row of extremes comes to the driver."""
    x1, y1, x2, y2 = vertices.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    count = lambda low, high: int((high + pad - (low - pad)) / cell) + 1
    return Grid(x1 - pad, y1 - pad, cell, count(x1, x2), count(y1, y2))


def classify_layer(layer: Column, type_: Column) -> Column:
    """The class code of a feature by its layer and type; null where it paints nothing."""
    code = F.when(layer.isin("continents", "islands"), CODES["plains"]).when(layer == "lakes", CODES["lake"]).when(layer == "roads", CODES["road"])
    for name, types in TYPES.items():
        for t, c in types.items():
            code = code.when((layer == name) & (F.lower(type_) == t), CODES[c])
    return code.cast("int")


def fill_polygons(edges: DataFrame, grid: Grid) -> DataFrame:
    """(layer, cls, row, xa, xb): spans of cells by scan lines, even-odd over all rings of a class in a layer.

    edges: layer, cls, x1, y1, x2, y2. An edge counts on a row if its latitude is in [low, high); crossings are paired
    from the left, and the cells between a pair, both ends included, are filled; a last odd crossing fills nothing.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    lat = lambda r: (r + 0.5) * grid.cell + grid.min_lat
    first = F.greatest(F.floor((low - grid.min_lat) / grid.cell) - 1, F.lit(0))
    last = F.least(F.ceil((high - grid.min_lat) / grid.cell), F.lit(grid.height - 1))
    rows = edges.where("y1 <> y2").where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("lat", lat(F.col("row"))).where((low <= F.col("lat")) & (F.col("lat") < high))
    x = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    order = Window.partitionBy("layer", "cls", "row").orderBy("x")
    crossed = rows.select("layer", "cls", "row", x.alias("x"))
    pairs = crossed.select("layer", "cls", "row", F.col("x").alias("a"), F.lead("x").over(order).alias("b"), F.row_number().over(order).alias("n"))
    pairs = pairs.where("n % 2 = 1 AND b IS NOT NULL")
    cell = lambda c: cell_of(F.col(c), grid.min_lon, grid.cell, grid.width)
    return pairs.select("layer", "cls", F.col("row").cast("int").alias("row"), cell("a").alias("xa"), cell("b").alias("xb"))


def stroke_lines(edges: DataFrame, grid: Grid) -> DataFrame:
    """(layer, cls, cx, cy): the cells that lines pass, sampled at half a cell."""
    span = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    steps = F.greatest(F.lit(1), (span / (grid.cell / 2)).cast("int"))
    rows = edges.select("layer", "cls", "x1", "y1", "x2", "y2", steps.alias("steps")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    part = F.col("i") / F.col("steps")
    at = lambda a, b, low, n: cell_of(F.col(a) + (F.col(b) - F.col(a)) * part, low, grid.cell, n)
    return rows.select("layer", "cls", at("x1", "x2", grid.min_lon, grid.width).alias("cx"), at("y1", "y2", grid.min_lat, grid.height).alias("cy")).distinct()


def all_cells(spark, grid: Grid) -> DataFrame:
    n = spark.range(grid.width * grid.height)
    return n.select((F.col("id") % grid.width).cast("int").alias("cx"), F.floor(F.col("id") / grid.width).cast("int").alias("cy"))


def paint_rows(spans: DataFrame, strokes: DataFrame, first_seen: DataFrame, grid: Grid) -> DataFrame:
    """(cy, xa, xb, cls): the grid's rows as maximal runs of one class, ocean where nothing is painted.

    Paints apply in the order of STACK, within a layer by the first appearance of the class (layer, cls, seen); a
    paint takes only over classes that its layer may paint over. Spans travel as they are; a task sweeps a few rows, each
    with its spans over one array of the grid's width, and gives runs: cells are never rows of a shuffle.
    """
    rank, allowed = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (layer, over) in enumerate(STACK):
        rank = F.when(F.col("layer") == layer, k).otherwise(rank)
        allowed = F.when(F.col("layer") == layer, over).otherwise(allowed)
    paints = spans.select("layer", "cls", "row", "xa", "xb").union(strokes.select("layer", "cls", "cy", "cx", "cx"))
    paints = paints.join(F.broadcast(first_seen), ["layer", "cls"])  # as many rows as layers have classes
    paints = paints.select("row", rank.alias("rank"), "seen", "cls", allowed.alias("over"), "xa", "xb")
    none = F.lit(-1)
    empty = spans.sparkSession.range(grid.height).select(F.col("id").cast("int").alias("row"), none.alias("rank"), none.alias("seen"), none.alias("cls"), none.alias("over"), F.lit(0).alias("xa"), none.alias("xb"))

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "rank", "seen", "cls"], kind="stable")
        out = []
        for row, paint in rows.groupby("row", sort=False):
            line = np.zeros(grid.width, np.int32)
            for cls, over, xa, xb in paint[["cls", "over", "xa", "xb"]].to_numpy().tolist():
                part = line[xa : xb + 1]
                part[(over >> part) & 1 == 1] = cls
            first = np.concatenate(([0], np.flatnonzero(np.diff(line)) + 1))
            out.append(pd.DataFrame({"cy": row, "xa": first, "xb": np.append(first[1:] - 1, grid.width - 1), "cls": line[first]}))
        return pd.concat(out)

    return paints.union(empty).groupBy(F.floor(F.col("row") / ROWS)).applyInPandas(sweep, "cy int, xa int, xb int, cls int")


def cells_of_runs(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.sequence("xa", "xb")).alias("cx"), "cy", "cls")


def paint_stack(spans: DataFrame, strokes: DataFrame, first_seen: DataFrame, grid: Grid) -> DataFrame:
    """(cx, cy, cls) for every cell of the grid, as paint_rows() has them."""
    return cells_of_runs(paint_rows(spans, strokes, first_seen, grid))


def runs_of(cells: DataFrame, keep: Column) -> DataFrame:
    """(run, cy, xa, xb): maximal runs of neighbouring cells of a row for which keep holds; run is a number of its own."""
    n = F.row_number().over(Window.partitionBy("cy").orderBy("cx"))
    kept = cells.where(keep).withColumn("__g", F.col("cx") - n)
    runs = kept.groupBy("cy", "__g").agg(F.min("cx").alias("xa"), F.max("cx").alias("xb"))
    return runs.select((F.col("cy").cast("long") * (1 << 31) + F.col("xa")).alias("run"), "cy", "xa", "xb")


def run_links(runs: DataFrame, reach: int) -> DataFrame:
    """(a, b): runs of adjacent rows that touch; reach 0 for four neighbours, 1 for eight.

    Runs meet in stretches of STRETCH columns, so that a row of very many runs is no all-pairs join; each link is kept
    where the overlap begins.
    """
    at = lambda c: F.floor(F.col(c) / STRETCH)
    here = runs.withColumn("at", F.explode(F.sequence(at("xa"), at("xb"))))
    up = runs.select(F.col("run").alias("b"), (F.col("cy") - 1).alias("cy"), (F.col("xa") - reach).alias("ua"), (F.col("xb") + reach).alias("ub"))
    up = up.withColumn("at", F.explode(F.sequence(at("ua"), at("ub"))))
    first = F.floor(F.greatest("xa", "ua") / STRETCH)
    return here.join(up, ["cy", "at"]).where((F.col("xa") <= F.col("ub")) & (F.col("ua") <= F.col("xb")) & (F.col("at") == first)).select(F.col("run").alias("a"), "b")


def labelled(runs: DataFrame, reach: int) -> DataFrame:
    """runs (run, cy, xa, xb) with label, the same for runs that steps join; reach 0 for four neighbours, 1 for eight.

    Bands of ROWS rows are labelled by themselves, each in one task; then only the labels that touch across a border
    between bands are contracted.
    """

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cy", "xa"], kind="stable")
        number, cy, xa, xb = (rows[c].tolist() for c in ("run", "cy", "xa", "xb"))
        up = list(range(len(number)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        above = i = 0
        while i < len(number):
            end = i
            while end < len(number) and cy[end] == cy[i]:
                end += 1
            if above < i and cy[above] == cy[i] - 1:
                p, q = above, i
                while p < i and q < end:
                    if xa[p] <= xb[q] + reach and xa[q] <= xb[p] + reach:
                        x, y = top(p), top(q)
                        up[max(x, y)] = min(x, y)
                    if xb[p] < xb[q]:
                        p += 1
                    else:
                        q += 1
            above, i = i, end
        return rows.assign(label=[number[top(k)] for k in range(len(number))])

    own = checkpoint(runs.groupBy(F.floor(F.col("cy") / ROWS)).applyInPandas(within, "run long, cy int, xa int, xb int, label long"))
    edge = own.where((F.col("cy") % ROWS == 0) | (F.col("cy") % ROWS == ROWS - 1))
    links = run_links(edge.where(F.col("cy") % ROWS == ROWS - 1).union(edge.where(F.col("cy") % ROWS == 0)), reach)
    names = lambda c: edge.select(F.col("run").alias(c), F.col("label").alias(f"{c}_label"))
    links = links.where(F.floor(F.shiftright("a", 31) / ROWS) != F.floor(F.shiftright("b", 31) / ROWS)).join(names("a"), "a").join(names("b"), "b")
    roots = components(links.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    return own.join(roots, F.col("label") == F.col("node"), "left").select("run", "cy", "xa", "xb", F.coalesce("root", "label").alias("label"))


def labelled_runs(cells: DataFrame, keep: Column, reach: int) -> DataFrame:
    """runs_of() with label, the same for connected runs."""
    return labelled(runs_of(cells, keep), reach)


def landlocked(runs: DataFrame, grid: Grid) -> DataFrame:
    """(run) of those of ocean runs (run, cy, xa, xb) that four-neighbour steps do not join to the grid's border."""
    known = checkpoint(labelled(runs, 0))
    border = F.col("cy").isin(0, grid.height - 1) | (F.col("xa") == 0) | (F.col("xb") == grid.width - 1)
    return known.join(known.where(border).select("label").distinct(), "label", "left_anti").select("run", "cy", "xa", "xb")


def reclass_landlocked(cells: DataFrame, grid: Grid) -> DataFrame:
    """Ocean that four-neighbour steps do not join to the ocean on the border becomes lake."""
    inner = landlocked(runs_of(cells, F.col("cls") == CODES["ocean"]), grid)
    enclosed = inner.select(F.explode(F.sequence("xa", "xb")).alias("cx"), "cy", F.lit(CODES["lake"]).alias("lake"))
    return cells.join(enclosed, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("lake", "cls").alias("cls"))


def build_terrain(edges: DataFrame, grid: Grid) -> DataFrame:
    """(cx, cy, cls) from classed edges (layer, feature_idx, cls, x1, y1, x2, y2); roads are stroked, the rest filled.

    Rows stay runs until the end: painted, reclassed, and only then spread into cells.
    """
    edges = checkpoint(edges)  # read by the spans, the strokes and the order of classes
    seen = edges.groupBy("layer", "cls").agg(F.min("feature_idx").alias("seen"))
    spans = fill_polygons(edges.where("layer <> 'roads'"), grid)
    strokes = stroke_lines(edges.where("layer = 'roads'"), grid)
    rows = checkpoint(paint_rows(spans, strokes, seen, grid).withColumn("run", F.col("cy").cast("long") * (1 << 31) + F.col("xa")))
    lakes = landlocked(rows.where(F.col("cls") == CODES["ocean"]).select("run", "cy", "xa", "xb"), grid).select("run", F.lit(CODES["lake"]).alias("lake"))
    return cells_of_runs(rows.join(lakes, "run", "left").select("cy", "xa", "xb", F.coalesce("lake", "cls").alias("cls")))


def terrain_histogram(cells: DataFrame) -> DataFrame:
    """(cls, name, n) for every class, zero included."""
    spark = cells.sparkSession
    legend = spark.range(len(CODES)).select(F.col("id").cast("int").alias("cls"), F.element_at(F.array(*map(F.lit, CODES)), (F.col("id") + 1).cast("int")).alias("name"))
    return legend.join(cells.groupBy("cls").count(), "cls", "left").select("cls", "name", F.coalesce("count", F.lit(0)).alias("n"))


def terrain_shares(cells: DataFrame) -> DataFrame:
    """(name, percent of all land cells) of the land classes."""
    land = terrain_histogram(cells).where(~F.col("name").isin("ocean", "lake"))
    whole = F.sum("n").over(Window.partitionBy())  # ten rows
    return land.select("name", F.bround(100.0 * F.col("n") / F.nullif(whole, F.lit(0)), 2).alias("percent"))
