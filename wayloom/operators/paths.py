"""Paths of journeys over the terrain grid: traced back through the settled blocks, straightened, and measured."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_center
from ..functions.scratch import checkpoint
from .raster import Grid
from .routing import MODES, STEPS, blocks_of, costs, ends_of, flies, measured, search_from

#: How many cells ahead a straight line may replace a path, and cells of a side of the blocks paths are traced in.
WINDOW, BLOCK = 60, 64
#: The colours of the modes.
COLOURS = {"foot": "#6b7f4a", "horse": "#8a5a2b", "carriage": "#7a6a90", "dragon": "#a8323a", "ship": "#2f6b8a"}
CELL = "struct<x: int, y: int>"


def walk(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (k, mode, ax, ay, cx, cy, bx, by, xs, ys, classes, weighted, miles) to (k, mode, piece, nx, ny, done).

    piece runs from (cx, cy) back towards the start (ax, ay), as far as the block reaches; (nx, ny) is the next cell.
    """

    def one(r) -> tuple:
        cost = costs(r.mode)
        at = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(r.xs, r.ys, strict=True))}
        x, y, piece = int(r.cx), int(r.cy), []
        while True:
            if (x // size, y // size) != (r.bx, r.by):
                return piece, x, y, False
            piece.append({"x": x, "y": y})
            if (x, y) == (r.ax, r.ay):
                return piece, x, y, True
            i = at[x, y]
            c, here = cost[int(r.classes[i])], (r.weighted[i], r.miles[i])
            for dx, dy in STEPS:
                j, d = at.get((x - dx, y - dy)), 2**0.5 if dx and dy else 1.0
                if j is not None and (r.weighted[j] + d * c, r.miles[j] + d) == here:
                    x, y = x - dx, y - dy
                    break
            else:
                raise ValueError(f"no way back from cell {x}, {y}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = [one(r) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"k": pdf["k"], "mode": pdf["mode"], "piece": [d[0] for d in done], "nx": [d[1] for d in done], "ny": [d[2] for d in done], "done": [d[3] for d in done]})

    return run


def route_path(ends: DataFrame, found: DataFrame, cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """(k, mode, path): the cells from start to goal of journeys ends (k, mode, origin, ax, ay, gx, gy).

    found is what search() gives. The settled cells are dealt into blocks with a margin of one cell, and each journey
    goes back from its goal block by block: there are as many rounds as blocks on the longest path, and no task holds
    more than a block for a journey. Journeys whose goal was not reached have no row.
    """
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / size).cast("int"), F.floor((F.col(c) + 1) / size).cast("int")))
    known = found.join(cells.select("cx", "cy", "cls"), ["cx", "cy"]).withColumn("bx", near("cx")).withColumn("by", near("cy"))
    keys = ["mode", "origin", "bx", "by"]
    packed = known.groupBy(*keys).agg(F.collect_list(F.struct("cx", "cy", "cls", "weighted", "miles")).alias("c"))
    columns = {"xs": "cx", "ys": "cy", "classes": "cls", "weighted": "weighted", "miles": "miles"}
    packed = checkpoint(packed.select(*keys, *(F.col(f"c.{v}").alias(n) for n, v in columns.items())))
    reached = found.select("mode", "origin", F.col("cx").alias("gx"), F.col("cy").alias("gy"))
    heads = checkpoint(ends.join(reached, ["mode", "origin", "gx", "gy"], "left_semi").select("k", "mode", "origin", "ax", "ay", F.col("gx").alias("cx"), F.col("gy").alias("cy")))
    pieces, part = None, 0
    while not heads.isEmpty():
        at = heads.withColumn("bx", block("cx")).withColumn("by", block("cy")).join(packed, keys)
        at = at.select("k", "mode", "ax", "ay", "cx", "cy", "bx", "by", *columns)
        went = checkpoint(at.mapInPandas(walk(size), f"k long, mode string, piece array<{CELL}>, nx int, ny int, done boolean").withColumn("part", F.lit(part)))
        got = went.select("k", "mode", "part", "piece")
        pieces, part = got if pieces is None else pieces.union(got), part + 1
        further = went.where("NOT done").select("k", "mode", F.col("nx").alias("cx"), F.col("ny").alias("cy"))
        heads = checkpoint(heads.drop("cx", "cy").join(further, ["k", "mode"]))
    if pieces is None:
        return ends.select("k", "mode", F.lit(None).cast(f"array<{CELL}>").alias("path")).limit(0)
    parts = pieces.groupBy("k", "mode").agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("p"))
    return parts.select("k", "mode", F.reverse(F.flatten(F.transform("p", lambda x: x["piece"]))).alias("path"))


def measure(path: np.ndarray, cls: np.ndarray, cost: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Length and cost of each step of path (n, 2), in cells, cls being the classes of its cells."""
    length = np.where(np.abs(np.diff(path, axis=0)).sum(axis=1) == 2, 2**0.5, 1.0)
    return length, length * np.array([cost[int(c)] for c in cls[1:]])


def straight(path: np.ndarray, of: Callable[[np.ndarray], np.ndarray], cost: dict[int, float]) -> np.ndarray:
    """path with runs replaced, farthest first, by straight lines over allowed cells that cost no more."""
    if len(path) < 3:
        return path
    spent = np.concatenate([[0.0], np.cumsum(measure(path, of(path), cost)[1])])
    out, at = [path[:1]], 0
    while at < len(path) - 1:
        for to in range(min(len(path) - 1, at + WINDOW), at, -1):
            if to == at + 1:
                line = path[at : to + 1]
                break
            a, b = path[at], path[to]
            steps = int(np.abs(b - a).max())
            if not steps:
                continue
            line = np.rint(a + (b - a) * (np.arange(steps + 1) / steps)[:, None]).astype(np.int64)
            classes = of(line)
            if all(int(c) in cost for c in classes) and measure(line, classes, cost)[1].sum() <= spent[to] - spent[at] + 1e-9:
                break
        out.append(line[1:])
        at = to
    return np.concatenate(out)


def straighten_path(paths: DataFrame, cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """(k, mode, path, miles, weighted), in cells, for paths (k, mode, path): straightened and measured anew.

    Each path meets the blocks within WINDOW cells of it, so that a group grows with the length of one path alone.
    """
    reach = -(-WINDOW // size)
    blocks = blocks_of(cells, size)
    own = paths.select("k", "mode", F.explode("path").alias("c"))
    own = own.select("k", "mode", F.floor(F.col("c.x") / size).cast("int").alias("bx"), F.floor(F.col("c.y") / size).cast("int").alias("by")).distinct()
    spread = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
    around = own.withColumn("bx", spread("bx")).withColumn("by", spread("by")).distinct().join(blocks, ["bx", "by"])
    around = around.select(*(F.col(c).alias(c) for c in around.columns))  # columns of its own beside those of paths

    def one(path_rows: pd.DataFrame, block_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(path_rows):
            return pd.DataFrame({"k": [], "mode": [], "path": [], "miles": [], "weighted": []})
        r = path_rows.iloc[0]
        cost = costs(r["mode"])
        known = {(int(x), int(y)): int(c) for b in block_rows.itertuples() for x, y, c in zip(b.xs, b.ys, b.classes, strict=True)}
        of = lambda line: np.array([known.get((int(x), int(y)), -1) for x, y in line])
        path = straight(np.array([(c["x"], c["y"]) for c in r["path"]], np.int64), of, cost)
        length, spent = measure(path, of(path), cost) if len(path) > 1 else (np.zeros(1), np.zeros(1))
        cells_of = [{"x": int(x), "y": int(y)} for x, y in path]
        return pd.DataFrame({"k": [r["k"]], "mode": [r["mode"]], "path": [cells_of], "miles": [float(length.sum())], "weighted": [float(spent.sum())]})

    both = paths.groupBy("k", "mode").cogroup(around.groupBy("k", "mode"))
    return both.applyInPandas(one, f"k long, mode string, path array<{CELL}>, miles double, weighted double")


def lon_lat(path: Column, grid: Grid) -> Column:
    """Cells as points on the map, rounded."""
    return F.transform(path, lambda c: F.struct(F.bround(cell_center(c["x"], grid.min_lon, grid.cell), 5).alias("lon"), F.bround(cell_center(c["y"], grid.min_lat, grid.cell), 5).alias("lat")))


def routes(journeys: DataFrame, cells: DataFrame, grid: Grid, miles_per_degree: float, size: int = BLOCK) -> DataFrame:
    """journeys (k, mode, x1, y1, x2, y2) with miles, weighted_miles, days, error and path of lon and lat.

    Paths on the ground are straightened, then measured; a flight's path is its two ends.
    """
    ends = ends_of(journeys, cells, grid)
    found = checkpoint(search_from(ends, cells, size))
    base = measured(journeys, ends, found, grid, miles_per_degree)
    known = ends.where("ax IS NOT NULL AND bx IS NOT NULL")
    traced = route_path(known.select("k", "mode", "origin", "ax", "ay", F.col("bx").alias("gx"), F.col("by").alias("gy")), found, cells, size)
    straightened = straighten_path(traced, cells, size)
    scale = grid.cell * miles_per_degree
    ground = straightened.select("k", "mode", lon_lat(F.col("path"), grid).alias("path"), (F.col("miles") * scale).alias("m"), (F.col("weighted") * scale).alias("w"))
    point = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    flown = journeys.where(flies()).select("k", "mode", F.array(point("x1", "y1"), point("x2", "y2")).alias("path"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("w"))
    out = base.join(ground.unionByName(flown), ["k", "mode"], "left")
    days = F.when(F.col("w").isNull(), F.col("days")).when(F.col("weighted_miles") == 0, 0.0).otherwise(F.col("days") * F.col("w") / F.col("weighted_miles"))
    return out.select("k", "mode", F.coalesce("m", "miles").alias("miles"), F.coalesce("w", "weighted_miles").alias("weighted_miles"), days.alias("days"), "error", "path")


def routes_to_features(routes: DataFrame) -> DataFrame:
    """(k, mode, feature): a GeoJSON line for every route (k, mode, path of lon and lat, error) that is possible."""
    colour = F.lit("#333")
    for mode, c in COLOURS.items():
        colour = F.when(F.col("mode") == mode, c).otherwise(colour)
    line = F.struct(F.lit("LineString").alias("type"), F.transform("path", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    own = F.struct("mode", colour.alias("colour"), flies().alias("straightLine"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), own.alias("properties"), line.alias("geometry")))
    return routes.where("error IS NULL AND path IS NOT NULL").select("k", "mode", feature.alias("feature"))
