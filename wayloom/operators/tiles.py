"""From the terrain grid to elevations, colours and tile pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .raster import CODES, Grid

#: Feet above the sea by class.
FEET = {"ocean": -600.0, "lake": -20.0, "swamp": 15.0, "road": 200.0, "plains": 220.0, "steppe": 350.0, "forest": 420.0, "desert": 500.0, "hills": 1100.0, "mountain": 4200.0}
METRES_PER_FOOT = 0.3048
#: Base colours by class, and the colours of sea, snow, ice, cold and warm ground.
BIOME = {
    "plains": (104, 118, 68), "steppe": (144, 138, 84), "forest": (54, 78, 44), "desert": (196, 170, 112), "swamp": (72, 86, 58),
    "hills": (118, 116, 78), "mountain": (116, 106, 92), "road": (140, 126, 92), "lake": (36, 74, 96),
}
SEA_SHALLOW, SEA_DEEP, SNOW, ICE, COLD, WARM = (44, 106, 132), (10, 34, 58), (238, 242, 246), (206, 220, 228), (108, 128, 140), (198, 168, 104)
#: Latitudes and heights of snow, light and its strength.
SNOW_LAT, SNOWLINE_LAT, SNOWLINE_FEET, SNOW_BAND = (32.0, 46.0), (-5.0, 40.0), (6500.0, 1500.0), 1800.0
LIGHT, SHADE_STRENGTH, SHADE_RANGE = (-0.6, 0.8), 0.00055, (0.62, 1.32)
TILE = 256
LAT_LIMIT = 85.05112878


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def by_class(cls: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(cls == CODES[name], F.lit(v)).otherwise(out)
    return out


def base_elevation(cls: Column) -> Column:
    return by_class(cls, FEET)


def kernel(passes: int) -> list[float]:
    """Weights of so many passes of a three-cell mean: the coefficients of (1 + x + x^2)^passes / 3^passes."""
    row = [1]
    for _ in range(passes):
        row = [sum(row[k] for k in (i - 2, i - 1, i) if 0 <= k < len(row)) for i in range(len(row) + 2)]
    return [w / 3.0**passes for w in row]


#: Cells of a side of the blocks that fields are worked on in.
BLOCK = 64


def with_halo(cells: DataFrame, reach: int) -> DataFrame:
    """cells with bx, by: once for each block of BLOCK by BLOCK cells that they are in or within reach of."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / BLOCK).cast("int"), F.floor((F.col(c) + reach) / BLOCK).cast("int")))
    return cells.withColumn("bx", near("cx")).withColumn("by", near("cy"))


def own_cells(rows: pd.DataFrame) -> np.ndarray:
    """Which rows of a block with its halo are cells of the block itself."""
    return ((rows.cx // BLOCK == rows.bx) & (rows.cy // BLOCK == rows.by)).to_numpy()


def image_of(rows: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """elev of rows as an array, and the cell of its first row and column."""
    x0, y0 = int(rows.cx.min()), int(rows.cy.min())
    image = np.full((int(rows.cy.max()) - y0 + 1, int(rows.cx.max()) - x0 + 1), np.nan)
    image[rows.cy - y0, rows.cx - x0] = rows.elev
    return image, x0, y0


def blur_field(cells: DataFrame, grid: Grid, passes: int = 9) -> DataFrame:
    """(cx, cy, elev): passes of a three-cell mean along rows and columns, edges mirrored, as one kernel an axis.

    Each block is blurred by itself with a halo as wide as the kernel reaches, which is less than a block.
    """
    weights = kernel(passes)

    def axis(block: int, length: int, first: int) -> tuple[np.ndarray, int]:
        """Where in the image the cells of a block and its halo lie, mirrored beyond the grid's edges, and how many are the block's."""
        start, end = block * BLOCK, min((block + 1) * BLOCK, length)
        p = np.arange(start - passes, end + passes) % (2 * length)
        return np.where(p < length, p, 2 * length - 1 - p) - first, end - start

    def blur(rows: pd.DataFrame) -> pd.DataFrame:
        if not own_cells(rows).any():
            return pd.DataFrame({"cx": [], "cy": [], "elev": []})
        image, x0, y0 = image_of(rows)
        bx, by = int(rows.bx.iat[0]), int(rows.by.iat[0])
        (across, w), (down, h) = axis(bx, grid.width, x0), axis(by, grid.height, y0)
        image = image[down][:, across]
        along = sum((image[:, o : o + w] * weight for o, weight in enumerate(weights)), 0.0)
        out = sum((along[o : o + h] * weight for o, weight in enumerate(weights)), 0.0)
        y, x = np.mgrid[:h, :w]
        return pd.DataFrame({"cx": (x + bx * BLOCK).ravel(), "cy": (y + by * BLOCK).ravel(), "elev": out.ravel()})

    if passes > BLOCK:
        raise ValueError(f"a kernel of {passes} passes reaches beyond the next block of {BLOCK} cells")
    return with_halo(cells.select("cx", "cy", "elev"), passes).groupBy("bx", "by").applyInPandas(blur, "cx int, cy int, elev double")


def elevation(cells: DataFrame, grid: Grid, passes: int = 9) -> DataFrame:
    return blur_field(cells.select("cx", "cy", base_elevation(F.col("cls")).alias("elev")), grid, passes)


def elevation_range(field: DataFrame) -> DataFrame:
    low, high = F.min("elev"), F.max("elev")
    return field.agg(
        F.bround(low, 0).alias("min_feet"), F.bround(high, 0).alias("max_feet"),
        F.bround(low * METRES_PER_FOOT, 0).alias("min_metres"), F.bround(high * METRES_PER_FOOT, 0).alias("max_metres"),
    )


def terrain_rgb(feet: Column) -> Column:
    """struct<r, g, b> of tenths of a metre above -10000 m."""
    code = ((feet * METRES_PER_FOOT + 10000.0) * 10.0).cast("int")
    byte = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(255))
    return F.struct(byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"))


def cell_noise(x: Column, y: Column) -> Column:
    """A value in [-1, 1] from the 32-bit hash of a cell; x and y below about a billion."""
    low = F.lit(0xFFFFFFFF)
    n = (x.cast("long") * 374761393 + y.cast("long") * 668265263).bitwiseAND(low)
    n = (n.bitwiseXOR(F.shiftright(n, 13)) * F.lit(1274126177)).bitwiseAND(low)
    return n.bitwiseXOR(F.shiftright(n, 16)).bitwiseAND(F.lit(0xFFFF)) / 32767.5 - 1.0


def latitude_factors(lat: Column) -> dict[str, Column]:
    """How cold, warm and snowy flat ground is at a latitude, and the height of the snowline."""
    chill = clamp((lat - SNOWLINE_LAT[0]) / (SNOWLINE_LAT[1] - SNOWLINE_LAT[0]))
    return {
        "cold": clamp((lat - 8.0) / 30.0), "warm": clamp((6.0 - lat) / 22.0),
        "snow_lat": clamp((lat - SNOW_LAT[0]) / (SNOW_LAT[1] - SNOW_LAT[0])),
        "snowline": SNOWLINE_FEET[0] + (SNOWLINE_FEET[1] - SNOWLINE_FEET[0]) * chill,
    }


def relief_shade(field: DataFrame) -> DataFrame:
    """field with shade: light from the north-west on the central differences; edges count as flat outwards.

    Each block is shaded by itself with the cells next to it.
    """

    def shade(rows: pd.DataFrame) -> pd.DataFrame:
        own = own_cells(rows)
        image, x0, y0 = image_of(rows)
        image = np.pad(image, 1, constant_values=np.nan)
        x, y = (rows.cx[own] - x0 + 1).to_numpy(), (rows.cy[own] - y0 + 1).to_numpy()
        here = image[y, x]
        at = lambda dy, dx: np.where(np.isnan(image[y + dy, x + dx]), here, image[y + dy, x + dx])
        light = 1.0 + ((at(0, 1) - at(0, -1)) * LIGHT[0] + (at(1, 0) - at(-1, 0)) * LIGHT[1]) * SHADE_STRENGTH
        return rows[own].drop(columns=["bx", "by"]).assign(shade=np.clip(light, *SHADE_RANGE))

    schema = T.StructType([*field.schema, T.StructField("shade", T.DoubleType())])
    return with_halo(field, 1).groupBy("bx", "by").applyInPandas(shade, schema)


def mix(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def satellite_colour(cells: DataFrame, grid: Grid) -> DataFrame:
    """(cx, cy, r, g, b) of cells (cx, cy, cls, elev, shade)."""
    lat = (F.col("cy") + 0.5) * grid.cell + grid.min_lat
    f = latitude_factors(lat)
    c = cells.withColumns(f)
    cls, elev = F.col("cls"), F.col("elev")
    sea = cls == CODES["ocean"]
    depth = F.pow(clamp(-elev / 600.0), F.lit(0.65))
    snow = F.greatest(F.col("snow_lat") * 0.9, clamp((elev - F.col("snowline")) / SNOW_BAND))
    snow = F.when(cls == CODES["lake"], snow * 0.4).otherwise(snow)
    grain = F.bround(cell_noise(F.col("cx"), F.col("cy")) * 3.0, 0) / 3.0
    c = c.withColumn("snow", snow).withColumn("light", F.when(sea, 1.0).otherwise(F.col("shade") * (1.0 + grain * 0.045)))
    out = []
    for k, name in enumerate("rgb"):
        water = mix(mix(F.lit(float(SEA_SHALLOW[k])), F.lit(float(SEA_DEEP[k])), depth), F.lit(float(ICE[k])), F.col("snow_lat") * 0.55)
        base = by_class(cls, {n: float(v[k]) for n, v in BIOME.items()}, float(BIOME["plains"][k]))
        land = mix(base, F.lit(float(SNOW[k])), F.col("snow"))
        tint = 1.0 - F.col("snow")
        land = mix(land, F.lit(float(COLD[k])), F.col("cold") * 0.20 * tint)
        land = mix(land, F.lit(float(WARM[k])), F.col("warm") * 0.22 * tint)
        out.append(clamp(F.when(sea, water).otherwise(land) * F.col("light"), 0.0, 255.0).cast("int").alias(name))
    return c.select("cx", "cy", *out)


def tile_row(lat: Column, z: Column) -> Column:
    r = F.radians(clamp(lat, -LAT_LIMIT, LAT_LIMIT))
    return (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * F.pow(F.lit(2.0), z)


def tile_range(boxes: DataFrame) -> DataFrame:
    """(z, tx, ty) of all tiles that any of boxes (z, west, south, east, north) touches, each once."""
    n = F.pow(F.lit(2.0), F.col("z"))
    last = (n - 1).cast("int")
    held = lambda c: F.least(F.greatest(c.cast("int"), F.lit(0)), last)
    column = lambda lon: held((F.col(lon) + 180) / 360 * n)
    row = lambda lat: held(tile_row(F.col(lat), F.col("z")))
    sides = boxes.select("z", column("west").alias("x0"), column("east").alias("x1"), row("north").alias("y0"), row("south").alias("y1")).distinct()
    return sides.withColumn("tx", F.explode(F.sequence("x0", "x1"))).withColumn("ty", F.explode(F.sequence("y0", "y1"))).select("z", "tx", "ty").distinct()


def pixel_axes(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(z, tx, px, lon) and (z, ty, py, lat): a pixel's longitude hangs on its column alone, its latitude on its row."""
    pixels = F.sequence(F.lit(0), F.lit(TILE - 1))
    n = F.pow(F.lit(2.0), F.col("z"))
    west, east = F.col("tx") / n * 360.0 - 180.0, (F.col("tx") + 1) / n * 360.0 - 180.0
    xs = tiles.select("z", "tx").distinct().withColumn("px", F.explode(pixels)).withColumn("lon", west + (east - west) * (F.col("px") + 0.5) / TILE)
    y = (F.col("ty") + (F.col("py") + 0.5) / TILE) / n
    ys = tiles.select("z", "ty").distinct().withColumn("py", F.explode(pixels)).withColumn("lat", F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y)))))
    return xs, ys


def pixel_to_cell_nearest(tiles: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(z, tx, px, cx) and (z, ty, py, cy)."""
    index = lambda v, low, n: F.least(F.greatest(((v - low) / grid.cell).cast("int"), F.lit(0)), F.lit(n - 1))
    xs, ys = pixel_axes(tiles)
    return (
        xs.select("z", "tx", "px", index(F.col("lon"), grid.min_lon, grid.width).alias("cx")),
        ys.select("z", "ty", "py", index(F.col("lat"), grid.min_lat, grid.height).alias("cy")),
    )


def pixel_cells(z: int, tx: int, ty: int, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Where the pixel columns and rows of a tile lie on the grid, in cells from its south-west corner."""
    n, mid = 2.0**z, (np.arange(TILE) + 0.5) / TILE
    west, east = tx / n * 360.0 - 180.0, (tx + 1) / n * 360.0 - 180.0
    lat = np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * (ty + mid) / n))))
    return (west + (east - west) * mid - grid.min_lon) / grid.cell, (lat - grid.min_lat) / grid.cell


def nearest(x: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The one cell that each pixel lies in along an axis of n cells, with weight one."""
    return [(np.clip(x.astype(np.int64), 0, n - 1), np.ones(len(x)))]


def bilinear(x: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two cells whose centres are beside each pixel along an axis of n cells, clamped, and their weights."""
    i = np.floor(x - 0.5).astype(np.int64)
    part = (x - 0.5) - np.floor(x - 0.5)
    return [(np.clip(i, 0, n - 1), 1 - part), (np.clip(i + 1, 0, n - 1), part)]


def sampled(sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The cells of an axis that pixels take, each once."""
    return np.unique(np.concatenate([i for i, _ in sides]))


def cells_under(tiles: DataFrame, cells: DataFrame, grid: Grid, values: list[str], sample, block: int = 64) -> DataFrame:
    """(z, tx, ty, cx, cy, values): for each of tiles arrays of the cells that its pixels take, block by block.

    Cells travel in blocks to the tiles that they touch; of each block only the columns and rows that are sampled go on.
    A tile takes 256 columns and rows at most, or twice as many where pixels lie between cells, at any zoom.
    """
    place = lambda c: F.floor(F.col(c) / block).cast("int")
    packed = cells.groupBy(place("cx").alias("bx"), place("cy").alias("by")).agg(*(F.collect_list(c).alias(c) for c in ("cx", "cy", *values)))
    n = F.pow(F.lit(2.0), F.col("z"))
    column = lambda t: (t / n * 360.0 - 180.0 - grid.min_lon) / grid.cell
    row = lambda t: (F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * t / n)))) - grid.min_lat) / grid.cell
    held = lambda v, count: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(count - 1.0)) / block).cast("int")
    span = lambda low, high, count: F.explode(F.sequence(held(low - 2, count), held(high + 2, count)))
    spread = tiles.select("z", "tx", "ty", span(column(F.col("tx")), column(F.col("tx") + 1), grid.width).alias("bx"))
    spread = spread.select("*", span(row(F.col("ty") + 1), row(F.col("ty")), grid.height).alias("by"))
    names = ["cx", "cy", *values]

    def trim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            kept: dict[str, list] = {c: [] for c in names}
            for r in pdf.itertuples(index=False):
                x, y = pixel_cells(r.z, r.tx, r.ty, grid)
                keep = np.isin(r.cx, sampled(sample(x, grid.width))) & np.isin(r.cy, sampled(sample(y, grid.height)))
                for c in names:
                    kept[c].append(np.asarray(getattr(r, c))[keep])
            yield pdf[["z", "tx", "ty"]].assign(**kept)

    met = spread.join(packed, ["bx", "by"]).select("z", "tx", "ty", *names)
    return met.mapInPandas(trim, met.schema)


def drawn(tiles: DataFrame, cells: DataFrame, grid: Grid, values: list[str], sample, finish, schema: str, block: int = 64) -> DataFrame:
    """finish(z, tx, ty, pixels) for each of tiles, pixels being the values of cells (cx, cy, values) weighted as sample says.

    A tile is drawn at once: a group holds the cells that its pixels take, and pixels never become rows of a shuffle.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, tx, ty = (int(pdf[c].iloc[0]) for c in ("z", "tx", "ty"))
        x, y = pixel_cells(z, tx, ty, grid)
        across, down = sample(x, grid.width), sample(y, grid.height)
        columns, rows = sampled(across), sampled(down)
        image = np.zeros((len(rows), len(columns), len(values)))
        at = np.searchsorted(rows, np.concatenate(pdf.cy.to_list())), np.searchsorted(columns, np.concatenate(pdf.cx.to_list()))
        for k, c in enumerate(values):
            image[at[0], at[1], k] = np.concatenate(pdf[c].to_list())
        out = 0.0
        for j, v in down:
            for i, u in across:
                out = out + image[np.searchsorted(rows, j)[:, None], np.searchsorted(columns, i)[None, :]] * (v[:, None] * u[None, :])[:, :, None]
        return finish(z, tx, ty, out)

    return cells_under(tiles, cells, grid, values, sample, block).groupBy("z", "tx", "ty").applyInPandas(one, schema)


def as_pixels(z: int, tx: int, ty: int, rgb: np.ndarray) -> pd.DataFrame:
    py, px = np.divmod(np.arange(TILE * TILE, dtype=np.int32), np.int32(TILE))
    flat = rgb.reshape(-1, 3).astype(np.int32)
    return pd.DataFrame({"z": z, "tx": tx, "ty": ty, "px": px, "py": py, **{c: flat[:, k] for k, c in enumerate("rgb")}})


def as_tile(z: int, tx: int, ty: int, rgb: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"z": [z], "tx": [tx], "ty": [ty], "rgb": [rgb.astype(np.uint8).tobytes()]})


PIXEL, PACKED = "z int, tx int, ty int, px int, py int, r int, g int, b int", "z int, tx int, ty int, rgb binary"


def bilinear_pixels(tiles: DataFrame, colours: DataFrame, grid: Grid) -> DataFrame:
    """(z, tx, ty, px, py, r, g, b): the four cells round each pixel, weighted, truncated."""
    finish = lambda z, tx, ty, v: as_pixels(z, tx, ty, np.floor(v + 1e-9))
    return drawn(tiles, colours, grid, ["r", "g", "b"], bilinear, finish, PIXEL)


def pack_satellite(tiles: DataFrame, colours: DataFrame, grid: Grid) -> DataFrame:
    """(z, tx, ty, rgb): one binary of TILE * TILE * 3 bytes a tile, rows from north, colours between the cells' centres."""
    finish = lambda z, tx, ty, v: as_tile(z, tx, ty, np.floor(v + 1e-9))
    return drawn(tiles, colours, grid, ["r", "g", "b"], bilinear, finish, PACKED)


def pack_tiles(tiles: DataFrame, field: DataFrame, grid: Grid) -> DataFrame:
    """(z, tx, ty, rgb): one binary of TILE * TILE * 3 bytes a tile, rows from north: elevations by the nearest cell."""
    coded = field.withColumn("c", terrain_rgb(F.col("elev"))).select("cx", "cy", "c.r", "c.g", "c.b")
    return drawn(tiles, coded, grid, ["r", "g", "b"], nearest, as_tile, PACKED)
