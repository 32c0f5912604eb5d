"""Tiles at any zoom take a bounded number of cells, and are what a plain painter draws."""

import numpy as np
import pytest

from wayloom.operators import tiles as t
from wayloom.operators.raster import Grid

GRID = Grid(-170.0, -80.0, 0.125, 2720, 1280)


@pytest.fixture(scope="module")
def cells(spark):
    n = spark.range(GRID.width * GRID.height)
    return n.selectExpr(f"CAST(id % {GRID.width} AS INT) AS cx", f"CAST(id div {GRID.width} AS INT) AS cy").selectExpr("cx", "cy", "CAST((cx * 7 + cy) % 251 AS DOUBLE) AS r", "CAST(cx % 250 AS DOUBLE) AS g", "CAST(cy % 240 AS DOUBLE) AS b").cache()


@pytest.mark.parametrize("sample, most", [(t.nearest, 65_536), (t.bilinear, 4 * 65_536)])
def test_a_tile_over_the_whole_map_takes_few_cells(spark, cells, sample, most):
    one = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (5, 17, 12)], "z int, tx int, ty int")
    taken = t.cells_under(one, cells, GRID, ["r", "g", "b"], sample).selectExpr("z", "size(cx) AS n").groupBy("z").sum("n").collect()
    assert {r.z for r in taken} == {0, 1, 5} and all(0 < r[1] <= most for r in taken)
    packed = {r.z: np.frombuffer(r.rgb, np.uint8).reshape(256, 256, 3) for r in t.drawn(one, cells, GRID, ["r", "g", "b"], sample, lambda z, x, y, v: t.as_tile(z, x, y, np.floor(v + 1e-9)), t.PACKED).collect()}
    whole = np.zeros((GRID.height, GRID.width, 3))
    y, x = np.mgrid[: GRID.height, : GRID.width]
    whole[..., 0], whole[..., 1], whole[..., 2] = (x * 7 + y) % 251, x % 250, y % 240
    for z, tx, ty in ((0, 0, 0), (1, 0, 1), (5, 17, 12)):
        px, py = t.pixel_cells(z, tx, ty, GRID)
        want = sum(whole[j[:, None], i[None, :]] * (v[:, None] * u[None, :])[:, :, None] for j, v in sample(py, GRID.height) for i, u in sample(px, GRID.width))
        assert (packed[z] == np.floor(want + 1e-9).astype(np.uint8)).all()


def test_satellite_tiles_are_their_pixels(spark, cells):
    one = spark.createDataFrame([(3, 2, 3)], "z int, tx int, ty int")
    packed = np.frombuffer(t.pack_satellite(one, cells, GRID).first().rgb, np.uint8).reshape(256, 256, 3)
    pixels = t.bilinear_pixels(one, cells, GRID).toPandas()
    assert (packed[pixels.py, pixels.px] == pixels[["r", "g", "b"]].to_numpy()).all() and len(pixels) == 65_536


@pytest.mark.parametrize("width, height", [(65, 129), (130, 64), (7, 5)])
def test_blur_and_relief_over_blocks(spark, width, height):
    rng = np.random.default_rng(width)
    field = rng.uniform(-600, 4000, (height, width))
    grid = Grid(0.0, 0.0, 1.0, width, height)
    df = spark.createDataFrame([(x, y, float(field[y, x]), "kept") for y in range(height) for x in range(width)], "cx int, cy int, elev double, name string")
    want = np.pad(field, 9, mode="symmetric")
    for axis in (0, 1):
        want = np.apply_along_axis(np.convolve, axis, want, t.kernel(9), "valid")
    got = t.blur_field(df, grid).toPandas()
    assert len(got) == width * height and np.allclose(want[got.cy, got.cx], got.elev)
    edge = np.pad(field, 1, mode="edge")
    # the edge itself counts as the cell beyond it
    light = 1.0 + ((edge[1:-1, 2:] - edge[1:-1, :-2]) * t.LIGHT[0] + (edge[2:, 1:-1] - edge[:-2, 1:-1]) * t.LIGHT[1]) * t.SHADE_STRENGTH
    shaded = t.relief_shade(df).toPandas()
    assert set(shaded.name) == {"kept"} and len(shaded) == width * height
    assert np.allclose(np.clip(light, *t.SHADE_RANGE)[shaded.cy, shaded.cx], shaded.shade)
