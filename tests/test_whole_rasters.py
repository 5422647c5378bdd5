"""One raster that many tasks write: places, empty tiles, NoData, BigTIFF, and what raises."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastergrid.functions.grid import Layout
from rastergrid.plans import fixtures as X
from rastergrid.plans import pipelines as P
from rastergrid.sources import geotiff as T
from rastergrid.sources import sinks
from rastergrid.sources.fs import BytesReader, RangeReader

LAYOUT = Layout.from_cells((0.0, 0.0, 640.0, 640.0), 1.0, 1.0, 16)      # 40 x 40 tiles
SCHEMA = "name string, band int, col int, row int, cells array<double>"


def tile_rows(grid, name="a.tif", band=0, skip=()):
    """The 16 x 16 tiles of a grid whose corner is tile (3, 5); NaN is NULL."""
    out = []
    for r in range(grid.shape[0] // 16):
        for c in range(grid.shape[1] // 16):
            if (c, r) not in skip:
                cells = grid[r * 16:r * 16 + 16, c * 16:c * 16 + 16].ravel()
                out.append((name, band, 3 + c, 5 + r, [None if np.isnan(v) else float(v) for v in cells]))
    return out


def stored(path):
    """Header and whole bands of a file."""
    with RangeReader(str(path)) as reader:
        h = T.read_header(reader)
        bands = [np.full((h.n_rows, h.n_cols), np.inf) for _ in range(h.n_bands)]
        for b, c0, r0, w, rows, values in T.read_windows(reader, h, list(range(h.n_bands))):
            bands[b][r0:r0 + rows, c0:c0 + w] = values
    return h, bands


def grid_of(rng, rows, cols, lo=0, hi=200, holes=True):
    grid = rng.integers(lo, hi, (rows, cols)).astype(float)
    if holes:
        grid[rng.random(grid.shape) < 0.2] = np.nan
    return grid


@pytest.mark.parametrize("big", [False, True])
def test_many_tasks_write_one_file(spark, tmp_path, big):
    rng = np.random.default_rng(3)
    bands = [grid_of(rng, 96, 128), grid_of(rng, 96, 128)]
    rows = tile_rows(bands[0], skip={(2, 1), (7, 5)}) + tile_rows(bands[1], band=1)
    bands[0][16:32, 32:48] = bands[0][80:96, 112:128] = np.nan
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    assert sinks.write_whole_rasters(df, LAYOUT, 32651, str(tmp_path / "out"), "float32", big) == 1
    assert os.listdir(tmp_path / "out") == ["a.tif"] and os.listdir(tmp_path) == ["out"]
    h, got = stored(tmp_path / "out" / "a.tif")
    assert (h.n_cols, h.n_rows, h.n_bands, h.cell_type, h.epsg) == (128, 96, 2, "float32", 32651)
    assert h.extent == (48.0, 640.0 - 11 * 16, 48.0 + 128, 640.0 - 5 * 16)
    assert h.counts.count(0) == 2 and len(h.counts) == 96
    assert all(np.array_equal(g, b, equal_nan=True) for g, b in zip(got, bands))


def test_a_task_holds_one_tile_and_space_follows_the_tiles(spark, tmp_path):
    rows = [("a.tif", 0, c, r, [float(c + r)] * 256) for c, r in ((0, 0), (39, 39))]
    sinks.write_whole_rasters(spark.createDataFrame(rows, SCHEMA), LAYOUT, 32651, str(tmp_path / "out"))
    info = os.stat(tmp_path / "out" / "a.tif")
    assert info.st_size > 640 * 640 * 8 and info.st_blocks * 512 < info.st_size / 10
    h, (got,) = stored(tmp_path / "out" / "a.tif")
    assert np.nansum(got) == 78 * 256 and np.isnan(got).sum() == 640 * 640 - 512


def test_one_tile_and_several_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    one, two = grid_of(rng, 16, 16), grid_of(rng, 32, 16)
    df = spark.createDataFrame(tile_rows(one, "one.tif") + tile_rows(two, "two.tif"), SCHEMA)
    assert sinks.write_whole_rasters(df, LAYOUT, 4326, str(tmp_path / "out")) == 2
    for name, grid in (("one.tif", one), ("two.tif", two)):
        h, (got,) = stored(tmp_path / "out" / name)
        assert h.epsg == 4326 and np.array_equal(got, grid, equal_nan=True)


def test_windows_of_tiles(spark, tmp_path):
    df = spark.createDataFrame([("a.tif", 0, 0, 0, 4, 2, 3, 2, [1.0, 2.0, None, 4.0, 5.0, 6.0])],
                               "name string, band int, col int, row int, c0 int, r0 int, w int, h int, cells array<double>")
    sinks.write_whole_rasters(df, LAYOUT, 32651, str(tmp_path / "out"), "int16")
    _, (got,) = stored(tmp_path / "out" / "a.tif")
    assert np.isnan(got).sum() == 256 - 5
    assert got[2, 4:7].tolist()[:2] == [1.0, 2.0] and got[3, 4:7].tolist() == [4.0, 5.0, 6.0]


def test_empty_value_of_whole_numbers_is_the_lowest_unused(spark, tmp_path):
    grid = np.arange(512.0).reshape(16, 32) % 256
    df = spark.createDataFrame(tile_rows(grid), SCHEMA)
    sinks.write_whole_rasters(df, LAYOUT, 32651, str(tmp_path / "full"), "uint8")
    h, (got,) = stored(tmp_path / "full" / "a.tif")
    assert h.nodata is None and np.array_equal(got, grid)              # all 256 values, no empty cell
    with pytest.raises(ValueError, match="no value of uint8"):
        sinks.write_whole_rasters(spark.createDataFrame(tile_rows(grid) + [("a.tif", 0, 9, 9, [None] * 256)], SCHEMA),
                                  LAYOUT, 32651, str(tmp_path / "holes"), "uint8")
    grid[grid == 77] = np.nan
    sinks.write_whole_rasters(spark.createDataFrame(tile_rows(grid), SCHEMA), LAYOUT, 32651, str(tmp_path / "gap"), "uint8")
    h, (got,) = stored(tmp_path / "gap" / "a.tif")
    assert h.nodata == 77 and np.array_equal(got, grid, equal_nan=True)
    run = np.arange(65536.0 + 1024).reshape(-1, 1024)[:, :]            # beyond one run of values
    run = run[:(run.shape[0] // 16) * 16]
    sinks.write_whole_rasters(spark.createDataFrame(tile_rows(run), SCHEMA), Layout.from_cells((0, 0, 2000, 2000), 1, 1, 16),
                              32651, str(tmp_path / "wide"), "uint32")
    h, (got,) = stored(tmp_path / "wide" / "a.tif")
    assert h.nodata == run.size and np.array_equal(got, run)


def test_what_raises_and_nothing_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("a.tif", 0, 0, 0, [300.0] * 256)], SCHEMA)
    with pytest.raises(ValueError, match="beyond uint8"):
        sinks.write_whole_rasters(rows, LAYOUT, 32651, str(tmp_path / "out"), "uint8")
    with pytest.raises(ValueError, match="multiples of 16"):
        sinks.write_whole_rasters(rows, Layout.from_cells((0, 0, 100, 100), 1, 1, 10), 32651, str(tmp_path / "out"))
    assert sinks.write_whole_rasters(rows.limit(0), LAYOUT, 32651, str(tmp_path / "none"), "uint8") == 0
    assert os.listdir(tmp_path / "none") == []


def test_a_written_tile_may_be_written_again(tmp_path):
    from rastergrid.sources.fs import write_at
    file = T.TiledFile((2, 2), (16, 16), 1, np.dtype("<f8"), (0.0, 0.0, 32.0, 32.0), 32651, np.nan)
    path, pixels = str(tmp_path / "a.tif"), np.arange(256.0).tobytes()
    for _ in range(2):
        write_at(path, [(0, file.head)], file.n_bytes)                 # a late copy of the head keeps the tiles
        write_at(path, file.pieces(1, 0, 0, pixels))
    _, (got,) = stored(path)
    assert np.array_equal(got[:16, 16:].ravel(), np.arange(256.0)) and np.isnan(got[16:]).all()
    with pytest.raises(ValueError, match="mounted folder"):
        write_at("mock://host/a.tif", [(0, b"")])


def test_large_files_are_bigtiff_by_themselves():
    small = T.TiledFile((512, 512), (16, 16), 1, np.dtype("<f8"), (0.0, 0.0, 8192.0, 8192.0), 32651, np.nan)
    large = T.TiledFile((512, 512), (64, 64), 1, np.dtype("<f8"), (0.0, 0.0, 32768.0, 32768.0), 32651, np.nan)
    assert not small.big and large.big and large.n_bytes > 1 << 32
    content = large.head + b"\0" * (large.pixels_at - len(large.head))
    h = T.read_header(BytesReader(content))
    assert (h.n_cols, h.n_rows, h.seg_w, len(h.offsets)) == (32768, 32768, 64, 512 * 512)


def test_tile_query_writes_one_file_for_a_polygon(spark, sf, tmp_path):
    folder, features = X.write_scene_files(spark, sf), X.features(spark, sf)

    def cells(output):
        back = T.read_scenes(spark, output).select(
            F.split("scene", r"[_.]")[1].alias("fid"), "band", "xmin", "ymax", "n_cols", "w", "c0", "r0",
            F.posexplode("cells").alias("pos", "value")).where("value is not null")
        return back.select("fid", "band", F.expr("round(xmin / 8 + c0 + pos % w)").alias("gc"),
                           F.expr("round(ymax / 8 - r0 - pos div w)").alias("gr"), "value")

    blocks = P.tile_query(spark, folder, features, features, str(tmp_path / "blocks.tif"), 16, 32651)
    whole = P.tile_query(spark, folder, features, features, str(tmp_path / "whole.tif"), 16, 32651, whole_files=True)
    a, b = cells(blocks["output"]), cells(whole["output"])
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < b.count()
    names = {name.split("_")[1] for name in os.listdir(blocks["output"]) if name.endswith(".tif")}
    assert whole["mosaics"] == len(names) and set(os.listdir(whole["output"])) == {f"mosaic_{n}.tif" for n in names}
