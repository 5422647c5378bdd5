import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastergrid.functions.grid import Layout
from rastergrid.model import SCENE_SCHEMA, LayerMeta
from rastergrid.operators import kernels as K
from rastergrid.operators import rasters as R
from rastergrid.plans import fixtures as X
from rastergrid.plans import pipelines as P
from rastergrid.session import materialize
from test_geometry import meets


def scene(order, xmin, ymax, cell, grid, band=0, epsg=32651, window=None):
    h, w = grid.shape
    c0, r0, c1, r1 = window or (0, 0, w, h)
    part = [None if np.isnan(v) else float(v) for v in grid[r0:r1, c0:c1].ravel()]
    return (f"s{order:03d}", order, epsg, xmin, ymax - h * cell, xmin + w * cell, ymax, w, h, "float64",
            band, c0, r0, c1 - c0, r1 - r0, part)


def cells_of(tiles, layout):
    return {(r.band, r.gc, r.gr): r.value for r in R.tile_cells(tiles, layout).collect()}


def random_grid(rng, h, w, holes=0.2):
    g = rng.integers(0, 1000, (h, w)).astype(float)
    g[rng.random((h, w)) < holes] = np.nan
    return g


def sample(grid, xmin, ymax, cell, x, y):
    """One bilinear sample by hand."""
    h, w = grid.shape
    fx = min(max((x - xmin) / cell - 0.5, 0), w - 1)
    fy = min(max((ymax - y) / cell - 0.5, 0), h - 1)
    c, r, top, bottom = int(fx), int(fy), 0.0, 0.0
    for dr in (0, 1):
        for dc in (0, 1):
            wt = (fx - c if dc else 1 - fx + c) * (fy - r if dr else 1 - fy + r)
            if wt > 0 and not np.isnan(grid[r + dr, c + dc]):
                top += wt * grid[r + dr, c + dc]
                bottom += wt
    return top / bottom if bottom else None


@pytest.fixture(scope="module")
def stack(spark):
    rng = np.random.default_rng(5)
    grids = [(i, 8.0 * int(rng.integers(0, 6)), 128.0 - 8.0 * int(rng.integers(0, 6)),
              random_grid(rng, 9, 11)) for i in range(9)]
    return grids, spark.createDataFrame([scene(i, x, y, 8.0, g) for i, x, y, g in grids], SCENE_SCHEMA)


def expected(grids, layout, n):
    out = {}
    for gr in range(-2, n):
        for gc in range(-2, n):
            x = layout.xmin + (gc + 0.5) * layout.cell_w
            y = layout.ymax - (gr + 0.5) * layout.cell_h
            for _, sx, sy, g in grids:
                if sx <= x < sx + g.shape[1] * 8 and sy - g.shape[0] * 8 < y <= sy:
                    v = sample(g, sx, sy, 8.0, x, y)
                    if v is not None:
                        out[(0, gc, gr)] = v
                        break
    return out


@pytest.mark.parametrize("corner,cell", [((0.0, 128.0), 8.0), ((4.0, 124.0), 8.0), ((2.0, 127.0), 4.0)])
@pytest.mark.parametrize("fan_in", [2, 256])
def test_tiling_against_brute_force(stack, corner, cell, fan_in):
    grids, df = stack
    layout = Layout.from_cells((corner[0], corner[1] - 160, corner[0] + 160, corner[1]), cell, cell, 8)
    got = cells_of(R.tile_to_layout(df, layout, fan_in=fan_in), layout)
    want = expected(grids, layout, int(160 / cell))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_windows_and_partitions_do_not_change_the_result(spark, stack):
    grids, df = stack
    layout = Layout.from_cells((2.0, -33.0, 162.0, 127.0), 4.0, 4.0, 8)
    whole = cells_of(R.tile_to_layout(df, layout), layout)
    cuts = [(0, 0, 4, 9), (4, 0, 11, 3), (4, 3, 11, 9)]
    split = spark.createDataFrame(
        [scene(i, x, y, 8.0, g, window=c) for i, x, y, g in reversed(grids) for c in cuts], SCENE_SCHEMA)
    for n in (1, 7, 64):
        got = cells_of(R.tile_to_layout(split.repartition(n), layout), layout)
        assert got.keys() == whole.keys()
        assert all(abs(got[k] - whole[k]) < 1e-9 for k in whole)


def test_an_all_null_scene_still_makes_its_tiles(spark):
    df = spark.createDataFrame([scene(0, 0.0, 128.0, 8.0, np.full((4, 4), np.nan))], SCENE_SCHEMA)
    layout = Layout.from_cells((0.0, 0.0, 128.0, 128.0), 8.0, 8.0, 4)
    tiles = R.tile_to_layout(df, layout)
    assert [(r.col, r.row, set(r.cells)) for r in tiles.collect()] == [(0, 0, {None})]


def test_one_cell_raster(spark):
    df = spark.createDataFrame([scene(0, 0.0, 8.0, 8.0, np.array([[3.0]]))], SCENE_SCHEMA)
    layout = Layout.from_cells((0.0, 0.0, 8.0, 8.0), 2.0, 2.0, 4)
    assert set(cells_of(R.tile_to_layout(df, layout), layout).values()) == {3.0}


def test_mixed_crs_is_an_error(spark):
    g = np.ones((2, 2))
    df = spark.createDataFrame([scene(0, 0.0, 8.0, 4.0, g), scene(1, 0.0, 8.0, 4.0, g, epsg=4326)], SCENE_SCHEMA)
    with pytest.raises(ValueError):
        R.read_layer_meta(df)
    with pytest.raises(ValueError):
        R.read_layer_meta(df.where("false"))


def test_kernel_tiles_equal_the_column_built_tiles(spark, sf):
    built = cells_of(X.tiles(spark, sf), X.L16)
    kernel = cells_of(R.tile_to_layout(X.scenes(spark, sf), X.L16), X.L16)
    assert built == kernel


def test_mask_keeps_tiles_by_geometry_alone(spark):
    """A tile with a centre inside stays even when all its cells are NULL."""
    tiles = spark.createDataFrame([(0, 0, 0, [None] * 16), (1, 0, 0, [1.0] * 16)],
                                  "col int, row int, band int, cells array<double>")
    layout = Layout(0.0, 0.0, 64.0, 64.0, 16, 16, 4, 4)
    square = spark.createDataFrame(
        [(7, "multipolygon", [(0, 0, [(0.0, 60.0), (6.0, 60.0), (6.0, 64.0), (0.0, 64.0), (0.0, 60.0)])],
          {}, 0.0, 60.0, 6.0, 64.0)],
        "fid bigint, geom_type string, rings array<struct<part:int,ring:int,pts:array<struct<x:double,y:double>>>>, "
        "attrs map<string,string>, xmin double, ymin double, xmax double, ymax double")
    masked = {(r.col, r.row): (r.c0, r.r0, r.w, r.h, r.cells) for r in R.mask_tiles(tiles, square, layout).collect()}
    assert set(masked) == {(0, 0), (1, 0)}
    assert masked[(0, 0)] == (0, 0, 4, 4, [None] * 16)
    assert masked[(1, 0)] == (0, 0, 2, 4, [1.0] * 8)


def test_lines_and_points_mask_nothing(spark, sf):
    tiles = materialize(X.tiles(spark, sf))
    kinds = X.kinds(spark, sf)
    masked = R.mask_tiles(tiles, kinds, X.L16)
    own = {r.fid for r in kinds.where("geom_type IN ('polygon', 'multipolygon')").collect()}
    assert {r.fid for r in masked.select("fid").distinct().collect()} <= own


def test_crowded_tiles_travel_once_for_each_list(spark, sf):
    tiles, features = materialize(X.tiles(spark, sf)), X.features(spark, sf)
    want = R.tile_cells(R.mask_tiles(tiles, features, X.L16), X.L16, keep=["fid"])
    got = R.tile_cells(R.mask_tiles(tiles, features, X.L16, per_row=2), X.L16, keep=["fid"])
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0 < want.count()


def test_centres_inside_against_one_edge_at_a_time():
    rng = np.random.default_rng(3)
    x, y = np.arange(20) + 0.5, 20 - np.arange(16) - 0.5
    for n in (0, 1, 7, 40):
        edges = rng.integers(-2, 24, (n, 4)) / 2.0
        want = np.zeros((16, 20), bool)
        for x1, y1, x2, y2 in edges:
            for r, c in np.ndindex(want.shape):
                want[r, c] ^= (y1 > y[r]) != (y2 > y[r]) and x[c] < (x2 - x1) * (y[r] - y1) / (y2 - y1) + x1
        assert (K.centres_inside(edges, x, y) == want).all()


def test_mask_without_polygons_is_empty(spark, sf):
    none = X.features(spark, sf).where("false")
    assert R.mask_tiles(X.tiles(spark, sf), none, X.L16).count() == 0


def test_stitched_blocks_are_the_whole_mosaic(spark, sf):
    masked = materialize(R.mask_tiles(X.tiles(spark, sf), X.features(spark, sf), X.L16))
    cells = {(r.fid, r.band, r.gc, r.gr): r.value
             for r in R.tile_cells(masked, X.L16, keep=["fid"]).collect()}
    for block in (1, 2, 64):
        got = R.mosaic_cells(R.stitch(masked, X.L16, block)).collect()
        assert {(r.fid, r.band, r.gc, r.gr): r.value for r in got} == cells
    one = R.stitch(masked, X.L16, 64)
    assert one.count() == one.select("fid", "band").distinct().count()


def test_reprojection_against_brute_force(spark):
    from rastergrid.functions.projection import np_project
    rng = np.random.default_rng(11)
    grid = random_grid(rng, 24, 24)
    cell = 1 / 512
    df = spark.createDataFrame([scene(0, 120.0, 1.0, cell, grid, epsg=4326)], SCENE_SCHEMA)
    meta = R.read_layer_meta(df)
    source = R.floating_layout(meta, 8)
    target = R.target_layout(meta, 32651, 8, 300.0)
    got = cells_of(R.reproject_tiles(R.tile_to_layout(df, source), meta, source, 32651, target), target)
    want = {}
    for gr in range(-1, target.rows * 8 + 1):
        for gc in range(-1, target.cols * 8 + 1):
            lon, lat = np_project(target.xmin + (gc + 0.5) * 300, target.ymax - (gr + 0.5) * 300, 32651, 4326)
            if 120 <= lon < 120 + 24 * cell and 1 - 24 * cell < lat <= 1:
                v = sample(grid, 120.0, 1.0, cell, float(lon), float(lat))
                if v is not None:
                    want[(0, gc, gr)] = v
    assert abs(len(got.keys() ^ want.keys())) == 0
    assert max(abs(got[k] - want[k]) for k in want) < 1.0      # positions are rounded to 1/4096 cell


def test_reprojection_keeps_the_cell_count_by_default():
    meta = LayerMeta(4326, "float64", (120.0, 0.0, 121.0, 1.0), 1 / 512, 1 / 512)
    layout = R.target_layout(meta, 32651, 64)
    assert 0.95 < layout.cell_w / (111_320 / 512) < 1.05


def test_merge_kernel_crosses_batches():
    import pyarrow as pa
    rows = [(0, 0, 0, 0, [1.0, np.nan]), (0, 0, 0, 1, [5.0, 2.0]), (1, 0, 0, 0, [7.0, 7.0])]

    def batch(part):
        out = K.BatchWriter(K._PIECE_FIELDS)
        for c, r, b, o, v in part:
            v = np.array(v)
            out.add(c, r, b, o, 0, 0, 2, 1, np.nan_to_num(v), (~np.isnan(v)).astype(float))
        return out.drain()[0]

    merged = pa.Table.from_batches(K.merge_sorted_pieces(2, 1)([batch([x]) for x in rows])).to_pylist()
    assert [(m["col"], m["cells"]) for m in merged] == [(0, [1.0, 2.0]), (1, [7.0, 7.0])]


def test_tile_and_query_pipeline(spark, sf, tmp_path):
    folder = X.write_scene_files(spark, sf)
    features = X.features(spark, sf)
    done = P.tile_query(spark, folder, features, features, str(tmp_path / "out.tif"), 16, 32651)
    assert done["mosaics"] == spark.read.format("binaryFile").load(str(tmp_path / "out.tif")).count() > 0
    keys = done["tiles"].select("col", "row").distinct().collect()     # also tiles without data
    w, h, layout = done["layout"].tile_w, done["layout"].tile_h, done["layout"]
    boxes = [(layout.xmin + k.col * w, layout.ymax - (k.row + 1) * h, layout.xmin + (k.col + 1) * w, layout.ymax - k.row * h)
             for k in keys]
    met = {str(f.fid) for f in features.collect() if any(meets(f, *box) for box in boxes)}
    found = spark.read.json(str(tmp_path / "out.json")).collect()
    assert sorted(r.UID for r in found) == sorted(met) and met


def test_curve_sort_is_a_permutation(spark, sf):
    keys = X.tile_keys(spark, sf)
    ordered = R.sort_by_curve(keys, "hilbert", 8, 3)
    assert ordered.select("col", "row").exceptAll(keys).count() == 0
    assert ordered.rdd.getNumPartitions() <= 3
    parts = ordered.withColumn("p", F.spark_partition_id()).groupBy("p").agg(
        F.min("sfc").alias("a"), F.max("sfc").alias("b")).orderBy("a").collect()
    assert all(p.b < q.a for p, q in zip(parts, parts[1:]))


def test_small_mosaics_do_not_keep_whole_blocks():
    """A block of 64 x 64 tiles takes 8 MB; what waits for the next batch is the cropped part alone."""
    rows = [{"fid": n, "band": 0, "block_col": 0, "block_row": 0, "col": n % 64, "row": 3, "c0": n % 15, "r0": 2,
             "w": 2, "h": 1, "cells": [float(n), None]} for n in range(40)]
    batch = pa.RecordBatch.from_pylist(rows)
    tracemalloc.start()
    got = [r for out in K.stitch_sorted_tiles(16, 16, 64)([batch]) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert [(r["fid"], r["gc0"], r["gr0"], r["n_cols"], r["n_rows"], r["cells"]) for r in got] == [
        (n, n % 64 * 16 + n % 15, 50, 2, 1, [float(n), None]) for n in range(40)]


def test_rows_that_wait_own_their_cells():
    """A view of a batch would keep all of it until the next batch is full."""
    out = K.BatchWriter([("n", pa.int32()), ("cells", pa.list_(pa.float64()))])
    strip = np.arange(1000.0)
    out.add(1, strip[3:5])
    strip[:] = 0
    assert out.rows[0][1].base is None
    assert out.drain()[0].to_pylist() == [{"n": 1, "cells": [3.0, 4.0]}]


def test_wide_batches_are_read_in_pieces():
    """Cells of a whole batch as numbers would double what the batch itself takes."""
    cells = pa.ListArray.from_arrays(pa.array(range(0, 4_000_001, 10_000), pa.int32()), pa.array(np.arange(4e6)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), cells], ["n", "cells"])
    seen, widest = [], 0
    for (n,), (own,) in K.rows_of([batch], ["n"], ["cells"]):
        seen.append((n, own[0], own.size))
        widest = max(widest, own.base.size if own.base is not None else own.size)
    assert seen == [(n, 1e4 * n, 10_000) for n in range(400)]
    assert widest <= 600_000
    empty = batch.slice(0, 0)
    assert list(K.rows_of([empty], ["n"], ["cells"])) == []
