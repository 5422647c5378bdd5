"""Where a CRS ends: points without coordinates, layers that are cut, outlines of bounded error."""

import numpy as np
import pytest

from rastergrid.functions import projection as J
from rastergrid.functions.grid import Layout
from rastergrid.model import SCENE_SCHEMA, LayerMeta
from rastergrid.operators import rasters as R


def test_points_beyond_a_domain_have_no_coordinates(spark):
    cases = [(123.0, 10.0, True, True), (152.9, 0.0, True, True), (153.1, 0.0, False, True), (-57.0, 5.0, False, True),
             (123.0, 86.0, True, False), (123.0, 91.0, False, False), (483.0, 10.0, True, True)]
    df = spark.createDataFrame(cases, "lon double, lat double, utm boolean, web boolean")
    for epsg, known in ((32651, "utm"), (3857, "web")):
        got = J.project(df, "lon", "lat", 4326, epsg, "x", "y").collect()
        assert all((r.x is not None) == (r.y is not None) == r[known] for r in got)
        x, y = J.np_project([c[0] for c in cases], [c[1] for c in cases], 4326, epsg)
        assert (~np.isnan(x)).tolist() == (~np.isnan(y)).tolist() == [r[known] for r in got]
    back = J.project(spark.createDataFrame([(9e6, 0.0), (5e5, 0.0)], "x double, y double"), "x", "y", 32651, 4326, "lon", "lat")
    assert [r.lon is None for r in back.collect()] == [True, False]


def test_rectangles_are_cut_at_the_zone_and_at_the_end_of_the_map():
    world = (-180.0, -90.0, 180.0, 90.0)
    assert J.cut_to_domain(world, 4326, 32651) == [(93.0, -90.0, 153.0, 90.0)]
    assert J.cut_to_domain(world, 4326, 32601) == [(-180.0, -90.0, -147.0, 90.0), (153.0, -90.0, 180.0, 90.0)]
    assert J.cut_to_domain((0.0, 0.0, 10.0, 10.0), 4326, 32651) == []
    ((_, south, _, north),) = J.cut_to_domain(world, 4326, 3857)
    assert -south == north == pytest.approx(85.0511287798)


@pytest.mark.parametrize("cell", [50_000.0, 1_000.0])
def test_outline_of_a_world_wide_layer(cell):
    """Bounds by a much finer walk along the edges; 65 points an edge miss whole cells of the second."""
    meta = LayerMeta(4326, "float64", (-180.0, -80.0, 180.0, 84.0), 0.5, 0.5)
    layout = R.target_layout(meta, 32651, 16, cell)
    px, py = J.outline((93.0, -80.0, 153.0, 84.0), 4326, 32651, None, 1 << 18)
    assert layout.xmin == np.floor(px.min() / cell) * cell and layout.ymax == np.ceil(py.max() / cell) * cell
    assert layout.xmax >= px.max() > layout.xmax - 17 * cell and layout.ymin <= py.min() < layout.ymin + 17 * cell


def test_layers_at_and_over_a_pole():
    polar = LayerMeta(4326, "float64", (100.0, 80.0, 140.0, 90.0), 0.5, 0.5)
    layout = R.target_layout(polar, 32651, 16, 10_000.0)
    pole = J.np_project(123.0, 90.0, 4326, 32651)[1]
    assert layout.ymax - 10_000 < pole <= layout.ymax
    over = LayerMeta(32651, "float64", (4e5, float(pole) - 1e5, 6e5, float(pole) + 1e5), 1e3, 1e3)
    with pytest.raises(ValueError, match="leaves the domain"):
        R.target_layout(over, 4326, 16)
    with pytest.raises(ValueError, match="no part of the layer"):
        R.target_layout(LayerMeta(4326, "float64", (0.0, 0.0, 10.0, 10.0), 0.5, 0.5), 32651, 16)


@pytest.mark.parametrize("epsg,zone", [(32651, 123.0), (32601, -177.0)])
def test_a_world_wide_raster_in_one_zone(spark, epsg, zone):
    """Cells hold their own longitude, so each target cell shows whether it came from the right place."""
    lon, lat = -178.0 + 4 * np.arange(90), 88.0 - 4 * np.arange(45)
    grid = np.cos(np.radians(lon[None, :] - zone)) * 100 + 0 * lat[:, None]
    row = ("w.tif", 0, 4326, -180.0, -90.0, 180.0, 90.0, 90, 45, "float64", 0, 0, 0, 90, 45, grid.ravel().tolist())
    scenes = spark.createDataFrame([row], SCENE_SCHEMA)
    meta = R.read_layer_meta(scenes)
    source = R.floating_layout(meta, 16)
    target = R.target_layout(meta, epsg, 16, 100_000.0)
    got = R.tile_cells(R.reproject_tiles(R.tile_to_layout(scenes, source), meta, source, epsg, target), target).collect()
    gc, gr = np.meshgrid(np.arange(target.cols * 16), np.arange(target.rows * 16))
    u, v = J.np_project(target.xmin + (gc + 0.5) * 1e5, target.ymax - (gr + 0.5) * 1e5, epsg, 4326)
    want = {(int(c), int(r)): np.cos(np.radians(w - zone)) * 100
            for c, r, w in zip(gc.ravel(), gr.ravel(), u.ravel()) if not np.isnan(w)}
    assert {(r.gc, r.gr) for r in got} == set(want) and len(want) > 5000
    assert max(abs(r.value - want[r.gc, r.gr]) for r in got) < 2.5      # half a cell of 4 degrees, at most
