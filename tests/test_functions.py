import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastergrid.functions import grid, projection, scalars
from rastergrid.functions.grid import Layout


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.pad_left(lit("123456789"), 8, "0"), scalars.pad_left(lit("7"), 3, "-")) == (
        "123456789", "--7")
    assert one(spark, scalars.round_at(lit(-2.5), 0), scalars.round_at(lit(2.5), 0), scalars.round_at(lit(0.125), 2)) == (
        -2.0, 3.0, 0.13)
    assert one(spark, scalars.path_join(lit("a/"), lit("/b")), scalars.path_join(lit("a"), lit("b"))) == ("a/b", "a/b")
    assert one(spark, scalars.swap_extension(lit("/x/y.z.tif")), scalars.path_stem_glob(lit("/d.1/y.tif")),
               scalars.path_basename(lit("hdfs://h/d/y.tif"))) == ("/x/y.z.json", "/d.*", "y.tif")
    assert one(spark, scalars.nanos_to_seconds(lit(1234567890)), scalars.size_in_units(lit(1536), 1)) == (1.2346, 1.5)


def test_tile_counts_saturate(spark):
    x = F.col("x")
    df = spark.createDataFrame([(1e300,), (-1e300,), (float("nan"),), (-1.0,), (1024.0,)], "x double")
    got = [tuple(r) for r in df.select(grid.tile_floor_count(x, 1024), grid.tile_ceiling_count(x, 1024)).collect()]
    assert got == [(2**31 - 1, 2**31 - 1), (-(2**31), -(2**31)), (0, 0), (-1, 0), (1, 1)]


def test_layout_and_keys(spark):
    layout = Layout.from_cells((0.0, 0.0, 100.0, 50.0), 10.0, 10.0, 4)
    assert (layout.cols, layout.rows, layout.xmax, layout.ymin) == (3, 2, 120.0, -30.0)
    keys = spark.range(36).select((F.col("id") % 6 - 2).cast("int").alias("col"),
                                  F.expr("cast(id div 6 - 2 as int)").alias("row"))
    boxed = keys.select("*", *grid.named(layout.key_extent()))
    centre = grid.named({"c": layout.col_of("(xmin + xmax) / 2"), "r": layout.row_of("(ymin + ymax) / 2")})
    assert boxed.select("col", "row", *centre).where("c != col OR r != row").count() == 0
    assert boxed.select("col", "row", *grid.named(layout.key_range())).where(
        "cmin != col OR cmax != col OR rmin != row OR rmax != row").count() == 0
    assert boxed.select("col", "row", *grid.named(layout.key_range(closed=True))).where(
        "cmin != col - 1 OR cmax != col + 1 OR rmin != row - 1 OR rmax != row + 1").count() == 0
    assert grid.drop_negative_keys(keys).count() == 16
    assert grid.drop_negative_keys(keys, layout).count() == 6


def test_keys_are_cut_at_the_upper_bound_only(spark):
    layout = Layout.from_tile_count((0.0, 0.0, 30.0, 30.0), 3, 3, 16)
    e = spark.createDataFrame([(-15.0, 5.0, 100.0, 25.0)], "xmin double, ymin double, xmax double, ymax double")
    assert {(r.col, r.row) for r in grid.keys_for_extent(e, layout).collect()} == {
        (c, r) for c in range(-2, 3) for r in range(3)}


def test_known_northing_and_round_trip():
    x, y = projection.np_project(123.0, 45.0, 4326, 32651)
    assert abs(x - 500000) < 1e-9 and abs(y - 4982950.4002) < 1e-3
    lon, lat = np.meshgrid(np.linspace(120, 126, 13), np.linspace(-10, 20, 13))
    for epsg in (32651, 32751, 3857):
        back = projection.np_project(*projection.np_project(lon, lat, 4326, epsg), epsg, 4326)
        assert np.abs(back[0] - lon).max() < 1e-12 and np.abs(back[1] - lat).max() < 1e-12
    assert projection.np_project(123.0, -1.0, 4326, 32651)[1] < 0
    south = projection.np_project(123.0, -1.0, 4326, 32751)[1] - projection.np_project(123.0, -1.0, 4326, 32651)[1]
    assert abs(south - 1e7) < 1e-6


@pytest.mark.parametrize("src,dst", [(4326, 32651), (32651, 4326), (3857, 32651), (32651, 32650), (4326, 3857)])
def test_column_and_numpy_forms_agree(spark, src, dst):
    lon, lat = np.meshgrid(np.linspace(120, 125, 11), np.linspace(-9, 19, 11))
    x, y = projection.np_project(lon.ravel(), lat.ravel(), 4326, src)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = projection.project(df, "x", "y", src, dst, "u", "v").collect()
    for r in got:
        u, v = projection.np_project(r.x, r.y, src, dst)
        assert math.isclose(r.u, u, rel_tol=1e-12, abs_tol=1e-6) and math.isclose(r.v, v, rel_tol=1e-12, abs_tol=1e-6)


@pytest.mark.parametrize("epsg", [4269, 32600, 32661, 99999])
def test_unknown_crs_is_an_error(epsg):
    with pytest.raises(ValueError):
        projection.check_epsg(epsg)


def test_projection_stays_in_one_codegen_stage(spark, sf):
    from rastergrid.plans import queries as Q
    text = Q.QUERIES["reproject_points"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "PythonUDF" not in text and len(text) < 100_000
