"""What a scan does not read: files, bytes, bands, row groups, and records that are not there."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rastergrid.functions import sfc
from rastergrid.functions.grid import Layout
from rastergrid.operators import rasters as R
from rastergrid.plans import fixtures as X
from rastergrid.sources import geotiff as T
from rastergrid.sources import shapefile as S


@pytest.fixture
def folder(tmp_path):
    """Ten rasters of two bands side by side."""
    for i in range(10):
        bands = [np.arange(64.0 * 64).reshape(64, 64) + 10_000 * b + i for b in (0, 1)]
        (tmp_path / f"s{i:02d}.tif").write_bytes(T.encode_geotiff(bands, (64.0 * i, 0.0, 64.0 * (i + 1), 64.0), 32651))
    return str(tmp_path)


@pytest.fixture
def reads(monkeypatch):
    """Files opened and bytes read in this process."""
    seen = {"files": set(), "bytes": 0}

    class Counting(T.RangeReader):
        def __init__(self, path):
            super().__init__(path)
            seen["files"].add(path)

        def read(self, at, n):
            seen["bytes"] += n
            return super().read(at, n)

    monkeypatch.setattr(T, "RangeReader", Counting)
    return seen


def scan(folder, **options):
    reader = T.GeoTiffReader({"path": folder, **options})
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


def test_files_of_other_names_are_not_opened(folder, reads):
    rows = scan(folder, scenes='["s03.tif", "s07.tif", "none.tif"]')
    assert {r["scene"] for r in rows} == {"s03.tif", "s07.tif"} and len(reads["files"]) == 2
    assert {r["ord"] for r in rows} == {3, 7}


def test_only_headers_are_read_of_files_elsewhere(folder, reads):
    whole = scan(folder)
    every, reads["bytes"] = reads["bytes"], 0
    rows = scan(folder, extent="330,10,380,20")
    assert {r["scene"] for r in rows} == {"s05.tif"} and len(whole) == 20
    assert reads["bytes"] < 0.2 * every


def test_other_bands_are_not_read(folder, reads):
    scan(folder)
    every, reads["bytes"] = reads["bytes"], 0
    rows = scan(folder, bands="1")
    assert {r["band"] for r in rows} == {1} and reads["bytes"] < 0.6 * every
    assert scan(folder, bands="5") == []


def test_pruned_scans_and_whole_ones_in_one_session(spark, folder):
    some = T.read_scenes(spark, folder, [1], scenes=["s02.tif"])
    assert [tuple(r) for r in some.select("scene", "band", F.array_max("cells")).collect()] == [("s02.tif", 1, 10_000 + 64 * 64 + 1.0)]
    touched = T.read_scenes(spark, folder, extent=(64.0, 0.0, 128.0, 1.0)).select("scene").distinct()
    assert {r.scene for r in touched.collect()} == {"s00.tif", "s01.tif", "s02.tif"}
    every = T.read_scenes(spark, folder)
    assert every.where("scene = 's02.tif' AND band = 1").count() == 1
    assert every.where("xmin >= 512 OR scene = 's00.tif'").select("scene").distinct().count() == 3


@pytest.mark.parametrize("strip_cells", [1 << 20, 64 * 16])
@pytest.mark.parametrize("deflate", [False, True])
def test_shares_begin_inside_a_strip(tmp_path, reads, strip_cells, deflate):
    grid = np.arange(64.0 * 50).reshape(50, 64)
    (tmp_path / "one.tif").write_bytes(T.encode_geotiff([grid, grid + 0.5], (0, 0, 64, 50), 32651, deflate=deflate, strip_cells=strip_cells))
    reader = T.GeoTiffReader({"path": str(tmp_path), "target_bytes": "10000", "window_cells": "320"})
    parts = reader.partitions()
    assert deflate or len(parts) >= 2
    got, rows = np.full((2, 50, 64), np.nan), []
    for part in parts:
        n = 0
        for batch in reader.read(part):
            for r in batch.to_pylist():
                got[r["band"], r["r0"]:r["r0"] + r["h"], r["c0"]:r["c0"] + r["w"]] = np.reshape(r["cells"], (r["h"], r["w"]))
                n += r["h"]
        rows.append(n)
    assert (got == np.stack([grid, grid + 0.5])).all()
    if not deflate:
        assert min(rows) > 0 and max(rows) < 2 * 100 / len(parts) + 10


def test_intervals_hold_the_rectangle_and_no_more_where_there_are_enough():
    rng = np.random.default_rng(1)
    for label in (sfc.HILBERT, sfc.ZORDER):
        for _ in range(20):
            c0, r0 = rng.integers(-3, 30, 2).tolist()
            c1, r1 = c0 + int(rng.integers(0, 12)), r0 + int(rng.integers(0, 12))
            keys = {sfc.key_index(label, c, r, 5) for c in range(max(c0, 0), min(c1, 31) + 1) for r in range(max(r0, 0), min(r1, 31) + 1)}
            exact = sfc.key_intervals(label, c0, r0, c1, r1, 5, 1000)
            assert {k for a, b in exact for k in range(a, b + 1)} == keys
            few = sfc.key_intervals(label, c0, r0, c1, r1, 5, 3)
            assert len(few) <= 3 and keys <= {k for a, b in few for k in range(a, b + 1)}
            assert all(a <= b < c for (a, b), (c, _) in zip(few, few[1:]))
    assert sfc.key_intervals(sfc.HILBERT, 5, 5, 4, 9, 5) == [] == sfc.key_intervals(sfc.ZORDER, -9, -9, -1, -1, 5)
    assert len(sfc.key_intervals(sfc.HILBERT, 3, 3, 2**31 - 7, 2**31 - 5, 31)) <= 64
    with pytest.raises(ValueError):
        sfc.key_intervals("peano", 0, 0, 1, 1, 5)


@pytest.mark.parametrize("label", [sfc.HILBERT, sfc.ZORDER])
def test_key_index_equals_the_column_form(spark, label):
    keys = [(0, 0), (5, 3), (2**31 - 1, 0), (2**31 - 1, 2**31 - 1), (123456789, 987654321)]
    df = spark.createDataFrame(keys, "col int, row int")
    got = df.select(sfc.sfc_index(label, F.col("col"), F.col("row"), 31, 31).alias("i")).collect()
    assert [r.i for r in got] == [sfc.key_index(label, c, r, 31) for c, r in keys]


def test_few_row_groups_hold_an_envelope(spark, tmp_path):
    layout = Layout(0.0, 0.0, 64.0, 64.0, 64, 64, 1, 1)
    tiles = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("col"), F.expr("cast(id div 64 as int)").alias("row"),
                                        F.lit(0).alias("band"), F.array(F.col("id").cast("double")).alias("cells"))
    path = str(tmp_path / "tiles")
    R.sort_by_curve(tiles, sfc.HILBERT, 6, 64).write.parquet(path)
    table = spark.read.parquet(path)
    extent = (10.0, 40.0, 18.0, 48.0)
    found = R.tiles_on_curve(table, layout, extent, sfc.HILBERT, 6)
    want = R.tiles_in_envelope(table, layout, extent)
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 and want.count() == 64
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().toString() or "GreaterThanOrEqual(sfc" in found._jdf.queryExecution().toString()
    intervals = sfc.key_intervals(sfc.HILBERT, *R.envelope_keys(layout, extent), 6)
    bounds = []
    for file in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("sfc")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            bounds.append((stats.min, stats.max))
    read = sum(any(a <= high and b >= low for a, b in intervals) for low, high in bounds)
    assert len(bounds) >= 32 and read <= 0.2 * len(bounds)


def test_deleted_records_are_left_out_and_code_pages_read(spark, tmp_path, sf):
    rows = [r.asDict(recursive=True) for r in X.kinds(spark, sf).where("geom_type = 'polygon'").collect()]
    rows = [{**r, "attrs": dict(r["attrs"])} for r in (rows * 4)[:4]]
    for r in rows:
        r["attrs"]["NAME"] = "?"
    files = X.encode_shapefile("polygon", rows)
    head, record = 32 * 4 + 1, 1 + 18 + 32 + 9
    dbf = bytearray(files[".dbf"])
    dbf[head + record] = ord("*")
    word = "Žluťoučký".encode("cp1250")
    at = head + 2 * record + 1 + 18
    dbf[at:at + len(word)] = word
    for ext, content in {**files, ".dbf": bytes(dbf), ".cpg": b"cp1250\n"}.items():
        (tmp_path / f"p{ext}").write_bytes(content)
    for path in (str(tmp_path), str(tmp_path / "p.shp")):
        got = {r.fid: r.attrs["NAME"] for r in S.read_features(spark, path).collect()}
        assert sorted(got) == [0, 2, 3] and got[2] == "Žluťoučký"
    latin = {r.fid: r.attrs["NAME"] for r in S.read_features(spark, str(tmp_path), encoding="latin-1").collect()}
    assert latin[2] == word.decode("latin-1")


def test_footprint_of_the_filtered_tiles(spark, sf, tmp_path):
    from rastergrid.plans import pipelines as P
    folder, features = X.write_scene_files(spark, sf), X.features(spark, sf)
    one = features.where("fid = (SELECT min(s_suppkey) FROM parquet.`{}/supplier.parquet` WHERE s_suppkey % 4 = 0)".format(sf))
    found = {}
    for part in (False, True):
        out = str(tmp_path / f"{part}.tif")
        P.tile_query(spark, folder, features, one, out, 16, 32651, filtered_footprint=part)
        found[part] = {r.UID for r in spark.read.schema("UID string").json(out[:-4] + ".json").collect()}
    assert found[True] <= found[False]
