import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastergrid.functions.grid import Layout
from rastergrid.plans import fixtures as X
from rastergrid.sources import files, geotiff, shapefile, sinks
from rastergrid.sources.fs import BytesReader


def hand_made_tiff(order, grid, deflate=False, tile=None, rows_per_strip=None, dtype="u2", nodata=None,
                   point_raster=False):
    """A chunky TIFF built field by field, apart from the writer under test."""
    h, w, n = grid.shape
    data = grid.astype(np.dtype(dtype).newbyteorder(order))
    segments = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                block = np.zeros((tile, tile, n), data.dtype)
                part = data[r:r + tile, c:c + tile]
                block[:part.shape[0], :part.shape[1]] = part
                segments.append(block.tobytes())
    else:
        segments = [data[r:r + rows_per_strip].tobytes() for r in range(0, h, rows_per_strip)]
    if deflate:
        segments = [zlib.compress(s) for s in segments]
    body, offsets = b"", []
    for s in segments:
        offsets.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    geo = (1, 1, 0, 2, 1025, 0, 1, 2 if point_raster else 1, 3072, 0, 1, 32651)
    kind = {"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind]
    values = {256: ("H", (w,)), 257: ("H", (h,)), 258: ("H", (data.dtype.itemsize * 8,) * n),
              259: ("H", (8 if deflate else 1,)), 277: ("H", (n,)), 284: ("H", (1,)), 339: ("H", (kind,) * n),
              33550: ("d", (10.0, 20.0, 0.0)), 33922: ("d", (0.0, 0.0, 0.0, 100.0, 900.0, 0.0)), 34735: ("H", geo)}
    if tile:
        values |= {322: ("H", (tile,)), 323: ("H", (tile,)), 324: ("I", tuple(offsets)),
                   325: ("I", tuple(len(s) for s in segments))}
    else:
        values |= {273: ("I", tuple(offsets)), 278: ("H", (rows_per_strip,)),
                   279: ("I", tuple(len(s) for s in segments))}
    if nodata is not None:
        values[42113] = ("s", nodata)
    types = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = 8 + len(body)
    extra_at, entries, extra = at + 2 + 12 * len(values) + 4, b"", b""
    for tag in sorted(values):
        code, v = values[tag]
        raw = v if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
        entries += struct.pack(order + "HHI", tag, types[code], len(v))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + body + struct.pack(order + "H", len(values)) + entries + b"\0" * 4 + extra


def decode(content, bands=None, **kw):
    reader = BytesReader(content)
    h = geotiff.read_header(reader)
    out = {b: np.full((h.n_rows, h.n_cols), -1.0) for b in range(h.n_bands)}
    for b, c0, r0, w, rows, v in geotiff.read_windows(reader, h, bands or list(range(h.n_bands)), **kw):
        out[b][r0:r0 + rows, c0:c0 + w] = v
    return h, out


GRID = np.arange(7 * 5 * 2).reshape(7, 5, 2) * 3


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("shape", [{"tile": 4}, {"rows_per_strip": 3}, {"rows_per_strip": 7}])
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4", "f8"])
def test_hand_made_tiffs(order, deflate, shape, dtype):
    h, got = decode(hand_made_tiff(order, GRID, deflate, dtype=dtype, **shape))
    assert (h.n_cols, h.n_rows, h.n_bands, h.epsg) == (5, 7, 2, 32651)
    assert h.extent == (100.0, 900.0 - 140.0, 150.0, 900.0)
    for b in (0, 1):
        assert (got[b] == GRID[:, :, b].astype(dtype)).all()


def test_nodata_value_point_raster_and_shares():
    content = hand_made_tiff("<", GRID, rows_per_strip=1, nodata=b"6\0", point_raster=True)
    h, got = decode(content)
    assert h.extent == (95.0, 910.0 - 140.0, 145.0, 910.0)
    assert np.isnan(got[0][0, 1]) and not np.isnan(got[1]).any()
    reader = BytesReader(content)
    seen = [(r0, rows) for p in range(3)
            for _, _, r0, _, rows, _ in geotiff.read_windows(reader, h, [1], p, 3, window_cells=10)]
    assert sorted(seen) == [(0, 2), (2, 2), (4, 2), (6, 1)]


def test_unsupported_files_are_refused():
    with pytest.raises(ValueError):
        geotiff.read_header(BytesReader(b"PK\x03\x04aaaa"))
    with pytest.raises(ValueError):
        geotiff.read_header(BytesReader(b"II" + struct.pack("<HI", 43, 8)))


@pytest.mark.parametrize("cell_type", ["float64", "float32", "int16", "uint8"])
@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_writer_round_trip(cell_type, deflate, order):
    grids = [np.arange(12.0).reshape(3, 4) + 1, np.arange(12.0).reshape(3, 4) * 2 + 1]
    grids[0][1, 1] = np.nan
    content = geotiff.encode_geotiff(grids, (0.0, 0.0, 8.0, 6.0), 4326, cell_type, deflate, order)
    h, got = decode(content)
    assert (h.extent, h.epsg, h.cell_type) == ((0.0, 0.0, 8.0, 6.0), 4326, cell_type)
    for b in (0, 1):
        assert np.array_equal(got[b], grids[b], equal_nan=True)


def test_scan_splits_files_and_selects_bands(spark, tmp_path):
    big = np.arange(40 * 8 * 2).reshape(40, 8, 2)
    (tmp_path / "b.tif").write_bytes(hand_made_tiff("<", big, rows_per_strip=2))
    (tmp_path / "a.tif").write_bytes(hand_made_tiff(">", GRID, tile=4))
    (tmp_path / "c.TIF").write_bytes(b"not read")
    scenes = geotiff.read_scenes(spark, str(tmp_path), bands=[1], target_bytes=400, window_cells=32)
    assert scenes.rdd.getNumPartitions() > 3
    rows = scenes.collect()
    assert {(r.scene, r.ord, r.band) for r in rows} == {("a.tif", 0, 1), ("b.tif", 1, 1)}
    got = np.full((40, 8), -1.0)
    for r in rows:
        if r.scene == "b.tif":
            got[r.r0:r.r0 + r.h, r.c0:r.c0 + r.w] = np.array(r.cells).reshape(r.h, r.w)
    assert (got == big[:, :, 1]).all()
    heads = geotiff.raster_catalog(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(h.scene, h.n_cols, h.n_rows, h.n_bands, h.cell_type) for h in heads] == [
        ("a.tif", 5, 7, 2, "uint16"), ("b.tif", 8, 40, 2, "uint16")]
    same = geotiff.read_scenes_binary(spark, str(tmp_path), bands=[1])
    total = F.aggregate("cells", F.lit(0.0), lambda a, v: a + v)
    assert same.agg(F.sum(total)).first() == scenes.agg(F.sum(total)).first()


def test_tile_files_are_named_by_key(spark, tmp_path):
    tiles = spark.createDataFrame([(2, 1, 0, [1.0, None, 3.0, 4.0])], "col int, row int, band int, cells array<double>")
    layout = Layout(0.0, 0.0, 64.0, 64.0, 4, 4, 2, 2)
    assert sinks.write_rasters(sinks.tile_rasters(tiles, layout, 32651), str(tmp_path), "float32", True) == 1
    row = geotiff.read_scenes(spark, str(tmp_path)).first()
    assert (row.scene, row.xmin, row.ymin, row.xmax, row.ymax) == ("2_1.tif", 32.0, 32.0, 48.0, 48.0)
    assert row.cells == [1.0, None, 3.0, 4.0] and row.cell_type == "float32"


def test_tile_table_is_pruned_by_key(spark, sf, tmp_path):
    path = str(tmp_path / "tiles")
    sinks.write_tiles(X.tiles(spark, sf), path)
    plan = spark.read.parquet(path).where("row = 1 and col between 2 and 3").select("cells")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(row" in text and "GreaterThanOrEqual(col,2)" in text


# Shapefiles -----------------------------------------------------------------------

def _shp(code, contents):
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 0) + struct.pack("<2i8d", 1000, code, *[0.0] * 8)
    shp, shx, at = head, head, 100
    for n, c in enumerate(contents, 1):
        shp += struct.pack(">2i", n, len(c) // 2) + c
        shx += struct.pack(">2i", at // 2, len(c) // 2)
        at += 8 + len(c)
    return shp, shx


def _rings(code, *rings, tail=b""):
    pts = [p for r in rings for p in r]
    starts, n = [], 0
    for r in rings:
        starts.append(n)
        n += len(r)
    return (struct.pack("<i4d2i", code, 0, 0, 0, 0, len(rings), n) + struct.pack(f"<{len(rings)}i", *starts)
            + b"".join(struct.pack("<2d", *p) for p in pts) + tail)


OUTER = [(0.0, 0.0), (0.0, 8.0), (8.0, 8.0), (8.0, 0.0), (0.0, 0.0)]             # clockwise
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]              # counter-clockwise
OTHER = [(20.0, 0.0), (20.0, 1.0), (21.0, 1.0), (20.0, 0.0)]


def test_hand_made_shapefile(spark, tmp_path):
    contents = [_rings(5, OUTER, HOLE, OTHER), _rings(15, OUTER, tail=b"\0" * 56), struct.pack("<i", 0)]
    shp, shx = _shp(5, contents)
    (tmp_path / "x.shp").write_bytes(shp)
    (tmp_path / "x.shx").write_bytes(shx)
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, 3, 97, 17)
    dbf += struct.pack("<11sc4xBB14x", b"UID", b"N", 6, 0) + struct.pack("<11sc4xBB14x", b"NAME", b"C", 10, 0) + b"\r"
    for uid, name in (("     7", "caf\xe9      "), ("      ", "          "), ("     9", "z         ")):
        dbf += (" " + uid + name).encode("latin-1")
    (tmp_path / "x.dbf").write_bytes(dbf)
    rows = shapefile.read_features(spark, str(tmp_path / "x.shp")).orderBy("fid").collect()
    assert [(r.fid, r.geom_type, r.attrs) for r in rows] == [
        (0, "multipolygon", {"UID": "7", "NAME": "caf\xe9"}), (1, "multipolygon", {"UID": None, "NAME": ""}),
        (2, None, {"UID": "9", "NAME": "z"})]
    assert [(g.part, g.ring, len(g.pts)) for g in rows[0].rings] == [(0, 0, 5), (0, 1, 5), (1, 0, 4)]
    assert (rows[0].xmin, rows[0].ymin, rows[0].xmax, rows[0].ymax) == (0.0, 0.0, 21.0, 8.0)
    single = shapefile.read_features(spark, str(tmp_path), single_part=True)
    assert [r.geom_type for r in single.orderBy("fid").collect()] == ["multipolygon", "polygon", None]
    assert shapefile.features_of_kind(spark, str(tmp_path), "polygon").count() == 1


def test_record_ranges_cover_every_record_once(spark, sf, tmp_path):
    folder = X.write_feature_files(X.features(spark, sf), str(tmp_path / "f"))
    whole = shapefile.read_features(spark, folder)
    split = shapefile.read_features(spark, folder, target_bytes=200)
    assert split.rdd.getNumPartitions() == 10 and whole.rdd.getNumPartitions() == 1
    assert split.drop("attrs").exceptAll(whole.drop("attrs")).count() == 0
    assert [r.fid for r in split.orderBy("fid").select("fid").collect()] == list(range(10))


def test_incomplete_file_sets_are_flagged(spark, tmp_path):
    for name in ("a.shp", "a.shx", "a.dbf", "a.prj", "b.shp"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.stem: (r.extensions, r.complete) for r in shapefile.shapefile_filesets(spark, str(tmp_path)).collect()}
    assert got == {"a": ("dbf,prj,shp,shx", True), "b": ("shp", False)}
    with pytest.raises(Exception, match="b.shx"):
        shapefile.read_features(spark, str(tmp_path)).count()


def test_listing_and_sizes(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"x" * 1536)
    (tmp_path / "b.TIF").write_bytes(b"x" * 10)
    (tmp_path / "sub").mkdir()
    assert files.list_files(spark, str(tmp_path)).count() == 2
    only = files.list_files(spark, str(tmp_path), [".tif"])
    assert only.count() == 1 and "content" not in only._jdf.queryExecution().executedPlan().toString()
    sizes = {r.path.split("/")[-1]: r.size for r in files.file_sizes(spark, str(tmp_path), 1).collect()}
    assert sizes == {"a.tif": 1.5, "b.TIF": 0.01}
