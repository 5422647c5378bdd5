"""Files and folders that outlive a job: whole-number rasters, draft folders, the shared folder."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rastergrid import session
from rastergrid.functions import sfc
from rastergrid.operators import rasters as R
from rastergrid.plans import fixtures as X
from rastergrid.sources import geotiff, sinks
from rastergrid.sources.fs import BytesReader


def back(bands, kind, **options):
    reader = BytesReader(geotiff.encode_geotiff(bands, (0, 0, 4, 4), 32651, kind, **options))
    head = geotiff.read_header(reader)
    out = {b: np.full(bands[0].shape, -1.0) for b in range(len(bands))}
    for b, c0, r0, w, h, values in geotiff.read_windows(reader, head, list(out)):
        out[b][r0:r0 + h, c0:c0 + w] = values
    return head, out


def test_whole_numbers_survive():
    band = np.array([[0.0, 1.7, np.nan, 255.0], [2.5, 3.5, 0.4, 254.0]])
    head, out = back([band, np.nan_to_num(band)], "uint8")
    np.testing.assert_array_equal(out[0], [[0, 2, np.nan, 255], [2, 4, 0, 254]])
    assert head.nodata == 1
    head, out = back([np.nan_to_num(band)], "uint8")
    assert head.nodata is None
    with pytest.raises(ValueError, match="beyond uint8"):
        back([np.array([[300.0]])], "uint8")
    with pytest.raises(ValueError, match="is left"):
        back([np.append(np.arange(256.0), np.nan).reshape(1, -1)], "uint8")


def test_large_files_have_strips_for_every_share():
    band = np.arange(64 * 64, dtype=float).reshape(64, 64)
    reader = BytesReader(geotiff.encode_geotiff([band], (0, 0, 64, 64), 32651, strip_cells=256))
    head = geotiff.read_header(reader)
    shares = [list(geotiff.read_windows(reader, head, [0], p, 8, 256)) for p in range(8)]
    assert all(shares)
    assert sum(w[3] * w[4] for share in shares for w in share) == band.size


@pytest.mark.parametrize("kinds, union", [
    (["int16", "int32"], "int32"), (["uint8", "int8"], "int16"), (["uint16", "uint8"], "uint16"),
    (["uint32", "int16"], "int64"), (["uint64", "int8"], "float64"), (["float32", "int16"], "float32"),
    (["float32", "int32"], "float64"), (["float64", "uint8"], "float64"), (["uint8"], "uint8")])
def test_union_of_cell_types(spark, kinds, union):
    df = spark.createDataFrame([(k,) for k in kinds], "cell_type string")
    assert df.agg(R.union_cell_type().alias("t")).first().t == union


def test_key_bounds(spark, sf):
    meta = R.read_layer_meta(X.scene_heads(spark, sf))
    assert R.key_bounds(meta, 16) == (0, 0, -(-meta.n_cols // 16) - 1, -(-meta.n_rows // 16) - 1)


@pytest.mark.parametrize("col, row", [(65539, 5), (-1, 0), (0, 1 << 16)])
def test_keys_outside_the_curve_raise(spark, col, row):
    df = spark.createDataFrame([(col, row)], "c int, r int")
    with pytest.raises(PySparkException, match="outside the Hilbert curve"):
        df.select(sfc.hilbert_encode(F.col("c"), F.col("r"), 16)).collect()
    with pytest.raises(PySparkException, match="beyond the Hilbert curve"):
        df.select(sfc.hilbert_decode(F.lit(1 << 32), 16)[0]).collect()


def test_a_second_run_leaves_no_stale_file(spark, tmp_path):
    rows = [(n, 32651, 0.0, 0.0, 1.0, 1.0, 1, 1, 0, [1.0]) for n in ("z.tif", "z2.tif")]
    schema = ("name string, epsg int, xmin double, ymin double, xmax double, ymax double, n_cols int, "
              "n_rows int, band int, cells array<double>")
    folder = str(tmp_path / "out")
    for keep in (rows, rows[:1]):
        assert sinks.write_rasters(spark.createDataFrame(keep, schema), folder) == len(keep)
    assert [f for f in os.listdir(folder) if not f.startswith(".")] == ["z.tif"]
    assert os.listdir(tmp_path) == ["out"]


def test_fallback_reader_ranks_files(spark, sf):
    folder = X.write_scene_files(spark, sf)
    main = {r.scene: r.ord for r in geotiff.read_scenes(spark, folder).select("scene", "ord").distinct().collect()}
    other = geotiff.read_scenes_binary(spark, folder).select("scene", "ord").distinct().collect()
    assert {r.scene: r.ord for r in other} == main


class _Cluster:
    """What ``shared_dir`` asks of a session, for a master that is not local."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)


def test_run_folder_goes_with_its_tables(spark):
    with session.run_folder(spark) as folder:
        table = session.materialize(spark.range(10))
        assert table.count() == 10 and folder in table.inputFiles()[0].replace("file:///", "file:/")
    assert not os.path.exists(folder.removeprefix("file:"))
