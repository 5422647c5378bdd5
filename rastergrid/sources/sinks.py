"""Writers: GeoTIFF files by tasks, attribute JSON and plain lines."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastergrid.functions.grid import Layout, named, number
from rastergrid.operators.kernels import rows_of
from rastergrid.session import materialize, qualified, swap_in
from rastergrid.sources.fs import write_at, write_atomic
from rastergrid.sources.geotiff import TiledFile, encode_geotiff

_RASTER_COLUMNS = ["name", "epsg", "xmin", "ymin", "xmax", "ymax", "n_cols", "n_rows", "band", "cells"]


def write_rasters(rasters: DataFrame, folder: str, cell_type: str = "float64",
                  deflate: bool = False) -> int:
    """Write one GeoTIFF per ``name`` holding its bands in order; returns the number of files.

    Rows: ``name, epsg, xmin, ymin, xmax, ymax, n_cols, n_rows, band, cells``. A task sees the
    bands of one file at a time and writes through a temporary name. All files go to a draft folder
    that takes the place of ``folder`` at the end, so nothing of an earlier run stays.
    """

    names = [c for c in _RASTER_COLUMNS if c != "cells"]
    spark = rasters.sparkSession
    folder = qualified(spark, folder).rstrip("/")
    draft = f"{folder}-{uuid.uuid4().hex}"

    def write_file(head, bands):
        name, epsg, xmin, ymin, xmax, ymax, n_cols, n_rows = head
        grids = [bands[b].reshape(n_rows, n_cols) for b in sorted(bands)]
        content = encode_geotiff(grids, (xmin, ymin, xmax, ymax), epsg, cell_type, deflate)
        write_atomic(f"{draft}/{name}", content)

    def write(batches):
        current, bands, n = None, {}, 0
        for head, (cells,) in rows_of(batches, names, ["cells"]):
            if current is not None and head[0] != current[0]:
                write_file(current, bands)
                bands, n = {}, n + 1
            current = head[:-1]
            bands[head[-1]] = cells
        if current is not None:
            write_file(current, bands)
            n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    done = (rasters.select(*_RASTER_COLUMNS).repartition("name").sortWithinPartitions("name")
            .mapInArrow(write, "files bigint"))
    n = done.agg(F.sum("files")).first()[0] or 0
    swap_in(spark, draft, folder)
    return n


def _unused_value(windows: DataFrame, known: Column, dtype: np.dtype, lo: float | None, hi: float | None,
                  full: bool) -> int | None:
    """The lowest value of a whole-number type that no cell has, or None where all are in use and no
    cell is empty. Values are counted by runs of 65,536; the first run with a gap comes to the driver."""
    limits, run = np.iinfo(dtype), 1 << 16
    if lo is not None and (np.rint(lo) < limits.min or np.rint(hi) > limits.max):
        raise ValueError(f"a cell value is beyond {dtype.name}")
    if lo is None or np.rint(lo) > limits.min:
        first_free = 0
    else:
        value = windows.select(F.explode(known).alias("v")).select((F.rint("v") - F.lit(float(limits.min))).alias("place"))
        value = value.distinct().withColumn("run", F.floor(F.col("place") / run))
        counts = value.groupBy("run").count().orderBy("run").limit(run + 1).collect()
        gap = next((i for i, c in enumerate(counts) if c["run"] != i or c["count"] < run), len(counts))
        used = {int(r.place) for r in value.where(F.col("run") == gap).select("place").collect()}
        first_free = next(i for i in range(gap * run, (gap + 1) * run) if i not in used)
    empty = limits.min + first_free
    if empty <= limits.max and (not first_free or float(empty) != float(limits.min)):
        return empty
    if not full:
        raise ValueError(f"no value of {dtype.name} is left for empty cells")
    return None


def write_whole_rasters(windows: DataFrame, layout: Layout, epsg: int, folder: str,
                        cell_type: str = "float64", big: bool | None = None) -> int:
    """One tiled GeoTIFF per ``name``, however large, each written by many tasks; returns the number of files.

    Rows: ``name, band, col, row, cells`` with whole tiles of ``layout``, or with ``c0, r0, w, h`` the
    windows of tiles; one row for each name, tile and band. A file covers the tiles from its first
    to its last column and row, so all places follow from the keys: one job writes the heads, then
    each task writes its own tiles where they belong. No pixel is shuffled, a task holds one tile, and tiles
    without a row take no space. Nothing is compressed, since places must be known first.

    ``windows`` is read twice, the first time without cells unless the type is one of whole numbers, so
    it should be a stored table. Empty cells are NaN, or in whole-number types (rounded to the nearest, a
    value beyond the type raises) the lowest value that no cell has. ``folder`` must be a
    mounted one; all files take its place together. Without a row the folder is empty.
    """
    if layout.tile_cols % 16 or layout.tile_rows % 16:
        raise ValueError("TIFF tiles have sides of whole multiples of 16 cells")
    spark = windows.sparkSession
    dtype, whole = np.dtype(cell_type).newbyteorder("<"), np.dtype(cell_type).kind != "f"
    folder = qualified(spark, folder).rstrip("/")
    draft = f"{folder}-{uuid.uuid4().hex}"
    per_tile = layout.tile_cols * layout.tile_rows
    if "w" not in windows.columns:
        windows = windows.withColumns({"c0": F.lit(0), "r0": F.lit(0), "w": F.lit(layout.tile_cols),
                                       "h": F.lit(layout.tile_rows)})
    known = F.filter("cells", lambda v: v.isNotNull() & ~F.isnan(v))
    sides = {"cmin": F.min("col"), "cmax": F.max("col"), "rmin": F.min("row"), "rmax": F.max("row"),
             "n_bands": F.max("band") + 1}
    values = [F.min(F.array_min(known)).alias("lo"), F.max(F.array_max(known)).alias("hi"),
              F.sum(F.size(known)).alias("held")] if whole else []
    bounds = materialize(windows.groupBy("name").agg(*(c.cast("int").alias(n) for n, c in sides.items()), *values))
    empty = np.nan
    if whole:
        room = (F.col("cmax") - F.col("cmin") + 1).cast("bigint") * (F.col("rmax") - F.col("rmin") + 1) * F.col("n_bands")
        lo, hi, full = bounds.agg(F.min("lo"), F.max("hi"), F.min(F.col("held") == room * per_tile)).first()
        empty = _unused_value(windows, known, dtype, lo, hi, bool(full))
    heads = ["name", *sides]

    def plan(cmin, cmax, rmin, rmax, n_bands) -> TiledFile:
        extent = (layout.xmin + cmin * layout.tile_w, layout.ymax - (rmax + 1) * layout.tile_h,
                  layout.xmin + (cmax + 1) * layout.tile_w, layout.ymax - rmin * layout.tile_h)
        return TiledFile((cmax - cmin + 1, rmax - rmin + 1), (layout.tile_cols, layout.tile_rows), n_bands,
                         dtype, extent, epsg, empty, big)

    def write_heads(batches):
        n = 0
        for (name, *sides), _ in rows_of(batches, heads, []):
            file = plan(*sides)
            write_at(f"{draft}/{name}", [(0, file.head)], file.n_bytes)
            n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    def write_tile_rows(batches):
        n, current, file = 0, None, None
        for (col, row, band, c0, r0, w, h, *head), (cells,) in rows_of(
                batches, ["col", "row", "band", "c0", "r0", "w", "h", *heads], ["cells"]):
            if head != current:
                current, file = head, plan(*head[1:])
            stored = np.full((layout.tile_rows, layout.tile_cols), 0 if empty is None else empty, dtype)
            grid = cells.reshape(h, w)
            if whole:
                held = ~np.isnan(grid)
                stored[r0:r0 + h, c0:c0 + w][held] = np.rint(grid[held]).astype(dtype)
            else:
                stored[r0:r0 + h, c0:c0 + w] = grid
            write_at(f"{draft}/{head[0]}", file.pieces(col - head[1], row - head[3], band, stored.tobytes()))
            n += 1
        yield pa.RecordBatch.from_pydict({"tiles": pa.array([n], pa.int64())})

    n = bounds.mapInArrow(write_heads, "files bigint").agg(F.sum("files")).first()[0] or 0
    placed = windows.join(bounds.select(*heads), "name").select(*heads, "col", "row", "band", "c0", "r0", "w", "h", "cells")
    placed.mapInArrow(write_tile_rows, "tiles bigint").agg(F.sum("tiles")).first()
    swap_in(spark, draft, folder)
    return n


def tile_rasters(tiles: DataFrame, layout: Layout, epsg: int) -> DataFrame:
    """Tiles in the shape ``write_rasters`` takes, named ``<col>_<row>.tif``."""
    return tiles.select(
        F.format_string("%d_%d.tif", "col", "row").alias("name"), F.lit(epsg).alias("epsg"),
        *named(layout.key_extent()), F.lit(layout.tile_cols).alias("n_cols"),
        F.lit(layout.tile_rows).alias("n_rows"), "band", "cells")


def mosaic_rasters(mosaics: DataFrame, layout: Layout, epsg: int) -> DataFrame:
    """Stitched rasters in the shape ``write_rasters`` takes, one file per mosaic block."""
    xmin = f"{number(layout.xmin)} + gc0 * {number(layout.cell_w)}"
    ymax = f"{number(layout.ymax)} - gr0 * {number(layout.cell_h)}"
    box = {"xmin": xmin, "ymin": f"{ymax} - n_rows * {number(layout.cell_h)}",
           "xmax": f"{xmin} + n_cols * {number(layout.cell_w)}", "ymax": ymax}
    return mosaics.select(
        F.format_string("mosaic_%d_%d_%d.tif", "fid", "block_row", "block_col").alias("name"),
        F.lit(epsg).alias("epsg"), *named(box), "n_cols", "n_rows", "band", "cells")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """The tile table as Parquet, one folder per grid row, keys kept sorted for pruning. A long
    grid row is shared by several tasks."""
    (tiles.repartition("row", F.expr("col div 16")).sortWithinPartitions("row", "col", "band")
     .write.mode("overwrite").partitionBy("row").parquet(path))


def write_attribute_json(features: DataFrame, path: str) -> None:
    """One JSON object of attributes per line."""
    features.select(F.to_json("attrs").alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, value: Column, path: str) -> None:
    """One element per line."""
    df.select(value.cast("string").alias("value")).write.mode("overwrite").text(path)
