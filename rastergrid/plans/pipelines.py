"""What a user runs: tile and reproject, pixels by polygon, metadata by footprint, grid join."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastergrid.functions import sfc
from rastergrid.functions.grid import Layout
from rastergrid.model import LayerMeta
from rastergrid.operators import rasters as R
from rastergrid.operators import vectors as V
from rastergrid.session import materialize, shared_dir
from rastergrid.sources.geotiff import raster_catalog, read_scenes
from rastergrid.sources.sinks import (
    mosaic_rasters, write_attribute_json, write_rasters, write_tiles, write_whole_rasters)


def tile_scenes(spark: SparkSession, folder: str, tile: int, epsg: int,
                cell: float | None = None) -> tuple[DataFrame, Layout, LayerMeta]:
    """GeoTIFF folder -> tiles in ``epsg``: read, tile, reproject.

    Layout and overlap come from the headers alone, which are read and stored once, so the pixels
    are read once too.
    """
    heads = materialize(raster_catalog(spark, folder))
    meta = R.read_layer_meta(heads)
    source = R.floating_layout(meta, tile)
    tiles = R.tile_to_layout(read_scenes(spark, folder), source, heads)
    if meta.epsg == epsg:
        return tiles, source, meta
    target = R.target_layout(meta, epsg, tile, cell)
    return R.reproject_tiles(tiles, meta, source, epsg, target), target, meta


def pixels_by_polygon(tiles: DataFrame, polygons: DataFrame, layout: Layout,
                      block: int = 4) -> DataFrame:
    """Mosaics of the tile cells inside each polygon, one for each block of the grid."""
    return R.stitch(R.mask_tiles(tiles, polygons, layout), layout, block)


def metadata_by_footprint(tiles: DataFrame, features: DataFrame, layout: Layout) -> DataFrame:
    """Attributes of the features meeting the tiles, as JSON objects."""
    hits = V.features_by_footprint(features, tiles, layout)
    return hits.select("fid", F.to_json("attrs").alias("json"))


def grid_join(scene_heads: DataFrame, features: DataFrame, cell_w: float, cell_h: float,
              tile: int, list_size: int = V.LIST_SIZE, curve: str | None = None) -> DataFrame:
    """Grid over the merged raster extent joined with features: key -> UIDs. With ``curve`` the keys
    get their place on it as ``sfc`` and come in its order."""
    e = R.merged_extent(scene_heads).first()
    layout = Layout.from_cells((e.xmin, e.ymin, e.xmax, e.ymax), cell_w, cell_h, tile)
    lists = V.uids_per_key(features, layout, list_size)
    if curve is None:
        return lists
    index = sfc.sfc_index(curve, F.col("col"), F.col("row"), sfc.MAX_BITS, sfc.MAX_BITS)
    return lists.withColumn("sfc", index).orderBy("sfc", "part")


def tile_query(spark: SparkSession, folder: str, metadata: DataFrame, polygons: DataFrame,
               output: str, tile: int, epsg: int, cell: float | None = None,
               filtered_footprint: bool = False, whole_files: bool = False) -> dict:
    """The three steps in sequence: tile, pixels by polygon, metadata by footprint.

    The tile table is stored once for both queries; the footprint is that of all its tiles, or with
    ``filtered_footprint`` of those that meet a polygon. Pixels go to one GeoTIFF per mosaic block in the
    folder ``output``, or with ``whole_files`` to one per polygon (``output`` must be a mounted folder), in
    the scenes' cell type, metadata as JSON lines next to it under the same stem.
    """
    tiles, layout, meta = tile_scenes(spark, folder, tile, epsg, cell)
    stored = f"{shared_dir(spark)}/tiles"
    write_tiles(tiles, stored)
    tiles = spark.read.schema(tiles.schema).parquet(stored)
    if whole_files:
        masked = materialize(R.mask_tiles(tiles, polygons, layout))
        named = masked.withColumn("name", F.format_string("mosaic_%d.tif", "fid"))
        n = write_whole_rasters(named, layout, epsg, output, meta.cell_type)
    else:
        mosaics = mosaic_rasters(pixels_by_polygon(tiles, polygons, layout), layout, epsg)
        n = write_rasters(mosaics, output, meta.cell_type)
    if filtered_footprint:
        keys = tiles.select("col", "row").distinct()
        tiles_met = V.meet_keys(keys, V.cover(V.polygonal(polygons), layout)).select("col", "row")
    hits = V.features_by_footprint(metadata, tiles_met if filtered_footprint else tiles, layout)
    json_path = re.sub(r"\.[^.]*$", "", output) + ".json"
    write_attribute_json(hits, json_path)
    return {"tiles": tiles, "layout": layout, "mosaics": n, "output": output, "json": json_path}
