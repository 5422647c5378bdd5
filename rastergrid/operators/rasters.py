"""Operators on scenes and tiles: tile, reproject, merge, mask, stitch, sample, order."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastergrid.functions import geometry as G
from rastergrid.functions import sfc
from rastergrid.functions.grid import BOX, Layout, explode_keys, named
from rastergrid.functions.projection import cut_to_domain, outline
from rastergrid.model import LayerMeta
from rastergrid.operators import kernels as K
from rastergrid.operators.vectors import cover, meet_keys, polygonal
from rastergrid.session import materialize

SNAP = 4096.0          # sub-cell positions are rounded to 1/4096 of a cell
FAN_IN = 256           # rasters one merge task takes per tile before it splits the work
POLYGONS_PER_TILE = 256  # polygons that travel with a tile at once
_KEY = ["col", "row", "band"]


def merged_extent(scenes: DataFrame) -> DataFrame:
    """One row: the union of the scene extents."""
    return scenes.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
                      F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def union_cell_type() -> F.Column:
    """The narrowest cell type that holds all values of the column ``cell_type``: floating if one is,
    signed if one is, and wide enough; unsigned and signed need one step more than the unsigned."""
    bits = F.regexp_extract("cell_type", r"(\d+)$", 1).cast("int")
    widest = {kind: F.max(F.when(F.col("cell_type").rlike(f"^{kind}[0-9]"), bits))
              for kind in ("float", "int", "uint")}
    whole = F.greatest(widest["int"], widest["uint"])
    signed = F.greatest(widest["int"], F.when(widest["uint"] < 64, 2 * widest["uint"]))
    # floats hold whole numbers of up to 16 (float32) or 32 and more (float64) bits
    real = F.when((widest["float"] > 32) | (F.coalesce(whole, F.lit(0)) > 16), 64).otherwise(32)
    mixed_64 = widest["int"].isNotNull() & (widest["uint"] == 64)
    return (F.when(widest["float"].isNotNull(), F.concat(F.lit("float"), real))
            .when(mixed_64, F.lit("float64"))
            .when(widest["int"].isNotNull(), F.concat(F.lit("int"), signed))
            .otherwise(F.concat(F.lit("uint"), widest["uint"])))


def layer_metadata(scenes: DataFrame, cell_w: float | None = None,
                   cell_h: float | None = None) -> DataFrame:
    """One row over the scene headers: extent, smallest cell, CRS and the union of the cell types."""
    cw = F.lit(cell_w) if cell_w else F.min((F.col("xmax") - F.col("xmin")) / F.col("n_cols"))
    ch = F.lit(cell_h) if cell_h else F.min((F.col("ymax") - F.col("ymin")) / F.col("n_rows"))
    return scenes.agg(
        F.min("epsg").alias("epsg"), (F.min("epsg") == F.max("epsg")).alias("one_crs"),
        union_cell_type().alias("cell_type"),
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        cw.alias("cell_w"), ch.alias("cell_h"))


def read_layer_meta(scenes: DataFrame) -> LayerMeta:
    """The one-row layer metadata as a value; scenes in different CRSs are an error."""
    row = layer_metadata(scenes).first()
    if row is None or row.epsg is None:
        raise ValueError("the layer has no scenes")
    if not row.one_crs:
        raise ValueError("the scenes of a layer must share one CRS")
    return LayerMeta(row.epsg, row.cell_type, (row.xmin, row.ymin, row.xmax, row.ymax),
                     row.cell_w, row.cell_h)


def layer_bounds(metadata: DataFrame, tile: int) -> DataFrame:
    """``layer_metadata`` with the key bounds of its floating layout: ``cmin, rmin, cmax, rmax``."""
    def last(low: str, high: str, cell: str):
        return F.greatest(F.lit(0), F.ceil((F.col(high) - F.col(low)) / (F.col(cell) * tile)).cast("int") - 1)

    return metadata.select("*", F.lit(0).alias("cmin"), F.lit(0).alias("rmin"),
                           last("xmin", "xmax", "cell_w").alias("cmax"), last("ymin", "ymax", "cell_h").alias("rmax"))


def key_bounds(meta: LayerMeta, tile: int) -> tuple[int, int, int, int]:
    """Least and largest (col, row) of the layer on its floating layout."""
    layout = floating_layout(meta, tile)
    return 0, 0, layout.cols - 1, layout.rows - 1


def floating_layout(meta: LayerMeta, tile: int) -> Layout:
    return Layout.from_cells(meta.extent, meta.cell_w, meta.cell_h, tile)


def depth_of_overlap(scenes: DataFrame, layout: Layout) -> tuple[int, int]:
    """From scene headers alone: the most scenes over one tile, and the span of ``ord``."""
    heads = scenes.select("ord", "xmin", "ymin", "xmax", "ymax").distinct()
    keys = explode_keys(heads.select("ord", *named(layout.key_range())))
    per_key = keys.groupBy("col", "row").agg(F.count("*").alias("n"), F.max("ord").alias("last"))
    row = per_key.agg(F.max("n").alias("n"), F.max("last").alias("last")).first()
    return row.n or 0, (row.last or 0) + 1


def merge_pieces(pieces: DataFrame, layout: Layout, depth: int, span: int,
                 fan_in: int = FAN_IN) -> DataFrame:
    """Pieces -> tiles: within a tile the first non-NULL value in ascending ``ord`` wins.

    Rows are shuffled by key and merged as a sorted stream, so a task holds one tile at a time.
    Where more than ``fan_in`` rasters overlap one tile (``depth``), runs of ``fan_in`` consecutive
    ``ord`` are merged first, each in a task of its own; first-wins is associative over runs. That
    repeats until at most ``fan_in`` runs of the ``span`` of ``ord`` are left.
    """
    while depth > fan_in and span > fan_in:
        runs = (pieces.withColumn("run", F.expr(f"ord div {fan_in}"))
                      .repartition(*_KEY, "run").sortWithinPartitions(*_KEY, "ord"))
        pieces = runs.drop("run").mapInArrow(
            K.merge_sorted_pieces(layout.tile_cols, layout.tile_rows, fan_in), K.PIECE_SCHEMA)
        span = -(-span // fan_in)
    return (pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "ord")
            .mapInArrow(K.merge_sorted_pieces(layout.tile_cols, layout.tile_rows), K.TILE_SCHEMA))


def scene_pieces(scenes: DataFrame, layout: Layout, snap: float = SNAP) -> DataFrame:
    """Cut and resample every scene window onto the tiles it meets, before any merge."""
    return scenes.mapInArrow(K.scatter_windows(layout, snap), K.PIECE_SCHEMA)


def tile_to_layout(scenes: DataFrame, layout: Layout, heads: DataFrame | None = None,
                   fan_in: int = FAN_IN, snap: float = SNAP) -> DataFrame:
    """Scenes -> tiles of ``layout``: one pass over the pixels, one shuffle of the pieces.

    ``heads`` is a cheaper source of the scene headers where there is one.
    """
    depth, span = depth_of_overlap(scenes if heads is None else heads, layout)
    return merge_pieces(scene_pieces(scenes, layout, snap), layout, depth, span, fan_in)


def target_layout(meta: LayerMeta, epsg: int, tile: int, cell: float | None = None) -> Layout:
    """Layout of a layer in another CRS: its projected outline, grown to whole multiples of the
    cell. Without ``cell`` the diagonal keeps its number of cells.

    Only what lies in the domain of both CRS counts (``projection.cut_to_domain``); a layer wholly
    beyond it raises. The outline is within a sixteenth of a cell.
    """
    parts = cut_to_domain(meta.extent, meta.epsg, epsg)
    if not parts:
        raise ValueError(f"no part of the layer lies in the domain of EPSG:{epsg}")

    def edges(error):
        return (np.concatenate(c) for c in zip(*(outline(p, meta.epsg, epsg, error) for p in parts)))

    px, py = edges(None)
    if cell is None:
        cell = (math.hypot(px.max() - px.min(), py.max() - py.min())
                / math.hypot(meta.n_cols, meta.n_rows))
    px, py = edges(cell / 16)
    extent = (math.floor(px.min() / cell) * cell, math.floor(py.min() / cell) * cell,
              math.ceil(px.max() / cell) * cell, math.ceil(py.max() / cell) * cell)
    return Layout.from_cells(extent, cell, cell, tile)


def reproject_tiles(tiles: DataFrame, meta: LayerMeta, source: Layout, epsg: int,
                    target: Layout, snap: float = SNAP) -> DataFrame:
    """Tiles of one CRS -> tiles of ``target`` in another.

    Each source tile sends the weighted sums its own cells give to the target cells; sums from
    neighbouring tiles meet in the merge, so no halo is exchanged and the pixels are shuffled once.
    """
    whole = {"ord": F.lit(0).cast("bigint"), "xmin": F.lit(meta.extent[0]),
             "ymin": F.lit(meta.extent[3] - meta.n_rows * source.cell_h),
             "xmax": F.lit(meta.extent[0] + meta.n_cols * source.cell_w),
             "ymax": F.lit(meta.extent[3]), "n_cols": F.lit(meta.n_cols),
             "n_rows": F.lit(meta.n_rows), "band": F.col("band"),
             "c0": F.col("col") * source.tile_cols, "r0": F.col("row") * source.tile_rows,
             "w": F.lit(source.tile_cols), "h": F.lit(source.tile_rows), "cells": F.col("cells")}
    windows = tiles.select(*(c.alias(n) for n, c in whole.items()))
    pieces = windows.mapInArrow(K.scatter_windows(target, snap, meta.epsg, epsg), K.PIECE_SCHEMA)
    return merge_pieces(pieces, target, depth=1, span=1)


def tile_extents(tiles: DataFrame, layout: Layout) -> DataFrame:
    """Distinct keys with their map extents."""
    keys = tiles.select("col", "row").distinct()
    return keys.select("col", "row", *named(layout.key_extent()))


def envelope_keys(layout: Layout, extent) -> tuple[int, int, int, int]:
    """Key range of an extent: ``cmin, rmin, cmax, rmax``, inclusive."""
    xmin, ymin, xmax, ymax = extent
    cmin, rmin = math.floor((xmin - layout.xmin) / layout.tile_w), math.floor((layout.ymax - ymax) / layout.tile_h)
    cmax = max(cmin, math.ceil((xmax - layout.xmin) / layout.tile_w) - 1)
    rmax = max(rmin, math.ceil((layout.ymax - ymin) / layout.tile_h) - 1)
    return cmin, rmin, cmax, rmax


def tiles_on_curve(tiles: DataFrame, layout: Layout, extent, label: str, bits: int, most: int = 64) -> DataFrame:
    """``tiles_in_envelope`` for a table sorted by ``sort_by_curve`` (column ``sfc``): the key rectangle
    becomes at most ``most`` curve intervals. Where a key filter alone must look at all row groups
    whose columns or rows overlap, the intervals are pushed down to the few that hold them."""
    keys = envelope_keys(layout, extent)
    intervals = sfc.key_intervals(label, *keys, bits, most)
    held = reduce(lambda a, b: a | b, (F.col("sfc").between(a, b) for a, b in intervals), F.lit(False))
    return tiles_in_envelope(tiles.where(held), layout, extent)


def tiles_in_envelope(tiles: DataFrame, layout: Layout, extent) -> DataFrame:
    """Tiles whose key lies in the key range of an extent; a plain key filter, so it is pushed
    into a Parquet scan of the tile table."""
    cmin, rmin, cmax, rmax = envelope_keys(layout, extent)
    return tiles.where(F.col("col").between(cmin, cmax) & F.col("row").between(rmin, rmax))


def mask_tiles(tiles: DataFrame, polygons: DataFrame, layout: Layout,
               per_row: int = POLYGONS_PER_TILE) -> DataFrame:
    """Tiles cut to each polygon: ``fid, col, row, band`` and the window ``c0, r0, w, h, cells`` of the
    tile that holds its cells, NULL outside the polygon. Features of other kinds hold no cell.

    The tiles' keys meet the polygons' key ranges first, and each key gets a stored list of its
    polygons with the edges that matter there. Lists hold about ``per_row`` polygons, crowded keys
    have several, and a tile travels once for each list, not for each polygon. The key range of the polygons
    becomes a filter on the tile scan and the stored size decides how the equi-join runs. ``tiles``
    is read twice, the first time without cells.
    """
    covered = cover(polygonal(polygons), layout)
    span = covered.agg(F.min("cmin"), F.max("cmax"), F.min("rmin"), F.max("rmax")).first()
    near = tiles.where(F.col("col").between(span[0], span[1]) & F.col("row").between(span[2], span[3]))
    reach = materialize(meet_keys(near.select("col", "row").distinct(), covered))
    crowd = reach.groupBy("col", "row").agg(F.ceil(F.count("*") / per_row).cast("int").alias("lists")).where("lists > 1")
    dealt = reach.join(crowd, ["col", "row"], "left").withColumn(
        "deal", F.pmod(F.xxhash64("fid"), F.coalesce("lists", F.lit(1))))
    lists = materialize(dealt.groupBy("col", "row", "deal").agg(
        F.collect_list(F.struct("fid", "whole", "edges")).alias("polygons")))
    joined = near.join(lists, ["col", "row"]).select("col", "row", "band", "cells", "polygons")
    return joined.mapInArrow(K.mask_tiles(layout), K.MASK_SCHEMA)


def stitch(masked: DataFrame, layout: Layout, block: int = 4) -> DataFrame:
    """Per polygon, band and block of ``block`` x ``block`` grid tiles one raster over the masked
    windows in it.

    Blocks are those of the grid, so nothing has to be known about a polygon as a whole: the cells
    are read and shuffled once, and no task ever holds more than one block.
    """
    placed = masked.select(
        "*", F.floor(F.col("col") / block).cast("int").alias("block_col"),
        F.floor(F.col("row") / block).cast("int").alias("block_row"))
    by_block = ["fid", "band", "block_col", "block_row"]
    return (placed.repartition(*by_block).sortWithinPartitions(*by_block)
            .mapInArrow(K.stitch_sorted_tiles(layout.tile_cols, layout.tile_rows, block),
                        K.MOSAIC_SCHEMA))


def tile_cells(tiles: DataFrame, layout: Layout, keep: list[str] = ()) -> DataFrame:
    """Tiles, or windows of tiles, as one row per non-NULL cell: ``gc, gr`` count cells from the
    grid's corner."""
    tc, tr = layout.tile_cols, layout.tile_rows
    if "w" not in tiles.columns:
        tiles = tiles.withColumns({"c0": F.lit(0), "r0": F.lit(0), "w": F.lit(tc)})
    out = tiles.select(*keep, "col", "row", "band", "c0", "r0", "w", F.posexplode("cells").alias("pos", "value"))
    return out.where("value is not null").select(
        *keep, "band", F.expr(f"cast(col * {tc} + c0 + pos % w as int)").alias("gc"),
        F.expr(f"cast(row * {tr} + r0 + pos div w as int)").alias("gr"), "value")


def mosaic_cells(mosaics: DataFrame) -> DataFrame:
    """Mosaic blocks as one row per non-NULL cell."""
    out = mosaics.select("fid", "band", "gc0", "gr0", "n_cols",
                         F.posexplode("cells").alias("pos", "value"))
    return out.where("value is not null").select(
        "fid", "band", F.expr("cast(gc0 + pos % n_cols as int)").alias("gc"),
        F.expr("cast(gr0 + pos div n_cols as int)").alias("gr"), "value")


def bilinear_sample(samples: DataFrame, cells: DataFrame, n_cols: int, n_rows: int,
                    snap: float = SNAP, bands: tuple[str, ...] = ("value",)) -> DataFrame:
    """Bilinear values at fractional cell positions ``(id, fx, fy)`` over ``cells(gc, gr, *bands)``.

    Four neighbours per sample, clamped at the edge; NULL neighbours drop out, in each band for
    itself, and the weights are renormalised. An equi-join on the cell, then one sum per sample.
    """
    def at(c, n):
        snapped = F.floor(F.col(c) * snap + 0.5) / F.lit(snap)
        return F.least(F.greatest(snapped, F.lit(0.0)), F.lit(float(n - 1)))

    placed = samples.select("id", at("fx", n_cols).alias("px"), at("fy", n_rows).alias("py"))
    split = placed.select("id", F.floor("px").alias("left"), F.floor("py").alias("top"),
                          (F.col("px") - F.floor("px")).alias("wx"),
                          (F.col("py") - F.floor("py")).alias("wy"))
    corners = F.array(*(
        F.struct((F.col("left") + dx).cast("int").alias("gc"), (F.col("top") + dy).cast("int").alias("gr"),
                 ((F.col("wx") if dx else 1 - F.col("wx"))
                  * (F.col("wy") if dy else 1 - F.col("wy"))).alias("weight"))
        for dy in (0, 1) for dx in (0, 1)))
    near = split.select("id", F.inline(corners)).where("weight > 0")
    known = cells.where(F.coalesce(*bands).isNotNull()).select("gc", "gr", *bands)
    joined = near.join(known, ["gc", "gr"], "left")
    return joined.groupBy("id").agg(*(
        (F.sum(F.col("weight") * F.col(b)) / F.sum(F.when(F.col(b).isNotNull(), F.col("weight")))).alias(b)
        for b in bands))


def sort_by_curve(tiles: DataFrame, label: str, bits: int, n: int | None = None) -> DataFrame:
    """Tiles range-partitioned and sorted along a space-filling curve, for locality on disk."""
    indexed = tiles.withColumn("sfc", sfc.sfc_index(label, F.col("col"), F.col("row"), bits, bits))
    ranged = indexed.repartitionByRange(n, "sfc") if n else indexed.repartitionByRange("sfc")
    return ranged.sortWithinPartitions("sfc")


def footprint(tiles: DataFrame, layout: Layout) -> DataFrame:
    """The tile footprint as a relation: one rectangle per distinct key."""
    boxes = tile_extents(tiles, layout)
    ring = F.expr(G.rect_ring(BOX))
    return boxes.select("col", "row", ring.alias("ring"))


def sample_scene(scenes: DataFrame) -> DataFrame:
    """The first scene in merge order."""
    return scenes.orderBy("ord").limit(1)
