"""Rasters and features derived from the given tables, and the files written from them.

Every table is an expression over whole input tables. The layouts are anchored at (0, 4096) with
8-unit cells, so coordinates and weights are exact in binary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastergrid.functions.geometry import path, rect_ring
from rastergrid.functions.grid import Layout
from rastergrid.operators.vectors import with_envelope
from rastergrid.session import qualified, shared_dir
from rastergrid.sources.fs import write_atomic
from rastergrid.sources.sinks import write_rasters

SIDE = 50                                   # cells per scene side
STEP = 48                                   # cells from one scene to the next: two overlap
L16 = Layout(0.0, 3200.0, 896.0, 4096.0, 7, 7, 16, 16)
LHALF = Layout(4.0, 3196.0, 900.0, 4092.0, 7, 7, 16, 16)
LSHIFT = Layout(128.0, 3072.0, 1024.0, 3968.0, 7, 7, 16, 16)
GEO_SCALE = 4096.0                          # map units per degree in the geographic variant
GEO_WEST, GEO_SOUTH = 120.0, 0.0
GEO_CELL = 256.0                            # target cell in metres
GEO_TILE = 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event: its scene, its place in the scene and on the grid, and two band values."""
    e = table(spark, sf, "events").select(
        F.expr("event_id div 2500").alias("scene"), F.expr("cast(event_id % 2500 as int)").alias("k"),
        F.when(F.col("event_type") == "error", None).otherwise(F.col("user_id").cast("double")).alias("b0"),
        F.col("value").alias("b1"))
    i, j = F.expr(f"k % {SIDE}"), F.expr(f"k div {SIDE}")
    return e.select(
        "scene", "k", "b0", "b1",
        (F.expr(f"scene % 2 * {STEP}") + i).cast("int").alias("gc"),
        (F.expr(f"scene div 2 * {STEP}") + j).cast("int").alias("gr"))


def scene_heads(spark: SparkSession, sf: str, geographic: bool = False) -> DataFrame:
    """One row per scene and its full extent."""
    scene = table(spark, sf, "events").select(F.expr("event_id div 2500").alias("ord")).distinct()
    x0, y1 = F.expr("cast(ord % 2 * 384 as double)"), F.expr("cast(4096 - ord div 2 * 384 as double)")
    box = {"xmin": x0, "ymin": y1 - 400.0, "xmax": x0 + 400.0, "ymax": y1}
    if geographic:
        shift = {"x": GEO_WEST, "y": GEO_SOUTH}
        box = {n: c / GEO_SCALE + shift[n[0]] for n, c in box.items()}
    return scene.select(
        F.format_string("scene_%010d.tif", "ord").alias("scene"), "ord",
        F.lit(4326 if geographic else 32651).alias("epsg"), *(c.alias(n) for n, c in box.items()),
        F.lit(SIDE).alias("n_cols"), F.lit(SIDE).alias("n_rows"), F.lit("float64").alias("cell_type"))


def _padded(items: str, key: str, value: str, n: int):
    """An array of n values from an unordered list of structs; absent keys are NULL."""
    entries = F.map_from_entries(F.transform(items, lambda s: F.struct(s[key], s[value])))
    full = F.transform(F.array_sort(items), lambda s: s[value])
    sparse = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(entries, k))
    return F.when(F.size(items) == n, full).otherwise(sparse)


def _bands(df: DataFrame, items: str, key: str, n: int, keep: list[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(b).alias("band"), _padded(items, key, f"b{b}", n).alias("cells"))
                     for b in (0, 1)))
    return df.select(*keep, F.inline(rows))


def scenes(spark: SparkSession, sf: str, geographic: bool = False) -> DataFrame:
    """Scenes of 50 x 50 cells, two bands, one whole window each; a scene is 2500 events."""
    items = (cells(spark, sf).groupBy(F.col("scene").alias("ord"))
             .agg(F.collect_list(F.struct("k", "b0", "b1")).alias("items")))
    heads = scene_heads(spark, sf, geographic)
    joined = items.join(heads, "ord")
    rows = _bands(joined, "items", "k", SIDE * SIDE, heads.columns)
    return rows.select(
        "scene", "ord", "epsg", "xmin", "ymin", "xmax", "ymax", "n_cols", "n_rows", "cell_type",
        "band", F.lit(0).alias("c0"), F.lit(0).alias("r0"), F.lit(SIDE).alias("w"),
        F.lit(SIDE).alias("h"), "cells")


def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps resolved per cell: the first non-NULL value in scene order."""
    first = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("scene"))).alias(b) for b in ("b0", "b1")]
    return cells(spark, sf).groupBy("gc", "gr").agg(*first)


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The merged cells as 16 x 16 tiles on L16, built from columns alone."""
    at = merged_cells(spark, sf).select(
        F.expr("cast(gc div 16 as int)").alias("col"), F.expr("cast(gr div 16 as int)").alias("row"),
        F.expr("cast(gr % 16 * 16 + gc % 16 as int)").alias("pos"), "b0", "b1")
    grouped = at.groupBy("col", "row").agg(F.collect_list(F.struct("pos", "b0", "b1")).alias("items"))
    return _bands(grouped, "items", "pos", 256, ["col", "row"])


def tile_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the tiles, without their cells."""
    return cells(spark, sf).select(F.expr("cast(gc div 16 as int)").alias("col"),
                                   F.expr("cast(gr div 16 as int)").alias("row")).distinct()


def _path(*offsets: tuple[str, str]) -> str:
    """A path of (dx, dy) offsets from (cx, cy), as SQL text."""
    return path(*((f"cx + ({dx})", f"cy + ({dy})") for dx, dy in offsets))


def _ring(part: int, ring: int, pts: str) -> str:
    return f"struct({part} AS part, {ring} AS ring, {pts} AS pts)"


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Centre and half size of each supplier's shapes, spread over the whole layer."""
    s = table(spark, sf, "supplier")
    height = table(spark, sf, "events").agg(
        F.expr("16 + 384 * (max(event_id) div 2500 div 2 + 1)")).scalar()
    return s.select(
        F.col("s_suppkey").alias("fid"),
        F.expr("cast(s_suppkey * 53 % 784 as double)").alias("cx"),
        (4096 - F.col("s_suppkey") * 91 % height).cast("double").alias("cy"),
        F.expr("cast(8 + 4 * s_nationkey as double)").alias("h"),
        F.create_map(F.lit("UID"), F.col("s_suppkey").cast("string"), F.lit("NAME"), F.col("s_name"),
                     F.lit("NATION"), F.col("s_nationkey").cast("string")).alias("attrs"))


def _rect(half: str) -> str:
    return rect_ring((f"cx - {half}", f"cy - {half}", f"cx + {half}", f"cy + {half}"))


_SECOND = rect_ring(("cx + 248D", "cy - 72D", "cx + 264D", "cy - 56D"))
_COLUMNS = ["fid", "geom_type", "rings", "attrs", "xmin", "ymin", "xmax", "ymax"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    """One multipolygon per supplier: rectangle, diamond, L-shape or rectangle with a hole; every
    fifth has a second part."""
    diamond = _path(("-h", "0D"), ("0D", "-h"), ("h", "0D"), ("0D", "h"), ("-h", "0D"))
    ell = _path(("-h", "-h"), ("h", "-h"), ("h", "0D"), ("0D", "0D"), ("0D", "h"), ("-h", "h"), ("-h", "-h"))
    square = _ring(0, 0, _rect("h"))
    first = (f"CASE fid % 4 WHEN 0 THEN array({square}) WHEN 1 THEN array({_ring(0, 0, diamond)}) "
             f"WHEN 2 THEN array({_ring(0, 0, ell)}) ELSE array({square}, {_ring(0, 1, _rect('h / 2'))}) END")
    rings = F.expr(f"concat({first}, if(fid % 5 = 0, array({_ring(1, 0, _SECOND)}), slice(array({square}), 1, 0)))")
    shaped = _suppliers(spark, sf).select("fid", F.lit("multipolygon").alias("geom_type"),
                                          rings.alias("rings"), "attrs")
    return with_envelope(shaped).select(*_COLUMNS)


def combs(spark: SparkSession, sf: str) -> DataFrame:
    """One comb per supplier: a spine of 80 x 16 with three teeth of 16 x 2h on top, 16 apart."""
    comb = _path(("-40D", "-h - 16"), ("40D", "-h - 16"), ("40D", "h"), ("24D", "h"), ("24D", "-h"), ("8D", "-h"), ("8D", "h"),
                 ("-8D", "h"), ("-8D", "-h"), ("-24D", "-h"), ("-24D", "h"), ("-40D", "h"), ("-40D", "-h - 16"))
    shaped = _suppliers(spark, sf).select("fid", F.lit("polygon").alias("geom_type"),
                                          F.expr(f"array({_ring(0, 0, comb)})").alias("rings"), "attrs")
    return with_envelope(shaped).select(*_COLUMNS)


KINDS = ["point", "line", "polygon", "multipoint", "multiline", "multipolygon"]


def kinds(spark: SparkSession, sf: str) -> DataFrame:
    """One feature per supplier, its geometry kind by supplier key."""
    shapes = {
        "point": [_path(("0D", "0D"))],
        "line": [_path(("-h", "0D"), ("0D", "h"), ("h", "0D"))],
        "polygon": [_rect("h")],
        "multipoint": [_path(("-h", "-h"), ("h", "-h"), ("h", "h"), ("-h", "h"))],
        "multiline": [_path(("-h", "-h"), ("h", "-h")), _path(("-h", "h"), ("h", "h"))],
        "multipolygon": [_rect("h"), _SECOND],
    }
    cases = {n: f"array({', '.join(_ring(part, 0, pts) for part, pts in enumerate(shapes[kind]))})"
             for n, kind in enumerate(KINDS)}
    rings = F.expr("CASE fid % 6 " + " ".join(f"WHEN {n} THEN {c}" for n, c in cases.items()) + " END")
    kind = F.expr("CASE fid % 6 " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS)) + " END")
    shaped = _suppliers(spark, sf).select("fid", kind.alias("geom_type"), rings.alias("rings"), "attrs")
    return with_envelope(shaped).select(*_COLUMNS)


KEYS_PER_TASK = 1_000_000


def curve_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (col, row) pairs. The number of tasks follows the number of rows: pairs pack so well that
    tasks sized by bytes would each hold many millions."""
    lines = table(spark, sf, "lineitem")
    pairs = lines.select(F.col("l_partkey").cast("int").alias("col"), F.col("l_suppkey").cast("int").alias("row"))
    return pairs.repartition(max(1, -(-lines.count() // KEYS_PER_TASK)), "col", "row").distinct()


def geo_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of UTM zone 51 on both sides of the equator."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("120 + cast(o_custkey % 600 as double) / 100D").alias("lon"),
        F.expr("-10 + cast(o_orderkey % 3000 as double) / 100D").alias("lat"))


def world_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the whole world but its poles."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("cast(o_custkey * 37 % 3600 as double) / 10D - 180").alias("lon"),
        F.expr("cast(o_orderkey * 53 % 1799 as double) / 10D - 89.9D").alias("lat"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """File paths made of part columns; a third each ends in .tif, .TIF and .tif.aux."""
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("hdfs://h:9000/d."), F.col("p_size").cast("string"), F.lit("/"),
                 F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("."),
                 F.col("p_partkey").cast("string"),
                 F.when(F.expr("p_partkey % 3 = 0"), ".tif").when(F.expr("p_partkey % 3 = 1"), ".TIF")
                 .otherwise(".tif.aux")).alias("path"))


# Files ---------------------------------------------------------------------------

def write_scene_files(spark: SparkSession, sf: str, geographic: bool = False) -> str:
    """One GeoTIFF per scene in a new shared folder."""
    folder = shared_dir(spark) + "/scenes"
    write_rasters(scenes(spark, sf, geographic).withColumnRenamed("scene", "name"), folder)
    return folder


def write_whole_number_files(spark: SparkSession, sf: str) -> dict[str, str]:
    """Folders of scenes in whole-number cell types, with zeros, empty cells and, in int16, negative
    values."""
    out = {}
    for kind, shift in (("uint8", 0), ("int16", 125)):
        folder = shared_dir(spark) + f"/{kind}"
        whole = F.transform("cells", lambda v: F.floor(v) - 251 * F.floor(F.floor(v) / 251) - F.lit(float(shift)))
        rows = scenes(spark, sf).withColumn("cells", whole.cast("array<double>"))
        write_rasters(rows.withColumnRenamed("scene", "name"), folder, kind)
        out[kind] = folder
    return out


FILE_RECORDS = 5000
# Attribute table fields (name, type, width).
_DBF_FIELDS = [("UID", "N", 18), ("NAME", "C", 32), ("NATION", "N", 9)]
_SHAPE = {"point": 1, "line": 3, "multiline": 3, "polygon": 5, "multipolygon": 5, "multipoint": 8}


def _shape_content(kind: str, rings) -> bytes:
    """Record content; outer rings are turned clockwise and holes counter-clockwise."""
    code = _SHAPE[kind]
    paths = []
    for r in rings:
        xy = np.array([(p["x"], p["y"]) for p in r["pts"]], dtype="<f8")
        if code == 5:
            turn = np.sum(xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1])
            if (turn > 0) == (r["ring"] == 0):
                xy = xy[::-1]
        paths.append(xy)
    pts = np.concatenate(paths)
    if code == 1:
        return struct.pack("<i", code) + pts.tobytes()
    box = struct.pack("<i4d", code, *pts.min(axis=0), *pts.max(axis=0))
    if code == 8:
        return box + struct.pack("<i", len(pts)) + pts.tobytes()
    starts = np.cumsum([0] + [len(p) for p in paths[:-1]])
    return (box + struct.pack(f"<2i{len(paths)}i", len(paths), len(pts), *starts) + pts.tobytes())


def encode_shapefile(kind: str, rows) -> dict[str, bytes]:
    """The .shp, .shx and .dbf bytes of features of one shape type."""
    contents = [_shape_content(kind, r["rings"]) for r in rows]
    boxes = np.array([(r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in rows])
    bounds = (*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0))

    def head(n_bytes):
        return (struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n_bytes // 2)
                + struct.pack("<2i8d", 1000, _SHAPE[kind], *bounds, 0, 0, 0, 0))

    shapes, index, at = b"", b"", 100
    for n, content in enumerate(contents, 1):
        shapes += struct.pack(">2i", n, len(content) // 2) + content
        index += struct.pack(">2i", at // 2, len(content) // 2)
        at += 8 + len(content)
    record = 1 + sum(w for _, _, w in _DBF_FIELDS)
    dbf = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 32 * (len(_DBF_FIELDS) + 1) + 1, record)
    for name, kind_, width in _DBF_FIELDS:
        dbf += struct.pack("<11sc4xBB14x", name.encode(), kind_.encode(), width, 0)
    dbf += b"\x0d"
    for r in rows:
        attrs = dict(r["attrs"])
        dbf += b" " + b"".join(
            (attrs[n].ljust(w) if k == "C" else attrs[n].rjust(w)).encode("latin-1")
            for n, k, w in _DBF_FIELDS)
    return {".shp": head(at) + shapes, ".shx": head(100 + len(index)) + index, ".dbf": dbf + b"\x1a"}


def write_feature_files(features_: DataFrame, folder: str) -> str:
    """Shapefiles ``<kind>_<n>`` of at most FILE_RECORDS features, written by tasks."""
    folder = qualified(features_.sparkSession, folder)

    def write(key: tuple[pa.Scalar, ...],
              batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: r["fid"])
        kind, n = key[0].as_py(), key[1].as_py()
        for ext, content in encode_shapefile(kind, rows).items():
            write_atomic(f"{folder}/{kind}_{n:05d}{ext}", content)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    (features_.groupBy("geom_type", F.expr(f"fid div {FILE_RECORDS}").alias("n"))
     .applyInArrow(write, "n bigint").agg(F.sum("n")).first())
    return folder
