"""GeoTIFF scan: a Python data source whose tasks read only their own byte ranges.

A baseline subset: classic TIFF or BigTIFF, either byte order, strips or tiles, chunky or planar bands,
no compression or Deflate; a strip or tile of no bytes is empty. Files are listed once; a large file is shared by several tasks, each
reading the header and its part of the strips or tiles.
"""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rastergrid.model import HEADER_SCHEMA, SCENE_SCHEMA
from rastergrid.session import materialize, qualified
from rastergrid.sources.fs import BytesReader, RangeReader, list_sized

TARGET_BYTES = 64 << 20       # file bytes per task
WINDOW_CELLS = 1 << 20        # cells per emitted row
STRIP_CELLS = 1 << 16         # cells of a strip that we write
HEADERS_PER_TASK = 64
PAGE = 4096                   # pixels written by many tasks begin at a multiple

# TIFF tag numbers, field types and GeoKey ids.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
KIND_OF_FORMAT = {1: "u", 2: "i", 3: "f"}
CLASSIC, BIG = 42, 43
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC_CRS, PROJECTED_CRS = 1024, 1025, 2048, 3072
DEFLATE = (8, 32946)


@dataclass
class Header:
    order: str
    n_cols: int
    n_rows: int
    n_bands: int
    dtype: np.dtype
    compression: int
    planar: int
    seg_w: int
    seg_h: int
    offsets: tuple
    counts: tuple
    extent: tuple
    epsg: int
    nodata: float | None

    @property
    def cell_type(self) -> str:
        return self.dtype.newbyteorder("=").name

    @property
    def across(self) -> int:
        return -(-self.n_cols // self.seg_w)

    @property
    def down(self) -> int:
        return -(-self.n_rows // self.seg_h)


def _widths(big: bool) -> tuple[str, str, str, int, int]:
    """Codes of a directory's length, of an entry's head and of an offset, bytes of an entry and of the
    value inside it."""
    return ("Q", "HHQ", "Q", 20, 8) if big else ("H", "HHI", "I", 12, 4)


def _tags(reader, order: str, at: int, big: bool) -> dict[int, tuple]:
    length, head, word, width, inline = _widths(big)
    skip = struct.calcsize("=" + length)
    (n,) = struct.unpack(order + length, reader.read(at, skip))
    block = reader.read(at + skip, width * n)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + head, block, width * i)
        code = FIELD_TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * count
        raw = block[width * (i + 1) - inline:width * (i + 1)]
        if size > inline:
            raw = reader.read(struct.unpack(order + word, raw)[0], size)
        if code == "s":
            tags[tag] = (raw[:count].split(b"\0")[0].decode("ascii", "replace"),)
        else:
            tags[tag] = struct.unpack(f"{order}{count}{code}", raw[:size])
    return tags


def read_header(reader) -> Header:
    """Header of the first image of a file."""
    head = reader.read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    big = magic == BIG
    if magic not in (CLASSIC, BIG) or big and (len(head) < 16 or struct.unpack(order + "HH", head[4:8]) != (8, 0)):
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "Q", head[8:]) if big else struct.unpack(order + "I", head[4:8])
    t = _tags(reader, order, at, big)
    compression = t.get(COMPRESSION, (1,))[0]
    if compression != 1 and compression not in DEFLATE:
        raise ValueError(f"unsupported TIFF compression {compression}")
    if t.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("unsupported TIFF predictor")
    n_cols, n_rows, n_bands = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    if len(set(t.get(BITS, (1,)))) != 1 or t.get(BITS, (1,))[0] % 8:
        raise ValueError("bands must share one whole-byte sample size")
    kind = KIND_OF_FORMAT[t.get(SAMPLE_FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{t[BITS][0] // 8}")
    if TILE_OFFSETS in t:
        seg_w, seg_h, offsets, counts = t[TILE_W][0], t[TILE_H][0], t[TILE_OFFSETS], t[TILE_COUNTS]
    else:
        seg_w, seg_h = n_cols, min(t.get(ROWS_PER_STRIP, (n_rows,))[0], n_rows)
        offsets, counts = t[STRIP_OFFSETS], t[STRIP_COUNTS]
    if PIXEL_SCALE not in t or TIEPOINT not in t:
        raise ValueError("not georeferenced by a pixel scale and a tie point")
    sx, sy = t[PIXEL_SCALE][:2]
    px, py, _, x, y, _ = t[TIEPOINT][:6]
    keys = t.get(GEO_KEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    if geo.get(RASTER_TYPE) == 2:          # the tie point names a cell centre, not its corner
        px, py = px + 0.5, py + 0.5
    xmin, ymax = x - px * sx, y + py * sy
    nodata = float(t[NODATA][0]) if NODATA in t else None
    return Header(order, n_cols, n_rows, n_bands, dtype, compression, t.get(PLANAR, (1,))[0],
                  seg_w, seg_h, offsets, counts,
                  (xmin, ymax - n_rows * sy, xmin + n_cols * sx, ymax),
                  geo.get(PROJECTED_CRS, geo.get(GEOGRAPHIC_CRS, 0)), nodata)


def _segment(reader, h: Header, index: int, rows: int, planes: int) -> np.ndarray:
    """One strip or tile as (rows, seg_w, planes) doubles, NoData and what has no bytes as NaN."""
    if h.counts[index] == 0:
        return np.full((rows, h.seg_w, planes), np.nan)
    raw = reader.read(h.offsets[index], h.counts[index])
    if h.compression in DEFLATE:
        raw = zlib.decompress(raw)
    stored = np.frombuffer(raw, h.dtype, rows * h.seg_w * planes).reshape(rows, h.seg_w, planes)
    values = stored.astype(float)
    if h.nodata is not None and not np.isnan(h.nodata):
        values[values == h.nodata] = np.nan
    return values


def in_strips(h: Header, window_cells: int) -> Header:
    """The same file with large uncompressed strips as several, of whole rows and at most
    ``window_cells`` cells: a row lies at a known byte, so shares may begin inside a strip."""
    most = max(1, window_cells // h.n_cols)
    if h.compression != 1 or h.seg_w != h.n_cols or h.seg_h <= most:
        return h
    rows = most if h.down == 1 else max(d for d in range(1, most + 1) if h.seg_h % d == 0)
    width = h.n_cols * h.dtype.itemsize * (1 if h.planar == 2 else h.n_bands)
    offsets, counts = [], []
    for plane in range(h.n_bands if h.planar == 2 else 1):
        for strip in range(h.down):
            held = min(h.seg_h, h.n_rows - strip * h.seg_h)
            for top in range(0, held, rows):
                offsets.append(h.offsets[plane * h.down + strip] + top * width)
                counts.append(min(rows, held - top) * width)
    return replace(h, seg_h=rows, offsets=tuple(offsets), counts=tuple(counts))


def read_windows(reader, h: Header, bands: list[int], part: int = 0, parts: int = 1,
                 window_cells: int = WINDOW_CELLS):
    """(band, c0, r0, w, h, values) of one share of a file's strips or tiles.

    Neighbouring strips are joined up to ``window_cells``, large uncompressed ones are cut; a file
    tile is always a window.
    """
    h = in_strips(h, window_cells)
    striped = h.seg_w == h.n_cols
    per_window = max(1, window_cells // (h.seg_w * h.seg_h)) if striped else 1
    n_windows = -(-h.down // per_window) * h.across
    for i in range(part * n_windows // parts, (part + 1) * n_windows // parts):
        first, across = (i // h.across) * per_window, i % h.across
        stacks = {b: [] for b in bands}
        for down in range(first, min(first + per_window, h.down)):
            index, r0 = down * h.across + across, down * h.seg_h
            rows = h.seg_h if not striped else min(h.seg_h, h.n_rows - r0)
            if h.planar == 2:
                for b in bands:
                    plane = b * h.across * h.down + index
                    stacks[b].append(_segment(reader, h, plane, rows, 1)[:, :, 0])
            else:
                block = _segment(reader, h, index, rows, h.n_bands)
                for b in bands:
                    stacks[b].append(block[:, :, b])
        c0, r0 = across * h.seg_w, first * h.seg_h
        for b in bands:
            values = np.concatenate(stacks[b])[:h.n_rows - r0, :h.n_cols - c0]
            yield b, c0, r0, values.shape[1], values.shape[0], values


def _scene_batch(name, order, h: Header, window) -> pa.RecordBatch:
    band, c0, r0, w, rows, values = window
    flat = values.ravel()
    cells = pa.ListArray.from_arrays(pa.array([0, flat.size], pa.int32()),
                                     pa.array(flat, pa.float64(), mask=np.isnan(flat)))
    i32, f64 = pa.int32(), pa.float64()
    cols = {"scene": pa.array([name]), "ord": pa.array([order], pa.int64()),
            "epsg": pa.array([h.epsg], i32),
            **{n: pa.array([v], f64) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), h.extent)},
            "n_cols": pa.array([h.n_cols], i32), "n_rows": pa.array([h.n_rows], i32),
            "cell_type": pa.array([h.cell_type]), "band": pa.array([band], i32),
            "c0": pa.array([c0], i32), "r0": pa.array([r0], i32),
            "w": pa.array([w], i32), "h": pa.array([rows], i32), "cells": cells}
    return pa.RecordBatch.from_pydict(cols)


class _Share(InputPartition):
    """Files of one task: (path, ord, part, parts)."""

    def __init__(self, files):
        self.files = files


class GeoTiffReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.header_only = str(options.get("header_only", "false")).lower() == "true"
        bands = options.get("bands")
        self.bands = [int(b) for b in bands.split(",")] if bands else None
        self.target_bytes = int(options.get("target_bytes", TARGET_BYTES))
        self.window_cells = int(options.get("window_cells", WINDOW_CELLS))
        scenes, extent = options.get("scenes"), options.get("extent")
        self.scenes = set(json.loads(scenes)) if scenes else None
        self.extent = tuple(map(float, extent.split(","))) if extent else None

    def _meets(self, h: Header) -> bool:
        if self.extent is None:
            return True
        (x0, y0, x1, y1), (xmin, ymin, xmax, ymax) = self.extent, h.extent
        return xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0

    def partitions(self):
        files = [(p, i, n) for i, (p, n) in enumerate(list_sized(self.path, (".tif",)))
                 if self.scenes is None or posixpath.basename(p) in self.scenes]
        if self.header_only:
            shares = [(p, i, 0, 1) for p, i, _ in files]
            return [_Share(shares[i:i + HEADERS_PER_TASK])
                    for i in range(0, len(shares), HEADERS_PER_TASK)]
        out, pending, size = [], [], 0
        for path, i, length in files:
            parts = -(-length // self.target_bytes) or 1
            if parts > 1:
                out += [_Share([(path, i, p, parts)]) for p in range(parts)]
                continue
            if pending and size + length > self.target_bytes:
                out.append(_Share(pending))
                pending, size = [], 0
            pending.append((path, i, 0, 1))
            size += length
        return out + ([_Share(pending)] if pending else [])

    def read(self, partition):
        for path, order, part, parts in partition.files:
            name = posixpath.basename(path)
            with RangeReader(path) as reader:
                h = read_header(reader)
                if not self._meets(h):
                    continue
                if self.header_only:
                    yield (name, order, h.epsg, *h.extent, h.n_cols, h.n_rows, h.n_bands,
                           h.cell_type, path)
                    continue
                bands = range(h.n_bands) if self.bands is None else [b for b in self.bands if b < h.n_bands]
                for window in read_windows(reader, h, bands, part, parts, self.window_cells):
                    yield _scene_batch(name, order, h, window)


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff")``; options header_only, bands, scenes, extent, target_bytes,
    window_cells."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        heads = str(self.options.get("header_only", "false")).lower() == "true"
        return HEADER_SCHEMA if heads else SCENE_SCHEMA

    def reader(self, schema):
        return GeoTiffReader(self.options)


def read_scenes(spark: SparkSession, path: str, bands: list[int] | None = None, scenes: list[str] | None = None,
                extent: tuple[float, float, float, float] | None = None, **options) -> DataFrame:
    """Scene windows of every ``.tif`` under ``path``; ``ord`` is the file's rank by name.

    ``scenes`` names the files to open; of files whose box does not meet ``extent`` (touching counts)
    only the header is read, of the others only the ``bands``. These are arguments and not filters that
    Spark pushes down: in 4.1 a Python source keeps what one query has pushed for the next query over
    the same DataFrame.
    """
    spark.dataSource.register(GeoTiffSource)
    reader = spark.read.format("geotiff").options(**options)
    if bands is not None:
        reader = reader.option("bands", ",".join(map(str, bands)))
    if scenes is not None:
        reader = reader.option("scenes", json.dumps(scenes))
    if extent is not None:
        reader = reader.option("extent", ",".join(repr(float(v)) for v in extent))
    return reader.load(qualified(spark, path))


def raster_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per file from its header; no pixel byte is read."""
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").option("header_only", "true").load(qualified(spark, path))


def read_scenes_binary(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """The same scan through Spark's own file access, for filesystems tasks cannot open themselves.

    A file is one row of one task here. ``ord`` is the file's rank by name and path, from a listing
    without contents that is ranked in two steps: by file in ranges of names, then by range.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.tif")
             .option("recursiveFileLookup", "true").load(path)
             .withColumn("scene", F.element_at(F.split("path", "/"), -1)))
    listed = materialize(files.select("scene", "path").repartitionByRange("scene", "path")
                         .sortWithinPartitions("scene", "path")
                         .withColumn("share", F.spark_partition_id())
                         .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    ahead = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)     # one row a range of names
    before = listed.groupBy("share").agg(F.count("*").alias("n")).select(
        "share", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    ranked = listed.join(before, "share").select("path", (F.col("base") + F.col("place")).alias("ord"))
    files = files.join(ranked, "path").select("scene", "ord", "content")

    def decode(batches):
        for batch in batches:
            for name, order, content in zip(batch.column("scene"), batch.column("ord"), batch.column("content")):
                reader = BytesReader(content.as_py())
                h = read_header(reader)
                wanted = bands if bands is not None else list(range(h.n_bands))
                for window in read_windows(reader, h, wanted):
                    yield _scene_batch(name.as_py(), order.as_py(), h, window)

    return files.mapInArrow(decode, SCENE_SCHEMA)


def stored_values(bands: list[np.ndarray], dtype: np.dtype) -> tuple[list[np.ndarray], int | float | None]:
    """Bands as stored in a file of the type, and its NoData value (None where no cell is empty)."""
    if dtype.kind == "f":
        return [band.astype(dtype) for band in bands], np.nan
    limits, kept = np.iinfo(dtype), []
    for band in bands:
        whole = np.rint(band)
        if (whole < limits.min).any() or (whole > limits.max).any() or np.isinf(whole).any():
            raise ValueError(f"a cell value is beyond {dtype.name}")
        kept.append(whole)
    if not any(np.isnan(w).any() for w in kept):
        return [w.astype(dtype) for w in kept], None
    used = np.unique(np.concatenate([np.unique(w[~np.isnan(w)]) for w in kept]))
    gap = np.flatnonzero(used != limits.min + np.arange(len(used)))
    empty = limits.min + int(gap[0] if len(gap) else len(used))
    if empty > limits.max:
        raise ValueError(f"no value of {dtype.name} is left for empty cells")
    return [np.where(np.isnan(w), empty, w).astype(dtype) for w in kept], empty


def encode_geotiff(bands: list[np.ndarray], extent, epsg: int, cell_type: str = "float64",
                   deflate: bool = False, order: str = "<", strip_cells: int = STRIP_CELLS) -> bytes:
    """A striped, planar GeoTIFF of equally sized bands, in strips of at most ``strip_cells`` cells.

    NaN is NoData in floating types. Whole-number types take values rounded to the nearest (halves
    to even); a value beyond the type raises. They get a NoData value only where a cell is empty:
    the lowest value of the type that no cell has, which raises if all are in use.
    """
    n_rows, n_cols = bands[0].shape
    dtype = np.dtype(cell_type).newbyteorder(order)
    xmin, ymin, xmax, ymax = extent
    bands, empty = stored_values(bands, dtype)
    rows_per_strip = max(1, min(n_rows, strip_cells // n_cols))
    strips = []
    for band in bands:
        for top in range(0, n_rows, rows_per_strip):
            data = band[top:top + rows_per_strip].tobytes()
            strips.append(zlib.compress(data, 6) if deflate else data)
    n = len(bands)

    def front(offsets) -> bytes:
        """Everything before the pixels, with the strips at ``offsets``."""
        fields = _image_fields(n_cols, n_rows, n, dtype, extent, epsg, empty, 8 if deflate else 1)
        fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, (rows_per_strip,)),
                   (STRIP_COUNTS, 4, tuple(len(s) for s in strips))]
        return directory(fields, order)[0]

    at = len(front((0,) * len(strips))) + np.cumsum([0] + [len(s) for s in strips[:-1]])
    return front(tuple(int(o) for o in at)) + b"".join(strips)


def _image_fields(n_cols, n_rows, n_bands, dtype, extent, epsg, empty, compression) -> list[tuple]:
    """Tags of a planar, georeferenced image, without those that place its pixels."""
    geographic = epsg == 4326
    geo = (1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1,
           GEOGRAPHIC_CRS if geographic else PROJECTED_CRS, 0, 1, epsg)
    kind = {k: code for code, k in KIND_OF_FORMAT.items()}[dtype.kind]
    xmin, ymin, xmax, ymax = extent
    fields = [
        (WIDTH, 4, (n_cols,)), (HEIGHT, 4, (n_rows,)), (BITS, 3, (dtype.itemsize * 8,) * n_bands),
        (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (n_bands,)), (PLANAR, 3, (2,)),
        (SAMPLE_FORMAT, 3, (kind,) * n_bands),
        (PIXEL_SCALE, 12, ((xmax - xmin) / n_cols, (ymax - ymin) / n_rows, 0.0)),
        (TIEPOINT, 12, (0.0, 0.0, 0.0, xmin, ymax, 0.0)), (GEO_KEYS, 3, geo),
    ]
    if empty is not None:
        fields.append((NODATA, 2, b"nan\0" if dtype.kind == "f" else b"%d\0" % empty))
    return fields


def directory(fields: list[tuple], order: str = "<", big: bool = False) -> tuple[bytes, dict[int, int], int]:
    """File head and tag directory; with it the byte where each tag's values lie and the end of all.

    A field is ``(tag, type, values)``. A whole number in place of the values stands for that many
    zeros to be written later: they lie behind all others and the bytes returned end before them.
    """
    length, head, word, width, inline = _widths(big)
    packed = []
    for tag, code, value in sorted(fields):
        late = isinstance(value, int)
        form = f"{order}{value if late else len(value)}{FIELD_TYPES[code]}"
        raw = value if code == 2 else b"" if late else struct.pack(form, *value)
        packed.append((tag, code, value if late else len(value), raw, struct.calcsize(form) if late else len(raw), late))
    first = 16 if big else 8
    entries_at = first + struct.calcsize("=" + length)
    end, places, extra = entries_at + width * len(packed) + inline, {}, b""
    for tag, _, _, raw, size, late in sorted(packed, key=lambda p: p[-1]):
        if size > inline:
            places[tag] = end
            end += size + size % 2
            extra += b"" if late else raw + b"\0" * (size % 2)
    entries = b""
    for i, (tag, code, count, raw, _, _) in enumerate(packed):
        entries += struct.pack(order + head, tag, code, count)
        entries += struct.pack(order + word, places[tag]) if tag in places else raw.ljust(inline, b"\0")
        places.setdefault(tag, entries_at + width * (i + 1) - inline)
    mark = b"II" if order == "<" else b"MM"
    top = struct.pack(order + "HHHQ", BIG, 8, 0, first) if big else struct.pack(order + "HI", CLASSIC, first)
    return (mark + top + struct.pack(order + length, len(packed)) + entries + b"\0" * inline + extra,
            places, end)


class TiledFile:
    """An uncompressed tiled raster whose every byte has its place before any pixel is known, so that
    many tasks write one file.

    ``head`` comes first, ``n_bytes`` is the length. Each tile of a band goes to its place with the two
    entries that point to it (``pieces``); what is never written reads as zeros, and an entry of zero
    is an empty tile. Files that 32 bits do not reach are BigTIFF.
    """

    def __init__(self, tiles: tuple[int, int], tile: tuple[int, int], n_bands: int, dtype: np.dtype, extent,
                 epsg: int, empty: int | float | None, big: bool | None = None):
        (self.across, self.down), (self.tile_w, self.tile_h) = tiles, tile
        self.dtype, self.n_bands = dtype, n_bands
        self.tile_bytes = self.tile_w * self.tile_h * dtype.itemsize
        n_tiles = self.across * self.down * n_bands
        fields = _image_fields(self.across * self.tile_w, self.down * self.tile_h, n_bands, dtype, extent, epsg,
                               empty, 1)
        fields += [(TILE_W, 4, (self.tile_w,)), (TILE_H, 4, (self.tile_h,))]
        for self.big in (False, True) if big is None else (big,):
            self.code = 16 if self.big else 4
            self.head, places, end = directory(
                fields + [(TILE_OFFSETS, self.code, n_tiles), (TILE_COUNTS, self.code, n_tiles)], big=self.big)
            self.pixels_at = -(-end // PAGE) * PAGE
            self.n_bytes = self.pixels_at + n_tiles * self.tile_bytes
            if self.n_bytes < 1 << 32:
                break
        self.tables = places[TILE_OFFSETS], places[TILE_COUNTS]

    def pieces(self, col: int, row: int, band: int, pixels: bytes) -> list[tuple[int, bytes]]:
        """(place, bytes) of one tile, ``col`` and ``row`` counted from the file's corner."""
        index = (band * self.down + row) * self.across + col
        form = "<" + FIELD_TYPES[self.code]
        place = self.pixels_at + index * self.tile_bytes
        entries = [(table + index * struct.calcsize(form), struct.pack(form, value))
                   for table, value in zip(self.tables, (place, len(pixels)))]
        return [(place, pixels), *entries]
