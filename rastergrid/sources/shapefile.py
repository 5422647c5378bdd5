"""Shapefile scan: a Python data source whose tasks read ranges of records.

The record count of a file follows from the size of its ``.shx`` index, so the listing alone
gives every task its record range and every record its dataset-wide ``fid``. A task reads its
slice of the index, one byte range of the geometry file and one of the attribute table.
"""

from __future__ import annotations

import codecs
import posixpath
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rastergrid.model import FEATURE_SCHEMA
from rastergrid.session import qualified
from rastergrid.sources.fs import RangeReader, list_sized

TARGET_BYTES = 32 << 20
BATCH_BYTES = 8 << 20

# Shape type codes (Z and M variants add 10 and 20).
POINT, POLYLINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
MULTI_KIND = {POINT: "point", POLYLINE: "multiline", POLYGON: "multipolygon", MULTIPOINT: "multipoint"}
SINGLE_KIND = {POLYLINE: "line", POLYGON: "polygon"}


def parse_record(content: bytes) -> tuple[int, list[tuple[int, int, np.ndarray]]]:
    """Base shape type and (part, ring, points) paths of one record's content."""
    (code,) = struct.unpack_from("<i", content, 0)
    base = code % 10
    if code == 0:
        return 0, []
    if base == POINT:
        return POINT, [(0, 0, np.frombuffer(content, "<f8", 2, 4).reshape(1, 2))]
    if base == MULTIPOINT:
        (n,) = struct.unpack_from("<i", content, 36)
        return MULTIPOINT, [(0, 0, np.frombuffer(content, "<f8", 2 * n, 40).reshape(n, 2))]
    if base not in (POLYLINE, POLYGON):
        raise ValueError(f"unsupported shape type {code}")
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = struct.unpack_from(f"<{n_parts}i", content, 44) + (n_points,)
    pts = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(n_points, 2)
    paths, part, ring = [], -1, 0
    for a, b in zip(starts, starts[1:]):
        xy = pts[a:b]
        hole = False
        if base == POLYGON and part >= 0:
            # Outer rings run clockwise; a counter-clockwise ring is a hole of the part before it.
            turn = np.sum(xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1])
            hole = turn > 0
        part, ring = (part, ring + 1) if hole else (part + 1, 0)
        paths.append((part, ring, xy))
    return base, paths


def _dbf_layout(reader: RangeReader):
    head = reader.read(0, 32)
    header_len, record_len = struct.unpack_from("<HH", head, 8)
    block = reader.read(32, header_len - 32)
    fields, at = [], 1
    for i in range(0, len(block) - 31, 32):
        if block[i] == 0x0D:
            break
        name = block[i:i + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(block[i + 11]), at, block[i + 16]))
        at += block[i + 16]
    return header_len, record_len, fields


def _attribute_rows(path: str, first: int, count: int, encoding: str):
    """Attribute dicts of a record range, None for records marked as deleted; texts lose trailing
    blanks, empty numbers are NULL."""
    with RangeReader(path) as reader:
        header_len, record_len, fields = _dbf_layout(reader)
        raw = reader.read(header_len + first * record_len, count * record_len)
    for i in range(count):
        row = raw[i * record_len:(i + 1) * record_len]
        if row[:1] == b"*":
            yield None
            continue
        out = {}
        for name, kind, at, size in fields:
            text = row[at:at + size].decode(encoding)
            out[name] = text.rstrip(" \0") if kind == "C" else (text.strip(" \0") or None)
        yield out


def _feature_batch(rows) -> pa.RecordBatch:
    """(fid, kind, paths, attrs) rows as one Arrow batch with nested rings."""
    part, ring, ring_ends, row_ends, xy, boxes = [], [], [0], [0], [np.zeros((0, 2))], []
    for _, _, paths, _ in rows:
        for p, r, pts in paths:
            part.append(p)
            ring.append(r)
            ring_ends.append(ring_ends[-1] + len(pts))
            xy.append(pts)
        row_ends.append(len(part))
        own = np.concatenate([pts for _, _, pts in paths]) if paths else np.zeros((0, 2))
        boxes.append((*own.min(axis=0), *own.max(axis=0)) if len(own) else (None,) * 4)
    flat = np.concatenate(xy)
    pts = pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["x", "y"]))
    rings = pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(part, pa.int32()), pa.array(ring, pa.int32()), pts], ["part", "ring", "pts"]))
    box = list(zip(*boxes)) if boxes else [[]] * 4
    return pa.RecordBatch.from_pydict({
        "fid": pa.array([r[0] for r in rows], pa.int64()),
        "geom_type": pa.array([r[1] for r in rows], pa.string()), "rings": rings,
        "attrs": pa.array([list(r[3].items()) for r in rows], pa.map_(pa.string(), pa.string())),
        **{n: pa.array(v, pa.float64()) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), box)}})


# Names of code pages in .cpg files that Python knows under another name.
CODE_PAGES = {"88591": "latin-1", "ISO88591": "latin-1", "ANSI 1252": "cp1252", "65001": "utf-8", "OEM 437": "cp437"}


def code_page(path: str) -> str:
    """Encoding that a ``.cpg`` file names; latin-1 where Python does not know it."""
    with RangeReader(path) as reader:
        name = reader.read(0, 64).decode("ascii", "replace").strip(" \0\r\n\t")
    try:
        return codecs.lookup(CODE_PAGES.get(name, name)).name
    except LookupError:
        return "latin-1"


class _Records(InputPartition):
    def __init__(self, shp, shx, dbf, cpg, first, count, fid0):
        self.shp, self.shx, self.dbf, self.cpg = shp, shx, dbf, cpg
        self.first, self.count, self.fid0 = first, count, fid0


class ShapefileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.single_part = str(options.get("single_part", "false")).lower() == "true"
        self.encoding = options.get("encoding")
        self.target_bytes = int(options.get("target_bytes", TARGET_BYTES))
        kind = options.get("kind")
        self.codes = kind and {c for c in MULTI_KIND if kind in (MULTI_KIND[c], SINGLE_KIND.get(c))}

    def _sizes(self) -> dict[str, int]:
        """Sizes of the files to read; of one ``.shp`` those of its own set, without its folder."""
        suffixes = (".shp", ".shx", ".dbf", ".cpg")
        if not self.path.endswith(".shp"):
            return dict(list_sized(self.path, suffixes))
        sized = dict(list_sized(self.path, suffixes))
        for suffix in suffixes[1:]:
            try:
                sized |= dict(list_sized(self.path[:-4] + suffix, suffixes))
            except FileNotFoundError:
                pass
        return sized

    def partitions(self):
        sized = self._sizes()
        out, fid0 = [], 0
        for shp in sorted((p for p in sized if p.endswith(".shp")),
                          key=lambda p: (posixpath.basename(p), p)):
            stem = shp[:-4]
            if stem + ".shx" not in sized:
                raise FileNotFoundError(stem + ".shx")
            n = (sized[stem + ".shx"] - 100) // 8
            dbf, cpg = (stem + ext if stem + ext in sized else None for ext in (".dbf", ".cpg"))
            parts = max(1, min(n, -(-sized[shp] // self.target_bytes)))
            for p in range(parts):
                a, b = p * n // parts, (p + 1) * n // parts
                if b > a:
                    out.append(_Records(shp, stem + ".shx", dbf, cpg, a, b - a, fid0))
            fid0 += n
        return out

    def _kind(self, base: int, paths) -> str | None:
        if self.single_part and base in SINGLE_KIND and len({p for p, _, _ in paths}) == 1:
            return SINGLE_KIND[base]
        return MULTI_KIND.get(base)

    def read(self, p):
        if self.codes is not None:
            with RangeReader(p.shp) as shapes:     # the shape code of all records, from the file's head
                if int.from_bytes(shapes.read(32, 4), "little") % 10 not in self.codes:
                    return
        encoding = self.encoding or (code_page(p.cpg) if p.cpg else "latin-1")
        with RangeReader(p.shx) as index, RangeReader(p.shp) as shapes:
            table = np.frombuffer(index.read(100 + 8 * p.first, 8 * p.count), ">i4").reshape(-1, 2)
            start = 2 * table[:, 0].astype(np.int64)
            length = 2 * table[:, 1].astype(np.int64)
            batch_of = np.cumsum(length + 8) // BATCH_BYTES
            cuts = [0, *(np.nonzero(np.diff(batch_of))[0] + 1), p.count]
            for lo, hi in zip(cuts, cuts[1:]):
                first, count = p.first + int(lo), int(hi - lo)
                base = int(start[lo:hi].min())
                block = shapes.read(base, int((start + length)[lo:hi].max()) + 8 - base)
                attrs = (_attribute_rows(p.dbf, first, count, encoding) if p.dbf
                         else ({} for _ in range(count)))
                rows = []
                for i, row in enumerate(attrs):
                    if row is None:
                        continue
                    at = int(start[lo + i]) - base + 8
                    code, paths = parse_record(block[at:at + int(length[lo + i])])
                    rows.append((p.fid0 + first + i, self._kind(code, paths), paths, row))
                yield _feature_batch(rows)


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile")``; options kind, single_part, encoding, target_bytes. Of files
    that cannot hold ``kind`` only the head is read."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return FEATURE_SCHEMA

    def reader(self, schema):
        return ShapefileReader(self.options)


def read_features(spark: SparkSession, path: str, single_part: bool = False,
                  **options) -> DataFrame:
    """Features of one ``.shp`` or of every one under a folder.

    Records that the attribute table marks as deleted are left out; ``fid`` counts them all the same.
    Texts are in the encoding of the ``.cpg`` file, or of the option ``encoding``, or latin-1.
    Polygon and line records are tagged as the multi kinds; with ``single_part`` a record of one
    part is tagged ``polygon`` or ``line``.
    """
    spark.dataSource.register(ShapefileSource)
    return (spark.read.format("shapefile").option("single_part", str(single_part).lower())
            .options(**options).load(qualified(spark, path)))


def features_of_kind(spark: SparkSession, path: str, kind: str,
                     single_part: bool | None = None) -> DataFrame:
    """Typed reader for one geometry kind; the single kinds need the number of parts looked at."""
    single = kind in ("line", "polygon") if single_part is None else single_part
    return read_features(spark, path, single_part=single, kind=kind).where(F.col("geom_type") == kind)


def shapefile_filesets(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files grouped by stem: ``stem, extensions, complete``; contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(F.substring_index(name, ".", 1).alias("stem"),
                     F.element_at(F.split(name, r"\."), -1).alias("ext")))
    sets = files.groupBy("stem").agg(F.sort_array(F.collect_set("ext")).alias("found"))
    needed = F.array(F.lit("dbf"), F.lit("shp"), F.lit("shx"))
    return sets.select("stem", F.array_join("found", ",").alias("extensions"),
                       (F.size(F.array_except(needed, "found")) == 0).alias("complete"))


