"""Operators on features: grid keys, joins with tiles, clipping, grouping, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastergrid.functions import geometry as G
from rastergrid.functions.grid import BOX, Layout, drop_negative_keys, explode_keys, named, number
from rastergrid.operators import kernels as K
from rastergrid.session import materialize

COARSE = 16            # blocks a side that a feature of few edges is first cut into
FEW_EDGES = 64         # features of more edges start with fewer blocks
STEP = 2               # halvings a side from one deal to the next
LIST_SIZE = 4096       # features one grouped list holds at most
_BLOCK = tuple("b_" + c for c in BOX)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal blocks over all tasks, so one giant feature is not exploded by a single task. The
    explicit number keeps AQE from folding the still-small partitions together again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def with_envelope(features: DataFrame) -> DataFrame:
    """Add the bounding-box columns."""
    return features.withColumns({n: F.expr(e) for n, e in G.envelope("rings").items()})


def _first_level(coarse: int, edges: str) -> str:
    """Level (halvings a side above one key) of the blocks a key range is first cut into."""
    bits = f"if({edges} > {FEW_EDGES}, {min(STEP, (coarse - 1).bit_length())}, {(coarse - 1).bit_length()})"
    span = "length(bin(greatest(cmax - cmin, rmax - rmin, 1)))"
    return f"greatest(0, {STEP} * int(ceil(({span} - {bits}) / {STEP})))"


def _halved(ranged: DataFrame, layout: Layout) -> DataFrame:
    """One row for each block of ``level`` of a key range: ``bcol, brow``, the part of the range in the
    block, and the rectangle of these keys (``b_xmin`` ...)."""
    blocks = named({f"b{c}": f"shiftright({c}, level)" for c in ("cmin", "rmin", "cmax", "rmax")})
    out = explode_keys(ranged.select("*", *blocks), "bcmin", "brmin", "bcmax", "brmax", "bcol", "brow")
    out = out.withColumns({n: F.expr(e) for n, e in {
        "cmin": "greatest(cmin, shiftleft(bcol, level))", "rmin": "greatest(rmin, shiftleft(brow, level))",
        "cmax": "least(cmax, shiftleft(bcol + 1, level) - 1)",
        "rmax": "least(rmax, shiftleft(brow + 1, level) - 1)"}.items()})
    first, last = layout.key_extent("cmin", "rmin"), layout.key_extent("cmax", "rmax")
    return out.withColumns({n: F.expr(e) for n, e in {
        "b_xmin": first["xmin"], "b_ymax": first["ymax"], "b_xmax": last["xmax"], "b_ymin": last["ymin"]}.items()})


def cover(features: DataFrame, layout: Layout, closed: bool = False, keep: tuple[str, ...] = (),
          coarse: int = COARSE) -> DataFrame:
    """Key ranges that cover what a feature intersects: ``fid``, the ``keep`` columns, ``level``,
    ``cmin, rmin, cmax, rmax``, ``edges, whole``; stored.

    A feature's key range is halved again and again. A half that no edge meets ends: outside, or as
    a ``whole`` range of up to 2^level keys a side that lies inside the polygon. Single keys that an
    edge meets come with the edges that decide for a point of the key. So the rows of a polygon grow
    with its outline, not with its area, and those of a line with its length, not with its box.

    Each half takes along the edges in its box, for a polygon also those east of it that end
    beside it; edges that pass it there from end to end become one, or cancel out. Halves are dealt to all tasks after every
    ``STEP`` halvings. ``closed`` also tries keys that the bounding box only touches.
    """
    area = G.is_kind("geom_type", G.POLYGONAL)
    shape = (f"CASE WHEN {G.is_kind('geom_type', G.PUNCTUAL)} THEN {G.point_edges('rings')} "
             f"ELSE {G.edges('rings')} END")
    ranged = features.select("fid", *keep, F.expr(area).alias("area"), F.expr(shape).alias("edges"),
                             *named(layout.key_range(closed=closed)))
    ranged = ranged.withColumn("level", F.expr(_first_level(coarse, "size(edges)")))
    beyond = (f"b_xmax + {number(layout.tile_w)}", f"b_ymin - {number(layout.tile_h)}", f"b_ymax + {number(layout.tile_h)}")
    done = []
    while True:
        cut = _halved(ranged, layout).withColumn("edges", F.expr(G.passed_edges("edges", "area", _BLOCK, beyond)))
        near = _spread(cut, "fid", "bcol", "brow").drop("bcol", "brow")
        tested = near.withColumn("met", F.expr(f"exists(edges, _e -> {G.segment_meets_rect('_e', _BLOCK)})"))
        hit = tested.where(f"met OR (area AND {G.point_in_polygon('edges', _BLOCK[0], _BLOCK[1])})")
        stored = materialize(hit.drop(*_BLOCK))
        done.append(stored.where("NOT met OR level = 0"))
        ranged = stored.where("met AND level > 0")
        if ranged.isEmpty():
            break
        ranged = ranged.drop("met").withColumn("level", F.col("level") - STEP)
    # Level edges never count as a crossing, and a whole range needs none.
    crossing = F.expr("filter(edges, _e -> met AND _e.y1 != _e.y2)").alias("edges")
    return reduce(DataFrame.unionAll, done).select(
        "fid", *keep, "level", "cmin", "rmin", "cmax", "rmax", crossing, F.expr("NOT met").alias("whole"))


def feature_keys(features: DataFrame, layout: Layout, closed: bool = False,
                 keep: tuple[str, ...] = (), coarse: int = COARSE) -> DataFrame:
    """Feature x grid key pairs whose rectangle the feature intersects: ``fid, col, row, edges,
    whole`` and the ``keep`` columns of the feature. ``whole`` marks keys inside a polygon that no
    edge meets; they need no further test."""
    return explode_keys(cover(features, layout, closed, keep, coarse)).select(
        "fid", *keep, "col", "row", "edges", "whole")


def meet_keys(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """``rows`` (with ``col, row``) joined with the ranges of a ``cover`` that hold their key.

    A block of a level is a prefix of the key's bits, so this is an equi-join on level and prefix: a
    row is tried once for each level there is (at most 16, mostly one), and a whole range stays one
    row however many keys it has.
    """
    levels = sorted(r["level"] for r in covered.select("level").distinct().collect())
    blocks = covered.withColumns({"b_level": F.col("level"), "b_col": F.expr("shiftright(cmin, level)"),
                                  "b_row": F.expr("shiftright(rmin, level)")}).drop("level", "cmin", "rmin", "cmax", "rmax")
    tried = rows.withColumn("b_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    tried = tried.withColumns({"b_col": F.expr("shiftright(col, b_level)"), "b_row": F.expr("shiftright(row, b_level)")})
    return tried.join(blocks, ["b_level", "b_col", "b_row"]).drop("b_level", "b_col", "b_row")


def polygonal(features: DataFrame) -> DataFrame:
    return features.where(G.is_kind("geom_type", G.POLYGONAL))


def points_in_polygons(points: DataFrame, polygons: DataFrame, layout: Layout) -> DataFrame:
    """Points ``x, y, ...`` paired with the polygons that hold them: adds ``fid``. Keys a polygon
    only touches are tried too: a point on their rim may count as inside. Other kinds hold no point."""
    keyed = points.select("*", *named({"col": layout.col_of("x"), "row": layout.row_of("y")}))
    joined = meet_keys(keyed, cover(polygonal(polygons), layout, closed=True))
    inside = joined.where(f"whole OR {G.point_in_polygon('edges', 'x', 'y')}")
    return inside.select("fid", *points.columns)


def grouped_lists(pairs: DataFrame, value: Column, list_size: int = LIST_SIZE) -> DataFrame:
    """Grid key -> ``value`` of its features in id order: ``col, row, part, items``.

    ``part`` is the range of ``list_size`` ids a feature belongs to, for every key alike: no list and
    no task grows with the key, and a new feature changes the list of its own part only.
    """
    lists = F.array_sort(F.collect_list(F.struct("fid", value.alias("item"))),
                         lambda a, b: F.when(a.fid < b.fid, -1).when(a.fid > b.fid, 1).otherwise(0))
    return (pairs.groupBy("col", "row", F.expr(f"fid div {list_size}").alias("part"))
            .agg(F.transform(lists, lambda s: s.item).alias("items")))


def features_per_key(pairs: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """Grid key -> sorted feature ids: ``col, row, part, items``."""
    return grouped_lists(pairs.select("col", "row", "fid"), F.col("fid"), list_size)


def feature_count_per_key(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("col", "row").agg(F.count("*").alias("n"))


def clip_to_grid(features: DataFrame, layout: Layout, coarse: int = COARSE) -> DataFrame:
    """Polygon features cut to each grid key: ``fid, geom_type, attrs, col, row, rings, area``.

    What a key cuts into several pieces comes back as several parts, each with its own holes, and
    ``geom_type`` follows. Outer rings run counter-clockwise from their least point, holes the other
    way. Keys the feature only touches have no area and drop out.

    Rings are cut to ever smaller blocks, dealt to all tasks in between, so a key is cut from a
    small ring; a block that lies inside the polygon is not cut further.
    """
    vertices = "aggregate(rings, 0, (_n, _r) -> _n + size(_r.pts))"
    ranged = polygonal(features).select("fid", "attrs", "rings", *named(layout.key_range()))
    left = ranged.withColumn("level", F.expr(_first_level(coarse, vertices)))
    done, schema = [], None
    while True:
        schema = schema or left.withColumn("solid", F.lit(True)).schema
        dealt = _spread(left, "fid", "cmin", "rmin")
        stored = materialize(dealt.mapInArrow(K.clip_blocks(layout, dealt.columns), schema))
        done.append(stored.where("solid OR level = 0"))
        left = stored.where("NOT solid AND level > 0")
        if left.isEmpty():
            break
        left = left.drop("solid").withColumn("level", F.col("level") - STEP)
    keyed = explode_keys(reduce(DataFrame.unionAll, done)).select(
        "*", *named({"k_" + n: e for n, e in layout.key_extent().items()}))
    square = F.expr(f"array(struct(0 AS part, 0 AS ring, {G.rect_ring(tuple('k_' + c for c in BOX))} AS pts))")
    rings = F.when(F.col("solid"), square).otherwise(F.col("rings")).alias("rings")
    kind = "if(size(filter(rings, _r -> _r.ring = 0)) > 1, 'multipolygon', 'polygon')"
    return (keyed.select("fid", "attrs", "col", "row", rings).withColumn("area", F.expr(G.polygon_area("rings")))
            .where("area > 0").select("fid", F.expr(kind).alias("geom_type"), "attrs", "col", "row", "rings", "area"))


def promote_multipolygon(features: DataFrame) -> DataFrame:
    """Polygons become multipolygons, multipolygons stay, every other kind is dropped."""
    return (features.where(G.is_kind("geom_type", G.POLYGONAL))
            .withColumn("geom_type", F.lit("multipolygon")))


def clipped_features_per_key(features: DataFrame, layout: Layout, list_size: int = LIST_SIZE,
                             whole: bool = False) -> DataFrame:
    """Clip, promote, drop negative keys, group by key. Items are ids, or with ``whole`` the features
    themselves: ``fid, attrs, rings`` as cut to the key."""
    clipped = drop_negative_keys(promote_multipolygon(clip_to_grid(features, layout)))
    item = F.struct("fid", "attrs", "rings") if whole else F.col("fid")
    pairs = clipped.select("col", "row", "fid", item.alias("value"))
    return grouped_lists(pairs, F.col("value"), list_size)


def uids_per_key(features: DataFrame, layout: Layout, list_size: int = LIST_SIZE) -> DataFrame:
    """Grid key -> the UID attribute of the features that meet it, in id order."""
    named = features.withColumn("uid", F.col("attrs")["UID"])
    pairs = drop_negative_keys(feature_keys(named, layout, keep=("uid",)))
    return grouped_lists(pairs.select("fid", "uid", "col", "row"), F.col("uid"), list_size)


def features_by_footprint(features: DataFrame, tiles: DataFrame, layout: Layout) -> DataFrame:
    """Features meeting the union of the tile rectangles (touching counts).

    Tile keys meet the features' key ranges, then features the ids that survive; nothing is
    collected and no side is assumed small.
    """
    keys = tiles.select("col", "row").distinct()
    hits = meet_keys(keys, cover(features, layout, closed=True)).select("fid").distinct()
    return features.join(hits, "fid", "left_semi")


def metadata_json(features: DataFrame, chunk: int = LIST_SIZE) -> DataFrame:
    """Attribute objects as JSON text in id order: ``part, json``.

    One text per range of ``chunk`` ids; the parts joined by ',\\n' in order are the whole list,
    which as a single value would have to pass through one task.
    """
    part = F.expr(f"fid div {chunk}").alias("part")
    ordered = F.sort_array(F.collect_list(F.struct("fid", F.to_json("attrs").alias("obj"))))
    return features.groupBy(part).agg(
        F.array_join(F.transform(ordered, lambda s: s.obj), ",\n").alias("json"))


def attribute(features: DataFrame, name: str, data_type: str) -> Column:
    """One attribute cast to a type; a missing name or unreadable text is NULL."""
    return F.col("attrs")[name].try_cast(data_type)


def of_kind(features: DataFrame, kind: str, field: str | None = None,
            data_type: str = "string") -> DataFrame:
    """Features of one geometry kind; with ``field`` that attribute becomes ``data``."""
    out = features.where(F.col("geom_type") == kind)
    if field is None:
        return out
    return out.select("fid", "geom_type", "rings", attribute(out, field, data_type).alias("data"))


def first_feature(features: DataFrame) -> DataFrame:
    """The feature a single-polygon query uses: id 0."""
    return features.where("fid = 0")


def count_vertices(features: DataFrame) -> DataFrame:
    polygons = features.where("geom_type = 'multipolygon'")
    return polygons.agg(F.sum(F.expr(G.vertex_count("rings"))).alias("vertices"))


def count_features(features: DataFrame) -> DataFrame:
    return features.where("geom_type = 'multipolygon'").agg(F.count("*").alias("features"))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Row counts of named tables as ``(stage, n)``."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionAll(one)
    return out
