"""The query registry: one entry per operator, over whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastergrid.functions import geometry as G
from rastergrid.functions import grid, projection, scalars, sfc
from rastergrid.functions.grid import Layout
from rastergrid.operators import rasters as R
from rastergrid.operators import vectors as V
from rastergrid.plans import fixtures as X
from rastergrid.plans import pipelines as P
from rastergrid.session import materialize, shared_dir
from rastergrid.sources import files, geotiff, shapefile, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BITS = sfc.MAX_BITS
ENVELOPE = (200.0, 3500.0, 600.0, 3900.0)
BOX = ["xmin", "ymin", "xmax", "ymax"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scene_cells(scenes: DataFrame) -> DataFrame:
    """Scene windows as one row per non-NULL cell."""
    out = scenes.select("scene", "ord", "band", "n_cols", "c0", "r0", "w",
                        F.posexplode("cells").alias("pos", "value"))
    return out.where("value is not null").select(
        "scene", "ord", "band",
        F.expr("cast((r0 + pos div w) * n_cols + c0 + pos % w as int)").alias("k"), "value")


def _text(array: str) -> F.Column:
    return F.array_join(F.transform(array, lambda v: v.cast("string")), ",")


# Sources -------------------------------------------------------------------------

@query
def scan_geotiff(spark, sf):
    return _scene_cells(geotiff.read_scenes(spark, X.write_scene_files(spark, sf)))


@query
def scan_geotiff_named(spark, sf):
    named = geotiff.read_scenes(spark, X.write_scene_files(spark, sf))
    per_window = named.select("scene", "band", F.aggregate(
        "cells", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("total")),
        lambda a, v: F.struct((a.n + F.when(v.isNull(), 0).otherwise(1)).alias("n"),
                              (a.total + F.coalesce(v, F.lit(0.0))).alias("total"))).alias("s"))
    total = F.when(F.col("band") == 0, F.sum("s.total")).otherwise(scalars.round_at(F.sum("s.total"), 4))
    return per_window.groupBy("scene", "band").agg(F.sum("s.n").alias("n"), total.alias("total"))


@query
def scan_geotiff_extent(spark, sf):
    """Band 1 of the scenes that meet an extent; of the others no more than the header is read."""
    return _scene_cells(geotiff.read_scenes(spark, X.write_scene_files(spark, sf), [1], extent=(10.0, 3400.0, 380.0, 3720.0)))


@query
def scan_geotiff_binary(spark, sf):
    folder = X.write_scene_files(spark, sf)
    heads = geotiff.raster_catalog(spark, folder)
    tiled = R.tile_to_layout(geotiff.read_scenes_binary(spark, folder), X.LHALF, heads)
    return _rounded(R.tile_cells(tiled, X.LHALF))


@query
def scan_geotiff_whole_numbers(spark, sf):
    folders = X.write_whole_number_files(spark, sf)
    scans = [_scene_cells(geotiff.read_scenes(spark, folder)).withColumn("cell_type", F.lit(kind))
             for kind, folder in folders.items()]
    return scans[0].unionAll(scans[1])


@query
def raster_catalog(spark, sf):
    heads = geotiff.raster_catalog(spark, X.write_scene_files(spark, sf))
    return heads.select("scene", *BOX, "epsg", "n_cols", "n_rows", "n_bands", "cell_type")


@query
def list_files(spark, sf):
    found = files.list_files(spark, X.write_scene_files(spark, sf))
    return found.select(scalars.path_basename(F.col("path")).alias("name"),
                        (F.col("length") > 0).alias("filled"))


def _kind_files(spark, sf) -> str:
    return X.write_feature_files(X.kinds(spark, sf), shared_dir(spark) + "/kinds")


@query
def list_files_ext(spark, sf):
    found = files.list_files(spark, _kind_files(spark, sf), [".shp", ".dbf"])
    return found.select(scalars.path_basename(F.col("path")).alias("name"))


@query
def scan_shapefile(spark, sf):
    folder = X.write_feature_files(X.features(spark, sf), shared_dir(spark) + "/poly")
    return shapefile.read_features(spark, folder).select(
        F.col("attrs")["UID"].cast("bigint").alias("uid"), F.col("attrs")["NAME"].alias("name"),
        "geom_type", F.array_max(F.transform("rings", lambda r: r.part)).alias("last_part"),
        F.size("rings").alias("n_rings"), F.expr(G.vertex_count("rings")).alias("vertices"),
        F.expr(G.polygon_area("rings")).alias("area"), *BOX)


def _register_kinds():
    def whole(kind):
        def run(spark, sf):
            found = shapefile.features_of_kind(spark, _kind_files(spark, sf), kind, single_part=True)
            return found.select(F.col("attrs")["UID"].cast("bigint").alias("uid"),
                                F.col("attrs")["NAME"].alias("name"),
                                F.expr(G.coords_text("rings")).alias("coords"))
        return run

    def one_field(kind):
        def run(spark, sf):
            some = shapefile.features_of_kind(spark, _kind_files(spark, sf), kind, single_part=True)
            found = V.of_kind(some, kind, "NATION", "int")
            return found.select(F.expr(G.coords_text("rings")).alias("coords"), "data")
        return run

    for kind in X.KINDS:
        QUERIES[f"features_{kind}"] = whole(kind)
        QUERIES[f"features_{kind}_field"] = one_field(kind)


_register_kinds()


@query
def features_repartition(spark, sf):
    return X.features(spark, sf).repartition(40).select(
        "fid", "geom_type", F.expr(G.vertex_count("rings")).alias("vertices"))


@query
def shapefile_filesets(spark, sf):
    return shapefile.shapefile_filesets(spark, _kind_files(spark, sf))


# Sinks ---------------------------------------------------------------------------

def _mosaics(spark, sf, block=4) -> DataFrame:
    return P.pixels_by_polygon(X.tiles(spark, sf), X.features(spark, sf), X.L16, block)


@query
def write_geotiff(spark, sf):
    folder = shared_dir(spark) + "/mosaics"
    sinks.write_rasters(sinks.mosaic_rasters(_mosaics(spark, sf, 64), X.L16, 32651), folder)
    return _mosaic_files(spark, folder)


@query
def write_whole_geotiff(spark, sf):
    """Each polygon's pixels as one file that many tasks write."""
    folder = shared_dir(spark) + "/whole"
    masked = materialize(R.mask_tiles(X.tiles(spark, sf), X.features(spark, sf), X.L16))
    sinks.write_whole_rasters(masked.withColumn("name", F.format_string("mosaic_%d_whole.tif", "fid")),
                              X.L16, 32651, folder)
    return _mosaic_files(spark, folder)


def _mosaic_files(spark, folder) -> DataFrame:
    """Cells of written mosaics at their place on the grid of the scenes."""
    back = geotiff.read_scenes(spark, folder)
    at = back.select("scene", "band", "xmin", "ymax", "n_cols", "w", "c0", "r0",
                     F.posexplode("cells").alias("pos", "value")).where("value is not null")
    return at.select(
        F.regexp_extract("scene", r"^mosaic_(\d+)_", 1).cast("bigint").alias("fid"), "band",
        F.expr("cast((xmin - 0D) / 8 + c0 + pos % w as int)").alias("gc"),
        F.expr("cast((4096D - ymax) / 8 + r0 + pos div w as int)").alias("gr"), "value")


@query
def write_tiles(spark, sf):
    folder = shared_dir(spark) + "/tiles"
    sinks.write_rasters(sinks.tile_rasters(X.tiles(spark, sf), X.L16, 32651), folder)
    back = geotiff.read_scenes(spark, folder)
    key = F.split(F.regexp_replace("scene", r"\.tif$", ""), "_")
    tiled = back.select(key[0].cast("int").alias("col"), key[1].cast("int").alias("row"), "band", "cells")
    return R.tile_cells(tiled, X.L16)


@query
def write_metadata_json(spark, sf):
    folder = shared_dir(spark) + "/json"
    hits = V.features_by_footprint(X.features(spark, sf), X.tile_keys(spark, sf), X.L16)
    sinks.write_attribute_json(hits, folder)
    return spark.read.schema("UID string, NAME string, NATION string").json(folder)


@query
def write_lines(spark, sf):
    folder = shared_dir(spark) + "/lines"
    sinks.write_lines(X.table(spark, sf, "part"), F.col("p_name"), folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# Projections ---------------------------------------------------------------------

@query
def feature_attribute_map(spark, sf):
    return X.features(spark, sf).select("fid", F.explode("attrs").alias("name", "value"))


@query
def feature_attribute(spark, sf):
    f = X.features(spark, sf)
    return f.select("fid", V.attribute(f, "NATION", "int").alias("nation"),
                    V.attribute(f, "NAME", "int").isNull().alias("not_a_number"),
                    V.attribute(f, "NOTHING", "string").isNull().alias("missing"))


@query
def geom_envelope(spark, sf):
    return X.features(spark, sf).select(
        "fid", *(F.expr(e).alias(n) for n, e in G.envelope("rings").items()))


@query
def tile_extents(spark, sf):
    return R.tile_extents(X.tile_keys(spark, sf), X.L16)


@query
def extent_to_polygon(spark, sf):
    heads = X.scene_heads(spark, sf)
    return heads.select("scene", F.expr(G.path_text(G.rect_ring(BOX))).alias("ring"))


@query
def promote_multipolygon(spark, sf):
    return V.promote_multipolygon(X.kinds(spark, sf)).select("fid", "geom_type")


@query
def path_basename(spark, sf):
    return X.paths(spark, sf).select("p_partkey", scalars.path_basename(F.col("path")).alias("name"))


@query
def swap_extension(spark, sf):
    return X.paths(spark, sf).select("p_partkey", scalars.swap_extension(F.col("path")).alias("path"))


@query
def path_stem_glob(spark, sf):
    return X.paths(spark, sf).select("p_partkey", scalars.path_stem_glob(F.col("path")).alias("stem"))


@query
def attrs_to_json(spark, sf):
    return X.features(spark, sf).select("fid", F.to_json("attrs").alias("json"))


# Filters -------------------------------------------------------------------------

@query
def filter_tif(spark, sf):
    return X.paths(spark, sf).where(scalars.has_extension(F.col("path"), [".tif"]))


@query
def tiles_in_envelope(spark, sf):
    return R.tile_cells(R.tiles_in_envelope(X.tiles(spark, sf), X.L16, ENVELOPE), X.L16)


@query
def tiles_on_curve(spark, sf):
    """The envelope query over tables sorted along either curve, read by intervals of it."""
    parts = []
    for label in (sfc.HILBERT, sfc.ZORDER):
        table = materialize(R.sort_by_curve(X.tiles(spark, sf), label, BITS))
        found = R.tiles_on_curve(table, X.L16, ENVELOPE, label, BITS)
        parts.append(R.tile_cells(found.drop("sfc"), X.L16).withColumn("label", F.lit(label)))
    return parts[0].unionByName(parts[1])


@query
def drop_negative_keys(spark, sf):
    pairs = V.feature_keys(X.features(spark, sf), X.LSHIFT).select("fid", "col", "row")
    return grid.drop_negative_keys(pairs)


@query
def polygon_intersects_rect(spark, sf):
    pairs = V.feature_keys(X.features(spark, sf), X.L16, closed=True).select("fid", "col", "row")
    return pairs.join(X.tile_keys(spark, sf), ["col", "row"], "left_semi").select("fid", "col", "row")


@query
def point_in_polygon(spark, sf):
    centres = X.cells(spark, sf).select(
        "scene", "k", F.expr("8D * gc + 4").alias("x"), F.expr("4092D - 8 * gr").alias("y"))
    return V.points_in_polygons(centres, X.features(spark, sf), X.L16).select("fid", "scene", "k")


# Joins ---------------------------------------------------------------------------

@query
def metadata_by_footprint(spark, sf):
    hits = V.features_by_footprint(X.features(spark, sf), X.tile_keys(spark, sf), X.L16)
    return hits.select("fid", F.col("attrs")["NAME"].alias("name"))


LIST_SIZE = 4


@query
def features_per_key(spark, sf):
    pairs = grid.drop_negative_keys(V.feature_keys(X.features(spark, sf), X.L16))
    return V.features_per_key(pairs, LIST_SIZE).select("col", "row", "part", _text("items").alias("fids"))


@query
def clip_to_grid(spark, sf):
    return V.clip_to_grid(X.features(spark, sf), X.L16).select("fid", "col", "row", "area")


@query
def clip_parts(spark, sf):
    """Kind, rings and coordinates of combs cut to keys: a key above the spine holds a piece of each tooth."""
    return V.clip_to_grid(X.combs(spark, sf), X.L16).select(
        "fid", "col", "row", "geom_type", F.size("rings").alias("n_rings"), F.expr(G.coords_text("rings")).alias("coords"))


@query
def clipped_geometries_per_key(spark, sf):
    """Attributes and geometry of the clipped features of a key, not their ids alone."""
    grouped = V.clipped_features_per_key(X.combs(spark, sf), X.L16, LIST_SIZE, whole=True)
    text = f"transform(items, _i -> concat(_i.fid, ' ', _i.attrs['NAME'], ' ', {G.coords_text('_i.rings')}))"
    return grouped.select("col", "row", "part", F.expr(f"array_join({text}, ';')").alias("items"))


@query
def clipped_features_per_key(spark, sf):
    grouped = V.clipped_features_per_key(X.features(spark, sf), X.LSHIFT, LIST_SIZE)
    return grouped.select("col", "row", "part", _text("items").alias("fids"))


@query
def uids_per_key(spark, sf):
    grouped = P.grid_join(X.scene_heads(spark, sf), X.features(spark, sf), 8.0, 8.0, 16, LIST_SIZE, sfc.ZORDER)
    return grouped.select("col", "row", "part", "sfc", _text("items").alias("uids"))


@query
def mask_tiles(spark, sf):
    masked = R.mask_tiles(X.tiles(spark, sf), X.features(spark, sf), X.L16)
    return R.tile_cells(masked, X.L16, keep=["fid"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", scalars.round_at(F.col("value"), 4))


@query
def tile_to_layout(spark, sf):
    tiled = R.tile_to_layout(X.scenes(spark, sf), X.LHALF, X.scene_heads(spark, sf))
    return _rounded(R.tile_cells(tiled, X.LHALF))


def _geographic(spark, sf):
    heads = X.scene_heads(spark, sf, geographic=True)
    meta = R.read_layer_meta(heads)
    source = R.floating_layout(meta, X.GEO_TILE)
    tiles = R.tile_to_layout(X.scenes(spark, sf, geographic=True), source, heads)
    return tiles, source, meta


@query
def reproject_tiles(spark, sf):
    tiles, source, meta = _geographic(spark, sf)
    target = R.target_layout(meta, 32651, X.GEO_TILE, X.GEO_CELL)
    return _rounded(R.tile_cells(R.reproject_tiles(tiles, meta, source, 32651, target), target))


@query
def query_first_feature(spark, sf):
    first = V.first_feature(X.features(spark, sf))
    ranged = first.select("fid", *BOX, *grid.named(X.L16.key_range()))
    keys = grid.explode_keys(ranged)
    return keys.join(X.tile_keys(spark, sf), ["col", "row"], "left_semi").select(
        "fid", *BOX, "col", "row")


# Aggregations --------------------------------------------------------------------

@query
def merged_extent(spark, sf):
    return R.merged_extent(X.scene_heads(spark, sf))


@query
def layer_metadata(spark, sf):
    return R.layer_metadata(X.scene_heads(spark, sf))


@query
def layer_bounds(spark, sf):
    return R.layer_bounds(R.layer_metadata(X.scene_heads(spark, sf)), 16).select("cmin", "rmin", "cmax", "rmax")


@query
def layer_metadata_mixed(spark, sf):
    kind = F.when(F.expr("ord % 2 = 0"), "uint16").otherwise("int8")
    return R.layer_metadata(X.scene_heads(spark, sf).withColumn("cell_type", kind))


@query
def feature_count_per_key(spark, sf):
    return V.feature_count_per_key(V.feature_keys(X.features(spark, sf), X.L16))


@query
def merge_tiles(spark, sf):
    heads = X.scene_heads(spark, sf)
    pieces = R.scene_pieces(X.scenes(spark, sf), X.L16)
    depth, span = R.depth_of_overlap(heads, X.L16)
    return R.tile_cells(R.merge_pieces(pieces, X.L16, depth, span), X.L16)


@query
def stitch(spark, sf):
    mosaics = _mosaics(spark, sf, 2)
    cells = mosaics.select("fid", "band", "block_col", "block_row", "n_cols", "n_rows",
                           F.posexplode("cells").alias("pos", "value"))
    return cells.where("value is not null")


@query
def footprint(spark, sf):
    boxes = R.footprint(X.tile_keys(spark, sf), X.L16)
    return boxes.select("col", "row", F.expr(G.path_text("ring")).alias("ring"))


@query
def metadata_json_agg(spark, sf):
    hits = V.features_by_footprint(X.features(spark, sf), X.tile_keys(spark, sf), X.L16)
    return V.metadata_json(hits, 16)


@query
def stage_counts(spark, sf):
    f = X.features(spark, sf)
    clipped = materialize(V.clip_to_grid(f, X.LSHIFT).select("fid", "col", "row"))
    grouped = grid.drop_negative_keys(clipped.select("col", "row").distinct())
    return V.stage_counts(tiles=X.tile_keys(spark, sf), features=f, clipped=clipped, grouped=grouped)


@query
def count_vertices(spark, sf):
    return V.count_vertices(X.features(spark, sf))


@query
def count_features(spark, sf):
    return V.count_features(X.kinds(spark, sf))


@query
def tiles_sfc_sorted(spark, sf):
    return R.sort_by_curve(X.tile_keys(spark, sf), sfc.HILBERT, BITS).select("col", "row", "sfc")


@query
def sample_scene(spark, sf):
    return R.sample_scene(X.scene_heads(spark, sf)).select("scene", "ord", *BOX)


# Grid and curves -----------------------------------------------------------------

@query
def layout_from_extent(spark, sf):
    return grid.layout_from_extent(R.merged_extent(X.scene_heads(spark, sf)), 10.0, 10.0, 32)


def _scene_layout(spark, sf) -> Layout:
    e = R.merged_extent(X.scene_heads(spark, sf)).first()
    return Layout.from_cells((e.xmin, e.ymin, e.xmax, e.ymax), 8.0, 8.0, 16)


@query
def layout_from_tile_count(spark, sf):
    e = R.merged_extent(X.scene_heads(spark, sf)).first()
    layout = Layout.from_tile_count((e.xmin, e.ymin, e.xmax, e.ymax), 8, 4, 16)
    return grid.keys_for_extent(X.scene_heads(spark, sf), layout).select("scene", "col", "row")


@query
def keys_for_extent(spark, sf):
    keys = grid.keys_for_extent(X.scene_heads(spark, sf), _scene_layout(spark, sf))
    return keys.select("scene", "col", "row")


@query
def keys_for_raster(spark, sf):
    return grid.keys_for_raster(X.scene_heads(spark, sf), 128).select("scene", "col", "row")


@query
def tile_snap(spark, sf):
    line = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("x"))
    customer = X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    x = F.col("x")
    return line.unionAll(customer).select(
        "id", "x", grid.tile_floor_count(x, 1024).alias("floor_count"),
        grid.tile_floor_value(x, 1024).alias("floor_value"),
        grid.tile_ceiling_count(x, 1024).alias("ceiling_count"),
        grid.tile_ceiling_value(x, 1024).alias("ceiling_value"))


@query
def zorder_encode(spark, sf):
    return X.curve_keys(spark, sf).select(
        "col", "row", sfc.zorder_encode(F.col("col"), F.col("row")).alias("idx"))


@query
def zorder_decode(spark, sf):
    coded = X.curve_keys(spark, sf).select(
        sfc.index_to_hex(sfc.zorder_encode(F.col("col"), F.col("row"))).alias("hex"))
    col, row = sfc.sfc_invert(sfc.ZORDER, F.col("hex"), BITS, BITS)
    return coded.select("hex", col.alias("col"), row.alias("row"))


@query
def hilbert_encode(spark, sf):
    return X.curve_keys(spark, sf).select(
        "col", "row", sfc.hilbert_encode(F.col("col"), F.col("row"), BITS).alias("idx"))


@query
def hilbert_decode(spark, sf):
    coded = X.curve_keys(spark, sf).select(
        sfc.index_to_hex(sfc.hilbert_encode(F.col("col"), F.col("row"), BITS)).alias("hex"))
    col, row = sfc.sfc_invert(sfc.HILBERT, F.col("hex"), BITS, BITS)
    return coded.select("hex", col.alias("col"), row.alias("row"))


@query
def sfc_index(spark, sf):
    keys = X.curve_keys(spark, sf)
    labelled = [keys.select(F.lit(label).alias("label"), "col", "row", sfc.sfc_index(
        label, F.col("col"), F.col("row"), BITS, BITS).alias("idx")) for label in (sfc.HILBERT, sfc.ZORDER)]
    return labelled[0].unionAll(labelled[1])


@query
def sfc_hex(spark, sf):
    idx = sfc.zorder_encode(F.col("col"), F.col("row"))
    coded = X.curve_keys(spark, sf).select("col", "row", sfc.index_to_hex(idx, 8).alias("hex"))
    return coded.withColumn("idx", sfc.hex_to_index(F.col("hex")))


# Scalars -------------------------------------------------------------------------

@query
def pad_left(spark, sf):
    key = F.col("o_orderkey").cast("string")
    return X.table(spark, sf, "orders").select(
        "o_orderkey", scalars.pad_left(key, 3, "0").alias("three"), scalars.pad_left(key, 8, "0").alias("eight"))


@query
def repeat_char(spark, sf):
    return X.table(spark, sf, "part").select(
        "p_partkey", scalars.repeat_char(F.col("p_size") - 10, "x").alias("text"))


@query
def path_join(spark, sf):
    p = X.paths(spark, sf)
    slashed = F.concat(F.col("path"), F.when(F.expr("p_partkey % 2 = 0"), "/").otherwise(""))
    child = F.concat(F.when(F.expr("p_partkey % 5 = 0"), "/").otherwise(""), F.lit("part.json"))
    return p.select("p_partkey", scalars.path_join(slashed, child).alias("path"))


@query
def file_join(spark, sf):
    p = X.paths(spark, sf)
    parent = F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(path, '//') ELSE path END")
    child = F.expr("CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '//a//b/' ELSE 'part.json' END")
    return p.select("p_partkey", scalars.file_join(parent, child).alias("path"))


@query
def round_at(spark, sf):
    return X.table(spark, sf, "customer").select(
        "c_custkey", scalars.round_at(F.col("c_custkey") / 2 - 100, 0).alias("ties"),
        scalars.round_at(F.col("c_acctbal"), 1).alias("balance"))


@query
def nanos_to_seconds(spark, sf):
    return X.table(spark, sf, "orders").select(
        "o_orderkey", scalars.nanos_to_seconds(F.col("o_orderkey") * 123456789).alias("seconds"))


@query
def size_in_units(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", scalars.size_in_units(F.col("n_chars"), 1).alias("kib"),
        scalars.size_in_units(F.col("n_chars"), 2).alias("mib"))


@query
def format_timestamp(spark, sf):
    return X.table(spark, sf, "events").select(
        "event_id", scalars.format_timestamp(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("text"))


# Projection and resampling ---------------------------------------------------------

@query
def reproject_points(spark, sf):
    done = projection.project(X.geo_points(spark, sf), "lon", "lat", 4326, 32651, "x", "y")
    return done.select("id", scalars.round_at(F.col("x"), 3).alias("x"),
                       scalars.round_at(F.col("y"), 3).alias("y"))


@query
def unproject_points(spark, sf):
    there = projection.project(X.geo_points(spark, sf), "lon", "lat", 4326, 32651, "x", "y")
    metres = there.select("id", scalars.round_at(F.col("x"), 3).alias("x"),
                          scalars.round_at(F.col("y"), 3).alias("y"))
    back = projection.project(metres, "x", "y", 32651, 4326, "lon", "lat")
    return back.select("id", scalars.round_at(F.col("lon"), 8).alias("lon"),
                       scalars.round_at(F.col("lat"), 8).alias("lat"))


@query
def reproject_worldwide(spark, sf):
    """Points all over the world in zone 51 and in web mercator, NULL beyond the domain of each."""
    points = X.world_points(spark, sf)
    for epsg, x, y in ((32651, "x", "y"), (3857, "mx", "my")):
        points = projection.project(points, "lon", "lat", 4326, epsg, x, y)
    return points.select("id", *(scalars.round_at(F.col(c), 3).alias(c) for c in ("x", "y", "mx", "my")))


@query
def bilinear_sample(spark, sf):
    """Both bands at positions of whole quarters of a cell over the layer's own width and height."""
    e = R.merged_extent(X.scene_heads(spark, sf)).first()
    cols, rows = round((e.xmax - e.xmin) / 8), round((e.ymax - e.ymin) / 8)
    samples = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr(f"cast(o_orderkey * 37 % {4 * cols} as double) / 4 - 0.5D").alias("fx"),
        F.expr(f"cast(o_custkey * 53 % {4 * rows} as double) / 4 - 0.5D").alias("fy"))
    bands = ("b0", "b1")
    known = X.merged_cells(spark, sf).withColumn("b1", F.expr("round(b1 * 100)"))
    return R.bilinear_sample(samples, known, cols, rows, bands=bands).select(
        "id", *(scalars.round_at(F.col(b), 6).alias(b) for b in bands))


@query
def bilinear_sample_bands(spark, sf):
    """Both bands, at positions spread over the layer's own width and height; the second in whole
    hundredths, so sums are exact and the order of the neighbours does not show."""
    e = R.merged_extent(X.scene_heads(spark, sf)).first()
    cols, rows = round((e.xmax - e.xmin) / 8), round((e.ymax - e.ymin) / 8)
    samples = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr(f"cast(o_orderkey * 37 % {64 * cols} as double) / 64 - 0.5D").alias("fx"),
        F.expr(f"cast(o_custkey * 53 % {64 * rows} as double) / 64 - 0.5D").alias("fy"))
    bands = ("b0", "b1")
    known = X.merged_cells(spark, sf).withColumn("b1", F.expr("round(b1 * 100)"))
    return R.bilinear_sample(samples, known, cols, rows, bands=bands).select(
        "id", *(scalars.round_at(F.col(b), 6).alias(b) for b in bands))


# Pipelines -----------------------------------------------------------------------

@query
def pipeline_tile(spark, sf):
    folder = X.write_scene_files(spark, sf, geographic=True)
    tiles, layout, _ = P.tile_scenes(spark, folder, X.GEO_TILE, 32651, X.GEO_CELL)
    filled = F.filter("cells", lambda v: v.isNotNull())
    stats = tiles.select(
        "band", "col", "row", F.size(filled).alias("n"),
        scalars.round_at(F.array_min(filled), 4).alias("least"),
        scalars.round_at(F.array_max(filled), 4).alias("most"))
    return stats.where("n > 0").select("*", *grid.named(layout.key_extent()))


@query
def pipeline_tile_cells(spark, sf):
    """Every cell value that ``pipeline_tile`` sums up."""
    folder = X.write_scene_files(spark, sf, geographic=True)
    tiles, layout, _ = P.tile_scenes(spark, folder, X.GEO_TILE, 32651, X.GEO_CELL)
    return _rounded(R.tile_cells(tiles, layout))


@query
def pipeline_pixels_by_polygon(spark, sf):
    return R.mosaic_cells(_mosaics(spark, sf))


@query
def pipeline_all(spark, sf):
    output = shared_dir(spark) + "/pixels.tif"
    done = P.tile_query(spark, X.write_scene_files(spark, sf), X.features(spark, sf), X.features(spark, sf),
                        output, 16, 32651)
    pixels = _mosaic_files(spark, done["output"]).select("fid", "band", "gc", "gr", "value")
    found = spark.read.schema("UID string").json(done["json"])
    none = [F.lit(None).cast(t).alias(n) for n, t in (("band", "int"), ("gc", "int"), ("gr", "int"), ("value", "double"))]
    return pixels.unionAll(found.select(F.col("UID").cast("bigint").alias("fid"), *none))


@query
def pipeline_metadata(spark, sf):
    return P.metadata_by_footprint(X.tile_keys(spark, sf), X.features(spark, sf), X.L16)
