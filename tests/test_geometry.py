"""Geometry expressions against brute force in plain Python, on random half-integer shapes."""

import random

import pytest
from pyspark.sql import functions as F

from rastergrid.functions import geometry as G
from rastergrid.functions.grid import Layout
from rastergrid.model import FEATURE_SCHEMA
from rastergrid.operators import vectors as V

GRID = Layout(0.0, 0.0, 64.0, 64.0, 16, 16, 4, 4)


def feature(fid, kind, *rings, parts=None, attrs=None):
    pts = [p for r in rings for p in r]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return (fid, kind, [((parts or [0] * len(rings))[i] if parts else 0, i if not parts else 0, list(r))
                        for i, r in enumerate(rings)],
            attrs or {"UID": str(fid)}, float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)))


def closed(*pts):
    return [(float(x), float(y)) for x, y in (*pts, pts[0])]


def star(rng, cx, cy, n, far):
    """A simple polygon: points by angle with random radii, rounded to halves."""
    import math
    pts = []
    for k in range(n):
        r = rng.uniform(0.2, 1) * far
        a = 2 * math.pi * (k + rng.random() * 0.5) / n
        pts.append((round(2 * (cx + r * math.cos(a))) / 2, round(2 * (cy + r * math.sin(a))) / 2))
    return closed(*pts)


@pytest.fixture(scope="module")
def stars(spark):
    rng = random.Random(7)
    rows = [feature(i, "multipolygon", star(rng, rng.uniform(-5, 70), rng.uniform(-5, 70),
                                            rng.choice([3, 5, 9]), rng.uniform(1, 30))) for i in range(40)]
    rows.append(feature(40, "multipolygon", closed((8, 8), (40, 8), (40, 40), (8, 40)),
                        closed((12, 12), (32, 12), (32, 32), (12, 32))))
    rows.append(feature(41, "line", [(1.0, 1.0), (30.0, 30.0), (30.0, 2.0)]))
    rows.append(feature(42, "multipoint", [(4.0, 4.0), (63.0, 1.0)]))
    return rows, spark.createDataFrame(rows, FEATURE_SCHEMA)


def edges_of(row):
    return [(a, b) for _, _, r in row[2] for a, b in zip(r, r[1:])]


def inside(row, x, y):
    n = 0
    for (x1, y1), (x2, y2) in edges_of(row):
        n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def segment_in_rect(a, b, x0, y0, x1, y1):
    """Liang-Barsky on exact fractions."""
    from fractions import Fraction
    (ax, ay), (bx, by) = a, b
    lo, hi = Fraction(0), Fraction(1)
    for p, q in ((ax - bx, ax - x0), (bx - ax, x1 - ax), (ay - by, ay - y0), (by - ay, y1 - ay)):
        p, q = Fraction(p), Fraction(q)
        if p == 0:
            if q < 0:
                return False
        elif p < 0:
            lo = max(lo, q / p)
        else:
            hi = min(hi, q / p)
    return lo <= hi


def meets(row, x0, y0, x1, y1):
    if row[4] > x1 or row[6] < x0 or row[5] > y1 or row[7] < y0:
        return False
    pts = [p for _, _, r in row[2] for p in r]
    if row[1] == "multipoint":
        return any(x0 <= x <= x1 and y0 <= y <= y1 for x, y in pts)
    if any(segment_in_rect(a, b, x0, y0, x1, y1) for a, b in edges_of(row)):
        return True
    return row[1] == "multipolygon" and any(inside(row, x, y) for x in (x0, x1) for y in (y0, y1))


@pytest.mark.parametrize("is_closed", [False, True])
@pytest.mark.parametrize("coarse", [1, 3, 16])
def test_feature_keys_against_brute_force(stars, is_closed, coarse):
    rows, df = stars
    got = {(r.fid, r.col, r.row) for r in V.feature_keys(df, GRID, closed=is_closed, coarse=coarse).collect()}
    want = set()
    for row in rows:
        for c in range(-12, 30):
            for r in range(-12, 30):
                box = (c * 4.0, 64 - (r + 1) * 4.0, (c + 1) * 4.0, 64 - r * 4.0)
                if not is_closed:
                    import math
                    cmin, rmin = math.floor(row[4] / 4), math.floor((64 - row[7]) / 4)
                    cmax = max(cmin, math.ceil(row[6] / 4) - 1)
                    rmax = max(rmin, math.ceil((64 - row[5]) / 4) - 1)
                    if not (cmin <= c <= cmax and rmin <= r <= rmax):
                        continue
                if meets(row, *box):
                    want.add((row[0], c, r))
    assert got == want


def test_points_in_polygons_against_brute_force(spark, stars):
    rows, df = stars
    pts = spark.range(48 * 48).select(
        F.col("id"), (F.col("id") % 48 * 1.5 - 4).alias("x"), (F.expr("id div 48") * 1.5 - 4).alias("y"))
    polygons = df.where("geom_type = 'multipolygon'")
    got = {(r.fid, r.id) for r in V.points_in_polygons(pts, polygons, GRID).collect()}
    want = {(row[0], i) for row in rows if row[1] == "multipolygon" for i in range(48 * 48)
            if inside(row, i % 48 * 1.5 - 4, i // 48 * 1.5 - 4)}
    assert got == want


@pytest.mark.parametrize("coarse", [1, 4, 16])
def test_clipped_areas_add_up(stars, coarse):
    _, df = stars
    whole = {r.fid: r.a for r in df.where("geom_type = 'multipolygon'")
             .select("fid", F.expr(G.polygon_area("rings")).alias("a")).collect()}
    parts = V.clip_to_grid(df, GRID, coarse=coarse).groupBy("fid").agg(F.sum("area").alias("a"))
    got = {r.fid: r.a for r in parts.collect()}
    assert got.keys() == {k for k, a in whole.items() if a > 0}
    assert all(abs(got[k] - whole[k]) < 1e-9 * max(1, whole[k]) for k in got)


def test_clip_of_hole_covering_a_cell_and_of_a_touch(spark):
    ring = feature(0, "multipolygon", closed((0, 32), (32, 32), (32, 64), (0, 64)),
                   closed((4, 36), (28, 36), (28, 60), (4, 60)))
    touch = feature(1, "multipolygon", closed((4, 4), (8, 4), (8, 8), (4, 8)))
    df = spark.createDataFrame([ring, touch], FEATURE_SCHEMA)
    got = {(r.fid, r.col, r.row): r.area for r in V.clip_to_grid(df, GRID).collect()}
    assert (0, 3, 3) not in got and got[(0, 0, 0)] == 16.0
    assert {k for k in got if k[0] == 1} == {(1, 1, 14)}


@pytest.fixture
def tried(monkeypatch):
    """Rows that a cover stores on all its levels."""
    counts = []

    def counting(df, *args, store=V.materialize):
        out = store(df, *args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(V, "materialize", counting)
    return counts


def big(side):
    return Layout(0.0, 0.0, float(side), float(side), side, side, 4, 4)


def test_a_line_costs_its_length_not_its_box(spark, tried):
    sizes = []
    for side in (256, 512, 1024):
        tried.clear()
        line = spark.createDataFrame([feature(0, "line", [(0.5, 0.5), (side - 0.5, 0.7 * side)])], FEATURE_SCHEMA)
        n = V.feature_keys(line, big(side)).count()
        assert 1.6 * side < n < 1.8 * side
        sizes.append(sum(tried))
        assert sizes[-1] < 4 * n
    assert sizes[2] < 2.2 * sizes[1] < 2.2 * 2.2 * sizes[0]


def test_an_area_costs_its_outline(spark, tried):
    sizes = []
    for side in (128, 256, 512):
        tried.clear()
        diamond = closed((side / 2, 0.25), (side - 0.25, side / 2), (side / 2, side - 0.25), (0.25, side / 2))
        covered = V.cover(spark.createDataFrame([feature(0, "multipolygon", diamond)], FEATURE_SCHEMA), big(side))
        keys = covered.agg(F.sum(F.expr("(cmax - cmin + 1) * (rmax - rmin + 1)"))).first()[0]
        assert keys > 0.5 * side * side
        sizes.append(sum(tried))
    assert sizes[2] < 2.3 * sizes[1] < 2.3 * 2.3 * sizes[0] and sizes[2] < 0.1 * 512 * 512


def test_whole_ranges_meet_keys_like_single_keys(spark):
    rng = random.Random(3)
    rows = [feature(i, "multipolygon", star(rng, 40, 40, 60, 300)) for i in range(3)]
    df = spark.createDataFrame(rows, FEATURE_SCHEMA)
    layout = Layout(0.0, 0.0, 64.0, 64.0, 64, 64, 4, 4)
    covered = V.cover(df, layout)
    assert covered.select("level").distinct().count() > 1
    keys = spark.range(200 * 200).select((F.col("id") % 200 - 90).cast("int").alias("col"), (F.expr("id div 200") - 90).cast("int").alias("row"))
    met = V.meet_keys(keys, covered).select("fid", "col", "row", "whole")
    every = V.feature_keys(df, layout).where("col BETWEEN -90 AND 109 AND row BETWEEN -90 AND 109").select("fid", "col", "row", "whole")
    assert met.exceptAll(every).count() == every.exceptAll(met).count() == 0 < met.count()


def cells_in(rings, n=8):
    """Cells of a fine raster inside rings by the even-odd rule; no point of it lies on an edge."""
    import numpy as np
    from rastergrid.operators.kernels import centres_inside
    edges = np.array([(a[0], a[1], b[0], b[1]) for r in rings for a, b in zip(r, r[1:])], float).reshape(-1, 4)
    at = (np.arange(64 * n) + 0.5271) / n
    return centres_inside(edges, at, at)


SHAPES = {
    "u": [closed((2, 2), (30, 2), (30, 30), (22, 30), (22, 10), (10, 10), (10, 30), (2, 30))],
    "comb": [closed((1, 1), (61, 1), (61, 50), (50, 50), (50, 5), (40, 5), (40, 50), (30, 50), (30, 5), (20, 5), (20, 50), (1, 50))],
    "hole cut": [closed((0, 0), (32, 0), (32, 32), (0, 32)), closed((6, 6), (26, 6), (26, 26), (6, 26))],
    "holes": [closed((0, 0), (64, 0), (64, 64), (0, 64)), closed((5, 5), (7, 5), (7, 7), (5, 7)), closed((9, 9), (11, 10), (10, 11)),
              closed((20, 20), (44, 20), (32, 44))],
    "on the lines": [closed((4, 4), (12, 4), (12, 8), (8, 8), (8, 12), (12, 12), (12, 16), (4, 16))],
    "touch from inside": [closed((1, 1), (31, 1), (31, 31), (24, 16), (16, 31), (8, 16), (1, 31))],
    "spiral": [closed((0, 0), (40, 0), (40, 40), (6, 40), (6, 12), (28, 12), (28, 30), (14, 30), (14, 20), (18, 20), (18, 26), (24, 26),
                      (24, 16), (10, 16), (10, 36), (36, 36), (36, 4), (0, 4))],
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("tile", [16, 5])
def test_clipping_splits(spark, name, tile):
    """Pieces cover what the shape covers, do not touch from within, and are separate rings."""
    import numpy as np
    from rastergrid.operators import kernels as K
    side = 16 * tile
    layout = Layout(0.0, 64.0 - side, float(side), 64.0, 16, 16, 4, 4)
    df = spark.createDataFrame([feature(0, "multipolygon", *SHAPES[name])], FEATURE_SCHEMA)
    whole = cells_in(SHAPES[name])
    seen = np.zeros(whole.shape, int)
    for r in V.clip_to_grid(df, layout, coarse=4).collect():
        x0, y1 = r.col * tile, 64 - r.row * tile
        rings = [[(p.x, p.y) for p in q.pts] for q in r.rings]
        assert all(x0 <= x <= x0 + tile and y1 - tile <= y <= y1 for q in rings for x, y in q)
        seen += cells_in(rings)
        outer = [q for q, own in zip(rings, r.rings) if own.ring == 0]
        assert r.geom_type == ("multipolygon" if len(outer) > 1 else "polygon")
        for q in rings:         # no edge is walked twice, which is how a piece that should be two shows
            along = [frozenset(e) for e in zip(q, q[1:])]
            assert len(set(along)) == len(along)
        parts = {own.part for own in r.rings}
        assert parts == set(range(len(outer)))
        for q, own in zip(rings, r.rings):
            assert (K.signed_area(np.array(q[:-1])) > 0) == (own.ring == 0)
        inside = cells_in(rings)
        assert _pieces(inside) <= len(outer)
    assert (seen == whole).all()


def _pieces(mask):
    """Connected pieces of a raster."""
    todo, n = set(zip(*(m.tolist() for m in mask.nonzero()))), 0
    while todo:
        n += 1
        stack = [todo.pop()]
        while stack:
            r, c = stack.pop()
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near in todo:
                    todo.remove(near)
                    stack.append(near)
    return n


def test_a_cut_u_is_two_rings(spark):
    layout = Layout(0.0, 0.0, 64.0, 64.0, 2, 2, 4, 4)
    high = closed((2, 2), (30, 2), (30, 60), (22, 60), (22, 10), (10, 10), (10, 60), (2, 60))
    got = {(r.col, r.row): r for r in V.clip_to_grid(spark.createDataFrame([feature(0, "polygon", high)], FEATURE_SCHEMA), layout).collect()}
    assert got[0, 0].geom_type == "multipolygon" and got[0, 1].geom_type == "polygon"
    assert [[(p.x, p.y) for p in r.pts] for r in got[0, 0].rings] == [
        closed((2, 32), (10, 32), (10, 60), (2, 60)), closed((22, 32), (30, 32), (30, 60), (22, 60))]


def test_rings_that_cross_themselves_are_cut_too(spark):
    bow = closed((0, 0), (40, 40), (40, 0), (0, 40))
    got = V.clip_to_grid(spark.createDataFrame([feature(0, "polygon", bow)], FEATURE_SCHEMA), GRID).collect()
    assert got


def test_promotion_drops_other_kinds(stars):
    _, df = stars
    kinds = {r.geom_type for r in V.promote_multipolygon(df).select("geom_type").collect()}
    assert kinds == {"multipolygon"}


def test_a_new_feature_changes_its_own_part_only(spark):
    def lists(ids):
        df = spark.createDataFrame([(1, 1, i) for i in ids], "col int, row int, fid bigint")
        return {r.part: r["items"] for r in V.features_per_key(df, 64).collect()}

    before, after = lists([1, 70, 140]), lists([1, 70, 140, 71])
    assert before == {0: [1], 1: [70], 2: [140]}
    assert {p for p in after if after[p] != before.get(p)} == {1}


def test_busy_keys_are_split_and_whole(spark):
    pairs = spark.range(1000).select(F.lit(1).alias("col"), F.lit(2).alias("row"), F.col("id").alias("fid"))
    pairs = pairs.unionAll(spark.createDataFrame([(5, 5, 3), (5, 5, 999)], "col int, row int, fid bigint"))
    got = V.features_per_key(pairs, 64).collect()
    busy = [r for r in got if r.col == 1]
    assert len(busy) == 16 and max(len(r["items"]) for r in busy) == 64
    assert sorted(i for r in busy for i in r["items"]) == list(range(1000))
    assert sorted((r.part, r["items"]) for r in got if r.col == 5) == [(0, [3]), (15, [999])]


def test_footprint_join_counts_a_touch_and_needs_no_tiles(spark):
    df = spark.createDataFrame([
        feature(0, "multipolygon", closed((8, 56), (10, 56), (10, 58), (8, 58))),
        feature(1, "multipolygon", closed((9, 50), (10, 50), (10, 51), (9, 51))),
        feature(2, "multipolygon", closed((-50, -50), (100, -50), (100, 100), (-50, 100)))], FEATURE_SCHEMA)
    tiles = spark.createDataFrame([(1, 1)], "col int, row int")       # x 4..8, y 56..60
    assert {r.fid for r in V.features_by_footprint(df, tiles, GRID).collect()} == {0, 2}
    assert V.features_by_footprint(df, tiles.where("false"), GRID).count() == 0


def test_json_parts_join_to_the_whole_list(spark):
    import json
    rows = [feature(i, "multipolygon", closed((0, 0), (1, 0), (1, 1))) for i in range(10)]
    parts = V.metadata_json(spark.createDataFrame(rows, FEATURE_SCHEMA), 4).orderBy("part").collect()
    text = "[" + ",\n".join(p.json for p in parts) + "]"
    assert [int(o["UID"]) for o in json.loads(text)] == list(range(10))
