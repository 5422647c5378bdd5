"""Planar geometry as Spark SQL expressions.

A geometry is ``geom_type string`` plus ``rings array<struct<part:int,ring:int,
pts:array<struct<x:double,y:double>>>>``; polygon rings are closed (first point repeated last).
The functions take SQL text (column names or expressions) and return SQL text for ``F.expr``:
they nest into one expression that is parsed once, stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

POLYGONAL = ("polygon", "multipolygon")
PUNCTUAL = ("point", "multipoint")
RINGS_TYPE = "array<struct<part:int,ring:int,pts:array<struct<x:double,y:double>>>>"

Rect = tuple[str, str, str, str]      # xmin, ymin, xmax, ymax


def is_kind(geom_type: str, kinds: tuple[str, ...]) -> str:
    return f"{geom_type} IN ({', '.join(repr(k) for k in kinds)})"


def points(rings: str) -> str:
    return f"flatten(transform({rings}, _r -> _r.pts))"


def vertex_count(rings: str) -> str:
    return f"aggregate({rings}, 0L, (_n, _r) -> _n + size(_r.pts))"


def segments(pts: str) -> str:
    """Consecutive point pairs of one path as ``struct<x1,y1,x2,y2>``."""
    n = f"greatest(size({pts}) - 1, 0)"
    return (f"zip_with(slice({pts}, 1, {n}), slice({pts}, 2, {n}), "
            "(_a, _b) -> struct(_a.x AS x1, _a.y AS y1, _b.x AS x2, _b.y AS y2))")


def edges(rings: str) -> str:
    return f"flatten(transform({rings}, _r -> {segments('_r.pts')}))"


def envelope(rings: str) -> dict[str, str]:
    def bound(fn: str, axis: str) -> str:
        return f"{fn}(transform({points(rings)}, _p -> _p.{axis}))"
    return {"xmin": bound("array_min", "x"), "ymin": bound("array_min", "y"),
            "xmax": bound("array_max", "x"), "ymax": bound("array_max", "y")}


def path(*pts: tuple[str, str]) -> str:
    """An array of points from coordinate texts."""
    return f"array({', '.join(f'struct({x} AS x, {y} AS y)' for x, y in pts)})"


def rect_ring(rect: Rect) -> str:
    """Closed rectangle ring, counter-clockwise from the south-west corner."""
    x0, y0, x1, y1 = rect
    return path((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


def point_in_polygon(edge_array: str, x: str, y: str) -> str:
    """Even-odd rule over all rings; holes need no orientation."""
    return (f"(aggregate({edge_array}, 0, (_n, _e) -> CASE WHEN (_e.y1 > {y}) != (_e.y2 > {y}) THEN "
            f"CASE WHEN {x} < (_e.x2 - _e.x1) * ({y} - _e.y1) / (_e.y2 - _e.y1) + _e.x1 "
            "THEN _n + 1 ELSE _n END ELSE _n END) % 2 = 1)")


def segment_meets_rect(e: str, rect: Rect) -> str:
    """Closed test by separating axes: the boxes overlap and the rectangle's corners do not all
    lie strictly on one side of the segment's line. No division."""
    x0, y0, x1, y1 = rect
    sides = ", ".join(f"({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({e}.y2 - {e}.y1) * ({x} - {e}.x1)"
                      for x in (x0, x1) for y in (y0, y1))
    return (f"(least({e}.x1, {e}.x2) <= {x1} AND greatest({e}.x1, {e}.x2) >= {x0}"
            f" AND least({e}.y1, {e}.y2) <= {y1} AND greatest({e}.y1, {e}.y2) >= {y0}"
            f" AND least({sides}) <= 0 AND greatest({sides}) >= 0)")


def point_edges(rings: str) -> str:
    """Points as edges without length, which the edge tests take as they are."""
    return f"transform({points(rings)}, _p -> struct(_p.x AS x1, _p.y AS y1, _p.x AS x2, _p.y AS y2))"


def passed_edges(edge_array: str, area: str, rect: Rect, beyond: tuple[str, str, str]) -> str:
    """The edges that can meet a rectangle and, where ``area`` holds, those that count as a crossing
    for its points: edges east of it that end beside it, and one edge at ``beyond`` (x, and y from
    and to) for an odd number of those that pass it from end to end. Exact for both tests."""
    x0, y0, x1, y1 = rect
    low, high = "least(_e.y1, _e.y2)", "greatest(_e.y1, _e.y2)"
    east, passes = f"least(_e.x1, _e.x2) > {x1}", f"({low} <= {y0} AND {high} > {y1})"
    near = (f"filter({edge_array}, _e -> {high} >= {y0} AND {low} <= {y1} AND greatest(_e.x1, _e.x2) >= {x0}"
            f" AND (NOT {east} OR ({area} AND _e.y1 != _e.y2 AND NOT {passes})))")
    odd = f"(aggregate({edge_array}, 0, (_n, _e) -> if({east} AND {passes}, _n + 1, _n)) % 2 = 1)"
    x, below, above = beyond
    one = f"array(struct({x} AS x1, {below} AS y1, {x} AS x2, {above} AS y2))"
    return f"concat({near}, if({area} AND {odd}, {one}, slice({edge_array}, 1, 0)))"


def ring_area(pts: str) -> str:
    """Unsigned shoelace area of a closed ring."""
    return (f"(abs(aggregate({segments(pts)}, 0D, (_n, _e) -> _n + (_e.x1 * _e.y2 - _e.x2 * _e.y1)))"
            " / 2)")


def polygon_area(rings: str) -> str:
    """Outer rings (ring 0 of a part) add, holes subtract."""
    return (f"aggregate({rings}, 0D, (_t, _r) -> _t + CASE WHEN _r.ring = 0 THEN 1 ELSE -1 END * "
            f"{ring_area('_r.pts')})")


def path_text(pts: str) -> str:
    """Whole-number coordinates of one path as text: 'x y,x y'."""
    return (f"array_join(transform({pts}, _p -> concat_ws(' ', string(bigint(_p.x)), "
            "string(bigint(_p.y)))), ',')")


def coords_text(rings: str) -> str:
    """Whole-number coordinates as text, one path between bars."""
    return f"array_join(transform({rings}, _r -> {path_text('_r.pts')}), '|')"
