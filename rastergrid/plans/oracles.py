"""DuckDB SQL for every registered query, derived from the input tables alone.

The statements are built from shared WITH parts that state the derived inputs a second time, as
relations (edges, cells, keys) instead of arrays and kernels.
"""

from __future__ import annotations

from rastergrid.functions.projection import ALPHA, BETA, E, E2, K0, RADIUS

CELLS = """cells AS (
  SELECT event_id // 2500 AS scene, CAST(event_id % 2500 AS INTEGER) AS k,
         CAST((event_id // 2500) % 2 * 48 + (event_id % 2500) % 50 AS INTEGER) AS gc,
         CAST((event_id // 2500) // 2 * 48 + (event_id % 2500) // 50 AS INTEGER) AS gr,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS DOUBLE) END AS b0, value AS b1
  FROM events)"""
MERGED = CELLS + """, merged AS (
  SELECT gc, gr, arg_min(b0, scene) FILTER (WHERE b0 IS NOT NULL) AS b0,
         arg_min(b1, scene) FILTER (WHERE b1 IS NOT NULL) AS b1
  FROM cells GROUP BY gc, gr),
  bands AS (SELECT 0 AS band, gc, gr, b0 AS value FROM merged WHERE b0 IS NOT NULL
            UNION ALL SELECT 1, gc, gr, b1 FROM merged WHERE b1 IS NOT NULL)"""
SCENES = """scenes AS (
  SELECT ord, printf('scene_%010d.tif', ord) AS scene,
         CAST(ord % 2 * 384 AS DOUBLE) AS xmin, CAST(3696 - ord // 2 * 384 AS DOUBLE) AS ymin,
         CAST(ord % 2 * 384 + 400 AS DOUBLE) AS xmax, CAST(4096 - ord // 2 * 384 AS DOUBLE) AS ymax
  FROM (SELECT DISTINCT event_id // 2500 AS ord FROM events))"""
TILEKEYS = CELLS + ", tilekeys AS (SELECT DISTINCT gc // 16 AS c, gr // 16 AS r FROM cells)"
_SUPPLIERS = """sup AS (
  SELECT s_suppkey AS fid, CAST(s_suppkey * 53 % 784 AS DOUBLE) AS cx,
         CAST(4096 - s_suppkey * 91 % (SELECT 16 + 384 * (max(event_id) // 2500 // 2 + 1) FROM events) AS DOUBLE) AS cy, CAST(8 + 4 * s_nationkey AS DOUBLE) AS h,
         s_name, s_nationkey FROM supplier)"""


def _pts(*offsets: tuple[str, str]) -> str:
    return "[" + ", ".join(f"{{'x': cx + ({dx}), 'y': cy + ({dy})}}" for dx, dy in offsets) + "]"


_SQUARE = _pts(("-h", "-h"), ("h", "-h"), ("h", "h"), ("-h", "h"), ("-h", "-h"))
_HOLE = _pts(("-h/2", "-h/2"), ("h/2", "-h/2"), ("h/2", "h/2"), ("-h/2", "h/2"), ("-h/2", "-h/2"))
_DIAMOND = _pts(("-h", "0"), ("0", "-h"), ("h", "0"), ("0", "h"), ("-h", "0"))
_ELL = _pts(("-h", "-h"), ("h", "-h"), ("h", "0"), ("0", "0"), ("0", "h"), ("-h", "h"), ("-h", "-h"))
_FAR = _pts(("248", "-72"), ("264", "-72"), ("264", "-56"), ("248", "-56"), ("248", "-72"))
POLY = _SUPPLIERS + f""",
ring(fid, part, ring, pts) AS (
  SELECT fid, 0, 0, {_SQUARE} FROM sup WHERE fid % 4 IN (0, 3)
  UNION ALL SELECT fid, 0, 0, {_DIAMOND} FROM sup WHERE fid % 4 = 1
  UNION ALL SELECT fid, 0, 0, {_ELL} FROM sup WHERE fid % 4 = 2
  UNION ALL SELECT fid, 0, 1, {_HOLE} FROM sup WHERE fid % 4 = 3
  UNION ALL SELECT fid, 1, 0, {_FAR} FROM sup WHERE fid % 5 = 0),
vert AS (SELECT fid, part, ring, generate_subscripts(pts, 1) AS n, unnest(pts) AS p FROM ring),
edge AS (
  SELECT fid, part, ring, p.x AS x1, p.y AS y1, lead(p.x) OVER w AS x2, lead(p.y) OVER w AS y2
  FROM vert WINDOW w AS (PARTITION BY fid, part, ring ORDER BY n) QUALIFY x2 IS NOT NULL),
box AS (SELECT fid, min(p.x) AS xmin, min(p.y) AS ymin, max(p.x) AS xmax, max(p.y) AS ymax
        FROM vert GROUP BY fid)"""


def _crossing(x: str, y: str) -> str:
    return (f"CASE WHEN (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1 "
            "THEN 1 ELSE 0 END")


def _enter(d: str, at: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({lo} - {at}) / {d} WHEN {d} < 0 THEN ({hi} - {at}) / {d} ELSE 0 END"


def _leave(d: str, at: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({hi} - {at}) / {d} WHEN {d} < 0 THEN ({lo} - {at}) / {d} ELSE 1 END"


_MEETS = f"""(NOT (x1 = x2 AND (x1 < rx0 OR x1 > rx1)) AND NOT (y1 = y2 AND (y1 < ry0 OR y1 > ry1))
  AND greatest(0, {_enter('(x2 - x1)', 'x1', 'rx0', 'rx1')}, {_enter('(y2 - y1)', 'y1', 'ry0', 'ry1')})
   <= least(1, {_leave('(x2 - x1)', 'x1', 'rx0', 'rx1')}, {_leave('(y2 - y1)', 'y1', 'ry0', 'ry1')}))"""


def _keyed(west: int, north: int, closed: bool = False) -> str:
    """Candidate keys of each polygon on a 128-unit grid and the ones it intersects."""
    lo = "ceil({v} / 128) - 1" if closed else "floor({v} / 128)"
    hi = "floor({v} / 128)" if closed else "greatest(floor({u} / 128), ceil({v} / 128) - 1)"

    def span(a: str, b: str) -> str:
        return (f"generate_series(CAST({lo.format(v=a)} AS BIGINT), "
                f"CAST({hi.format(u=a, v=b)} AS BIGINT))")

    return f"""cand AS (
  SELECT fid, c, unnest({span(f'({north} - ymax)', f'({north} - ymin)')}) AS r
  FROM (SELECT *, unnest({span(f'(xmin - {west})', f'(xmax - {west})')}) AS c FROM box)),
rect AS (SELECT fid, c, r, CAST({west} + c * 128 AS DOUBLE) AS rx0, CAST({west} + (c + 1) * 128 AS DOUBLE) AS rx1,
                CAST({north} - (r + 1) * 128 AS DOUBLE) AS ry0, CAST({north} - r * 128 AS DOUBLE) AS ry1 FROM cand),
hit AS (
  SELECT fid, c, r FROM rect JOIN edge USING (fid) GROUP BY fid, c, r
  HAVING bool_or(x1 BETWEEN rx0 AND rx1 AND y1 BETWEEN ry0 AND ry1) OR bool_or({_MEETS})
      OR sum({_crossing('rx0', 'ry0')}) % 2 = 1 OR sum({_crossing('rx1', 'ry0')}) % 2 = 1
      OR sum({_crossing('rx0', 'ry1')}) % 2 = 1 OR sum({_crossing('rx1', 'ry1')}) % 2 = 1)"""


HITS = POLY + ", " + _keyed(0, 4096)
HITS_CLOSED = POLY + ", " + _keyed(0, 4096, closed=True) + ", " + TILEKEYS + """,
met AS (SELECT DISTINCT fid FROM hit JOIN tilekeys USING (c, r))"""
HITS_SHIFT = POLY + ", " + _keyed(128, 3968)

# Cells of the merged raster inside each polygon.
INSIDE = MERGED + ", " + POLY + f""", inside AS (
  SELECT fid, band, gc, gr, value
  FROM (SELECT b.*, 8.0::DOUBLE * gc + 4 AS x, 4092.0::DOUBLE - 8 * gr AS y FROM bands b)
  JOIN box ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax JOIN edge USING (fid)
  GROUP BY fid, band, gc, gr, value HAVING sum({_crossing('x', 'y')}) % 2 = 1),
-- cell centres inside the polygon, whatever the cell's value
centres AS (
  SELECT fid, c * 16 + o % 16 AS gc, r * 16 + o // 16 AS gr
  FROM (SELECT DISTINCT gc // 16 AS c, gr // 16 AS r FROM merged) t
  CROSS JOIN (SELECT unnest(generate_series(0, 255)) AS o) s
  JOIN box ON (t.c * 16 + o % 16) * 8.0::DOUBLE + 4 BETWEEN xmin AND xmax
          AND 4092.0::DOUBLE - (t.r * 16 + o // 16) * 8 BETWEEN ymin AND ymax
  JOIN edge USING (fid)
  GROUP BY fid, c, r, o
  HAVING sum({_crossing('((c * 16 + o % 16) * 8.0::DOUBLE + 4)', '(4092.0::DOUBLE - (r * 16 + o // 16) * 8)')}) % 2 = 1)"""

KINDS = ["point", "line", "polygon", "multipoint", "multiline", "multipolygon"]
_KIND_CASE = "CASE fid % 6 " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS)) + " END"


def _xy(dx: str, dy: str) -> str:
    return f"CAST(cx + ({dx}) AS BIGINT) || ' ' || CAST(cy + ({dy}) AS BIGINT)"


def _line(*offsets: tuple[str, str]) -> str:
    return " || ',' || ".join(_xy(dx, dy) for dx, dy in offsets)


# Outer rings come back clockwise from a file, so squares are listed in reverse.
_SQUARE_TEXT = _line(("-h", "-h"), ("-h", "h"), ("h", "h"), ("h", "-h"), ("-h", "-h"))
_FAR_TEXT = _line(("248", "-72"), ("248", "-56"), ("264", "-56"), ("264", "-72"), ("248", "-72"))
_KIND_TEXT = {
    "point": _line(("0", "0")),
    "line": _line(("-h", "0"), ("0", "h"), ("h", "0")),
    "polygon": _SQUARE_TEXT,
    "multipoint": _line(("-h", "-h"), ("h", "-h"), ("h", "h"), ("-h", "h")),
    "multiline": _line(("-h", "-h"), ("h", "-h")) + " || '|' || " + _line(("-h", "h"), ("h", "h")),
    "multipolygon": _SQUARE_TEXT + " || '|' || " + _FAR_TEXT,
}

PATHS = """paths AS (
  SELECT p_partkey, 'hdfs://h:9000/d.' || p_size || '/' || replace(p_name, ' ', '_') || '.' || p_partkey
    || CASE p_partkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIF' ELSE '.tif.aux' END AS path FROM part)"""
KEYS = "keys AS (SELECT DISTINCT CAST(l_partkey AS INTEGER) AS c, CAST(l_suppkey AS INTEGER) AS r FROM lineitem)"
ZORDER = KEYS + """, z AS (
  SELECT c, r, CAST(sum((((c >> b) & 1)::BIGINT << (2 * b)) + (((r >> b) & 1)::BIGINT << (2 * b + 1))) AS BIGINT) AS idx
  FROM keys CROSS JOIN (SELECT unnest(generate_series(0, 30))::INTEGER AS b) GROUP BY c, r)"""
HILBERT = "RECURSIVE " + KEYS + """, walk(c, r, s, x, y, d) AS (
  SELECT c, r, 1073741824::BIGINT, c::BIGINT, r::BIGINT, 0::BIGINT FROM keys
  UNION ALL
  SELECT c, r, s // 2,
         CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 2147483647 - y ELSE y END ELSE x END,
         CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 2147483647 - x ELSE x END ELSE y END,
         d + s * s * xor(3 * rx, ry)
  FROM (SELECT *, CASE WHEN x & s > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & s > 0 THEN 1 ELSE 0 END AS ry
        FROM walk WHERE s > 0)),
  h AS (SELECT c, r, d AS idx FROM walk WHERE s = 0)"""


def _up(value: str, places: int) -> str:
    return f"floor(({value}) * 1e{places} + 0.5) / 1e{places}"


# Transverse Mercator, zone 51 north, as chained relations.
def _sum(coefs, outer, inner, p, q):
    return " + ".join(f"({c!r}::DOUBLE) * {outer}({2 * j} * {p}) * {inner}({2 * j} * {q})"
                      for j, c in enumerate(coefs, 1))


def _conformal(t: str) -> str:
    sig = f"sinh({E!r}::DOUBLE * atanh({E!r}::DOUBLE * {t} / sqrt(1 + {t} * {t})))"
    return f"({t} * sqrt(1 + {sig} * {sig}) - {sig} * sqrt(1 + {t} * {t}))"


def _forward(source: str, name: str) -> str:
    """Relation ``name(id, x, y)`` of ``source(id, lon, lat)``."""
    kr = repr(K0 * RADIUS)
    return f"""{name}_a AS (SELECT id, tan(radians(lat)) AS t, radians(lon - 123) AS l FROM {source}),
{name}_b AS (SELECT id, l, {_conformal('t')} AS tc FROM {name}_a),
{name}_c AS (SELECT id, atan2(tc, cos(l)) AS p, asinh(sin(l) / sqrt(tc * tc + cos(l) * cos(l))) AS q FROM {name}_b),
{name} AS (SELECT id, 500000 + {kr}::DOUBLE * (q + {_sum(ALPHA, 'cos', 'sinh', 'p', 'q')}) AS x,
                  {kr}::DOUBLE * (p + {_sum(ALPHA, 'sin', 'cosh', 'p', 'q')}) AS y FROM {name}_c)"""


def _backward(source: str, name: str) -> str:
    """Relation ``name(id, lon, lat)`` of ``source(id, x, y)``."""
    kr, e1 = repr(K0 * RADIUS), repr(1 - E2)
    step = ""
    for n in (1, 2, 3):
        prev = "tc" if n == 1 else "t"
        step += f"""{name}_n{n} AS (SELECT id, lam, tc, {prev} + (tc - g) / sqrt(1 + g * g)
     * (1 + {e1}::DOUBLE * {prev} * {prev}) / ({e1}::DOUBLE * sqrt(1 + {prev} * {prev})) AS t
  FROM (SELECT *, {_conformal(prev)} AS g FROM {name}_{'c' if n == 1 else f'n{n - 1}'})),
"""
    return f"""{name}_a AS (SELECT id, y / {kr}::DOUBLE AS p, (x - 500000) / {kr}::DOUBLE AS q FROM {source}),
{name}_b AS (SELECT id, p - ({_sum(BETA, 'sin', 'cosh', 'p', 'q')}) AS pc,
                    q - ({_sum(BETA, 'cos', 'sinh', 'p', 'q')}) AS qc FROM {name}_a),
{name}_c AS (SELECT id, atan2(sinh(qc), cos(pc)) AS lam,
                    sin(pc) / sqrt(sinh(qc) * sinh(qc) + cos(pc) * cos(pc)) AS tc FROM {name}_b),
{step}{name} AS (SELECT id, 123 + degrees(lam) AS lon, degrees(atan(t)) AS lat FROM {name}_n3)"""


GEO = """geo AS (
  SELECT o_orderkey AS id, 120 + CAST(o_custkey % 600 AS DOUBLE) / 100 AS lon,
         -10 + CAST(o_orderkey % 3000 AS DOUBLE) / 100 AS lat FROM orders)"""

WORLD = """world AS (
  SELECT o_orderkey AS id, CAST(o_custkey * 37 % 3600 AS DOUBLE) / 10 - 180 AS lon,
         CAST(o_orderkey * 53 % 1799 AS DOUBLE) / 10 - 89.9::DOUBLE AS lat FROM orders)"""

# The geographic raster and its image in zone 51: outline, target grid, inverse positions, blend.
WARP = MERGED + ", " + SCENES + f""", whole AS (
  SELECT 120 + min(xmin) / 4096 AS w, min(ymin) / 4096 AS s, 120 + max(xmax) / 4096 AS e, max(ymax) / 4096 AS n,
         CAST((max(xmax) - min(xmin)) / 8 AS BIGINT) AS nc, CAST((max(ymax) - min(ymin)) / 8 AS BIGINT) AS nr
  FROM scenes),
rim AS (
  SELECT row_number() OVER () AS id, lon, lat FROM (
    SELECT w + (e - w) * t / 64 AS lon, unnest([s, n]) AS lat FROM whole, (SELECT unnest(generate_series(0, 64))::DOUBLE AS t)
    UNION ALL
    SELECT unnest([w, e]), s + (n - s) * t / 64 FROM whole, (SELECT unnest(generate_series(0, 64))::DOUBLE AS t))),
{_forward('rim', 'outline')},
frame AS (SELECT floor(min(x) / 256) * 256 AS x0, ceil(max(x) / 256) * 256 AS x1,
                 floor(min(y) / 256) * 256 AS y0, ceil(max(y) / 256) * 256 AS y1 FROM outline),
target AS (
  SELECT row_number() OVER () AS id, gc, gr, x0 + (gc + 0.5::DOUBLE) * 256 AS x, y1 - (gr + 0.5::DOUBLE) * 256 AS y
  FROM (SELECT *, unnest(generate_series(-1, CAST((y1 - y0) / 256 AS BIGINT))) AS gr
        FROM (SELECT *, unnest(generate_series(-1, CAST((x1 - x0) / 256 AS BIGINT))) AS gc FROM frame))),
{_backward('target', 'source')},
placed AS (
  SELECT gc, gr,
         least(greatest(floor(((lon - w) * 512 - 0.5::DOUBLE) * 4096 + 0.5::DOUBLE) / 4096, 0), nc - 1) AS px,
         least(greatest(floor(((n - lat) * 512 - 0.5::DOUBLE) * 4096 + 0.5::DOUBLE) / 4096, 0), nr - 1) AS py
  FROM target JOIN source USING (id), whole WHERE lon >= w AND lon < e AND lat > s AND lat <= n),
near AS (
  SELECT gc, gr, CAST(floor(px) AS BIGINT) + dx AS sc, CAST(floor(py) AS BIGINT) + dy AS sr,
         (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END)
       * (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS wt
  FROM placed, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
warped AS (
  SELECT near.gc, near.gr, band, sum(wt * value) / sum(wt) AS value
  FROM near JOIN bands ON bands.gc = sc AND bands.gr = sr WHERE wt > 0 GROUP BY near.gc, near.gr, band)"""

# Area of polygon and rectangle: the signed area under each edge, its height clamped to the
# rectangle's rows and its span to the rectangle's columns (Green's theorem; no ring is cut).

def _clip_area(west: int, north: int) -> str:
    # Antiderivative of clamp(v, ry0, ry1), continuous at both ends.
    def grown(v: str) -> str:
        return (f"(CASE WHEN {v} < ry0 THEN ry0 * {v} WHEN {v} > ry1 "
                f"THEN ry1 * {v} + (ry0 * ry0 - ry1 * ry1) / 2 ELSE ({v} * {v} + ry0 * ry0) / 2 END)")

    return f"""span AS (
  SELECT fid, part, ring, c, r, ry0, ry1, CASE WHEN x2 > x1 THEN 1 ELSE -1 END AS dir,
         greatest(least(x1, x2), rx0) AS a, least(greatest(x1, x2), rx1) AS b,
         (y2 - y1) / (x2 - x1) AS m, x1, y1
  FROM rect JOIN edge USING (fid) WHERE x1 <> x2),
under AS (
  SELECT fid, part, ring, c, r, dir * CASE
    WHEN m = 0 THEN (least(greatest(y1, ry0), ry1) - ry0) * (b - a)
    ELSE ({grown('(y1 + m * (b - x1))')} - {grown('(y1 + m * (a - x1))')}) / m - ry0 * (b - a) END AS s
  FROM span WHERE b > a),
rings AS (SELECT fid, part, ring, c, r, abs(sum(s)) AS s FROM under GROUP BY fid, part, ring, c, r),
clip AS (SELECT fid, c, r, sum(CASE WHEN ring = 0 THEN s ELSE -s END) AS area FROM rings
         GROUP BY fid, c, r HAVING area > 0)"""

CLIP = POLY + ", " + _keyed(0, 4096) + ", " + _clip_area(0, 4096)
CLIP_SHIFT = POLY + ", " + _keyed(128, 3968) + ", " + _clip_area(128, 3968)

# Combs cut to keys. Above the spine every tooth is a piece; with the spine all is one ring, walked
# from its south-western corner: along the bottom, then tooth after tooth from the east.


def _at(x: str, y: str) -> str:
    return f"CAST({x} AS BIGINT) || ' ' || CAST({y} AS BIGINT)"


COMBS = _SUPPLIERS + f""",
comb AS (SELECT fid, s_name, cx - 40 AS sx0, cx + 40 AS sx1, cy - h - 16 AS sb, cy - h AS st, cy + h AS top FROM sup),
cells AS (
  SELECT *, c * 128 AS rx0, (c + 1) * 128 AS rx1, 4096 - (r + 1) * 128 AS ry0, 4096 - r * 128 AS ry1 FROM (
    SELECT *, unnest(generate_series(CAST(floor((4096 - top) / 128) AS BIGINT), CAST(ceil((4096 - sb) / 128) - 1 AS BIGINT))) AS r FROM (
      SELECT *, unnest(generate_series(CAST(floor(sx0 / 128) AS BIGINT), CAST(ceil(sx1 / 128) - 1 AS BIGINT))) AS c FROM comb))),
cut AS (
  SELECT fid, s_name, c, r, st > ry0 AS spine, st < ry1 AS open, greatest(sx0, rx0) AS x0, least(sx1, rx1) AS x1,
         greatest(sb, ry0) AS y0, least(st, ry1) AS y1, least(top, ry1) AS y2, ry0, sx0, rx0, rx1 FROM cells),
tooth AS (
  SELECT *, greatest(sx0 + 32 * i, rx0) AS a, least(sx0 + 32 * i + 16, rx1) AS b FROM cut, (VALUES (0), (1), (2)) t(i)
  WHERE open AND greatest(sx0 + 32 * i, rx0) < least(sx0 + 32 * i + 16, rx1)),
pieces AS (
  SELECT fid, s_name, c, r, count(*) AS n_rings, string_agg({_at('a', 'ry0')} || ',' || {_at('b', 'ry0')} || ',' || {_at('b', 'y2')} || ','
    || {_at('a', 'y2')} || ',' || {_at('a', 'ry0')}, '|' ORDER BY a) AS coords
  FROM tooth WHERE NOT spine GROUP BY ALL
  UNION ALL
  SELECT fid, s_name, c, r, 1, {_at('x0', 'y0')} || ',' || {_at('x1', 'y0')} || ','
    || CASE WHEN east IS NULL OR east < x1 THEN {_at('x1', 'y1')} || ',' ELSE '' END || coalesce(walk, '')
    || CASE WHEN west IS NULL OR west > x0 THEN {_at('x0', 'y1')} || ',' ELSE '' END || {_at('x0', 'y0')}
  FROM cut LEFT JOIN (
    SELECT fid, c, r, max(b) AS east, min(a) AS west, string_agg(
      CASE WHEN b < x1 THEN {_at('b', 'y1')} || ',' ELSE '' END || {_at('b', 'y2')} || ',' || {_at('a', 'y2')} || ','
      || CASE WHEN a > x0 THEN {_at('a', 'y1')} || ',' ELSE '' END, '' ORDER BY a DESC) AS walk
    FROM tooth WHERE spine GROUP BY ALL) USING (fid, c, r) WHERE spine)"""

_INT = "CAST({} AS INTEGER) AS {}"


def _colrow(c: str = "c", r: str = "r") -> str:
    return f'CAST({c} AS INTEGER) AS col, CAST({r} AS INTEGER) AS "row"'


def _lists(pairs: str, value: str = "fid", out: str = "fids") -> str:
    """Sorted id lists per key and range of 4 ids."""
    return f"""SELECT {_colrow()}, part, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY fid) AS {out}
FROM (SELECT *, fid // 4 AS part FROM {pairs})
GROUP BY c, r, part"""


_ATTRS = """'{"UID":"' || s_suppkey || '","NAME":"' || s_name || '","NATION":"' || s_nationkey || '"}'"""
_RECT_TEXT = ("CAST(xmin AS BIGINT) || ' ' || CAST(ymin AS BIGINT) || ',' || CAST(xmax AS BIGINT) || ' ' || CAST(ymin AS BIGINT)"
              " || ',' || CAST(xmax AS BIGINT) || ' ' || CAST(ymax AS BIGINT) || ',' || CAST(xmin AS BIGINT) || ' ' || CAST(ymax AS BIGINT)"
              " || ',' || CAST(xmin AS BIGINT) || ' ' || CAST(ymin AS BIGINT)")
_TILE_BOX = ("CAST(c * 128 AS DOUBLE) AS xmin, CAST(4096 - (r + 1) * 128 AS DOUBLE) AS ymin, "
             "CAST((c + 1) * 128 AS DOUBLE) AS xmax, CAST(4096 - r * 128 AS DOUBLE) AS ymax")
_SCENE_NAME = "printf('scene_%010d.tif', scene)"


def _with(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"


ORACLES: dict[str, str] = {
    # Sources
    "scan_geotiff": _with(CELLS, f"""SELECT {_SCENE_NAME} AS scene, scene AS ord, band, k, value FROM (
  SELECT scene, 0 AS band, k, b0 AS value FROM cells UNION ALL SELECT scene, 1, k, b1 FROM cells)
WHERE value IS NOT NULL"""),
    "scan_geotiff_extent": _with(CELLS, f"""SELECT {_SCENE_NAME} AS scene, scene AS ord, 1 AS band, k, b1 AS value FROM cells
WHERE b1 IS NOT NULL AND scene % 2 = 0 AND 3696 - scene // 2 * 384 <= 3720 AND 4096 - scene // 2 * 384 >= 3400"""),
    "scan_geotiff_named": _with(CELLS, f"""SELECT {_SCENE_NAME} AS scene, 0 AS band, count(b0) AS n,
  CAST(sum(b0) AS DOUBLE) AS total FROM cells GROUP BY scene
UNION ALL SELECT {_SCENE_NAME}, 1, count(b1), floor(CAST(sum(b1) AS DOUBLE) * 1e4 + 0.5) / 1e4 FROM cells GROUP BY scene"""),
    "scan_geotiff_whole_numbers": _with(CELLS, f"""SELECT {_SCENE_NAME} AS scene, scene AS ord, band, k,
  floor(v) - 251 * floor(floor(v) / 251) - shift AS value, cell_type
FROM (SELECT scene, 0 AS band, k, b0 AS v FROM cells UNION ALL SELECT scene, 1, k, b1 FROM cells),
     (VALUES ('uint8', 0), ('int16', 125)) t(cell_type, shift)
WHERE v IS NOT NULL"""),
    "raster_catalog": _with(SCENES, """SELECT scene, xmin, ymin, xmax, ymax, 32651 AS epsg, 50 AS n_cols,
  50 AS n_rows, 2 AS n_bands, 'float64' AS cell_type FROM scenes"""),
    "list_files": _with(SCENES, "SELECT scene AS name, true AS filled FROM scenes"),
    "list_files_ext": _with(_SUPPLIERS, f"""SELECT DISTINCT printf('%s_%05d', {_KIND_CASE}, fid // 5000) || ext AS name
FROM sup, (VALUES ('.shp'), ('.dbf')) v(ext)"""),
    "scan_shapefile": _with(POLY, """SELECT fid AS uid, s_name AS name, 'multipolygon' AS geom_type,
  CAST(CASE WHEN fid % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS last_part, CAST(n_rings AS INTEGER) AS n_rings,
  vertices, CAST(area AS DOUBLE) AS area, xmin, ymin, xmax, ymax
FROM sup JOIN box USING (fid)
JOIN (SELECT fid, count(*) AS vertices, count(DISTINCT part * 10 + ring) AS n_rings FROM vert GROUP BY fid) USING (fid)
JOIN (SELECT fid, sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS area FROM (
        SELECT fid, part, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM edge GROUP BY ALL) GROUP BY fid) USING (fid)"""),
    "features_repartition": _with(POLY, """SELECT fid, 'multipolygon' AS geom_type, count(*) AS vertices
FROM vert GROUP BY fid"""),
    "shapefile_filesets": _with(_SUPPLIERS, f"""SELECT DISTINCT printf('%s_%05d', {_KIND_CASE}, fid // 5000) AS stem,
  'dbf,shp,shx' AS extensions, true AS complete FROM sup"""),
    # Sinks
    "write_whole_geotiff": _with(INSIDE, "SELECT fid, band, gc, gr, value FROM inside"),
    "write_geotiff": _with(INSIDE, "SELECT fid, band, gc, gr, value FROM inside"),
    "write_tiles": _with(MERGED, "SELECT band, gc, gr, value FROM bands"),
    "write_metadata_json": _with(HITS_CLOSED, """SELECT CAST(fid AS VARCHAR) AS UID, s_name AS NAME,
  CAST(s_nationkey AS VARCHAR) AS NATION FROM met JOIN sup USING (fid)"""),
    "write_lines": "SELECT p_name AS line, count(*) AS n FROM part GROUP BY p_name",
    # Projections
    "feature_attribute_map": """SELECT s_suppkey AS fid, 'UID' AS name, CAST(s_suppkey AS VARCHAR) AS value FROM supplier
UNION ALL SELECT s_suppkey, 'NAME', s_name FROM supplier
UNION ALL SELECT s_suppkey, 'NATION', CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "feature_attribute": """SELECT s_suppkey AS fid, s_nationkey AS nation,
  TRY_CAST(s_name AS INTEGER) IS NULL AS not_a_number, true AS missing FROM supplier""",
    "geom_envelope": _with(POLY, "SELECT fid, xmin, ymin, xmax, ymax FROM box"),
    "tile_extents": _with(TILEKEYS, f"SELECT {_colrow()}, {_TILE_BOX} FROM tilekeys"),
    "extent_to_polygon": _with(SCENES, f"SELECT scene, {_RECT_TEXT} AS ring FROM scenes"),
    "promote_multipolygon": "SELECT s_suppkey AS fid, 'multipolygon' AS geom_type FROM supplier WHERE s_suppkey % 6 IN (2, 5)",
    "path_basename": _with(PATHS, "SELECT p_partkey, string_split(path, '/')[-1] AS name FROM paths"),
    "swap_extension": _with(PATHS, """SELECT p_partkey, substr(path, 1, length(path) - strpos(reverse(path), '.')) || '.json' AS path
FROM paths"""),
    "path_stem_glob": _with(PATHS, "SELECT p_partkey, string_split(path, '.')[1] || '.*' AS stem FROM paths"),
    "attrs_to_json": f"SELECT s_suppkey AS fid, {_ATTRS} AS json FROM supplier",
    # Filters
    "filter_tif": _with(PATHS, "SELECT p_partkey, path FROM paths WHERE right(path, 4) = '.tif'"),
    "tiles_in_envelope": _with(MERGED, """SELECT band, gc, gr, value FROM bands
WHERE gc // 16 BETWEEN 1 AND 4 AND gr // 16 BETWEEN 1 AND 4"""),
    "tiles_on_curve": _with(MERGED, """SELECT band, gc, gr, value, label FROM bands, (VALUES ('hilbert'), ('zorder')) t(label)
WHERE gc // 16 BETWEEN 1 AND 4 AND gr // 16 BETWEEN 1 AND 4"""),
    "drop_negative_keys": _with(HITS_SHIFT, f"SELECT fid, {_colrow()} FROM hit WHERE c >= 0 AND r >= 0"),
    "polygon_intersects_rect": _with(HITS_CLOSED, f"SELECT fid, {_colrow()} FROM hit JOIN tilekeys USING (c, r)"),
    "point_in_polygon": _with(CELLS + ", " + POLY, f"""SELECT fid, scene, k
FROM (SELECT scene, k, 8.0::DOUBLE * gc + 4 AS x, 4092.0::DOUBLE - 8 * gr AS y FROM cells)
JOIN box ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax JOIN edge USING (fid)
GROUP BY fid, scene, k HAVING sum({_crossing('x', 'y')}) % 2 = 1"""),
    # Joins
    "metadata_by_footprint": _with(HITS_CLOSED, "SELECT fid, s_name AS name FROM met JOIN sup USING (fid)"),
    "features_per_key": _with(HITS + ", kept AS (SELECT * FROM hit WHERE c >= 0 AND r >= 0)", _lists("kept")),
    "clip_to_grid": _with(CLIP, f"SELECT fid, {_colrow()}, CAST(area AS DOUBLE) AS area FROM clip"),
    "clip_parts": _with(COMBS, f"""SELECT fid, {_colrow()}, CASE WHEN n_rings > 1 THEN 'multipolygon' ELSE 'polygon' END AS geom_type,
  CAST(n_rings AS INTEGER) AS n_rings, coords FROM pieces"""),
    "clipped_geometries_per_key": _with(COMBS, f"""SELECT {_colrow()}, fid // 4 AS part,
  string_agg(fid || ' ' || s_name || ' ' || coords, ';' ORDER BY fid) AS items
FROM pieces WHERE c >= 0 AND r >= 0 GROUP BY c, r, fid // 4"""),
    "clipped_features_per_key": _with(
        CLIP_SHIFT + ", kept AS (SELECT fid, c, r FROM clip WHERE c >= 0 AND r >= 0)", _lists("kept")),
    "uids_per_key": _with(HITS + ", kept AS (SELECT * FROM hit WHERE c >= 0 AND r >= 0)", f"""SELECT *,
  (SELECT CAST(sum((((col >> b) & 1)::BIGINT << (2 * b)) + (((\"row\" >> b) & 1)::BIGINT << (2 * b + 1))) AS BIGINT)
   FROM (SELECT unnest(generate_series(0, 30))::INTEGER AS b)) AS sfc
FROM ({_lists("kept", out="uids")})"""),
    "mask_tiles": _with(INSIDE, "SELECT fid, band, gc, gr, value FROM inside"),
    "tile_to_layout": _with(CELLS, f"""SELECT band, {_INT.format('gc', 'gc')}, {_INT.format('gr', 'gr')},
  {_up('value', 4)} AS value FROM (
  SELECT band, gc, gr, arg_min(value, scene) AS value FROM (
    SELECT band, scene, scene % 2 * 48 + a AS gc, scene // 2 * 48 + b AS gr,
           sum(wt * value) FILTER (WHERE value IS NOT NULL) / sum(wt) FILTER (WHERE value IS NOT NULL) AS value
    FROM (SELECT unnest(generate_series(-1, 48)) AS a), (SELECT unnest(generate_series(-1, 48)) AS b),
         (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy),
         (SELECT scene, k % 50 AS i, k // 50 AS j, 0 AS band, b0 AS value FROM cells
          UNION ALL SELECT scene, k % 50, k // 50, 1, b1 FROM cells),
         LATERAL (SELECT CASE WHEN a < 0 THEN CASE dx WHEN 1 THEN 1 ELSE 0 END ELSE 0.5::DOUBLE END
                       * CASE WHEN b < 0 THEN CASE dy WHEN 1 THEN 1 ELSE 0 END ELSE 0.5::DOUBLE END AS wt)
    WHERE i = a + dx AND j = b + dy AND wt > 0
    GROUP BY band, scene, a, b)
  WHERE value IS NOT NULL GROUP BY band, gc, gr)"""),
    "reproject_tiles": _with(WARP, f"""SELECT band, {_INT.format('gc', 'gc')}, {_INT.format('gr', 'gr')},
  {_up('value', 4)} AS value FROM warped"""),
    "query_first_feature": _with(POLY + ", " + TILEKEYS, f"""SELECT fid, xmin, ymin, xmax, ymax, {_colrow()}
FROM box JOIN tilekeys ON c >= floor(xmin / 128) AND c <= greatest(floor(xmin / 128), ceil(xmax / 128) - 1)
 AND r >= floor((4096 - ymax) / 128) AND r <= greatest(floor((4096 - ymax) / 128), ceil((4096 - ymin) / 128) - 1)
WHERE fid = 0"""),
    # Aggregations
    "merged_extent": _with(SCENES, """SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax,
  max(ymax) AS ymax FROM scenes"""),
    "layer_metadata": _with(SCENES, """SELECT 32651 AS epsg, true AS one_crs, 'float64' AS cell_type,
  min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax,
  min((xmax - xmin) / 50) AS cell_w, min((ymax - ymin) / 50) AS cell_h FROM scenes"""),
    "layer_bounds": _with(SCENES, """SELECT 0 AS cmin, 0 AS rmin, CAST(ceil((max(xmax) - min(xmin)) / 128) - 1 AS INTEGER) AS cmax,
  CAST(ceil((max(ymax) - min(ymin)) / 128) - 1 AS INTEGER) AS rmax FROM scenes"""),
    "layer_metadata_mixed": _with(SCENES, """SELECT 32651 AS epsg, true AS one_crs,
  CASE WHEN max(ord % 2) = min(ord % 2) THEN 'uint16' ELSE 'int32' END AS cell_type,
  min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax,
  min((xmax - xmin) / 50) AS cell_w, min((ymax - ymin) / 50) AS cell_h FROM scenes"""),
    "feature_count_per_key": _with(HITS, f"SELECT {_colrow()}, count(*) AS n FROM hit GROUP BY c, r"),
    "merge_tiles": _with(MERGED, "SELECT band, gc, gr, value FROM bands"),
    "stitch": _with(INSIDE, """SELECT fid, band, CAST(bc AS INTEGER) AS block_col, CAST(br AS INTEGER) AS block_row,
  CAST(wide AS INTEGER) AS n_cols, CAST(high AS INTEGER) AS n_rows,
  CAST((gr - r0) * wide + gc - c0 AS INTEGER) AS pos, value
FROM (SELECT *, gc // 32 AS bc, gr // 32 AS br FROM inside)
JOIN (SELECT fid, gc // 32 AS bc, gr // 32 AS br, min(gc) AS c0, max(gc) - min(gc) + 1 AS wide,
             min(gr) AS r0, max(gr) - min(gr) + 1 AS high FROM centres GROUP BY ALL) USING (fid, bc, br)"""),
    "footprint": _with(TILEKEYS, f"""SELECT {_colrow()}, {_RECT_TEXT} AS ring
FROM (SELECT c, r, {_TILE_BOX} FROM tilekeys)"""),
    "metadata_json_agg": _with(HITS_CLOSED, f"""SELECT s_suppkey // 16 AS part,
  string_agg({_ATTRS}, chr(44) || chr(10) ORDER BY s_suppkey) AS json
FROM supplier WHERE s_suppkey IN (SELECT fid FROM met) GROUP BY s_suppkey // 16"""),
    "stage_counts": _with(CLIP_SHIFT + ", " + TILEKEYS, """SELECT 'tiles' AS stage, count(*) AS n FROM tilekeys
UNION ALL SELECT 'features', count(*) FROM supplier
UNION ALL SELECT 'clipped', count(*) FROM clip
UNION ALL SELECT 'grouped', count(*) FROM (SELECT DISTINCT c, r FROM clip WHERE c >= 0 AND r >= 0)"""),
    "count_vertices": _with(POLY, "SELECT count(*) AS vertices FROM vert"),
    "count_features": "SELECT count(*) AS features FROM supplier WHERE s_suppkey % 6 = 5",
    "tiles_sfc_sorted": _with(
        HILBERT.replace(KEYS, TILEKEYS + ", keys AS (SELECT CAST(c AS INTEGER) AS c, CAST(r AS INTEGER) AS r FROM tilekeys)"),
        f"SELECT {_colrow()}, idx AS sfc FROM h"),
    "sample_scene": _with(SCENES, "SELECT scene, ord, xmin, ymin, xmax, ymax FROM scenes ORDER BY ord LIMIT 1"),
    # Grid and curves
    "layout_from_extent": _with(SCENES, """SELECT x0 AS xmin, y1 - n_rows * 320 AS ymin, x0 + n_cols * 320 AS xmax, y1 AS ymax,
  CAST(n_cols AS INTEGER) AS cols, CAST(n_rows AS INTEGER) AS rows, 32 AS tile_cols, 32 AS tile_rows
FROM (SELECT min(xmin) AS x0, max(ymax) AS y1, ceil((max(xmax) - min(xmin)) / 320) AS n_cols,
             ceil((max(ymax) - min(ymin)) / 320) AS n_rows FROM scenes)"""),
    "layout_from_tile_count": _with(SCENES, """SELECT scene, CAST(c AS INTEGER) AS col, CAST(unnest(generate_series(
  CAST(floor((n - ymax) / h) AS BIGINT), CAST(least(3, greatest(floor((n - ymax) / h), ceil((n - ymin) / h) - 1)) AS BIGINT))) AS INTEGER) AS "row"
FROM (SELECT *, unnest(generate_series(CAST(floor((xmin - w0) / w) AS BIGINT),
               CAST(least(7, greatest(floor((xmin - w0) / w), ceil((xmax - w0) / w) - 1)) AS BIGINT))) AS c
      FROM scenes, (SELECT min(xmin) AS w0, max(ymax) AS n, (max(xmax) - min(xmin)) / 8 AS w, (max(ymax) - min(ymin)) / 4 AS h FROM scenes))"""),
    "keys_for_extent": _with(SCENES, f"""SELECT scene, {_colrow()} FROM (
  SELECT *, unnest(generate_series(CAST((4096 - ymax) // 128 AS BIGINT), CAST(ceil((4096 - ymin) / 128) - 1 AS BIGINT))) AS r FROM (
    SELECT *, unnest(generate_series(CAST(xmin // 128 AS BIGINT), CAST(ceil(xmax / 128) - 1 AS BIGINT))) AS c FROM scenes))"""),
    "keys_for_raster": _with(SCENES, f"""SELECT scene, {_colrow()} FROM scenes,
  (SELECT unnest(generate_series(0, 3)) AS c), (SELECT unnest(generate_series(0, 3)) AS r)"""),
    "tile_snap": """SELECT id, x, CAST(floor(x / 1024) AS INTEGER) AS floor_count, CAST(floor(x / 1024) AS BIGINT) * 1024 AS floor_value,
  CAST(ceil(x / 1024) AS INTEGER) AS ceiling_count, CAST(ceil(x / 1024) AS BIGINT) * 1024 AS ceiling_value
FROM (SELECT l_orderkey AS id, l_extendedprice AS x FROM lineitem UNION ALL SELECT c_custkey, c_acctbal FROM customer)""",
    "zorder_encode": _with(ZORDER, f"SELECT {_colrow()}, idx FROM z"),
    "zorder_decode": _with(ZORDER, f"SELECT printf('%x', idx) AS hex, {_colrow()} FROM z"),
    "hilbert_encode": _with(HILBERT, f"SELECT {_colrow()}, idx FROM h"),
    "hilbert_decode": _with(HILBERT, f"SELECT printf('%x', idx) AS hex, {_colrow()} FROM h"),
    "sfc_index": _with(HILBERT + ZORDER[len(KEYS):], f"""SELECT 'hilbert' AS label, {_colrow()}, idx FROM h
UNION ALL SELECT 'zorder', {_colrow()}, idx FROM z"""),
    "sfc_hex": _with(ZORDER, f"SELECT {_colrow()}, printf('%08x', idx) AS hex, idx FROM z"),
    # Scalars
    "pad_left": """SELECT o_orderkey, repeat('0', greatest(0, 3 - length(k))) || k AS three,
  repeat('0', greatest(0, 8 - length(k))) || k AS eight FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)""",
    "repeat_char": "SELECT p_partkey, repeat('x', greatest(0, p_size - 10)) AS text FROM part",
    "path_join": _with(PATHS, "SELECT p_partkey, path || '/part.json' AS path FROM paths"),
    # 'hdfs://h' has an inner double slash, which goes too
    "file_join": _with(PATHS, """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN
    CASE p_partkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '/a/b' ELSE '/part.json' END
  ELSE replace(path, '//', '/') || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/a/b' ELSE '/part.json' END END AS path FROM paths"""),
    "round_at": f"""SELECT c_custkey, floor(c_custkey / CAST(2 AS DOUBLE) - 100 + 0.5) AS ties, {_up('c_acctbal', 1)} AS balance
FROM customer""",
    "nanos_to_seconds": f"SELECT o_orderkey, {_up('CAST(o_orderkey * 123456789 AS DOUBLE) / 1e9', 4)} AS seconds FROM orders",
    "size_in_units": f"""SELECT doc_id, {_up('CAST(n_chars AS DOUBLE) / 1024', 3)} AS kib,
  {_up('CAST(n_chars AS DOUBLE) / 1048576', 3)} AS mib FROM documents""",
    "format_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events",
    # Projection and resampling
    "reproject_points": _with(GEO + ", " + _forward("geo", "utm"),
                              f"SELECT id, {_up('x', 3)} AS x, {_up('y', 3)} AS y FROM utm"),
    "unproject_points": _with(
        GEO + ", " + _forward("geo", "utm") + f", metres AS (SELECT id, {_up('x', 3)} AS x, {_up('y', 3)} AS y FROM utm), "
        + _backward("metres", "back"), f"SELECT id, {_up('lon', 8)} AS lon, {_up('lat', 8)} AS lat FROM back"),
    "reproject_worldwide": _with(
        WORLD + ", " + _forward("world", "utm"), f"""SELECT id,
  CASE WHEN abs(lon - 123) <= 30 OR abs(lon - 123) >= 330 THEN {_up('x', 3)} END AS x,
  CASE WHEN abs(lon - 123) <= 30 OR abs(lon - 123) >= 330 THEN {_up('y', 3)} END AS y,
  CASE WHEN abs(lat) < 85.0511 THEN {_up('radians(lon) * 6378137', 3)} END AS mx,
  CASE WHEN abs(lat) < 85.0511 THEN {_up('ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137', 3)} END AS my
FROM world JOIN utm USING (id)"""),
    # Pipelines
    "pipeline_tile": _with(WARP, f"""SELECT band, {_colrow()}, CAST(n AS INTEGER) AS n, least, most,
  x0 + c * 4096 AS xmin, y1 - (r + 1) * 4096 AS ymin, x0 + (c + 1) * 4096 AS xmax, y1 - r * 4096 AS ymax
FROM (SELECT band, gc // 16 AS c, gr // 16 AS r, count(*) AS n, {_up('min(value)', 4)} AS least, {_up('max(value)', 4)} AS most
      FROM warped GROUP BY ALL), frame"""),
    "pipeline_pixels_by_polygon": _with(INSIDE, "SELECT fid, band, gc, gr, value FROM inside"),
    "pipeline_metadata": _with(HITS_CLOSED, f"""SELECT s_suppkey AS fid, {_ATTRS} AS json FROM supplier
WHERE s_suppkey IN (SELECT fid FROM met)"""),
}

for _kind in KINDS:
    _rows = f"FROM sup WHERE {_KIND_CASE} = '{_kind}'"
    ORACLES[f"features_{_kind}"] = _with(
        _SUPPLIERS, f"SELECT fid AS uid, s_name AS name, {_KIND_TEXT[_kind]} AS coords {_rows}")
    ORACLES[f"features_{_kind}_field"] = _with(
        _SUPPLIERS, f"SELECT {_KIND_TEXT[_kind]} AS coords, s_nationkey AS data {_rows}")

ORACLES["scan_geotiff_binary"] = ORACLES["tile_to_layout"]
ORACLES["pipeline_tile_cells"] = ORACLES["reproject_tiles"]
_SAMPLES = _with(MERGED + ", " + SCENES, f"""SELECT id, {_up('v0', 6)} AS b0, {_up('v1', 6)} AS b1 FROM (
  SELECT id, sum(wt * b0) / sum(wt) FILTER (WHERE b0 IS NOT NULL) AS v0, sum(wt * round(b1 * 100)) / sum(wt) FILTER (WHERE b1 IS NOT NULL) AS v1 FROM (
    SELECT id, CAST(floor(px) AS BIGINT) + dx AS sc, CAST(floor(py) AS BIGINT) + dy AS sr,
           abs(1 - dx - (px - floor(px))) * abs(1 - dy - (py - floor(py))) AS wt
    FROM (SELECT o_orderkey AS id,
                 least(greatest(CAST(o_orderkey * 37 % (64 * nc) AS DOUBLE) / 64 - 0.5::DOUBLE, 0), nc - 1) AS px,
                 least(greatest(CAST(o_custkey * 53 % (64 * nr) AS DOUBLE) / 64 - 0.5::DOUBLE, 0), nr - 1) AS py
          FROM orders, (SELECT CAST((max(xmax) - min(xmin)) / 8 AS BIGINT) AS nc,
                               CAST((max(ymax) - min(ymin)) / 8 AS BIGINT) AS nr FROM scenes)),
         (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
  LEFT JOIN merged ON gc = sc AND gr = sr WHERE wt > 0 GROUP BY id)""")
ORACLES["bilinear_sample_bands"] = _SAMPLES
ORACLES["bilinear_sample"] = _SAMPLES.replace("(64 * n", "(4 * n").replace(" / 64 ", " / 4 ")
# The footprint of the whole run holds every tile of the scenes, also where all cells are empty.
_ALL_TILES = """tilekeys AS (
  SELECT DISTINCT (ord % 2 * 48 + a) // 16 AS c, (ord // 2 * 48 + b) // 16 AS r
  FROM (SELECT DISTINCT event_id // 2500 AS ord FROM events),
       (SELECT unnest(generate_series(0, 49)) AS a), (SELECT unnest(generate_series(0, 49)) AS b))"""
ORACLES["pipeline_all"] = _with(
    INSIDE + ", " + _keyed(0, 4096, closed=True) + ", " + _ALL_TILES
    + ", met AS (SELECT DISTINCT fid FROM hit JOIN tilekeys USING (c, r))",
    """SELECT fid, band, gc, gr, value FROM inside
UNION ALL SELECT fid, NULL, NULL, NULL, NULL FROM met""")
