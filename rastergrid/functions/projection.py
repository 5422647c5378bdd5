"""Coordinates between geographic WGS84, web mercator and UTM.

Transverse Mercator by the Krueger series to sixth order in the third flattening, with the
inverse latitude from three Newton steps (Karney 2011, "Transverse Mercator with an accuracy of
a few nanometers"). Each CRS has a domain, beyond which a point has no coordinates: NULL, or NaN in numpy.
The Column form chains projections, so each step is computed once; the numpy
form serves the pixel kernels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM constants.
A = 6378137.0
FLATTENING = 1 / 298.257223563
K0 = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

# Domains: degrees beside a zone's central meridian within which the series holds, and the parallel
# where web mercator ends (a square map).
ZONE_REACH = 30.0
MERCATOR_LAT = math.degrees(math.atan(math.sinh(math.pi)))
_SLACK = 1e-9

E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
_N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)

# Series coefficients; row j lists the terms in n^j, n^(j+1), ..., n^6.
_FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
_INVERSE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


def _evaluate(table: list[list[float]]) -> list[float]:
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


ALPHA = _evaluate(_FORWARD)
BETA = _evaluate(_INVERSE)


def utm_parameters(epsg: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing of a 326zz / 327zz code."""
    zone = epsg % 100
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"unsupported EPSG code {epsg}")
    return zone * 6.0 - 183.0, 0.0 if epsg // 100 == 326 else FALSE_NORTHING_SOUTH


def check_epsg(epsg: int) -> int:
    if epsg not in (4326, 3857):
        utm_parameters(epsg)
    return epsg


def _limits(epsg: int) -> tuple[float, float | None, float | None]:
    """Highest latitude, central meridian and least cosine of the angle beside it, in radians."""
    if epsg in (4326, 3857):
        return math.radians(MERCATOR_LAT if epsg == 3857 else 90.0) + _SLACK, None, None
    return math.pi / 2 + _SLACK, math.radians(utm_parameters(epsg)[0]), math.cos(math.radians(ZONE_REACH)) - _SLACK


# Column form ------------------------------------------------------------------

_TMP = "__proj_"


def _steps(df: DataFrame, steps: list[list[tuple[str, Column]]]) -> DataFrame:
    for group in steps:
        df = df.withColumns({_TMP + name: expr for name, expr in group})
    return df


def _t(name: str) -> Column:
    return F.col(_TMP + name)


def _series(coefs: list[float], outer, inner, sign: float) -> Column:
    out = F.lit(0.0)
    for j, c in enumerate(coefs, 1):
        out = out + F.lit(sign * c) * outer(_t("p") * (2.0 * j)) * inner(_t("q") * (2.0 * j))
    return out


def _from_geographic(df: DataFrame, epsg: int) -> DataFrame:
    """From radians in tmp lam/phi to map units in tmp X/Y."""
    if epsg == 4326:
        return _steps(df, [[("X", F.degrees(_t("lam"))), ("Y", F.degrees(_t("phi")))]])
    if epsg == 3857:
        return _steps(df, [[("X", _t("lam") * A), ("Y", F.asinh(F.tan(_t("phi"))) * A)]])
    lon0, fn = utm_parameters(epsg)
    return _steps(df, [
        [("tau", F.tan(_t("phi"))), ("dl", _t("lam") - F.lit(math.radians(lon0)))],
        [("root", F.sqrt(_t("tau") * _t("tau") + 1))],
        [("sig", F.sinh(F.atanh(_t("tau") * E / _t("root")) * E))],
        [("tc", _t("tau") * F.sqrt(_t("sig") * _t("sig") + 1) - _t("sig") * _t("root")),
         ("cl", F.cos(_t("dl")))],
        [("p", F.atan2(_t("tc"), _t("cl"))),
         ("q", F.asinh(F.sin(_t("dl")) / F.sqrt(_t("tc") * _t("tc") + _t("cl") * _t("cl"))))],
        [("X", F.lit(FALSE_EASTING)
          + F.lit(K0 * RADIUS) * (_t("q") + _series(ALPHA, F.cos, F.sinh, 1.0))),
         ("Y", F.lit(fn) + F.lit(K0 * RADIUS) * (_t("p") + _series(ALPHA, F.sin, F.cosh, 1.0)))],
    ])


def _to_geographic(df: DataFrame, epsg: int, x: Column, y: Column) -> DataFrame:
    """From map units to radians in tmp lam/phi."""
    if epsg == 4326:
        return _steps(df, [[("lam", F.radians(x)), ("phi", F.radians(y))]])
    if epsg == 3857:
        return _steps(df, [[("lam", x / A), ("phi", F.atan(F.sinh(y / A)))]])
    lon0, fn = utm_parameters(epsg)
    steps = [
        [("p", (y - F.lit(fn)) / F.lit(K0 * RADIUS)),
         ("q", (x - F.lit(FALSE_EASTING)) / F.lit(K0 * RADIUS))],
        [("pc", _t("p") + _series(BETA, F.sin, F.cosh, -1.0)),
         ("qc", _t("q") + _series(BETA, F.cos, F.sinh, -1.0))],
        [("sh", F.sinh(_t("qc"))), ("cp", F.cos(_t("pc")))],
        [("tc", F.sin(_t("pc")) / F.sqrt(_t("sh") * _t("sh") + _t("cp") * _t("cp"))),
         ("lam", F.atan2(_t("sh"), _t("cp")) + F.lit(math.radians(lon0)))],
        [("tau", _t("tc"))],
    ]
    for _ in range(3):
        steps += [
            [("root", F.sqrt(_t("tau") * _t("tau") + 1))],
            [("sig", F.sinh(F.atanh(_t("tau") * E / _t("root")) * E))],
            [("ti", _t("tau") * F.sqrt(_t("sig") * _t("sig") + 1) - _t("sig") * _t("root"))],
            [("tau", _t("tau") + (_t("tc") - _t("ti")) / F.sqrt(_t("ti") * _t("ti") + 1)
              * (1 + F.lit(1 - E2) * _t("tau") * _t("tau")) / (F.lit(1 - E2) * _t("root")))],
        ]
    return _steps(df, steps + [[("phi", F.atan(_t("tau")))]])


def project(df: DataFrame, x: str, y: str, src: int, dst: int,
            out_x: str, out_y: str) -> DataFrame:
    """Add ``out_x``/``out_y``: the point (x, y) of CRS ``src`` in CRS ``dst``, NULL beyond the domain
    of either."""
    check_epsg(src), check_epsg(dst)
    keep = [F.col(c) for c in df.columns if c not in (out_x, out_y)]
    done = _from_geographic(_to_geographic(df, src, F.col(x), F.col(y)), dst)
    known = F.lit(True)
    for lat, meridian, cosine in map(_limits, (src, dst)):
        known = known & (F.abs(_t("phi")) <= lat)
        if meridian is not None:
            known = known & (F.cos(_t("lam") - meridian) >= cosine)
    return done.select(*keep, F.when(known, _t("X")).alias(out_x), F.when(known, _t("Y")).alias(out_y))


# numpy form for the pixel kernels -------------------------------------------------

def _np_conformal(tau):
    root = np.sqrt(1 + tau * tau)
    sig = np.sinh(E * np.arctanh(E * tau / root))
    return tau * np.sqrt(1 + sig * sig) - sig * root


def np_project(x, y, src: int, dst: int):
    """Arrays of points from CRS ``src`` to CRS ``dst``; NaN beyond the domain of either."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if src == dst:
        return x, y
    if src == 4326:
        lam, phi_tan = np.radians(x), np.tan(np.radians(y))
    elif src == 3857:
        lam, phi_tan = x / A, np.sinh(y / A)
    else:
        lon0, fn = utm_parameters(src)
        p, q = (y - fn) / (K0 * RADIUS), (x - FALSE_EASTING) / (K0 * RADIUS)
        pc, qc = p.copy(), q.copy()
        for j, b in enumerate(BETA, 1):
            pc = pc - b * np.sin(2 * j * p) * np.cosh(2 * j * q)
            qc = qc - b * np.cos(2 * j * p) * np.sinh(2 * j * q)
        goal = np.sin(pc) / np.hypot(np.sinh(qc), np.cos(pc))
        lam = np.arctan2(np.sinh(qc), np.cos(pc)) + math.radians(lon0)
        phi_tan = goal
        for _ in range(3):
            got = _np_conformal(phi_tan)
            phi_tan = phi_tan + ((goal - got) / np.sqrt(1 + got * got)
                                 * (1 + (1 - E2) * phi_tan**2)
                                 / ((1 - E2) * np.sqrt(1 + phi_tan**2)))
    known = np.ones(np.broadcast(lam, phi_tan).shape, bool)
    for lat, meridian, cosine in map(_limits, (src, dst)):
        known &= np.abs(y if src == 4326 else np.degrees(np.arctan(phi_tan))) <= math.degrees(lat)
        if meridian is not None:
            known &= np.cos(lam - meridian) >= cosine
    px, py = _np_from_geographic(lam, phi_tan, dst)
    return np.where(known, px, np.nan), np.where(known, py, np.nan)


def _np_from_geographic(lam, phi_tan, dst: int):
    if dst == 4326:
        return np.degrees(lam), np.degrees(np.arctan(phi_tan))
    if dst == 3857:
        return lam * A, np.arcsinh(phi_tan) * A
    lon0, fn = utm_parameters(dst)
    dl, tc = lam - math.radians(lon0), _np_conformal(phi_tan)
    p = np.arctan2(tc, np.cos(dl))
    q = np.arcsinh(np.sin(dl) / np.hypot(tc, np.cos(dl)))
    north, east = p.copy(), q.copy()
    for j, a in enumerate(ALPHA, 1):
        north = north + a * np.sin(2 * j * p) * np.cosh(2 * j * q)
        east = east + a * np.cos(2 * j * p) * np.sinh(2 * j * q)
    return FALSE_EASTING + K0 * RADIUS * east, fn + K0 * RADIUS * north


def cut_to_domain(extent, src: int, dst: int) -> list[tuple[float, float, float, float]]:
    """The parts of a rectangle of ``src`` that have coordinates in ``dst``; none where it lies beyond.

    Rectangles of 4326 and 3857 are cut at meridians and parallels, in up to three parts where the
    zone's width passes the end of the map. One of a UTM zone that leaves its domain or that of
    ``dst``, a pole included, cannot be cut to rectangles and raises.
    """
    x0, y0, x1, y1 = extent
    if src not in (4326, 3857):
        t = np.linspace(0.0, 1.0, 65)
        xs, ys = x0 + (x1 - x0) * t, y0 + (y1 - y0) * t
        edges = [np_project(xs, np.full(65, y), src, dst) for y in (y0, y1)]
        edges += [np_project(np.full(65, x), ys, src, dst) for x in (x0, x1)]
        if np.isnan(edges).any():
            raise ValueError(f"a layer in EPSG:{src} leaves the domain of EPSG:{src} or EPSG:{dst}")
        return [extent]
    lat = MERCATOR_LAT if 3857 in (src, dst) else 90.0
    spans = [(-math.inf, math.inf)]
    if dst not in (4326, 3857):
        middle = utm_parameters(dst)[0]
        spans = [(middle - ZONE_REACH + turn, middle + ZONE_REACH + turn) for turn in (-360.0, 0.0, 360.0)]
    if src == 3857:
        spans = [(math.radians(w) * A, math.radians(e) * A) for w, e in spans]
        lat = math.asinh(math.tan(math.radians(lat))) * A
    parts = [(max(x0, w), max(y0, -lat), min(x1, e), min(y1, lat)) for w, e in spans]
    return [p for p in parts if p[0] < p[2] and p[1] < p[3]]


def outline(extent, src: int, dst: int, error: float | None = None, pieces: int = 64):
    """Points of a rectangle's edges in ``dst``. Edges begin as ``pieces`` and with ``error`` are halved
    until the middle of each piece lies within that distance of the middle of its chord."""
    x0, y0, x1, y1 = extent
    t = np.linspace(0.0, 1.0, pieces + 1)
    xs, ys = x0 + (x1 - x0) * t, y0 + (y1 - y0) * t
    edges = [(xs, np.full_like(xs, y0)), (xs, np.full_like(xs, y1)), (np.full_like(ys, x0), ys), (np.full_like(ys, x1), ys)]
    found = [np.stack(np_project(*e, src, dst)) for e in edges]
    starts = np.concatenate([np.stack(e)[:, :-1] for e in edges], axis=1)
    ends = np.concatenate([np.stack(e)[:, 1:] for e in edges], axis=1)
    while error is not None and starts.size:
        middle = (starts + ends) / 2
        a, m, b = (np.stack(np_project(*p, src, dst)) for p in (starts, middle, ends))
        found.append(m)
        far = (np.abs(m - (a + b) / 2) > error).any(axis=0) & (middle != starts).any(axis=0) & (middle != ends).any(axis=0)
        starts, ends = (np.concatenate([p[:, far], q[:, far]], axis=1) for p, q in ((starts, middle), (middle, ends)))
    points = np.concatenate(found, axis=1)
    return points[0], points[1]
