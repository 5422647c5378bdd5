"""numpy kernels on Arrow batches: the per-tile pixel work inside tasks.

Cells travel as ``array<double>`` with NULL for NoData; in numpy NoData is NaN. A kernel sees one
window or tile at a time and keeps at most one tile under construction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from rastergrid.functions.projection import A, cut_to_domain, np_project

PIECE_SCHEMA = ("col int, row int, band int, ord bigint, pc int, pr int, pw int, ph int, "
                "total array<double>, weight array<double>")
TILE_SCHEMA = "col int, row int, band int, cells array<double>"

_BATCH_BYTES = 16 << 20
_PIECE_BYTES = 4 << 20


def bounded(batches):
    """The batches in pieces of about ``_PIECE_BYTES``: rows are as wide as the tiles and the lists they
    hold, and what a kernel makes of a piece takes several times its size."""
    for batch in batches:
        n = -(-batch.nbytes // _PIECE_BYTES)
        step = max(1, batch.num_rows // max(1, n))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows_of(batches, scalars: list[str], lists: list[str]):
    """Rows of Arrow batches: python scalars by name, then one float array per list column."""
    for batch in bounded(batches):
        plain = [batch.column(c).to_pylist() for c in scalars]
        flat, ends = [], []
        for c in lists:
            column = batch.column(c)
            flat.append(column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False))
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends.append(np.concatenate([[0], np.cumsum(lengths)]))
        for i in range(batch.num_rows):
            yield ([col[i] for col in plain],
                   [v[e[i]:e[i + 1]] for v, e in zip(flat, ends)])


class BatchWriter:
    """Collects rows and yields record batches of bounded size. What a row holds is its own: a view is
    copied, since it would keep the whole array behind it, which may then be used again."""

    def __init__(self, fields: list[tuple[str, pa.DataType]]):
        self.fields, self.rows, self.size = fields, [], 0

    def add(self, *row):
        row = [v.copy() if isinstance(v, np.ndarray) and v.base is not None else v for v in row]
        self.rows.append(row)
        self.size += sum(v.nbytes if isinstance(v, np.ndarray) else 8 for v in row)
        return self.drain() if self.size >= _BATCH_BYTES else []

    def drain(self):
        if not self.rows:
            return []
        columns = []
        for (_, kind), values in zip(self.fields, zip(*self.rows)):
            if pa.types.is_list(kind):
                offsets = np.concatenate([[0], np.cumsum([v.size for v in values])])
                flat = np.concatenate([v.ravel() for v in values])
                columns.append(pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat))))
            else:
                columns.append(pa.array(values, kind))
        self.rows, self.size = [], 0
        return [pa.RecordBatch.from_arrays(columns, [n for n, _ in self.fields])]


_I32, _I64, _LIST = pa.int32(), pa.int64(), pa.list_(pa.float64())
_PIECE_FIELDS = [("col", _I32), ("row", _I32), ("band", _I32), ("ord", _I64), ("pc", _I32),
                 ("pr", _I32), ("pw", _I32), ("ph", _I32), ("total", _LIST), ("weight", _LIST)]
_TILE_FIELDS = [("col", _I32), ("row", _I32), ("band", _I32), ("cells", _LIST)]


def bilinear_parts(window, c0, r0, n_cols, n_rows, fx, fy, snap):
    """Weighted sums and weights that a raster window gives to fractional cell positions.

    ``fx, fy`` count cell centres from the raster's north-west cell. Positions are rounded to
    1/snap of a cell and clamped at the raster edge; neighbours outside the window or NoData add
    nothing, so parts from several windows of one raster simply add up.
    """
    fx = np.clip(np.floor(fx * snap + 0.5) / snap, 0, n_cols - 1)
    fy = np.clip(np.floor(fy * snap + 0.5) / snap, 0, n_rows - 1)
    left, top = np.floor(fx), np.floor(fy)
    wx, wy = fx - left, fy - top
    # A rim of nothing around the window catches neighbours that lie outside it.
    h, w = window.shape
    valid = np.zeros((h + 2, w + 2))
    valid[1:-1, 1:-1] = ~np.isnan(window)
    values = np.zeros((h + 2, w + 2))
    values[1:-1, 1:-1] = np.where(np.isnan(window), 0.0, window)
    cols = [np.clip(left + d - c0, -1, w).astype(np.int64) + 1 for d in (0, 1)]
    rows = [np.clip(top + d - r0, -1, h).astype(np.int64) + 1 for d in (0, 1)]
    total = weight = 0.0
    for dy, row_part in ((0, 1 - wy), (1, wy)):
        for dx, col_part in ((0, 1 - wx), (1, wx)):
            part = row_part * col_part
            total = total + part * values[rows[dy], cols[dx]]
            weight = weight + part * valid[rows[dy], cols[dx]]
    return total, weight


def _densified_box(xmin, ymin, xmax, ymax, src, dst, n=16):
    """Bounding box of a projected rectangle from sampled edges, widened by the bend they show."""
    t = np.linspace(0.0, 1.0, n + 1)
    xs = xmin + (xmax - xmin) * t
    ys = ymin + (ymax - ymin) * t
    x, y = np_project(
        np.stack([xs, xs, np.full_like(xs, xmin), np.full_like(xs, xmax)]),
        np.stack([np.full_like(ys, ymin), np.full_like(ys, ymax), ys, ys]), src, dst)
    bend = max(np.abs(np.diff(x, 2)).max(), np.abs(np.diff(y, 2)).max())
    return x.min() - bend, y.min() - bend, x.max() + bend, y.max() + bend


def scatter_windows(target, snap, src=0, dst=0):
    """Kernel: raster windows -> pieces of target tiles, resampled bilinearly.

    With ``src``/``dst`` EPSG codes that differ, target cell centres are mapped back through the
    projection. Each window is read once, whatever number of tiles it meets.
    """
    names = ["ord", "xmin", "ymin", "xmax", "ymax", "n_cols", "n_rows", "band", "c0", "r0", "w", "h"]
    tc, tr, cw, ch = target.tile_cols, target.tile_rows, target.cell_w, target.cell_h
    turns = {4326: 360.0, 3857: 2 * math.pi * A}

    def run(batches):
        out = BatchWriter(_PIECE_FIELDS)
        for head, (cells,) in rows_of(batches, names, ["cells"]):
            order, xmin, ymin, xmax, ymax, n_cols, n_rows, band, c0, r0, w, h = head
            sw, sh = (xmax - xmin) / n_cols, (ymax - ymin) / n_rows
            # The window's reach: half a cell beyond its own cells, inside the raster.
            wx0, wx1 = max(xmin, xmin + (c0 - 0.5) * sw), min(xmax, xmin + (c0 + w + 0.5) * sw)
            wy1, wy0 = min(ymax, ymax - (r0 - 0.5) * sh), max(ymin, ymax - (r0 + h + 0.5) * sh)
            if src != dst:
                parts = cut_to_domain((wx0, wy0, wx1, wy1), src, dst)
                if not parts:
                    continue
                lows_highs = np.array([_densified_box(*part, src, dst) for part in parts])
                (wx0, wy0), (wx1, wy1) = lows_highs[:, :2].min(axis=0), lows_highs[:, 2:].max(axis=0)
            # Target cells by centre; cells whose centre lies at the east/south edge are out.
            g0 = math.ceil((wx0 - target.xmin) / cw - 0.5)
            g1 = math.ceil((wx1 - target.xmin) / cw - 0.5) - 1
            q0 = math.ceil((target.ymax - wy1) / ch - 0.5)
            q1 = math.ceil((target.ymax - wy0) / ch - 0.5) - 1
            window = cells.reshape(h, w)
            x = target.xmin + (np.arange(g0, g1 + 1) + 0.5)[None, :] * cw
            for row in range(q0 // tr, q1 // tr + 1):
                # One strip of tiles at a time: all columns at once, then cut into tiles.
                b0, b1 = max(q0, row * tr), min(q1, row * tr + tr - 1)
                sx, sy = x, target.ymax - (np.arange(b0, b1 + 1) + 0.5)[:, None] * ch
                if src != dst:
                    sx, sy = np_project(*np.broadcast_arrays(sx, sy), dst, src)
                    if src in turns:                # the same meridian by another number
                        sx = np.where((sx < xmin) | (sx >= xmin + turns[src]), xmin + (sx - xmin) % turns[src], sx)
                inside = (sx >= xmin) & (sx < xmax) & (sy > ymin) & (sy <= ymax)
                sx, sy = np.where(inside, sx, xmin), np.where(inside, sy, ymax)      # also what has no position
                total, weight = bilinear_parts(
                    window, c0, r0, n_cols, n_rows,
                    (sx - xmin) / sw - 0.5, (ymax - sy) / sh - 0.5, snap)
                total, weight = np.where(inside, total, 0.0), np.where(inside, weight, 0.0)
                for col in range(g0 // tc, g1 // tc + 1):
                    a0, a1 = max(g0, col * tc), min(g1, col * tc + tc - 1)
                    cut = np.s_[:, a0 - g0:a1 - g0 + 1]
                    if not inside[cut].any():
                        continue
                    # Keep only the used part; an all-NoData piece still announces its tile.
                    t, wt = total[cut], weight[cut]
                    rr, cc = np.nonzero(wt.any(axis=1))[0], np.nonzero(wt.any(axis=0))[0]
                    if rr.size:
                        used = np.s_[rr[0]:rr[-1] + 1, cc[0]:cc[-1] + 1]
                        t, wt = t[used], wt[used]
                        pc, pr = a0 - col * tc + int(cc[0]), b0 - row * tr + int(rr[0])
                    else:
                        t = wt = np.zeros((0, 0))
                        pc = pr = 0
                    yield from out.add(col, row, band, order, pc, pr, t.shape[1], t.shape[0], t, wt)
        yield from out.drain()

    return run


def merge_sorted_pieces(tile_cols, tile_rows, fan_in=0):
    """Kernel: pieces sorted by key and ``ord`` -> tiles, first non-NoData value wins.

    Pieces of equal ``ord`` are parts of one raster and add up before they count. With ``fan_in``
    the input is also split by ``ord div fan_in`` and the result is pieces again, one per split,
    ready for the next merge. Memory is one tile whatever the length of a group.
    """

    def run(batches):
        out = BatchWriter(_PIECE_FIELDS if fan_in else _TILE_FIELDS)
        shape = (tile_rows, tile_cols)
        group = order = acc = total = weight = None

        def close_order():
            done = weight > 0
            fill = done & np.isnan(acc)
            acc[fill] = total[fill] / weight[fill]
            total[:], weight[:] = 0.0, 0.0

        def close_group():
            close_order()
            if fan_in:
                seen = ~np.isnan(acc)
                return out.add(*group[:3], group[3], 0, 0, tile_cols, tile_rows,
                               np.where(seen, acc, 0.0), seen.astype(float))
            return out.add(*group[:3], acc)

        names = ["col", "row", "band", "ord", "pc", "pr", "pw", "ph"]
        for head, (t, wt) in rows_of(batches, names, ["total", "weight"]):
            col, row, band, o, pc, pr, pw, ph = head
            key = (col, row, band, o // fan_in if fan_in else 0)
            if key != group:
                if group is not None:
                    yield from close_group()
                group, order = key, o
                acc = np.full(shape, np.nan)
                total, weight = np.zeros(shape), np.zeros(shape)
            elif o != order:
                close_order()
                order = o
            if pw:
                total[pr:pr + ph, pc:pc + pw] += t.reshape(ph, pw)
                weight[pr:pr + ph, pc:pc + pw] += wt.reshape(ph, pw)
        if group is not None:
            yield from close_group()
        yield from out.drain()

    return run


def centres_inside(ring_edges, x, y):
    """Even-odd mask of a grid of points; ``ring_edges`` is rows of x1, y1, x2, y2.

    Each crossing of an edge and a row of points turns all points west of it: crossings are counted
    at the first point they leave alone, and summed up from the east.
    """
    x1, y1, x2, y2 = ring_edges.T[:, :, None]
    edge, row = np.nonzero((y1 > y) != (y2 > y))
    x1, y1, x2, y2 = ring_edges[edge].T
    at = np.searchsorted(x, (x2 - x1) * (y[row] - y1) / (y2 - y1) + x1)
    turns = np.bincount(row * (x.size + 1) + at, minlength=y.size * (x.size + 1)).reshape(y.size, -1)
    return np.cumsum(turns[:, :0:-1], axis=1)[:, ::-1] % 2 == 1


MASK_SCHEMA = ("fid bigint, col int, row int, band int, c0 int, r0 int, w int, h int, "
               "cells array<double>")
_WINDOW = ("c0", "r0", "w", "h")


def mask_tiles(layout):
    """Kernel: tiles, each with a list of polygons (fid, whole, edges) -> for each polygon the window of
    the tile around the cell centres inside; polygons with no centre inside a tile are dropped."""
    fields = [("fid", _I64), ("col", _I32), ("row", _I32), ("band", _I32),
              *((n, _I32) for n in _WINDOW), ("cells", _LIST)]

    def run(batches):
        out = BatchWriter(fields)
        for batch in bounded(batches):
            lists = batch.column("polygons")
            inner = lists.flatten()
            n_edges = inner.field("edges").value_lengths().to_numpy(zero_copy_only=False)
            ends = 4 * np.append(0, np.cumsum(n_edges))
            own = inner.field("edges").flatten()
            flat = np.stack([own.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], axis=1).ravel()
            fids, wholes = (inner.field(c).to_pylist() for c in ("fid", "whole"))
            last = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            tiles = rows_of([batch], ["col", "row", "band"], ["cells"])
            for first, end, ((col, row, band), (cells,)) in zip([0, *last], last, tiles):
                x = layout.xmin + (col * layout.tile_cols + np.arange(layout.tile_cols) + 0.5) * layout.cell_w
                y = layout.ymax - (row * layout.tile_rows + np.arange(layout.tile_rows) + 0.5) * layout.cell_h
                for i in range(first, end):
                    if wholes[i]:
                        yield from out.add(fids[i], col, row, band, 0, 0, layout.tile_cols, layout.tile_rows, cells)
                        continue
                    inside = centres_inside(flat[ends[i]:ends[i + 1]].reshape(-1, 4), x, y)
                    if inside.any():
                        rows, cols = (np.flatnonzero(inside.any(axis=a)) for a in (1, 0))
                        window = np.s_[rows[0]:rows[-1] + 1, cols[0]:cols[-1] + 1]
                        kept = np.where(inside[window], cells.reshape(inside.shape)[window], np.nan)
                        yield from out.add(fids[i], col, row, band, cols[0], rows[0], kept.shape[1], kept.shape[0], kept)
        yield from out.drain()

    return run


def signed_area(pts):
    """Shoelace area of an open ring, positive if it runs counter-clockwise."""
    x, y = pts.T - pts[0][:, None]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def _linked(leaves, enters):
    """Which entry each exit goes on to along a cutting line: next to each other in its direction. At
    one place an exit and an entry are taken in turns, so what only touches the line stays apart. None
    if exits and entries do not alternate: then rings cross themselves or each other."""
    events = sorted([(v, i, True) for i, v in enumerate(leaves)] + [(v, i, False) for i, v in enumerate(enters)])
    follows, opened, k = {}, None, 0
    while k < len(events):
        same = [e for e in events[k:] if e[0] == events[k][0]] if k + 1 < len(events) and events[k + 1][0] == events[k][0] else [events[k]]
        k += len(same)
        while same:
            at = next((j for j, e in enumerate(same) if e[2] == (opened is None)), None)
            if at is None:
                return None
            _, i, leaving = same.pop(at)
            if leaving:
                opened = i
            else:
                follows[opened], opened = i, None
    return follows


def _paired(paths, along):
    """Rings from paths that do not alternate: by the even-odd rule the line is inside between the first
    and the second end on it, the third and the fourth, and so on. All count as outer rings."""
    ends = sorted((float(p[k, along]), i, k) for i, p in enumerate(paths) for k in (0, -1))
    other = {}
    for (_, i, a), (_, j, b) in zip(ends[::2], ends[1::2]):
        other[i, a], other[j, b] = (j, b), (i, a)
    rings, left = [], set(range(len(paths)))
    while left:
        i, a, parts = min(left), 0, []
        while i in left:
            left.remove(i)
            parts.append(paths[i] if a == 0 else paths[i][::-1])
            i, a = other[i, -1 if a == 0 else 0]
        ring = np.concatenate(parts)
        ring = ring[np.any(ring != np.roll(ring, 1, axis=0), axis=1)]
        area = signed_area(ring) if len(ring) > 2 else 0.0
        if area:
            rings.append(ring if area > 0 else ring[::-1])
    return rings


def cut_half(rings, axis, at, sign):
    """Rings of one polygon (open, outer ones counter-clockwise, holes clockwise) cut to the half-plane
    ``sign * (coordinate - at) > 0``.

    The paths inside are linked along the line: each exit goes on to the next entry in the direction
    that keeps the inside on the left. Every piece closes on its own, and a hole that the line cuts
    becomes part of an outer ring.
    """
    kept, paths = [], []
    for pts in rings:
        d = sign * (pts[:, axis] - at)
        within = d > 0
        if within.all():
            kept.append(pts)
            continue
        after = np.roll(within, -1)
        enter, leave = np.flatnonzero(~within & after), np.flatnonzero(within & ~after)
        n = len(pts)

        def crossing(i, n=n, pts=pts, d=d):
            j = (i + 1) % n
            a, b = pts[i], pts[j]
            if d[i] == 0 or d[j] == 0:
                return a if d[i] == 0 else b
            point = a + (b - a) * ((at - a[axis]) / (b[axis] - a[axis]))
            point[axis] = at
            return point

        for e in enter:
            k = np.searchsorted(leave, e)
            out = leave[k % len(leave)]
            middle = pts[e + 1:out + 1] if out > e else np.concatenate([pts[e + 1:], pts[:out + 1]])
            paths.append(np.concatenate([[crossing(e)], middle, [crossing(out)]]))
    along = 1 - axis
    way = -sign if axis == 0 else sign
    follows = _linked([way * p[-1, along] for p in paths], [way * p[0, along] for p in paths])
    if follows is None:
        return kept + _paired(paths, along)
    while follows:
        first, i = follows.popitem()
        parts = [paths[first]]
        while i != first:
            parts.append(paths[i])
            i = follows.pop(i)
        ring = np.concatenate(parts)
        ring = ring[np.any(ring != np.roll(ring, 1, axis=0), axis=1)]
        if len(ring) > 2 and signed_area(ring) != 0:
            kept.append(ring)
    return kept


def cut_rect(polygons, axis, low, high):
    """Polygons (lists of rings) between two parallel lines."""
    out = []
    for rings in polygons:
        rings = cut_half(cut_half(rings, axis, low, 1), axis, high, -1)
        if rings:
            out.append(rings)
    return out


def _inside(point, ring):
    edges = np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)
    return bool(centres_inside(edges, point[:1], point[1:])[0, 0])


def parts_of(polygons):
    """(part, ring, closed points) of polygons: every outer ring is a part, with the holes that lie in it;
    in the order of their least points, where each ring starts."""
    out = []
    for rings in polygons:
        turned = [np.roll(r, -np.lexsort((r[:, 1], r[:, 0]))[0], axis=0) for r in rings]
        outer = [r for r in turned if signed_area(r) >= 0]
        holes = {i: [] for i in range(len(outer))}
        for ring in turned:
            if signed_area(ring) < 0:
                held = [sum(_inside(p, o) for p in ring) for o in outer]
                if outer:
                    holes[int(np.argmax(held))].append(ring)
        out += [(o, holes[i]) for i, o in enumerate(outer)]
    out.sort(key=lambda part: part[0][0].tolist())
    return [(part, n, np.concatenate([r, r[:1]])) for part, (o, own) in enumerate(out)
            for n, r in enumerate([o, *sorted(own, key=lambda r: r[0].tolist())])]


def _polygons(rings):
    """Open, oriented rings of each part of a feature."""
    parts = {}
    for r in rings:
        pts = np.array([(p["x"], p["y"]) for p in r["pts"]], float).reshape(-1, 2)[:-1]
        pts = pts[np.any(pts != np.roll(pts, 1, axis=0), axis=1)] if len(pts) else pts
        if len(pts) > 2:
            area = signed_area(pts)
            parts.setdefault(r["part"], []).append(pts if area * (1 if r["ring"] == 0 else -1) >= 0 else pts[::-1])
    return list(parts.values())


def clip_blocks(layout, columns):
    """Kernel: rows with ``rings``, a key range and a ``level`` -> one row for each block of that level, with
    the rings cut to the keys of the range in the block, and ``solid`` where these are all of it."""
    kept = [c for c in columns if c not in ("rings", "cmin", "rmin", "cmax", "rmax")]
    w, h = layout.tile_w, layout.tile_h

    def spans(low, high, level):
        for b in range(low >> level, (high >> level) + 1):
            yield max(low, b << level), min(high, ((b + 1) << level) - 1)

    def cut_row(polygons, cmin, rmin, cmax, rmax, level):
        for c0, c1 in spans(cmin, cmax, level):
            x0, x1 = layout.xmin + c0 * w, layout.xmin + (c1 + 1) * w
            strip = cut_rect(polygons, 0, x0, x1)
            for r0, r1 in spans(rmin, rmax, level) if strip else ():
                y0, y1 = layout.ymax - (r1 + 1) * h, layout.ymax - r0 * h
                cut = cut_rect(strip, 1, y0, y1)
                if cut:
                    box = {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}
                    solid = len(cut) == len(cut[0]) == 1 and len(cut[0][0]) == 4 and set(map(tuple, cut[0][0].tolist())) == box
                    yield (c0, r0, c1, r1), solid, [] if solid else parts_of(cut)

    def flush(batch, found):
        source, ranges, solid, rings = zip(*found)
        sizes = np.cumsum([0, *(len(r) for r in rings)])
        paths = [p for own in rings for p in own]
        points = np.concatenate([p for _, _, p in paths]) if paths else np.zeros((0, 2))
        ends = np.cumsum([0, *(len(p) for _, _, p in paths)])
        pts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())], ["x", "y"]))
        ringed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(
            [pa.array([p for p, _, _ in paths], _I32), pa.array([n for _, n, _ in paths], _I32), pts], ["part", "ring", "pts"]))
        new = {c: pa.array(v, _I32) for c, v in zip(("cmin", "rmin", "cmax", "rmax"), zip(*ranges))}
        new |= {"rings": ringed, **{c: batch.column(c).take(pa.array(source, _I32)) for c in kept}}
        return pa.RecordBatch.from_arrays([*(new[c] for c in columns), pa.array(solid)], names=[*columns, "solid"])

    def run(batches):
        for batch in batches:
            ranges = zip(*(batch.column(c).to_pylist() for c in ("cmin", "rmin", "cmax", "rmax", "level")))
            found, size = [], 0
            for i, own in enumerate(ranges):
                for block in cut_row(_polygons(batch.column("rings")[i].as_py()), *own):
                    found.append((i, *block))
                    size += 16 * sum(len(p) for _, _, p in block[2])
                    if size > _BATCH_BYTES or len(found) > 10_000:
                        yield flush(batch, found)
                        found, size = [], 0
            if found:
                yield flush(batch, found)

    return run


MOSAIC_SCHEMA = ("fid bigint, band int, block_col int, block_row int, gc0 bigint, gr0 bigint, "
                 "n_cols int, n_rows int, cells array<double>")


def stitch_sorted_tiles(tile_cols, tile_rows, block):
    """Kernel: windows sorted by mosaic block -> one raster per block, cropped to its windows.

    A block has at most ``block`` x ``block`` tiles, and only the raster being filled is held: one array
    that is cleared after each block where it was written.
    ``gc0, gr0`` is its corner in cells from the grid's corner.
    """
    fields = [("fid", _I64), ("band", _I32), ("block_col", _I32), ("block_row", _I32),
              ("gc0", _I64), ("gr0", _I64), ("n_cols", _I32), ("n_rows", _I32), ("cells", _LIST)]
    names = ["fid", "band", "block_col", "block_row", "col", "row", *_WINDOW]
    wide, high = block * tile_cols, block * tile_rows

    def run(batches):
        out = BatchWriter(fields)
        group = box = None
        raster = np.full((high, wide), np.nan)

        def done():
            c0, r0, c1, r1 = box
            part = raster[r0:r1, c0:c1]
            ready = out.add(*group, group[2] * wide + c0, group[3] * high + r0, c1 - c0, r1 - r0, part)
            part[:] = np.nan
            return ready

        for head, (cells,) in rows_of(batches, names, ["cells"]):
            key, (col, row, c0, r0, w, h) = head[:4], head[4:]
            if key != group:
                if group is not None:
                    yield from done()
                group, box = key, (wide, high, 0, 0)
            c, r = (col - key[2] * block) * tile_cols + c0, (row - key[3] * block) * tile_rows + r0
            raster[r:r + h, c:c + w] = cells.reshape(h, w)
            box = (min(box[0], c), min(box[1], r), max(box[2], c + w), max(box[3], r + h))
        if group is not None:
            yield from done()
        yield from out.drain()

    return run
