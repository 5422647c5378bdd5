"""Space-filling curve keys over (col, row): Z-order, Hilbert and their hex text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastergrid.functions.scalars import pad_left

HILBERT = "hilbert"
ZORDER = "zorder"
MAX_BITS = 31


def _table(values: list[int]) -> Column:
    """A lookup array that is one short expression until the optimizer folds it to a constant."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') AS array<int>)")


def _byte(c: Column, place: int) -> Column:
    return F.shiftright(c, 8 * place).bitwiseAND(F.lit(255)).cast("int")


def _spread(value: int) -> int:
    """Bit i of a byte moved to bit 2i."""
    return sum((value >> i & 1) << 2 * i for i in range(8))


def _gathered(value: int) -> int:
    """The even bits of a byte as the low four bits of the result, the odd bits above them."""
    return sum((value >> i & 1) << (i // 2 + 4 * (i % 2)) for i in range(8))


def zorder_encode(col: Column, row: Column) -> Column:
    """Interleaved index: column bits at even places, row bits at odd places."""
    spread = _table([_spread(v) for v in range(256)])
    index = F.lit(0).cast("bigint")
    for place in range(4):
        pair = F.get(spread, _byte(col, place)).bitwiseOR(F.shiftleft(F.get(spread, _byte(row, place)), 1))
        index = index.bitwiseOR(F.shiftleft(pair.cast("bigint"), 16 * place))
    return index


def zorder_decode(index: Column) -> tuple[Column, Column]:
    gathered = _table([_gathered(v) for v in range(256)])
    col, row = F.lit(0), F.lit(0)
    for place in range(8):
        pair = F.get(gathered, _byte(index.cast("bigint"), place))
        col = col.bitwiseOR(F.shiftleft(pair.bitwiseAND(F.lit(15)), 4 * place))
        row = row.bitwiseOR(F.shiftleft(F.shiftright(pair, 4), 4 * place))
    return col, row


def _check_bits(x_bits: int, y_bits: int) -> int:
    if x_bits != y_bits:
        raise ValueError("the Hilbert curve here needs the same number of bits on both axes")
    if not 1 <= x_bits <= MAX_BITS:
        raise ValueError(f"bits per axis must be 1..{MAX_BITS}")
    return x_bits


# The Hilbert curve four levels at a time. The orientation inside a quadrant is two flags, axes
# swapped and both axes flipped; a table row holds what four levels of one orientation do, so an
# index is a chain of lookups that code generation keeps flat: a row refers to the one before once.
_LEVELS = 4
_CODES = 1 << (2 * _LEVELS)


def _walk(swapped: int, flipped: int, x: int, y: int) -> tuple[int, int]:
    """Distance digits of four levels and the orientation after them (swapped + 2 * flipped)."""
    digits = 0
    for level in reversed(range(_LEVELS)):
        bx, by = x >> level & 1, y >> level & 1
        rx, ry = (by if swapped else bx) ^ flipped, (bx if swapped else by) ^ flipped
        digits = digits << 2 | (3 * rx ^ ry)
        if ry == 0:
            swapped, flipped = swapped ^ 1, flipped ^ rx
    return digits, swapped | flipped << 1


def _tables() -> tuple[Column, Column]:
    """Forward rows ``digits * 4 + next`` by (state, x, y); backward rows ``(x, y) * 4 + next`` by
    (state, digits)."""
    forward, backward = [0] * (4 * _CODES), [0] * (4 * _CODES)
    for state in range(4):
        for place in range(_CODES):
            digits, after = _walk(state & 1, state >> 1, place >> _LEVELS, place & (1 << _LEVELS) - 1)
            forward[state * _CODES + place] = digits << 2 | after
            backward[state * _CODES + digits] = place << 2 | after
    return _table(forward), _table(backward)


def _groups(bits: int) -> tuple[int, int]:
    """Four-level groups for ``bits`` levels and the start state. Leading zero levels only swap
    the axes back and forth, so an odd number of them starts swapped."""
    n = -(-bits // _LEVELS)
    return n, (n * _LEVELS - bits) % 2


def _within(value: Column, inside: Column, what: str) -> Column:
    """``value`` where ``inside`` is not false; otherwise an error instead of a colliding key."""
    return F.when(~inside, F.raise_error(what).cast("bigint")).otherwise(value)


def hilbert_encode(col: Column, row: Column, bits: int) -> Column:
    """Distance along the Hilbert curve of order ``bits``; keys outside 0..2^bits - 1 raise."""
    n, start = _groups(_check_bits(bits, bits))
    table, _ = _tables()
    mask = (1 << _LEVELS) - 1
    index, state = None, F.lit(start)
    for g in reversed(range(n)):
        x = F.shiftright(col, g * _LEVELS).bitwiseAND(F.lit(mask))
        y = F.shiftright(row, g * _LEVELS).bitwiseAND(F.lit(mask))
        step = F.get(table, (state * _CODES + x * (mask + 1) + y).cast("int"))
        digits = F.shiftleft(F.shiftright(step, 2).cast("bigint"), 2 * _LEVELS * g)
        index = digits if index is None else index.bitwiseOR(digits)
        state = step.bitwiseAND(F.lit(3))
    inside = col.between(0, (1 << bits) - 1) & row.between(0, (1 << bits) - 1)
    return _within(index, inside, f"key outside the Hilbert curve of {bits} bits")


def hilbert_decode(index: Column, bits: int) -> tuple[Column, Column]:
    """(col, row) of a Hilbert distance; distances beyond the curve raise."""
    n, start = _groups(_check_bits(bits, bits))
    _, table = _tables()
    whole = index.cast("bigint")
    d = _within(whole, whole.between(0, (1 << 2 * bits) - 1), f"distance beyond the Hilbert curve of {bits} bits")
    mask = (1 << _LEVELS) - 1
    col, row, state = F.lit(0), F.lit(0), F.lit(start)
    for g in reversed(range(n)):
        digits = F.shiftright(d, 2 * _LEVELS * g).bitwiseAND(F.lit(_CODES - 1).cast("bigint"))
        step = F.get(table, (state * _CODES + digits).cast("int"))
        x = F.shiftright(step, 2 + _LEVELS)
        y = F.shiftright(step, 2).bitwiseAND(F.lit(mask))
        col = col.bitwiseOR(F.shiftleft(x, g * _LEVELS))
        row = row.bitwiseOR(F.shiftleft(y, g * _LEVELS))
        state = step.bitwiseAND(F.lit(3))
    return col, row


def sfc_index(label: str, col: Column, row: Column, x_bits: int, y_bits: int) -> Column:
    """Curve index by label; an unknown label is an error."""
    if label == HILBERT:
        return hilbert_encode(col, row, _check_bits(x_bits, y_bits))
    if label == ZORDER:
        return zorder_encode(col, row)
    raise ValueError(f"unknown curve label: {label!r}")


def sfc_invert(label: str, hex_text: Column, x_bits: int, y_bits: int) -> tuple[Column, Column]:
    """(col, row) of a hex index; an unknown label is an error."""
    index = hex_to_index(hex_text)
    if label == HILBERT:
        return hilbert_decode(index, _check_bits(x_bits, y_bits))
    if label == ZORDER:
        return zorder_decode(index)
    raise ValueError(f"unknown curve label: {label!r}")


def index_to_hex(index: Column, width: int = 0) -> Column:
    return pad_left(F.lower(F.hex(index)), width, "0")


def hex_to_index(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


# Key rectangles as curve intervals ----------------------------------------------

def key_index(label: str, col: int, row: int, bits: int) -> int:
    """Place of one key on a curve, as ``sfc_index`` gives it for columns."""
    if label == ZORDER:
        return sum(((col >> b & 1) << 2 * b) | ((row >> b & 1) << 2 * b + 1) for b in range(bits))
    if label != HILBERT:
        raise ValueError(f"unknown curve {label!r}")
    x, y, out, last = col, row, 0, (1 << bits) - 1
    for b in range(bits - 1, -1, -1):
        rx, ry = x >> b & 1, y >> b & 1
        out = out << 2 | (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = last - x, last - y
            x, y = y, x
    return out


def key_intervals(label: str, cmin: int, rmin: int, cmax: int, rmax: int, bits: int, most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` inclusive intervals of a curve that hold all keys of a rectangle.

    An aligned square of 2^n keys a side is one interval of either curve. Squares are halved until
    they lie inside or outside, level by level while there are few; then the smallest gaps between
    intervals are closed. So the intervals may hold keys outside the rectangle, and never miss one.
    """
    last = (1 << bits) - 1
    cmin, rmin, cmax, rmax = max(cmin, 0), max(rmin, 0), min(cmax, last), min(rmax, last)
    if cmin > cmax or rmin > rmax:
        return []
    inside, rim = [], [(0, 0, bits)]
    while rim and rim[0][2] > 0 and len(rim) <= 4 * most:
        halves, rim = [(2 * c + dc, 2 * r + dr, n - 1) for c, r, n in rim for dc in (0, 1) for dr in (0, 1)], []
        for c, r, n in halves:
            c0, r0, c1, r1 = c << n, r << n, (c + 1 << n) - 1, (r + 1 << n) - 1
            if c0 >= cmin and c1 <= cmax and r0 >= rmin and r1 <= rmax:
                inside.append((c, r, n))
            elif c0 <= cmax and c1 >= cmin and r0 <= rmax and r1 >= rmin:
                rim.append((c, r, n))
    starts = sorted((key_index(label, c << n, r << n, bits) >> 2 * n << 2 * n, 1 << 2 * n) for c, r, n in inside + rim)
    joined: list[list[int]] = []
    for start, size in starts:
        if joined and start == joined[-1][1] + 1:
            joined[-1][1] += size
        else:
            joined.append([start, start + size - 1])
    gaps = sorted(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1], reverse=True)
    cuts = [0, *sorted(gaps[:max(most, 1) - 1]), len(joined)]
    return [(joined[a][0], joined[b - 1][1]) for a, b in zip(cuts, cuts[1:])]
