import math
import struct

import numpy as np
import pytest

from rastergrid.llm import nearest, topk

import edge


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def table(seed=0, n=400, dim=7):
    rng = np.random.default_rng(seed)
    rows = [(i, [f32(x) for x in rng.normal(size=dim)]) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot) for i in range(150)]                       # a third of all rows are equal
    rows += [(2000, None), (2001, []), (2002, [0.0] * dim), (2003, [1.0, None] + [0.0] * (dim - 2)),
             (2004, [math.nan] * dim), (2100, [math.inf] + [0.0] * (dim - 1)), (None, rows[5][1]),
             (2200, [1.0, 2.0]), (2201, [1.0, 2.5]), (2202, [3.0, 1.0]), rows[7], rows[7]]
    return rows


def valid(v, zero=False):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def brute(rows, every, k, score, best_first, zero):
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and valid(v, zero)})
    out = []
    for q, a in own:
        if q % every == 0:
            found = [(score(a, b), i) for i, b in own if i != q and len(a) == len(b)]
            found.sort(key=lambda x: (-x[0] if best_first else x[0], x[1]))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def product(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))


@pytest.mark.parametrize("blocks", [{}, {"q_rows": 4, "c_rows": 50}])
def test_nearest_is_exact(spark, blocks):
    rows = table()
    got = nearest.nearest(edge.vectors(spark, rows), k=10, every=25, **blocks).collect()
    assert sorted(map(tuple, got)) == brute(rows, 25, 10, distance, False, False)


@pytest.mark.parametrize("options", [{}, {"q_rows": 4, "c_rows": 50}, {"segments": 3}, {"segments": 1}])
def test_top_scores_are_exact(spark, options):
    rows = table(1)
    got = topk.top_scores(edge.vectors(spark, rows), k=5, every=25, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, 25, 5, product, True, True)


def test_large_components(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, -2.0]), (2, [-1e6, 3.0]), (3, [5e5, 4.0]), (4, [1.0, 1.0])]
    rows = [(i, [f32(x) for x in v]) for i, v in rows]
    got = topk.top_scores(edge.vectors(spark, rows), k=5, every=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 5, product, True, True)
    got = nearest.nearest(edge.vectors(spark, rows), k=3, every=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 3, distance, False, False)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [2.0, 1.0])]):
        data = edge.vectors(spark, rows)
        assert sorted(map(tuple, nearest.nearest(data).collect())) == brute(rows, 100, 10, distance, False, False)
        assert sorted(map(tuple, topk.top_scores(data).collect())) == brute(rows, 50, 5, product, True, True)


def test_codes_stay_within_their_error_bounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 40)) * rng.gamma(1, size=(50, 1))
    scale = np.abs(x).max(axis=1) / 127
    q = np.clip(np.rint(x / scale[:, None]), -127, 127)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    for a in range(50):
        for b in range(50):
            true = np.linalg.norm(x[a] - x[b])
            about = np.linalg.norm(q[a] * scale[a] - q[b] * scale[b])
            assert abs(true - about) <= error[a] + error[b] + 1e-9
