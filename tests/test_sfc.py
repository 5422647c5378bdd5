import pytest
from pyspark.sql import functions as F

from rastergrid.plans import fixtures as X
from rastergrid.functions import sfc
from rastergrid.session import materialize


def _grid(spark, bits):
    n = 1 << bits
    return spark.range(n * n).select((F.col("id") % n).cast("int").alias("col"),
                                     F.expr(f"cast(id div {n} as int)").alias("row"))


def _textbook(bits, x, y):
    d, s = 0, 1 << (bits - 1)
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx == 1:
                x, y = (1 << bits) - 1 - x, (1 << bits) - 1 - y
            x, y = y, x
        s >>= 1
    return d


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 7])
def test_hilbert_is_a_unit_step_bijection(spark, bits):
    rows = _grid(spark, bits).select(
        "col", "row", sfc.hilbert_encode(F.col("col"), F.col("row"), bits).alias("d")).collect()
    at = {r.d: (r.col, r.row) for r in rows}
    assert sorted(at) == list(range(4 ** bits))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1
               for i in range(4 ** bits - 1))
    assert all(r.d == _textbook(bits, r.col, r.row) for r in rows)


@pytest.mark.parametrize("label", [sfc.HILBERT, sfc.ZORDER])
@pytest.mark.parametrize("bits", [5, 16, 31])
def test_round_trip_through_hex(spark, label, bits):
    top = (1 << bits) - 1
    keys = spark.range(500).select(
        F.expr(f"cast((id * 2654435761) % {top + 1} as int)").alias("col"),
        F.expr(f"cast((id * 40503 + 17) % {top + 1} as int)").alias("row"))
    edge = spark.createDataFrame([(0, 0), (top, 0), (0, top), (top, top)], "col int, row int")
    hexed = materialize(keys.unionAll(edge).select("col", "row", sfc.index_to_hex(
        sfc.sfc_index(label, F.col("col"), F.col("row"), bits, bits)).alias("hex")))
    col, row = sfc.sfc_invert(label, F.col("hex"), bits, bits)
    assert hexed.where((col != F.col("col")) | (row != F.col("row"))).count() == 0


def test_hilbert_31_bits_matches_textbook(spark):
    pts = [(2**31 - 1, 12345), (987654321, 1234567890), (1, 2**30)]
    df = spark.createDataFrame(pts, "col int, row int").select(
        "col", "row", sfc.hilbert_encode(F.col("col"), F.col("row"), 31).alias("d"))
    assert all(r.d == _textbook(31, r.col, r.row) for r in df.collect())


def test_bad_arguments():
    with pytest.raises(ValueError):
        sfc.sfc_index("peano", None, None, 4, 4)
    with pytest.raises(ValueError):
        sfc._check_bits(4, 5)
    with pytest.raises(ValueError):
        sfc._check_bits(32, 32)


def test_key_tasks_follow_the_rows(spark, sf, monkeypatch):
    """The number of tasks that tell keys apart grows with the table, and the keys stay the same."""
    lines = X.table(spark, sf, "lineitem")
    want = {(r.l_partkey, r.l_suppkey) for r in lines.select("l_partkey", "l_suppkey").collect()}
    monkeypatch.setattr(X, "KEYS_PER_TASK", 100)
    keys = X.curve_keys(spark, sf)
    assert keys.rdd.getNumPartitions() == -(-lines.count() // 100)
    got = [(r["col"], r["row"]) for r in keys.collect()]
    assert len(got) == len(set(got)) and set(got) == want
