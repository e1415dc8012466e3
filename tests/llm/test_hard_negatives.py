import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.llm import hard_negatives as hn


def whole(v, scale=256):
    return [int(np.floor(scale * x)) for x in v]


def brute(rows, k=3, positives=5, low=50, high=95):
    ok = [(i, whole(v), y) for i, v, y in rows if i is not None and v and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in {(i, tuple(v), y) for i, v, y in ok if i % 50 == 0}:
        met = sorted((-sum(p * q for p, q in zip(a[1], v)), i, y) for i, v, y in ok if i != a[0] and len(v) == len(a[1]))
        for ps, p, _ in [m for m in met if m[2] == a[2]][:positives]:
            inside = [(i, -s) for s, i, y in met if y != a[2] and -low * ps <= -100 * s <= -high * ps]
            out += [(a[0], p, r + 1, i, -ps, s) for r, (i, s) in enumerate(inside[:k])]
    return sorted(out)


def run(spark, rows, **size):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("anchor", "block", "w", "v", "d", "rank", "score"):
        df = df.withColumn(name, F.lit("clash"))
    got = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, **size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def some(n, dims, rng, labels=4):
    return [(i, [float(x) for x in np.round(rng.normal(size=dims), 2)], int(rng.integers(labels))) for i in range(n)]


def test_equals_brute_force_over_cells_passes_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = some(260, 6, rng)
    rows += [(1000 + i, [0.5, 0.25, 0.5, 0.0, 0.1, 0.3], i % 2) for i in range(120)]  # one vector, many rows: cuts fall among ids
    rows += [(500, None, 1), (501, [float("nan")] * 6, 1), (502, [None] * 6, 1), (503, [1.0] * 6, None), (None, [1.0] * 6, 1), (550, [], 2), (600, [1.0, 2.0], 0), (601, [2.0, 1.5], 0), (602, [1.0, 1.0], 1)]
    rows += [(700, [-1.0] * 6, 9), (701, [1.0] * 6, 9)]  # a positive below 0
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, rows, block_rows=70, chunk_rows=3, bins=4, gather=5) == want


def test_repeated_rows(spark):
    rows = [(50, [1.0, 0.0], 0)] * 3 + [(1, [0.75, 0.5], 0)] * 2 + [(2, [0.5, 0.5], 1)] * 4 + [(3, [0.5, 1.0], 1)]
    got = run(spark, rows, block_rows=2, bins=2, gather=1)
    assert got == brute(rows) == sorted([(50, 1, r, 2, 192 * 256, 128 * 256) for r in (1, 2, 3)] * 2)


def test_components_of_any_size_and_errors(spark):
    rows = [(0, [2.0**20, 3.0], 0), (1, [2.0**20, 5.0], 0), (2, [2.0**19 + 7, 9.0], 1), (3, [2.0**19 + 7, 9.015625], 1)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(OverflowError):
        run(spark, [(0, [1e30], 0), (1, [1e30], 0)])
    with pytest.raises(ValueError):
        hn.hard_negatives(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<double>, label int"), F.lit(True))


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0)]) == []
    assert run(spark, [(0, [1.0], 0)]) == []


def test_histogram_stops_at_the_digit_of_the_kth_row_and_spans_64_bits():
    v = np.array([10, 9, 9, 3, 2, 1], np.int64)
    ids = np.array([2**63 - 1, 5, 7, -(2**63), 8, 9], np.int64)
    inside = np.ones(6, bool)
    got = hn.histogram(v, inside, ids, 1, 10, 0, 0, 2, 5)
    assert got == [(9, 10, 0, 0, 3)]
    assert sum(x[4] for x in hn.histogram(v, inside, ids, 1, 10, 0, 0, 6, 5)) == 6
    by_id = hn.histogram(v, inside, ids, 4, 4, -(2**63), 2**63 - 1, 6, 2)
    assert [x[2:] for x in by_id] == [(-(2**63), -1, 1), (0, 2**63 - 1, 5)]
    wide = hn.histogram(np.array([2**62, -(2**62)], np.int64), inside[:2], ids[:2], -(2**62), 2**62, 0, 0, 2, 256)
    assert [x[4] for x in wide] == [1, 1] and wide[0][1] == 2**62


def test_percent_rounds_both_ways(spark):
    rows = [(x,) for x in (-201, -100, -1, 0, 1, 99, 100, 101, 12345678901234567)]
    got = spark.createDataFrame(rows, "s long").select("s", hn._percent("s", 95, False).alias("down"), hn._percent("s", 50, True).alias("up")).collect()
    assert all(r.down == 95 * r.s // 100 and r.up == -(-50 * r.s // 100) for r in got)
