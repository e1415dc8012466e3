import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.llm import topk


def brute(rows, k):
    out = []
    ok = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in ok if j != q and len(w) == len(v))[:k]
            out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force_over_blocks_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (520, [1.0, 2.0]), (521, [3.0, 1.0]), (540, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block_rows=90, chunk_rows=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(size=(3000, 3)) * 64)
    q = np.floor(rng.normal(size=(5, 3)) * 64)
    s, ids = topk.threshold_search(q, np.full(5, -1), rows, np.arange(3000), 4)
    exact = q @ rows.T
    for i in range(5):
        order = np.lexsort((np.arange(3000), -exact[i]))[:4]
        assert ids[i].tolist() == order.tolist() and s[i].tolist() == exact[i][order].tolist()


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (0, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_empty_vectors_and_components_of_any_size(spark):
    rows = [(0, []), (20, [2.0**27, 3.0, 2.0**26]), (1, [2.0**20, -1.0, 5.0]), (2, [2.0**20, -1.0, 5.015625]), (3, []), (4, [-(2.0**20), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()]
    q = [int(64 * x) for x in rows[1][1]]
    scores = sorted(((-sum(a * int(np.floor(64 * b)) for a, b in zip(q, v)), i) for i, v in rows if i in (1, 2, 4)))
    assert sorted(got) == [(20, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, F.col("vec_id") % 20 == 0).collect()


def test_a_floor_ends_the_search_and_loses_no_row_above_it():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.normal(size=(2000, 3)) * 64)
    q = np.floor(rng.normal(size=(4, 3)) * 64)
    exact = q @ rows.T
    floor = np.sort(exact, axis=1)[:, -2]  # between the second and the third row
    read = []
    s, ids = topk.threshold_search(q, np.full(4, -1), rows, np.arange(2000), 5, floor=floor)
    for i in range(4):
        order = np.lexsort((np.arange(2000), -exact[i]))[:2]
        assert ids[i][:2].tolist() == order.tolist() and s[i][:2].tolist() == exact[i][order].tolist()
        read.append(np.isfinite(s[i]).sum())
    assert read


def test_clashing_names_and_other_ids(spark):
    df = spark.createDataFrame([(20 * i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    for name in ("query", "floor", "block", "chunk", "d", "v", "score"):
        df = df.withColumn(name, F.lit("own"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 3, block_rows=7, chunk_rows=5).collect())
    assert got == brute([(20 * i, [float(i), 1.0]) for i in range(30)], 3)
    with pytest.raises(ValueError, match="whole numbers"):
        topk.top_k(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))
