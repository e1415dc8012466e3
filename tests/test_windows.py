"""Tiles, ranks and neighbours against Spark's own windows over one partition."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortmill.functions import windows
from cohortmill.operators import dq


def native(df, k, order, key):
    return {r[key]: r.t for r in df.select(key, F.ntile(k).over(Window.orderBy(*order, F.asc(key))).alias("t")).collect()}


@pytest.fixture()
def rows(spark):
    rng = random.Random(5)
    out = []
    for i in range(700):
        cents = rng.choice([None, 0, 0, 5, rng.randrange(-(10**6), 10**6), rng.randrange(10**11)])
        day = None if i % 9 == 0 else dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(4))
        out.append((f"{'é' if i % 50 == 0 else '9000'}{i * 7919 % 1000:05d}{'' if i % 3 else chr(0)}", i * 31 - 9000, None if cents is None else Decimal(cents) / 100, day, i % 2))
    return spark.createDataFrame(out, "key string, id long, spend decimal(15,2), day date, bit int").repartition(3)


@pytest.mark.parametrize("settle,bins", [(200, 1024), (3, 4)])
def test_tiles_equal_native_with_ties_nulls_and_both_directions(rows, monkeypatch, settle, bins):
    monkeypatch.setattr(windows, "SETTLE", settle)
    monkeypatch.setattr(windows, "BINS", bins)
    for key in ("key", "id"):
        asked = {"a": (10, F.col("spend"), False), "b": (7, F.col("spend"), True), "c": (5, F.col("day"), True), "d": (3, F.col("bit"), False), "e": (100, F.coalesce("spend", F.lit(0).cast("decimal(15,2)")), False)}
        got = windows.ntiles(rows, key, asked)
        assert "Window" not in got._jdf.queryExecution().toString() or key == ""
        found = got.collect()
        for name, (k, value, down) in asked.items():
            assert {r[key]: r[name] for r in found} == native(rows, k, [value.desc() if down else value.asc()], key), (key, name)


@pytest.mark.parametrize("n,k", [(0, 5), (1, 1), (3, 5), (10, 10), (103, 7)])
def test_tiles_of_few_rows(spark, n, k):
    df = spark.range(n).select("id", (F.col("id") * 7919 % 13).alias("x"))
    assert {r.id: r.t for r in windows.ntile(df, k, F.col("x"), "t", "id").collect()} == native(df, k, [F.asc("x")], "id")


def test_equal_keys_stay_together_and_other_types_raise(spark, monkeypatch):
    monkeypatch.setattr(windows, "SETTLE", 2)
    df = spark.range(40).select(F.lit("same").alias("key"), F.lit(1).alias("x"))
    assert {r.t for r in windows.ntile(df, 4, F.col("x"), "t", "key").collect()} == {1}
    with pytest.raises(ValueError):
        windows.ntile(df, 4, F.lit(0.5), "t", "key")


def test_global_rank(rows):
    got = windows.global_rank(rows, [F.desc("spend"), F.asc("id")], "rn", "n").collect()
    want = {r.id: r.w for r in rows.select("id", F.row_number().over(Window.orderBy(F.desc("spend"), F.asc("id"))).alias("w")).collect()}
    assert {r.id: r.rn for r in got} == want and {r.n for r in got} == {700}
    assert windows.global_rank(rows.where("false"), [F.asc("id")], "rn", "n").count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_neighbours_equal_native_at_borders_and_over_empty_ranges(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, None if i % 11 == 0 else i // 3, f"v{i}") for i in range(50)], "id long, x long, v string").repartition(3)
        order = [F.asc_nulls_last("x"), F.asc("id")]
        for back, f in ((False, F.lead), (True, F.lag)):
            want = {r.id: r.w for r in df.select("id", f("v").over(Window.orderBy(*order)).alias("w")).collect()}
            got = windows.neighbour(df, order, "v", "near", back, "end").collect()
            assert {r.id: r.near for r in got} == want
            assert sorted(r.id for r in got if r.end) == [i for i, w in want.items() if w is None]
        ties = spark.range(30).select(F.lit(1).alias("x"))
        assert sorted(str(r.near) for r in windows.neighbour(ties, [F.asc("x")], "x", "near").collect()) == ["1"] * 29 + ["None"]
        assert windows.neighbour(df.where("false"), order, "v", "near").count() == 0
        assert windows.neighbour(df.where("id = 1"), order, "v", "near", last="end").first()["end"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_data_tests_over_whole_tables_have_no_window_without_partitions(spark):
    r = spark.createDataFrame([(0, 5), (5, 9), (8, 12), (12, 12), (20, None), (None, 1)], "lo int, hi int")
    grouped = dq.mutually_exclusive_ranges(r.withColumn("k", F.lit(1)), "lo", "hi", "k")
    whole = dq.mutually_exclusive_ranges(r, "lo", "hi")
    assert sorted(str(x.lo) for x in whole.collect()) == sorted(str(x.lo) for x in grouped.collect())
    t = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "n int")
    steps = dq.sequential_values(t, "n")
    assert sorted(x.n for x in steps.collect()) == [5, 9]
    for df in (whole, steps):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
