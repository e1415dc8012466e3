"""Shared values as classes: linear output, exact pairs on demand."""

import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import identity, links


def rows(spark, n=300):
    data = [(f"v{i % 40}" if i % 10 else "placeholder", f"id{i:04d}") for i in range(n)] + [(None, "x"), (None, "y"), ("alone", "z"), ("v1", "id0001"), ("v1", "id0001")]
    return data, spark.createDataFrame(data, "value string, id string").repartition(3)


def test_classes_members_and_pairs_equal_plain_python(spark):
    data, df = rows(spark)
    of = defaultdict(set)
    for v, i in data:
        if v is not None:
            of[v].add(i)
    of = {v: ids for v, ids in of.items() if len(ids) > 1}
    assert {(r.value, r.members, r["first"].id) for r in links.classes(df, ["value"], ["id"]).collect()} == {(v, len(ids), min(ids)) for v, ids in of.items()}
    members = links.memberships(df, ["value"], ["id"])
    assert sorted((r.value, r.id, r.members) for r in members.collect()) == sorted((v, i, len(ids)) for v, ids in of.items() for i in ids)
    want = sorted((v, a, b) for v, ids in of.items() for a, b in itertools.combinations(sorted(ids), 2))
    for block in (3, 7, 1000):
        assert sorted((r.value, r.id_1, r.id_2) for r in links.pairs(members, ["value"], ["id"], "id", block).collect()) == want
    lists = links.listed(members, ["value"], "id", 8).collect()
    assert {v: sorted(x for r in lists if r.value == v for x in r.ids) for v in of} == {v: sorted(ids) for v, ids in of.items()}
    assert all(r.ids == sorted(r.ids) for r in lists) and {r.block for r in lists if r.members <= 8} <= {0}


def test_output_is_linear_where_a_value_is_shared_by_a_tenth(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "hot").otherwise(F.col("id").cast("string")).alias("value"), F.col("id").cast("string").alias("id"))
    members = links.memberships(df, ["value"], ["id"])
    assert links.classes(df, ["value"], ["id"]).count() == 1 and members.count() == 2000
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spread = links.memberships(df, ["value"], ["id"]).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in spread) < 1000  # its pieces lie in several tasks
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_pairs_of_different_tenants_only(spark):
    c = spark.createDataFrame(
        [("a", "1", "X@y.com ", "+91 9000000001", True), ("b", "2", "x@y.com", "123", True), ("b", "3", "x@Y.com", "9000000001", True), ("a", "4", "x@y.com", None, False), ("a", "5", " ", "9000000002", True), ("c", "6", None, "9000000002", True)],
        "brand string, customer_id string, email string, phone string, opt_in boolean",
    )
    got = sorted((r.brand_a, r.customer_a, r.brand_b, r.customer_b, r.method, r.confidence) for r in identity.cross_brand_links(c).collect())
    assert got == [("a", "1", "b", "2", "email_hash", 1.0), ("a", "1", "b", "3", "email_hash", 1.0), ("a", "1", "b", "3", "phone", 0.95), ("a", "5", "c", "6", "phone", 0.95)]
    assert sorted((r.method, r.customers, r.brands) for r in identity.cross_brand_classes(c).collect()) == [("email_hash", 3, 2), ("phone", 2, 2), ("phone", 2, 2)]


def test_elected_primary_of_connected_people(spark):
    people = spark.createDataFrame([("u1", None, "x"), ("u2", "n", "x"), ("u3", "n", "x"), ("u9", "n", None)], "unified_id string, name string, email string")
    pairs = spark.createDataFrame([("u1", "u2"), ("u3", "u2")], "id_1 string, id_2 string")
    got = {r.unified_id: r.primary_id for r in identity.elected(people, identity.connected_people(pairs)).collect()}
    assert got == {"u1": "u2", "u2": "u2", "u3": "u2"}


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    df = spark.createDataFrame([("v", "i")][:n], "value string, id string")
    members = links.memberships(df, ["value"], ["id"])
    assert links.classes(df, ["value"], ["id"]).count() == members.count() == links.pairs(members, ["value"], ["id"], "id").count() == 0


def test_files_of_pairs_hold_runs_and_references(spark, tmp_path):
    ids = spark.range(2500).select(F.lit("v").alias("value"), F.md5(F.col("id").cast("string")).alias("id"))
    pairs = links.pairs(links.memberships(ids, ["value"], ["id"]), ["value"], ["id"], "id")
    pairs.write.parquet(str(tmp_path / "pairs"))
    n = 2500 * 2499 // 2
    held = spark.read.parquet(str(tmp_path / "pairs"))
    assert held.count() == n and held.distinct().count() == n and held.where("id_1 >= id_2").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < n
