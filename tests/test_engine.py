"""Marts, identity, trees and audiences over small fixtures; results, not plans, are asserted."""

import datetime as dt
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortmill.functions import windows
from cohortmill.operators import identity, marts, segment
from cohortmill.plans import rules

AS_OF = "2024-06-30"


def attr(key, operator, value=None, **more):
    return {"attribute_key": key, "operator": operator, "value": value, **more}


def group(*conditions, op="and", **more):
    return {"type": "group", "logical_operator": op, "conditions": list(conditions), **more}


@pytest.fixture(scope="module")
def brand(spark):
    profiles = spark.createDataFrame(
        [(f"c{i}", f"90000000{i:02d}", f"Name {i}", f"m{i}@x.com" if i % 2 else None, "600001", f"S{i % 3}", "Pune" if i < 5 else None, "CIH", f"k{i}") for i in range(10)],
        "unified_id string, canonical_mobile string, display_name string, email string, pincode string, registered_store string, city string, primary_source string, corporate_id string",
    )
    behavior = spark.createDataFrame([(f"c{i}", i, i * 10.0, i, "Churned" if i % 2 else "Active") for i in range(1, 10)], "customer_id string, total_bills long, total_spend double, total_visits long, lifecycle_stage string")
    lines = spark.createDataFrame([(f"9190000000{i:02d}"[-12:], b, v) for i, b, v in [(1, "Tata", 5.0), (1, "Amul", 50.0), (2, "Amul", 7.0), (3, "Tata", 70.0)]], "mobile_number string, brand_name string, gross_sale_value double")
    locations = spark.createDataFrame([("S0", "KA ", "South"), ("S0 ", "KA", "South"), ("S1", "MH", "West")], "store_code string, store_state string, store_zone string")
    ts = lambda d: dt.datetime(2024, 6, d)
    events = spark.createDataFrame([("c1", "view", ts(1), {"p": "5"}), ("c1", "view", ts(20), {"p": "9"}), ("c2", "view", ts(2), {}), ("c3", "buy", ts(3), {"p": "x"})], "customer_id string, event_name string, event_ts timestamp_ntz, properties map<string,string>")
    b = segment.Brand("main", {"profiles": profiles, "behavior": behavior, "lines": lines, "locations": locations, "events": events})
    b.others["other"] = segment.Brand("other", {"profiles": profiles, "behavior": behavior})
    return b


def ids(frame):
    return sorted(r.customer_id for r in frame.select("customer_id").collect())


def run(brand, *conditions, **more):
    return ids(segment.Engine(brand, AS_OF).segment(group(*conditions, **more)))


def test_left_fold_and_negation(brand):
    a, b, c = attr("txn.total_bills", "equals", 1), attr("txn.total_bills", "equals", 2, logical_operator="or"), attr("lifecycle.lifecycle_stage", "equals", "ACTIVE", logical_operator="and")
    assert run(brand, a, b, c) == ["c2"]
    assert run(brand, attr("txn.total_bills", "greater_than", 2, negate=True)) == ["c1", "c2"]
    assert len(run(brand)) == 10 and len(run(brand, group())) == 10
    assert run(brand, attr("txn.total_bills", "equals", 1), group(attr("txn.total_bills", "equals", 7), logical_operator_prefix="or")) == ["c1", "c7"]


def test_locations_join_left_and_once(brand):
    assert run(brand, attr("geo.state", "equals", "ka"), attr("txn.total_bills", "equals", 2, logical_operator="or")) == ["c0", "c2", "c3", "c6", "c9"]
    assert segment.Engine(brand, AS_OF).preview(group(attr("geo.state", "equals", "KA"))).count() == 4


def test_lines_and_events_are_flags(brand):
    assert run(brand, attr("bt.brand_name", "equals", "tata")) == ["c1", "c3"]
    assert run(brand, attr("bt.brand_name", "equals", "tata", negate=True), attr("txn.total_bills", "less_than", 3)) == ["c2"]
    assert run(brand, attr("bt.gross_sale_value", "greater_than", 60), attr("txn.total_bills", "equals", 9, logical_operator="or")) == ["c3", "c9"]
    event = lambda name, op="has_performed", **more: {"type": "event", "event_name": name, "operator": op, **more}
    assert run(brand, event("view")) == ["c1", "c2"]
    assert "c1" not in run(brand, event("view", "has_not_performed")) and len(run(brand, event("view", negate=True))) == 8
    assert run(brand, event("view", "performed_count_greater_than_or_equal", value=2)) == ["c1"]
    assert run(brand, event("view", time_window={"type": "last_n_days", "n": 15})) == ["c1"]
    assert run(brand, event("view", property_filters=[{"property": "p", "operator": "greater_than", "value": 6}])) == ["c1"]
    assert run(brand, event("view", "first_performed_after", value="2024-06-01")) == ["c2"]
    with pytest.raises(ValueError):
        run(brand, event("view", "dreamt_of"))


def test_membership_and_other_brands(brand, tmp_path):
    e = segment.Engine(brand, AS_OF)
    e.materialize("s1", group(attr("txn.total_bills", "greater_than", 7)), f"file://{tmp_path}/s1")
    m = lambda op="is_member", **more: {"type": "segment_membership", "segment_id": "s1", "operator": op, **more}
    assert run(brand, m()) == ["c8", "c9"] and len(run(brand, m("is_not_member"))) == 8
    assert run(brand, m(), attr("txn.total_bills", "equals", 1, logical_operator="or")) == ["c1", "c8", "c9"]
    cross = {"type": "cross_brand", "target_brand": "other", "condition": attr("txn.total_bills", "equals", 4)}
    assert run(brand, cross) == ["c4"] and len(run(brand, {**cross, "negate": True})) == 9
    with pytest.raises(ValueError):
        run(brand, {**m(), "segment_id": "nope"})


def test_audience_operations(brand):
    e = segment.Engine(brand, AS_OF)
    low, odd = group(attr("txn.total_bills", "less_than", 6)), group(attr("lifecycle.lifecycle_stage", "equals", "Churned"))
    make = lambda kind: ids(e.segment({"root": low, "set_operation": kind, "set_members": [odd]}))
    assert make("union") == ["c1", "c2", "c3", "c4", "c5", "c7", "c9"] and make("overlap") == ["c1", "c3", "c5"] and make("exclude") == make("exclude_overlap") == ["c2", "c4"]
    top = e.segment({"root": group(), "rank": {"attribute_key": "txn.total_spend", "order": "desc", "limit": 3}}).orderBy("rank_position").collect()
    assert [(r.customer_id, r.rank_position) for r in top] == [("c9", 1), ("c8", 2), ("c7", 3)]
    s = e.summary(low).first()
    assert (s.audience_size, s.total_bills, s.total_spend, s.spend_per_bill) == (5, 15, 150.0, 10.0)
    nobody = e.summary(group(attr("txn.total_bills", "equals", 99))).first()
    assert nobody.audience_size == 0 and nobody.total_spend == 0 and nobody.spend_per_bill == 0
    split = e.split_attribute(group(), "lifecycle.lifecycle_stage", ["Active"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"Active": 4, "Remainder": 6}
    assert e.estimate({"root": low, "split": {"type": "percent", "splits": [{"percent": 50}, {"percent": None}]}})["audience_count"] == 5
    assert [r.value for r in e.distinct_values("geo.city").collect()] == ["Pune"]
    with pytest.raises(ValueError):
        segment.set_operation("xor", [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(range(10)), min_size=1, max_size=4, unique=True), st.lists(st.booleans(), min_size=3, max_size=3))
def test_fold_equals_python(brand, values, ors):
    conditions = [attr("txn.total_bills", "not_equals" if v % 2 else "equals", v, logical_operator="or" if i and ors[i - 1] else "and") for i, v in enumerate(values)]
    test = lambda n, v: n != v if v % 2 else n == v
    expected = [f"c{n}" for n in range(1, 10) if reduce(lambda a, iv: (a or test(n, iv[1])) if ors[iv[0] - 1] else (a and test(n, iv[1])), list(enumerate(values))[1:], test(n, values[0]))]
    assert [x for x in run(brand, *conditions) if x != "c0"] == expected


def test_percent_split_covers_without_overlap(brand, spark):
    profiles = spark.range(537).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("unified_id"), F.lit("x").alias("canonical_mobile"))
    e = segment.Engine(segment.Brand("b", {"profiles": profiles}), AS_OF)
    got = e.split_percent(group(), [20, 30, 50])
    assert got.count() == 537 and got.select("customer_id").distinct().count() == 537
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert abs(n[0] - 107) <= 20 and abs(n[2] - 268) <= 20


def test_identity_strategies(spark):
    cih = spark.createDataFrame([("m1", "s2", "Ann", None), ("m1", "s1", "Ann B", None), ("m2", "s3", None, "9")], "mobile string, surrogate_id string, name string, registered_store string")
    for c in identity.PROFILE:
        if c not in cih.columns:
            cih = cih.withColumn(c, F.lit(None).cast("string"))
    seen = spark.createDataFrame([("m1", "A", dt.date(2024, 1, 1)), ("m1", "B", dt.date(2024, 2, 1)), ("m3", "C", None)], "mobile string, store_code string, last_bill_date date")
    a = {r.canonical_mobile: r for r in identity.resolve(cih, seen).collect()}
    assert {k: (r.primary_source, r.has_transactions) for k, r in a.items()} == {"m1": ("CIH+POS", True), "m2": ("CIH", False), "m3": ("POS", True)}
    assert a["m1"].surrogate_id == "s1" and a["m3"].registered_store == "C"
    b = {r.canonical_mobile: r for r in identity.resolve(cih, seen, "pos_first").collect()}
    assert set(b) == {"m1", "m3"} and b["m1"].registered_store == "B" and b["m3"].primary_source == "POS"
    with pytest.raises(ValueError):
        identity.resolve(cih, seen, "other")


def test_connected_people(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "id_1 string, id_2 string")
    roots = {r.id: r.root for r in identity.connected_people(pairs).collect()}
    assert roots == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    people = spark.createDataFrame([("a", None), ("b", 1), ("c", 1), ("d", None), ("x", None), ("y", None)], "unified_id string, v int")
    got = {r.unified_id: r.primary_id for r in identity.elected(people, identity.connected_people(pairs)).collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "d": "b", "x": "x", "y": "x"}


def test_lifecycle_and_segments(spark):
    rows = spark.createDataFrame([(None,), (30,), (31,), (90,), (91,), (181,)], "r int").select(marts.lifecycle(F.col("r")).alias("s")).collect()
    assert [r.s for r in rows] == ["Registered", "Active", "At Risk", "At Risk", "Lapsed", "Churned"]
    cells = spark.createDataFrame([("Large", 1400.0, 5), ("Daily", 749.0, 6), ("Hyper", 1400.0, 4), ("Daily", None, None)], "fav_store_type string, spend_per_bill double, total_visits int").select(marts.l1_segment().alias("s")).collect()
    assert [r.s for r in cells] == ["HVHF", "LVHF", "HVLF", "LVLF"]


def test_definitions_of_every_template_compile(brand):
    from cohortmill.plans.catalog import TEMPLATES

    for d in TEMPLATES.values():
        rules.parse_definition(d)


def joins(brand, *conditions, **more):
    """Result and kinds of joins of the plan."""
    df = segment.Engine(brand, AS_OF).segment(group(*conditions, **more))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return ids(df), plan.count("Join LeftSemi"), plan.count("Join LeftAnti"), plan.count("bool_or") + plan.count("max((")


def test_conditions_that_must_hold_are_semi_and_anti_joins(brand):
    tata, amul = attr("bt.brand_name", "equals", "tata"), attr("bt.brand_name", "equals", "amul")
    many = attr("txn.total_bills", "greater_than", 0)
    assert joins(brand, tata) == (["c1", "c3"], 1, 0, 0)
    assert joins(brand, tata, amul) == (["c1"], 2, 0, 0)  # some line of each
    assert joins(brand, many, dict(amul, negate=True), group(tata)) == (["c3"], 1, 1, 0)
    # EXISTS goes over OR: one join.
    assert joins(brand, tata, dict(amul, logical_operator="or")) == (["c1", "c2", "c3"], 1, 0, 0)
    assert joins(brand, many, group(tata, amul, op="or")) == (["c1", "c2", "c3"], 1, 0, 0)
    assert joins(brand, many, group(tata, amul, op="or", negate=True))[:3] == ([f"c{i}" for i in range(4, 10)], 0, 1)


def test_under_or_and_negation_they_are_flags(brand):
    tata, many = attr("bt.brand_name", "equals", "tata"), attr("txn.total_bills", "greater_than", 8)
    got = joins(brand, tata, dict(many, logical_operator="or"))
    assert got[:3] == (["c1", "c3", "c9"], 0, 0) and got[3] > 0
    got = joins(brand, attr("txn.total_bills", "less_than", 5), group(tata, attr("txn.total_bills", "equals", 1), negate=True))
    assert got[:3] == (["c2", "c3", "c4"], 0, 0)
    mixed = joins(brand, dict(tata, negate=True), attr("bt.brand_name", "equals", "amul", logical_operator="or"))
    assert mixed[0] == ["c0", "c1", "c2", *(f"c{i}" for i in range(4, 10))] and mixed[1] == mixed[2] == 0


def test_members_and_other_brands_are_semi_joins(brand, spark):
    brand.segments["some"] = spark.createDataFrame([("c1",), ("c1",), ("c4",)], "customer_id string")
    member = lambda op, **more: {"type": "segment_membership", "segment_id": "some", "operator": op, **more}
    assert joins(brand, member("is_member"))[:3] == (["c1", "c4"], 1, 0)
    assert joins(brand, member("is_member", negate=True), attr("txn.total_bills", "less_than", 4))[:3] == (["c2", "c3"], 0, 1)
    assert joins(brand, member("is_not_member", negate=True))[:3] == (["c1", "c4"], 1, 0)
    cross = {"type": "cross_brand", "target_brand": "other", "condition": attr("txn.total_bills", "greater_than", 7)}
    assert joins(brand, cross)[:2] == (["c8", "c9"], 1)
