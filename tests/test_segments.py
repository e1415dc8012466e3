"""Stored audiences, and what the mart's events mean by dialect."""

import pytest

from cohortmill.functions.storage import scratch
from cohortmill.operators import segment
from cohortmill.operators.segments import Segments, members_of
from cohortmill.plans import catalog
from cohortmill.sources.publish import Published


def bills(op, n, **more):
    return {"attribute_key": "txn.total_bills", "operator": op, "value": n, **more}


def group(*conditions, op="and", **more):
    return {"type": "group", "logical_operator": op, "conditions": list(conditions), **more}


@pytest.fixture()
def engine(spark):
    profiles = spark.createDataFrame([(f"c{i}", f"9{i:09d}") for i in range(6)], "unified_id string, canonical_mobile string")
    behavior = spark.createDataFrame([(f"c{i}", i, i, None) for i in range(1, 6)], "customer_id string, total_bills long, promo_bill_count long, last_bill_date date")
    events = spark.createDataFrame([("c1", "purchase", None, {}), ("c2", "promo_usage", None, {})], "customer_id string, event_name string, event_ts timestamp_ntz, properties map<string,string>")
    return segment.Engine(segment.Brand("b", {"profiles": profiles, "behavior": behavior, "events": events}), "2024-01-01")


def ids(df):
    return sorted(r.customer_id for r in df.collect())


def test_create_update_compute_delete(spark, engine):
    tables = Published(spark, scratch(spark))
    s = Segments(engine, tables)
    assert s.all() == []
    member = {"type": "segment_membership", "segment_id": "many", "operator": "is_member"}
    assert s.create("many", group(bills("greater_than", 3)), "Many bills", "t1").customers == 2
    assert s.create("not_many", group(dict(member, operator="is_not_member"))).customers == 4
    with pytest.raises(ValueError, match="already"):
        s.create("many", group())
    with pytest.raises(ValueError, match="member of not_many"):
        s.delete("many")
    with pytest.raises(ValueError, match="itself"):
        s.update("many", group({"type": "segment_membership", "segment_id": "not_many", "operator": "is_member"}))
    with pytest.raises(ValueError, match="unknown attribute"):
        s.update("many", group({"attribute_key": "txn.nothing", "operator": "equals", "value": 1}))
    assert ids(s.ids("many")) == ["c4", "c5"] and s.get("many").name == "Many bills"  # what failed left the old one
    assert s.update("many", group(bills("greater_than", 1)), at="t2").customers == 4
    assert s.get("not_many").customers == 4 and s.compute("not_many").customers == 2
    # Another session finds them.
    other = Segments(segment.Engine(segment.Brand("b", engine.brand.tables), engine.as_of), tables)
    assert [(x.segment_id, x.customers, x.computed_at) for x in other.all()] == [("many", 4, "t2"), ("not_many", 2, "")]
    assert ids(other.engine.segment(group(member))) == ["c2", "c3", "c4", "c5"]
    s.delete("not_many")
    s.delete("many")
    assert s.all() == [] and "many" not in engine.brand.segments
    with pytest.raises(ValueError, match="not stored"):
        s.ids("many")


def test_members_of_a_definition():
    d = {"root": group({"type": "segment_membership", "segment_id": 7, "operator": "is_member"}, group()), "set_operation": "union", "set_members": ["a", {"segment_id": "b"}, {"root": group()}]}
    assert members_of(d) == {"7", "a", "b"}


def test_purchases_by_dialect(engine):
    event = lambda name, **more: group({"type": "event", "event_name": name, "operator": "has_performed", **more})
    assert ids(engine.segment(event("purchase"))) == [f"c{i}" for i in range(1, 6)]
    athena = segment.Engine(engine.brand, engine.as_of, "athena")
    assert ids(athena.segment(event("purchase"))) == ["c1"] and ids(athena.segment(event("promo_usage"))) == ["c2"]
    with pytest.raises(ValueError, match="takes no window"):
        engine.segment(event("promo_usage", time_window={"type": "last_n_days", "days": 3}))


def test_suggestions_with_patterns():
    assert catalog.suggest("omni-channel", patterns=True) == ["omni-channel", "Omni-channel customers in {region}"]
    assert catalog.suggest("", patterns=True) == [] and "STAR segment customers" in catalog.suggest("star", patterns=True)
