"""Lazy marts: what is ranked or joined for audiences that ask for a part of the columns."""

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import marts, segment
from cohortmill.plans import adapter as A
from cohortmill.plans import catalogue, coverage  # noqa: F401  coverage adds its queries
from cohortmill.plans import tenant


@pytest.fixture
def ranked(monkeypatch):
    """The names of the tiles that are computed."""
    names: list[str] = []
    real = marts.ntiles

    def seen(df, key, tiles):
        names.extend(tiles)
        return real(df, key, tiles)

    monkeypatch.setattr(marts, "ntiles", seen)
    return names


@pytest.mark.parametrize("name", ["reverse_etl_rows", "export_audiences", "customer_360"])
def test_readers_of_no_rank_have_none_computed(spark, smallest, ranked, name):
    assert catalogue.queries()[name](spark, smallest).count() > 0
    assert ranked == []


@pytest.mark.parametrize("name", ["estimate_with_members", "stored_segments", "set_overlap", "set_exclude", "cross_brand"])
def test_audiences_of_a_decile_have_no_scores_computed(spark, smallest, ranked, name):
    catalogue.queries()[name](spark, smallest).count()
    assert set(ranked) == tenant.DECILES


def test_lazy_marts_agree_whatever_is_asked(spark, smallest):
    m = tenant.models(spark, smallest, kind="view")
    whole = tenant.models(spark, smallest).frame("behavior")
    for asked in (None, {"rfm_monetary_score"}, {"spend_decile"}, {"store_spend"}):
        got = tenant.mart(m, asked)
        columns = sorted(got.columns)
        assert got.select(columns).exceptAll(whole.select(columns)).count() == 0 and got.count() == whole.count()
        assert (asked or set()) <= set(columns)
    assert m.builds["customers"] == m.builds["bills"] == 1


def test_bills_of_lines_that_are_summed_up_before_they_meet_their_bill(spark):
    lines = spark.createDataFrame(
        [("1", "Store", 10.0, 1.0, False, "P"), ("1", "Online", 5.0, None, None, None), ("1", "Online", 7.0, 0.5, True, None), ("2", "Store", 3.0, 0.0, True, None), ("3", "Store", 4.0, 0.0, False, None), ("none", "Store", 9.0, 0.0, False, None)],
        "bill_id string, delivery_channel string, gross double, discount double, sales_return boolean, promo_indicator string",
    ).select("*", F.col("gross").cast("decimal(15,2)").alias("gross_sale_value"), F.col("discount").cast("decimal(15,2)").alias("total_discount"))
    # Bill 3 has two headers of one customer and one of another; bill 4 has no lines.
    headers = spark.createDataFrame(
        [("1", "m1", "2020-01-04", "s1", 5, 90), ("2", "m1", "2020-01-05", "s2", 1, 2), ("3", "m2", "2020-01-06", "s1", 7, 9), ("3", "m2", "2020-01-07", "s3", 3, 8), ("3", "m3", "2020-01-06", None, 7, 9), ("4", "m4", "2020-01-06", "s1", 7, 9)],
        "bill_id string, mobile_number string, bill_date string, store_code string, start_secs long, end_secs long",
    )
    headers = headers.withColumns({"bill_date": F.to_date("bill_date"), "store_desc": F.concat(F.lit("d"), "store_code"), "store_format": F.lit("Large"), "day_of_week": F.date_format("bill_date", "E"), "weekend_flag": F.dayofweek("bill_date").isin(1, 7), "wednesday_flag": F.lit(False)})
    got = marts.bills_of_channels(marts.bill_channels_of_parts(lines, headers)).drop("channels")
    want = marts.bill_grain(lines.join(headers, "bill_id")).drop("channels").select(got.columns)
    assert want.count() == 4 and got.count() == 4 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_line_is_sorted_for_the_bills_of_lazy_marts(spark, smallest):
    plan = tenant.models(spark, smallest, kind="view").frame("bill_channels")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (bill_id") < plan.index("Aggregate [bill_id") < plan.index("l_orderkey")


@pytest.mark.parametrize("name", ["estimate_with_members", "stored_segments", "set_overlap", "set_exclude", "cross_brand"])
def test_audiences_of_spending_write_no_bills(spark, smallest, monkeypatch, name):
    made = []
    real = tenant.models
    monkeypatch.setattr(tenant, "models", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    catalogue.queries()[name](spark, smallest).count()
    assert [m.builds["spending"] for m in made] == [1] and not {"bills", "customers"} & set(made[0].builds)


def test_marts_of_spending_agree_with_the_whole(spark, smallest):
    m, whole = tenant.models(spark, smallest, kind="view"), tenant.models(spark, smallest).frame("behavior")
    for asked in ({"lifecycle_stage", "city"}, {"spend_decile", "channel_presence"}):
        got = tenant.mart(m, asked)
        columns = sorted(got.columns)
        assert asked | set(marts.SPENDING) <= set(columns)
        assert got.count() == whole.count() and got.select(columns).exceptAll(whole.select(columns)).count() == 0
    assert "bills" not in m.builds
    # A promotion is told by a column that these marts lack.
    event = {"type": "event", "event_name": "promo_usage", "operator": "has_performed"}
    both = catalogue.tree(event, catalogue.attr("decile.spend_decile", "greater_than_or_equal", 5))
    got = segment.Engine(tenant.brand(m), A.AS_OF).segment(both)
    assert got.count() == whole.where("promo_bill_count > 0 AND spend_decile >= 5").count() > 0


def test_spending_of_odd_lines(spark):
    lines = spark.createDataFrame(
        [("1", "Store", 10.0, False), ("1", "Online", 5.0, None), ("2", "Store", 3.0, True), ("3", "Store", 4.0, False), ("3", "App", None, False), ("4", None, None, False), ("5", "Online", 1.0, False), ("5", "Store", 2.0, True), ("none", "Store", 9.0, False)],
        "bill_id string, delivery_channel string, gross double, sales_return boolean",
    ).select("*", F.col("gross").cast("decimal(15,2)").alias("gross_sale_value"), F.lit(0).cast("decimal(15,2)").alias("total_discount"), F.lit("P").alias("promo_indicator"))
    # Bill 1 has two headers of one customer; m2 has returns only.
    headers = spark.createDataFrame([("1", "m1", "2020-01-04"), ("1", "m1", "2020-01-03"), ("2", "m2", "2020-01-05"), ("3", "m3", "2020-01-06"), ("4", "m4", "2020-01-07"), ("5", "m5", "2020-01-08"), ("6", "m6", "2020-01-09")], "bill_id string, mobile_number string, bill_date string")
    headers = headers.withColumns({"bill_date": F.to_date("bill_date"), "store_code": F.lit("s"), "store_desc": F.lit("d"), "store_format": F.lit("Large"), "day_of_week": F.lit("Mon"), "weekend_flag": F.lit(False), "wednesday_flag": F.lit(False), "start_secs": F.lit(1), "end_secs": F.lit(5)})
    got = marts.spending_of_parts(lines, headers, "2020-02-01")
    want = marts.customers_of_bills(marts.bills_of_channels(marts.bill_channels_of_parts(lines, headers)), "2020-02-01").select(got.columns)
    assert {r.mobile_number: r.channel_presence for r in got.collect()} == {"m1": "Omni", "m3": "Omni", "m4": "Offline", "m5": "Online"}
    assert got.schema.simpleString() == want.schema.simpleString() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
