"""Queries over tables that have more keys, longer groups and emptier ones than the smallest ones."""

import re
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from cohortmill.operators import identity, sketches
from cohortmill.plans import catalogue, coverage  # noqa: F401  coverage adds its queries
from cohortmill.plans import tenant


@pytest.fixture
def tables(spark, smallest, tmp_path):
    """A folder of the smallest tables, some of them replaced by the given frames."""

    def made(**replaced):
        for f in Path(smallest).glob("*.parquet"):
            if f.stem not in replaced:
                (tmp_path / f.name).symlink_to(f)
        for name, rows in replaced.items():
            rows.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return made


def test_targets_of_many_stores_pass_32_bits(spark, smallest, tables):
    stores = spark.read.parquet(f"{smallest}/supplier.parquet")
    d = tables(supplier=stores.unionByName(stores.selectExpr("s_suppkey + 5000 AS s_suppkey", "s_name", "s_nationkey", "s_acctbal")))
    got = {r.store_code: r.target for r in catalogue.queries()["target_achievement"](spark, d).collect()}
    assert len(got) == 2 * stores.count() and got["5000"] == 5001 * 1000000


def test_shares_of_departments_without_lines_are_null(spark, smallest, tables):
    lines = spark.read.parquet(f"{smallest}/lineitem.parquet").where("l_partkey % 3 <> 0 OR l_orderkey % 2 = 0")
    orders = spark.read.parquet(f"{smallest}/orders.parquet").selectExpr("* EXCEPT (o_custkey)", "o_orderkey % 4 AS o_custkey")
    got = {r.customer_id: r.fresh_produce_pct for r in catalogue.queries()["basket_line_metrics"](spark, tables(lineitem=lines, orders=orders)).collect()}
    assert got["1"] is None and got["3"] is None and got["0"] > 0 and got["2"] > 0


def test_an_email_of_many_profiles_is_one_row(spark, smallest, tables):
    customers = spark.read.parquet(f"{smallest}/customer.parquet").limit(1).drop("c_custkey").crossJoin(spark.range(2000).selectExpr("id * 500 + 1 AS c_custkey"))
    got = catalogue.queries()["email_clusters"](spark, tables(customer=customers)).collect()
    big = [r for r in got if r.value == "u1@example.com"]
    assert len(big) == 1 and big[0].profiles == 1333 and len(got) == 1
    ids = big[0].unified_ids.split(",")
    assert len(ids) == 1333 and ids == sorted(set(ids))


def test_sketches_in_parts_count_exactly(spark):
    ids = lambda a, b: spark.range(a, b).selectExpr("md5(CAST(id AS STRING)) AS customer_id")
    audiences = {"a": ids(0, 30000), "b": ids(20000, 50000), "none": ids(0, 0)}
    held = sketches.sketched(audiences, parts=sketches.parts_for(50000)).persist()
    counts = {kind: sketches.set_count(held, kind, ["a", "b"], exact=True).first().n for kind in ("union", "overlap", "exclude")}
    assert counts == {"union": 50000, "overlap": 10000, "exclude": 20000}
    assert sketches.set_count(held, "overlap", ["a", "none"], exact=True).first().n == 0
    with pytest.raises(Exception, match="more parts"):
        sketches.set_count(sketches.sketched(audiences), "union", ["a", "b"], exact=True).collect()


def test_no_step_deals_lines_by_their_store_alone(spark, smallest):
    for name in ("daily_store_sales", "daily_store_sales_full", "bill_summary", "bill_summary_full", "total_sales_margins"):
        plan = catalogue.queries()[name](spark, smallest)._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        keys = [[k.split("#")[0] for k in x.split(", ") if "#" in k] for x in dealt]
        assert keys and ["store_code"] not in keys, name


def test_audiences_read_customers_that_are_written_once(spark, smallest):
    e = catalogue.shared_engine(spark, smallest)
    for rule in ({"attribute_key": "decile.spend_decile", "operator": "greater_than", "value": 8}, {"attribute_key": "store.fav_store_code", "operator": "exists"}):
        df = e.segment({"type": "group", "logical_operator": "and", "conditions": [{"type": "attribute", **rule}]})
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "l_orderkey" not in plan and "p_partkey" not in plan


def test_published_marts_are_built_again_over_what_is_written(spark, smallest):
    m = tenant.models(spark, smallest, kind="view")
    m.frame("behavior")
    m.forget("behavior")
    m.frame("behavior")
    assert m.builds["behavior"] == 2 and m.builds["bills"] == m.builds["profiles"] == m.builds["transactions"] == 1


def test_bills_known_to_the_master_or_not_are_met_once(spark):
    master = spark.createDataFrame([("1", "C1", "5"), ("2", "C2", "6"), (None, "C0", None)], "mobile string, surrogate_id string, registered_store string")
    for c in identity.PROFILE:
        master = master if c in master.columns else master.withColumn(c, F.lit(None).cast("string"))
    seen = spark.createDataFrame([("2", "8", 1), ("2", "7", 2), ("3", "9", 1), ("3", "4", 1)], "mobile string, store_code string, last_bill_date int")
    got = identity.resolve(master, seen)
    rows = {r.canonical_mobile: (r.primary_source, r.has_transactions, r.registered_store) for r in got.collect()}
    assert rows == {"1": ("CIH", False, "5"), "2": ("CIH+POS", True, "6"), "3": ("POS", True, "4"), None: ("CIH", False, None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
