"""The registry of models, and published tables."""

import pytest
from pyspark.sql import functions as F

from cohortmill.functions.storage import scratch
from cohortmill.operators import segment
from cohortmill.plans import adapter as A
from cohortmill.plans import tenant
from cohortmill.plans.catalog import TEMPLATES
from cohortmill.plans.models import Models
from cohortmill.sources.publish import Published


def test_order_cycles_and_names(spark):
    m = Models(spark)
    m.source("a", lambda: spark.range(3))
    m.model("c", lambda a, b: a.join(b, "id"), ["a", "b"])
    m.model("b", lambda a: a.where("id > 0"), ["a"])
    assert m.order() == ["a", "b", "c"] and m.order("b") == ["a", "b"] and m.needed_by("a") == ["b", "c"] and m.needed_by("c") == []
    assert m.frame("c").count() == 2 and m.builds == {"a": 1, "b": 1, "c": 1}
    with pytest.raises(ValueError, match="twice"):
        m.source("a", lambda: None)
    with pytest.raises(ValueError, match="kind"):
        m.model("z", lambda: None, kind="cube")
    with pytest.raises(ValueError, match="tested"):
        m.model("z", lambda: None, tests=[lambda df: df])
    m.model("x", lambda y: y, ["y"])
    with pytest.raises(ValueError, match="unknown model 'y', needed by 'x'"):
        m.frame("x")
    m.model("y", lambda z: z, ["z"])
    m.model("z", lambda x: x, ["x"])
    with pytest.raises(ValueError, match="x -> y -> z -> x"):
        m.order("x")


def test_shared_models_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    m = Models(spark)
    m.source("rows", lambda: spark.range(50).mapInArrow(seen, "id long"))
    m.model("kept", lambda rows: rows.where("id % 2 = 0"), ["rows"], "shared")
    m.model("low", lambda k: k.where("id < 10"), ["kept"])
    m.model("high", lambda k: k.where("id >= 10"), ["kept"])
    assert (m.frame("low").count(), m.frame("high").count(), m.frame("low").count()) == (5, 20, 5)
    assert read.value == 50


def test_audiences_and_a_set_operation_read_the_lines_for_one_mart_only(spark, smallest):
    m = tenant.models(spark, smallest)
    e = segment.Engine(tenant.brand(m), A.AS_OF)
    plans = [e.segment(TEMPLATES["churned"]), e.segment(TEMPLATES["omni-channel"])]
    plans.append(e.segment({"root": TEMPLATES["churned"], "set_operation": "union", "set_members": [TEMPLATES["omni-channel"], TEMPLATES["top-spend-decile"]]}))
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in text and "l_orderkey" not in text and "Window" not in text
    assert plans[2].count() >= plans[0].count() > 0
    assert m.builds["behavior"] == m.builds["bill_channels"] == m.builds["lines"] == 1


def test_registry_and_lazy_marts_agree(spark, smallest):
    m = tenant.models(spark, smallest)
    lazy = tenant.behavior(A.bill_lines(spark, smallest), m.frame("profiles"))
    shared = m.frame("behavior")
    assert sorted(shared.columns) == sorted(lazy.columns)
    assert shared.select(sorted(shared.columns)).exceptAll(lazy.select(sorted(shared.columns))).count() == 0
    asked = tenant.behavior(A.bill_lines(spark, smallest), m.frame("profiles"), {"total_bills"})
    assert not (tenant.DECILES | tenant.SCORES) & set(asked.columns)


def test_publish_is_one_step_and_a_failed_build_leaves_the_old(spark):
    tables = Published(spark, scratch(spark))
    with pytest.raises(ValueError, match="was not published"):
        tables.read("t")
    tables.publish("t", spark.range(3))
    before = tables.read("t")

    def fails_half_way(batches):
        for b in batches:
            if b.column(0)[0].as_py() >= 50:
                raise RuntimeError("half way")
            yield b

    broken = spark.range(0, 100, 1, 4).mapInArrow(fails_half_way, "id long")
    with pytest.raises(Exception, match="half way"):
        tables.publish("t", broken)
    assert tables.versions("t") == [1] and tables.read("t").count() == 3
    with pytest.raises(ValueError, match="old version stays"):
        tables.publish("t", spark.range(9), tests=[lambda df: df.where("id > 5")])
    assert tables.versions("t") == [1] and tables.read("t").count() == 3
    tables.publish("t", spark.range(5), tests=[lambda df: df.where("id > 5")])
    assert tables.read("t").count() == 5 and before.count() == 3  # a reader that began before
    tables.publish("t", spark.range(6))
    assert tables.versions("t") == [2, 3] and tables.read("t", 2).count() == 5 and tables.read("t").count() == 6
    with pytest.raises(ValueError):
        tables.publish("../t", spark.range(1))


def test_a_table_read_while_its_next_version_is_built(spark):
    tables = Published(spark, scratch(spark))
    tables.publish("t", spark.range(4))
    tables.publish("t", tables.read("t").select((F.col("id") + 1).alias("id")))  # from itself
    assert sorted(r.id for r in tables.read("t").collect()) == [1, 2, 3, 4]


def test_published_models_are_found_by_other_runs(spark):
    root = scratch(spark)
    m = Models(spark, root)
    m.source("a", lambda: spark.range(7))
    m.model("t", lambda a: a.where("id > 1"), ["a"], "table", [lambda df: df.where("id < 2")])
    assert m.run() == ["t"]
    assert Published(spark, root).read("t").count() == 5
    again = Models(spark, root)
    again.source("a", lambda: spark.range(1, 3).withColumn("id", F.lit(1).cast("long")))
    again.model("t", lambda a: a, ["a"], "table", [lambda df: df.where("id < 2")])
    with pytest.raises(ValueError, match="old version"):
        again.run()
    assert Published(spark, root).read("t").count() == 5
