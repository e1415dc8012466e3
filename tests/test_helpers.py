"""General helpers, data tests, sources, sinks and streams."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import sqlutils as u
from cohortmill.operators import domain, dq
from cohortmill.sources import readers, sinks
from cohortmill.streaming import bills


def values(df):
    return [tuple(r) for r in df.collect()]


def test_columns_and_relations(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "")], "id int, size string, note string")
    assert u.column_values(df, "size") == ["a", "b"] and u.column_values(df, "nope", default=[7]) == [7]
    assert u.filtered_columns(df, ["ID"]) == ["size", "note"] and df.select(*u.star(df, ["note"], prefix="p_")).columns == ["p_id", "p_size"]
    assert u.single_value(df.where("id = 9"), "none") == "none" and u.results_as_dict(df.select("id").orderBy("id")) == {"id": (1, 2, 3)}
    assert values(u.nullcheck(df).orderBy("id").select("note")) == [(None,), ("x",), (None,)]
    df.createOrReplaceTempView("ev_20240101")
    df.createOrReplaceTempView("ev_20240102")
    assert u.relations_by_prefix(spark, "EV_2024", "%02") == ["ev_20240101"]
    with pytest.raises(ValueError):
        u.union_relations({"a": df}, include=["id"], exclude=["size"])
    both = u.union_relations({"a": df.select("id"), "b": df.select("size")})
    assert both.count() == 6 and both.columns == ["id", "_source_relation", "size"]


def test_golden_values(spark):
    one = spark.range(1)
    pick = lambda *c: one.select(*c).first()[0]
    geo = [F.lit(x) for x in (48.810234, 2.3, 45.7, 4.8)]
    assert abs(pick(u.haversine_distance(*geo, unit="km")) / pick(u.haversine_distance(*geo)) - 1.60934) < 1e-9
    with pytest.raises(ValueError):
        u.haversine_distance(*geo, unit="m")
    rows = spark.createDataFrame([(100000.0,), (200000.0,), (400000.0,), (-1.0,), (1e9 + 1,)], "a double").select(u.width_bucket(F.col("a"), 0, 400000, 4)).collect()
    assert [r[0] for r in rows] == [2, 3, 5, 0, 5]
    url = F.lit("https://www.x.com/a/b?utm=1&ref=q")
    assert (pick(u.url_host(url)), pick(u.url_path(url)), pick(u.url_parameter(url, "ref")), pick(u.url_parameter(url, "no"))) == ("www.x.com", "a/b", "q", None)
    assert pick(u.safe_add(F.lit(None).cast("int"), F.lit(2))) == 2 and pick(u.safe_divide(F.lit(1), F.lit(0))) is None
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert u.pretty_time(at) == "03:04:05" and u.pretty_time(at, "%Y") == "2024" and u.pretty_log("done", at) == "03:04:05 + done"
    with pytest.raises(ValueError):
        u.surrogate_key_removed("a")
    assert u.slugify("9 Big-Things!") == "_9_big_things" and u.powers_of_two(10) == 4
    assert [r[0] for r in u.date_spine(spark, "month", "2024-01-01", "2024-04-01").collect()] == [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)]
    with pytest.raises(ValueError):
        u.generate_series(spark, 0)


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([("S", "red"), ("S", "blue"), ("S", "red"), ("M", "red")], "size string, color string")
    assert sorted(values(df.groupBy("size").agg(*u.pivot("color", ["red", "blue"])))) == [("M", 1, 0), ("S", 2, 1)]
    wide = spark.createDataFrame([(1, True, None)], "id int, flag boolean, n int")
    assert sorted(values(u.unpivot(wide, ["id"])), key=str) == [(1, "flag", "true"), (1, "n", None)]


def test_data_tests(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, ""), (2, 9, " ")], "id int, n int, s string")
    assert values(dq.unique(df, "id")) == [(2, 2)] and dq.not_null(df, "n").count() == 1
    assert dq.accepted_range(df, "n", 5, 9).count() == 0 and dq.accepted_range(df, "n", 5, 9, inclusive=False).count() == 2
    assert dq.not_empty_string(df, "s").count() == 2 and dq.not_empty_string(df, "s", trim=False).count() == 1
    assert dq.expression_is_true(df, "> 6", "n").count() == 1 and dq.not_constant(df.where("id = 2"), "id").count() == 1
    assert dq.fewer_rows_than(df, df).first().row_count_delta == 1 and dq.passes(dq.equal_rowcount(df, df))
    assert dq.cardinality_equality(df, "id", df.where("id = 1"), "id").count() == 1
    assert {r.which_diff for r in dq.equality(df, df.where("id = 1"), ["id"]).collect()} == {"a_minus_b"}
    r = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 3, 9), (2, 5, 5)], "k int, lo int, hi int")
    assert sorted(x.lo for x in dq.mutually_exclusive_ranges(r, "lo", "hi", "k").collect()) == [2, 5]
    assert sorted(x.lo for x in dq.mutually_exclusive_ranges(r, "lo", "hi", "k", gaps="required", zero_length=True).collect()) == [0, 2]
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (0, 1, 3)], "ts timestamp")
    assert dq.sequential_values(t, "ts", 1, "hour").count() == 1 and dq.recency(t, "ts", "2024-01-03", "day", 1).count() == 1
    assert dq.column_set_difference(df, ["ID", "n"]) == ["s"] and dq.report({"x": dq.not_null(df, "id")}) == {"x": 0}
    assert dq.at_least_one(df, "n", ["id"]).count() == 0 and dq.not_accepted_values(df, "s", ["a"]).count() == 1


def test_domain_metrics(spark):
    d = dt.date
    bills_ = spark.createDataFrame([("c", d(2024, 1, 1), d(2024, 1, 10), d(2024, 1, 5), 10.0, 10.0, 0.0, 5.0, False, False), ("c", d(2024, 3, 1), d(2024, 3, 10), d(2024, 3, 20), 30.0, 20.0, 10.0, 7.0, True, True), ("c", d(2022, 3, 1), d(2022, 3, 10), None, 5.0, 0.0, 5.0, 1.0, False, False)], "customer_id string, bill_date date, due_date date, payment_date date, bill_amount double, payment_amount double, outstanding_amount double, consumption_kwh double, is_current boolean, disconnection_notice boolean")
    r = domain.metrics(bills_, domain.billing("2024-06-01")).first()
    assert (r.total_bills_generated, r.current_outstanding, r.total_outstanding, r.last_bill_amount, r.late_payment_count_12m, r.on_time_payment_rate, r.has_partial_payments, r.disconnection_notice_count) == (3, 10.0, 15.0, 30.0, 1, 50.0, True, 1)
    with pytest.raises(ValueError):
        domain.metrics(bills_, domain.billing("2024-06-01"), ["nope"])


def test_readers(spark, tmp_path):
    (tmp_path / "20240101").mkdir()
    with zipfile.ZipFile(tmp_path / "20240101" / "d.zip", "w") as z:
        z.writestr("x/a.csv", " Bill_No ,extra\n1,e\n2,f\n")
        z.writestr("b.csv", "bill_no\n3\n")
        z.writestr("c.txt", "no")
    (tmp_path / "20240101" / "broken.zip").write_bytes(b"nothing")
    got = readers.read_zipped_csv(spark, readers.dated_glob(f"file://{tmp_path}"), ["bill_no", "article"])
    assert sorted((r.bill_no, r.article, r._source_file) for r in got.collect()) == [("1", None, "a.csv"), ("2", None, "a.csv"), ("3", None, "b.csv")]
    (tmp_path / "p.csv").write_text("Store Code|Unit|Unit\nS1|cm|mm\n")
    assert values(readers.read_csv(spark, f"file://{tmp_path}/p.csv", ["store_code", "zone"], "|", {"Store Code": "store_code"})) == [("S1", None)]
    assert values(readers.read_positional(spark, f"file://{tmp_path}/p.csv", ["a", "b", "c"])) == [("S1", "cm", "mm")]
    assert readers.expand_env("${A:-x}/${B}", {"B": "y"}) == "x/y" and readers.fuzzy_renames(["Overall Rating (1-10)"], {"overall": "overall_rating"}) == {"Overall Rating (1-10)": "overall_rating"}
    assert readers.scan_cost(spark.range(10)) >= 0 and readers.table_metadata(spark.range(1))[0]["type"] == "bigint"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a\n{i}", "nan") for i in range(25)], "id int, s string, t string")
    sinks.write_table(df, f"file://{tmp_path}/t")
    back = spark.read.parquet(f"file://{tmp_path}/t")
    assert back.where("s LIKE '%\n%' OR t IS NOT NULL").count() == 0
    assert sinks.webhook(df.repartition(3), lambda rows: all(r["id"] != 7 for r in rows), 5)["synced"] >= 20
    out = sinks.export(df, "id < 5", [{"type": "csv", "path": f"file://{tmp_path}/c", "single": True}, {"type": "fax"}], ["id"])
    assert out[0]["synced"] == 5 and out[1]["skipped"]
    old, new = df.where("id < 3"), df.where("id BETWEEN 2 AND 4").withColumn("s", F.lit("new"))
    assert sinks.upsert(old, new, ["id"]).where("s = 'new'").count() == 3 and sinks.upsert(old, new, ["id"], update=False).where("s = 'new'").count() == 2
    assert [r.id for r in sinks.changed_rows(new, old, ["id"]).orderBy("id").collect()] == [2, 3, 4]
    sinks.audit(spark, f"file://{tmp_path}/log", "a", 5, 1, "x" * 2000)
    line = spark.read.parquet(f"file://{tmp_path}/log").first()
    assert line.status == "PARTIAL" and len(line.error) == 1000


def test_streams(spark, tmp_path):
    ts = lambda h: dt.datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([(1, "view", ts(1), 1.0), (1, "view", ts(1), 1.0), (2, "view", ts(2), 2.0)], "event_id int, event_name string, event_ts timestamp, value double")
    rows.write.parquet(f"file://{tmp_path}/in")
    source = bills.drop_folder(spark, f"file://{tmp_path}/in", rows.schema)
    q = bills.first_seen(source, ["event_id"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2
    assert bills.windowed_counts(rows).first().n == 3 and bills.sessions(rows, "event_id").count() == 2
