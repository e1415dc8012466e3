"""Staging expressions and builders over the edge rows that raw tables hold."""

import datetime as dt

from pyspark.sql import functions as F

from cohortmill.functions import cleaning as c
from cohortmill.operators import staging


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_mobiles_of_tills(spark):
    raw = [None, "", "-", "X", "0", "+919876543210", "919876543210", "9123456789", "98765 43210", "12345", " 9876543210 "]
    assert column(spark, raw, c.mobile_pos) == [None, None, None, None, None, "9876543210", "9876543210", "9123456789", "9876543210", None, "9876543210"]
    assert column(spark, ["9123456789"], lambda x: c.mobile_pos(x, True)) == [None]


def test_mobiles_of_service_records(spark):
    assert column(spark, ["+919876543210", "9876543210", None], c.mobile_crm) == [None, "9876543210", None]
    assert column(spark, ["+919876543210"], lambda x: c.mobile_crm(x, True)) == ["9876543210"]
    assert column(spark, ["98-76", "98765-43210"], c.mobile_or_raw) == ["98-76", "9876543210"]
    assert column(spark, ["+91 98765 43210", "9876543210"], c.phone) == ["9876543210", "9876543210"]


def test_typed_and_guarded(spark):
    assert column(spark, ["", " 12.50 ", "abc", None], lambda x: c.typed(x, "double")) == [None, 12.5, None, None]
    assert column(spark, ["42", "abc", "-1"], lambda x: c.guarded(x, r"^\d+$", "int")) == [42, None, None]
    assert column(spark, ["20240229", "2024", "20249999"], c.compact_date) == [dt.date(2024, 2, 29), None, None]
    assert column(spark, ["23:59:59", "24", None], c.seconds_of_day) == [86399, None, None]


def test_calendar_flags(spark):
    days = ["2024-02-01", "2024-02-07", "2024-02-08", "2024-02-15", "2024-02-16", "2024-02-23", "2024-02-22", "2024-02-29", "2024-02-03"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d")).select("d", *[v.alias(k) for k, v in c.calendar_flags(F.col("d")).items()]).collect()
    got = {str(r.d): r for r in rows}
    assert got["2024-02-07"].first_week_flag and not got["2024-02-08"].first_week_flag
    assert got["2024-02-15"].first_half_flag and not got["2024-02-16"].first_half_flag
    assert got["2024-02-23"].last_week_flag and not got["2024-02-22"].last_week_flag
    assert got["2024-02-03"].weekend_flag and got["2024-02-07"].wednesday_flag and got["2024-02-03"].day_of_week == "Saturday"


def test_bill_transactions(spark):
    raw = spark.createDataFrame(
        [("2024-01-06", "S1", "9998", "7", "1", " 12.50 ", "+", "P", "919876543210", "10:00:00"), ("bill_date", "plant", "till", "x", "x", "x", "x", "x", "x", "x"), ("2024-01-06", None, "1", "8", "2", "", "-", None, "X", "bad")],
        "bill_date string, plant string, till_no string, bill_no string, line_item_no string, gross_sale_value string, sales_return string, promo_indicator string, mobile_number string, bill_start_time string",
    )
    rows = staging.bill_transactions(raw).orderBy("till_no").collect()
    assert len(rows) == 2
    assert rows[1].bill_id == "S1-7-2024-01-06" and rows[1].delivery_channel == "Online" and rows[1].sales_return and float(rows[1].gross_sale_value) == 12.5 and rows[1].start_secs == 36000
    assert rows[0].bill_id is None and rows[0].gross_sale_value is None and not rows[0].sales_return and rows[0].mobile_number is None


def test_cih_profiles(spark):
    raw = spark.createDataFrame([("9876543210", "-1", "abc", "5"), ("-1", "x", "1", "1"), (" 9876543211", "Ann", "33", "1.5")], "brand_id string, name string, age string, total_spent string")
    rows = {r.mobile: r for r in staging.cih_profiles(raw).collect()}
    assert set(rows) == {"9876543210", "9876543211"}
    assert rows["9876543210"].name is None and rows["9876543210"].age is None and rows["9876543211"].age == 33


def test_last_file_wins(spark):
    rows = spark.createDataFrame([(" S1", "a", 1, "old"), ("S1", "b", 1, "new"), ("", "c", 1, "x")], "store_code string, _source_file string, _line int, v string")
    assert [(r.store_code, r.v) for r in staging.last_file_wins(rows, "store_code").collect()] == [("S1", "new")]


def test_date_dimension(spark):
    d = staging.date_dimension(spark)
    assert d.count() == 3287
    r = d.where("date_day = '2024-03-31'").first()
    assert (r.fiscal_year, r.fiscal_quarter, r.iso_week) == (2023, 4, 13)
