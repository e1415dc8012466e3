"""The driver's tables as the canonical tables of the engine: bill lines, locations, profiles, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.cleaning import calendar_flags
from cohortmill.functions.storage import scratch

#: After the last order of the driver's tables.
AS_OF = "2001-08-02"
#: Thresholds that fill all cells of the segments with the driver's amounts.
L1 = {"large": (160000, 9), "small": (140000, 9)}
HIGH_SPEND = 1500000
FORMATS = ["Hyper", "Large", "Super", "Daily"]


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write under the folder that the session names."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mobile(key: str):
    return F.concat(F.lit("9"), F.lpad(F.col(key).cast("string"), 9, "0"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    formats = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return joined.select(F.col("s_suppkey").cast("string").alias("store_code"), F.col("s_name").alias("store_name"), formats.alias("store_format"), F.col("n_name").alias("store_state"), F.col("r_name").alias("store_zone"), F.concat(F.col("r_name"), F.lit("-B")).alias("store_business_region"), F.lit(True).alias("is_latest"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") * 37) % 86400
    return o.select(
        F.col("o_orderkey").alias("_order"), F.col("o_orderkey").cast("string").alias("bill_id"), mobile("o_custkey").alias("mobile_number"), F.col("o_orderdate").cast("date").alias("bill_date"),
        (F.col("o_orderkey") % 10).cast("string").alias("store_code"), start.alias("start_secs"), ((start + 60 + (F.col("o_orderkey") * 13) % 1800) % 86400).alias("end_secs"),
    )


def bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line grain, returns included. (bill_id, line_item_no) isn't unique in these tables.

    Bills are met last of the large tables and by bill_id, so what is grouped by bill afterwards lies together already. Stores are
    broadcast: there are few store codes among the bills, and a join by them would leave all lines to as many tasks."""
    out = article_lines(spark, sf_dir).join(bills(spark, sf_dir).drop("_order"), "bill_id")
    return _with_stores(spark, sf_dir, out)


def article_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line grain by bill_id, with articles: what the lines of bill_lines say by themselves."""
    line = table(spark, sf_dir, "lineitem")
    money = "decimal(15,2)"
    price, rate = F.col("l_extendedprice").cast(money), F.col("l_discount").cast(money)
    l = line.select(
        F.col("l_orderkey").cast("string").alias("bill_id"), F.col("l_linenumber").alias("line_item_no"), F.col("l_partkey"), price.alias("gross_sale_value"), F.round(price * rate, 2).cast(money).alias("total_discount"), F.col("l_quantity").cast("decimal(12,3)").alias("billed_qty"),
        (F.col("l_returnflag") == "R").alias("sales_return"), F.when(F.col("l_linestatus") == "O", "Online").otherwise("Store").alias("delivery_channel"), F.when(F.col("l_discount") >= 0.05, "P").alias("promo_indicator"),
    )
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").cast("string").alias("article"), F.col("p_name").alias("article_desc"), F.col("p_brand").alias("brand_name"), F.col("p_type").alias("segment_desc"), F.concat_ws("/", "p_type", (F.col("p_size") % 5).cast("string")).alias("family_desc"), F.col("p_brand").alias("brick_desc"))
    return l.join(p, "l_partkey").drop("l_partkey")


def bill_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill grain: what bill_lines says of a bill on each of its lines."""
    return _with_stores(spark, sf_dir, bills(spark, sf_dir).drop("_order"))


def _with_stores(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    stores = locations(spark, sf_dir).select("store_code", F.col("store_name").alias("store_desc"), "store_format", F.col("store_state").alias("region_desc"))
    return rows.join(F.broadcast(stores), "store_code", "left").withColumns(calendar_flags(F.col("bill_date")))


def cih_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer master: two thirds of the customers; every tenth row comes twice, with another id."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    c = c.where("c_custkey % 3 <> 0")
    twice = c.withColumn("copy", F.explode(F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    joined = twice.join(F.broadcast(n), twice.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(
        mobile("c_custkey").alias("mobile"), F.concat_ws("_", F.lit("CIH"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), "copy").alias("surrogate_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("u"), (F.col("c_custkey") % 500).cast("string"), F.lit("@example.com"))).alias("email"), F.col("n_name").alias("city"), (F.col("c_custkey") % 100 + 600000).cast("string").alias("pincode"), F.col("r_name").alias("region"), (F.col("c_custkey") % 10).cast("string").alias("registered_store"),
        (F.col("c_custkey") % 70 + 15).cast("int").alias("age"), F.col("c_mktsegment").alias("customer_group"), F.lit(None).cast("string").alias("occupation"), F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("N").alias("whatsapp"), F.when(F.col("c_custkey") % 7 == 0, "Y").when(F.col("c_custkey") % 7 < 4, "N").alias("dnd"), F.lit(None).cast("string").alias("gw_customer_flag"),
        F.when(F.col("c_custkey") % 5 == 0, "No").otherwise("Yes").alias("accepts_email_marketing"), F.when(F.col("c_custkey") % 6 == 0, "No").when(F.col("c_custkey") % 6 < 4, "Yes").alias("accepts_sms_marketing"),
    )


def bill_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mobile x store with the last bill's date."""
    return bills(spark, sf_dir).groupBy(F.col("mobile_number").alias("mobile"), "store_code").agg(F.max("bill_date").alias("last_bill_date"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", mobile("user_id").alias("mobile_number"), F.md5(mobile("user_id")).alias("customer_id"), F.col("event_type").alias("event_name"), F.col("ts").alias("event_ts"), "value", F.from_json("props", "map<string,string>").alias("properties"))


#: The same tables for DuckDB, as the heads of queries.
SQL = {
    "loc": """loc AS (SELECT CAST(s_suppkey AS VARCHAR) AS store_code, s_name AS store_name, CASE s_suppkey % 4 WHEN 0 THEN 'Hyper' WHEN 1 THEN 'Large' WHEN 2 THEN 'Super' ELSE 'Daily' END AS store_format,
      n_name AS store_state, r_name AS store_zone FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "bills": """bills AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS bill_id, '9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS mobile_number, CAST(o_orderdate AS DATE) AS bill_date, CAST(o_orderkey % 10 AS VARCHAR) AS store_code,
      (o_orderkey * 37) % 86400 AS start_secs, ((o_orderkey * 37) % 86400 + 60 + (o_orderkey * 13) % 1800) % 86400 AS end_secs FROM orders)""",
    "bl": """bl AS (SELECT b.*, l_linenumber AS line_item_no, CAST(l_extendedprice AS DECIMAL(15,2)) AS gross_sale_value, CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2)), 2) AS DECIMAL(15,2)) AS total_discount, CAST(l_quantity AS DECIMAL(12,3)) AS billed_qty,
      l_returnflag = 'R' AS sales_return, CASE WHEN l_linestatus = 'O' THEN 'Online' ELSE 'Store' END AS delivery_channel, CASE WHEN l_discount >= 0.05 THEN 'P' END AS promo_indicator,
      CAST(p_partkey AS VARCHAR) AS article, p_name AS article_desc, p_brand AS brand_name, p_type AS segment_desc, p_type || '/' || CAST(p_size % 5 AS VARCHAR) AS family_desc, p_brand AS brick_desc,
      store_name AS store_desc, store_format, store_state AS region_desc, dayofweek(bill_date) IN (0, 6) AS weekend_flag, dayofweek(bill_date) = 3 AS wednesday_flag, day(bill_date) <= 7 AS first_week_flag,
      day(bill_date) >= day(last_day(bill_date)) - 6 AS last_week_flag, day(bill_date) <= 15 AS first_half_flag, dayname(bill_date) AS day_of_week
      FROM lineitem JOIN bills b ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN loc USING (store_code))""",
    "cih": """cih AS (SELECT '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS mobile, 'CIH_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '_' || CAST(k AS VARCHAR) AS surrogate_id, c_name AS name,
      CASE WHEN c_custkey % 4 <> 0 THEN 'u' || CAST(c_custkey % 500 AS VARCHAR) || '@example.com' END AS email, n_name AS city, CAST(c_custkey % 100 + 600000 AS VARCHAR) AS pincode, r_name AS region, CAST(c_custkey % 10 AS VARCHAR) AS registered_store,
      CAST(c_custkey % 70 + 15 AS INTEGER) AS age, c_mktsegment AS customer_group, CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS whatsapp, CASE WHEN c_custkey % 7 = 0 THEN 'Y' WHEN c_custkey % 7 < 4 THEN 'N' END AS dnd,
      CASE WHEN c_custkey % 5 = 0 THEN 'No' ELSE 'Yes' END AS accepts_email_marketing, CASE WHEN c_custkey % 6 = 0 THEN 'No' WHEN c_custkey % 6 < 4 THEN 'Yes' END AS accepts_sms_marketing
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT unnest([1, 2]) AS k) ON k = 1 OR c_custkey % 10 = 0 WHERE c_custkey % 3 <> 0)""",
    "ids": "ids AS (SELECT mobile_number AS mobile, store_code, max(bill_date) AS last_bill_date FROM bills GROUP BY ALL)",
}


def head(*names: str) -> str:
    """WITH clause of the named tables and what they need, in order."""
    needs = {"bl": ["loc", "bills"], "ids": ["bills"]}
    order: list[str] = []
    for n in names:
        for x in (*needs.get(n, []), n):
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(SQL[n] for n in order)
