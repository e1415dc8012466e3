"""Staging: raw text tables, typed and cleaned. Every raw column is a string; missing ones count as null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import cleaning as c
from cohortmill.functions.windows import first_rows

MONEY = "decimal(15,2)"
#: Raw columns of a bill line that are only trimmed, with their staged names. Fixed values.
TRIMMED = {
    "plant": "store_code", "plant_desc": "store_desc", "store_format": "store_format", "city": "city", "city_desc": "city_desc", "region": "region", "region_desc": "region_desc", "till_no": "till_no", "bill_no": "bill_no",
    "condition_type": "condition_type", "promo_indicator": "promo_indicator", "cashier_no": "cashier_no", "cashier_name": "cashier_name", "article": "article", "article_desc": "article_desc", "segment": "segment", "segment_desc": "segment_desc",
    "family": "family", "family_desc": "family_desc", "class": "class", "class_desc": "class_desc", "brick": "brick", "brick_desc": "brick_desc", "manufacturer": "manufacturer", "manufacturer_name": "manufacturer_name", "brand": "brand", "brand_name": "brand_name",
    "base_unit": "base_unit", "gift_item_indicator": "gift_item_indicator", "liquidity_type": "liquidity_type", "bill_start_time": "bill_start_time", "bill_end_time": "bill_end_time",
}
AMOUNTS = ("billed_mrp", "billed_qty", "total_mrp_value", "gross_sale_value", "total_discount", "vka0_discount_value", "ka04_discount_value", "ka02_discount_value", "z006_discount_value", "z007_discount_value", "zpro_discount_value", "zfre_discount_value", "zcat_discount_value", "zemp_discount_value", "zbil_discount_value", "total_manual_bill_disc")


def bill_transactions(raw: DataFrame, strict: bool = False, strict_mobile: bool = False) -> DataFrame:
    """Bill lines. Rows need a date like yyyy-mm-dd; header rows that were read as data go."""
    raw = raw.select(*c.select_or_null(raw, ["bill_date", "line_item_no", "sales_return", "mobile_number", *TRIMMED, *AMOUNTS]))
    raw = raw.where(F.col("bill_date").rlike(r"^\d{4}-\d{2}-\d{2}"))
    date = F.substring(F.trim("bill_date"), 1, 10).try_cast("date")
    amounts = {a: c.typed(F.col(a), "decimal(12,3)" if a == "billed_qty" else MONEY, strict) for a in AMOUNTS}
    out = raw.select(
        c.bill_id(F.col("plant"), F.col("bill_no"), F.col("bill_date")).alias("bill_id"), c.typed(F.col("line_item_no"), "int", strict).alias("line_item_no"), date.alias("bill_date"), c.mobile_pos(F.col("mobile_number"), strict_mobile).alias("mobile_number"),
        *(F.trim(old).alias(new) for old, new in TRIMMED.items()), *(v.alias(k) for k, v in amounts.items()), F.coalesce(F.trim("sales_return") == "+", F.lit(False)).alias("sales_return"), c.delivery_channel(F.col("till_no")).alias("delivery_channel"),
        c.seconds_of_day(F.trim("bill_start_time")).alias("start_secs"), c.seconds_of_day(F.trim("bill_end_time")).alias("end_secs"),
    )
    return out.withColumns(c.calendar_flags(F.col("bill_date"))).withColumn("bill_month", F.date_format("bill_date", "yyyy-MM"))


def bill_identifiers(lines: DataFrame) -> DataFrame:
    return lines.where("mobile_number IS NOT NULL").groupBy(F.col("mobile_number").alias("mobile"), "store_code").agg(F.max("bill_date").alias("last_bill_date"))


def cih_profiles(raw: DataFrame) -> DataFrame:
    """The customer master; -1 and blanks are null, and rows without a mobile go."""
    text = ["name", "first_name", "last_name", "email_id", "city", "pincode", "street", "region", "store_code", "status", "dob", "customer_group", "occupation", "whatsapp", "dnd", "gw_customer_flag", "accepts_email_marketing", "accepts_sms_marketing"]
    raw = raw.select(*c.select_or_null(raw, ["brand_id", "age", "total_orders", "total_spent", "customer_surrogate_id", *text]))
    named = {"email_id": "email", "store_code": "registered_store"}
    clean = lambda x: F.nullif(c.unless(F.col(x), "-1"), F.lit(""))
    mobile = F.trim("brand_id")
    return raw.select(
        mobile.alias("mobile"), F.coalesce(clean("customer_surrogate_id"), F.concat(F.lit("CIH_"), F.md5(mobile))).alias("surrogate_id"), *(clean(x).alias(named.get(x, x)) for x in text),
        c.guarded(F.col("age"), r"^\d+$", "int").alias("age"), c.guarded(F.col("total_orders"), r"^\d+$", "int").alias("total_orders"), c.guarded(F.col("total_spent"), r"^[\d.]+$", MONEY).alias("total_spent"),
    ).where("mobile IS NOT NULL AND mobile NOT IN ('', '-1')")


def customers(raw: DataFrame, keep_prefixed: bool = False) -> DataFrame:
    raw = raw.select(*c.select_or_null(raw, ["mobile", "name", "address", "pincode", "created_at", "last_updated_on"]))
    return raw.select(c.mobile_crm(F.col("mobile"), keep_prefixed).alias("mobile"), F.upper(F.trim("name")).alias("name"), F.trim("address").alias("address"), F.trim("pincode").alias("pincode"), F.col("created_at").try_cast("timestamp").alias("created_at"), F.col("last_updated_on").try_cast("timestamp").alias("last_updated_on")).where("mobile IS NOT NULL")


def identifiers(raw: DataFrame, mobile: str = "mobile", name: str | None = None, email: str | None = None, store: str | None = None, keep_prefixed: bool = False) -> DataFrame:
    """mobile, name, email, store_code of a source of service records (surveys, feedback, cashback)."""
    pick = lambda x: F.nullif(F.trim(x), F.lit("")) if x else F.lit(None).cast("string")
    rows = raw.select(c.mobile_crm(F.col(mobile), keep_prefixed).alias("mobile"), F.upper(pick(name)).alias("name"), F.lower(pick(email)).alias("email"), pick(store).alias("store_code"))
    return rows.where("mobile IS NOT NULL").distinct()


def nps(raw: DataFrame, keep_prefixed: bool = False) -> DataFrame:
    rows = raw.select(c.mobile_crm(F.col("mobile"), keep_prefixed).alias("mobile"), F.trim("store_code").alias("store_code"), F.substring("bill_date", 1, 10).try_cast("date").alias("bill_date"), F.col("overall_rating").cast("int").alias("nps_score"))
    return rows.where("mobile IS NOT NULL").withColumn("nps_category", c.nps_category(F.col("nps_score")))


def articles(raw: DataFrame) -> DataFrame:
    text = ["article", "article_description", "segment", "segment_desc", "family", "family_desc", "class", "class_desc", "brick", "brick_desc", "manufacturer", "brand", "category", "status", "article_type", "base_uom", "ean_upc", "hsn_code"]
    raw = raw.select(*c.select_or_null(raw, [*text, "net_weight", "created_on", "last_change"]))
    return raw.select(*(F.trim(x).alias("article_code" if x == "article" else x) for x in text), c.guarded(F.col("net_weight"), r"^\d", "decimal(12,3)").alias("net_weight"), c.compact_date(F.trim("created_on")).alias("created_on"), c.compact_date(F.trim("last_change")).alias("last_change"))


def locations(raw: DataFrame) -> DataFrame:
    text = ["store_code", "store_name", "store_format", "store_zone", "store_business_region", "store_region_code", "store_state", "store_city_code", "store_city_description", "store_pincode", "store_address", "status"]
    raw = raw.select(*c.select_or_null(raw, [*text, "store_opening_date", "store_closing_date"]))
    return raw.select(*(F.trim(x).alias(x) for x in text), c.compact_date(F.trim("store_opening_date")).alias("store_opening_date"), c.compact_date(F.trim("store_closing_date")).alias("store_closing_date"))


def location_history(stores: DataFrame, as_of: str) -> DataFrame:
    """Snapshot of the stores in the form of a history: all current from the as-of date on."""
    return stores.withColumn("is_latest", F.lit(True)).withColumn("valid_from", c.day(as_of)).withColumn("valid_to", c.day("9999-12-31"))


def current_locations(history: DataFrame) -> DataFrame:
    return history.where("is_latest")


def last_file_wins(rows: DataFrame, key: str, file: str = "_source_file", line: str = "_line") -> DataFrame:
    """The last file's last row of each key; rows without a key go."""
    rows = rows.withColumn(key, F.trim(key)).where(F.col(key).isNotNull() & (F.col(key) != ""))
    return first_rows(rows, [key], [F.desc(file), F.desc(line)]).drop("rn")


def article_dimension(offline: DataFrame, online: DataFrame) -> DataFrame:
    """Articles of both catalogues in one list of columns, the missing ones null."""
    return offline.withColumn("catalogue", F.lit("offline")).unionByName(online.withColumn("catalogue", F.lit("online")), allowMissingColumns=True)


def date_dimension(spark, start: str = "2018-01-01", end: str = "2026-12-31") -> DataFrame:
    """One row a day, with the fiscal year and quarter that begin in April."""
    d = F.col("date_day")
    fiscal = F.add_months(d, -3)
    return spark.range(1).select(F.explode(F.sequence(c.day(start), c.day(end), F.expr("INTERVAL 1 DAY"))).alias("date_day")).select(
        "date_day", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.weekofyear(d).alias("iso_week"), F.dayofmonth(d).alias("day"), (F.dayofweek(d) - 1).alias("dow"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "EEEE").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), F.year(fiscal).alias("fiscal_year"), F.quarter(fiscal).alias("fiscal_quarter"),
    )


def scrubbed(df: DataFrame) -> DataFrame:
    """Strings fit for bulk loads: line ends and tabs as blanks, and texts that mean nothing as null."""
    clean = lambda x: c.unless(F.regexp_replace(x, r"[\r\n\t]+", " "), "nan", "None", "NaT", "")
    return df.select(*(clean(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))


def sentinel_nulls(df: DataFrame, sentinels: tuple[str, ...] = ("-1", "", "nan", "None", "NaT")) -> DataFrame:
    """All columns as strings, sentinels as null."""
    return df.select(*(c.unless(F.col(f"`{n}`").cast("string"), *sentinels).alias(n) for n in df.columns))

