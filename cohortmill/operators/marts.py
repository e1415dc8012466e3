"""Marts over bill lines: bill summary, channel, product and store rollups, customer transactions, behaviour.

Lines have the columns of the staging layer. The as-of date is a parameter; ties end in a unique key, nulls are ordered
explicitly. Distinct counts run over pre-aggregated grains (bills, days, customers, customer x article), and at the customer
grain over sets that the calendar and the number of stores bound, so no row is expanded once per distinct count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.functions.cleaning import day, seconds_of_day
from cohortmill.functions.storage import written
from cohortmill.functions.windows import first_rows, ntiles

MONEY = "decimal(15,2)"
#: Thresholds of the first segmentation: spend per bill and visits, for large stores and for the others.
L1_DEFAULT = {"large": (1400, 4), "small": (750, 5)}
LARGE_FORMATS = ("Large", "LARGE", "Hyper")
#: Days without a bill that bound the states of the second segmentation.
L2_DAYS = (30, 60, 120, 180)
#: Columns of spending_of_parts.
SPENDING = ["first_bill_date", "last_bill_date", "total_bills", "total_spend", "recency_days", "tenure_days", "spend_per_bill", "channel_presence"]
LIFECYCLE_DAYS = ((30, "Active"), (90, "At Risk"), (180, "Lapsed"))


def ratio(a: Column, b: Column) -> Column:
    """a / b to two digits; null for b = 0."""
    return F.round(a.cast("decimal(20,2)") / F.nullif(b.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), 2).cast(MONEY)


def kept(lines: DataFrame) -> DataFrame:
    return lines.where(~F.coalesce("sales_return", F.lit(False)))


def bill_summary(lines: DataFrame) -> DataFrame:
    """Bill grain, returns included. billing_time_secs may be negative across midnight."""
    return lines.groupBy("bill_id", "mobile_number", "bill_date", "store_code", "store_format", "day_of_week").agg(
        F.count("*").alias("line_items"), F.sum("gross_sale_value").cast(MONEY).alias("bill_value"), F.sum("total_discount").cast(MONEY).alias("bill_discount"), F.count_distinct("article").alias("articles"),
        F.bool_or("sales_return").alias("has_return"), F.bool_or(F.col("promo_indicator").eqNullSafe("P")).alias("has_promo"), F.bool_or("weekend_flag").alias("weekend_flag"), F.bool_or("wednesday_flag").alias("wednesday_flag"),
        F.max("delivery_channel").alias("delivery_channel"), (F.max("end_secs") - F.min("start_secs")).alias("billing_time_secs"),
    )


def bill_summary_full(lines: DataFrame) -> DataFrame:
    """Bill grain by all ten keys, returns included, with amounts, times, gift and liquidity flags. billing_time_secs is null
    where the times aren't hh:mm:ss, and negative across midnight."""
    flag = lambda c, name: F.bool_or(F.coalesce(c, F.lit(False))).alias(name)
    money = lambda c: F.sum(c).cast(MONEY).alias(c)
    out = lines.groupBy("bill_date", "store_code", "store_format", "till_no", "bill_no", "bill_id", "mobile_number", "region", "city", "delivery_channel").agg(
        F.max("store_desc").alias("store_desc"), F.count("*").alias("line_item_count"), money("gross_sale_value"), money("total_discount"), money("total_mrp_value"), F.min("bill_start_time").alias("bill_start_time"), F.max("bill_end_time").alias("bill_end_time"),
        F.bool_or("sales_return").alias("sales_return"), flag(F.col("promo_indicator") == "P", "promo_applied"), flag(F.col("gift_item_indicator") == "Y", "gift_indicator"), flag(F.trim("liquidity_type") == "LQ", "liquidity_indicator"),
        F.bool_or("weekend_flag").alias("weekend_flag"), F.bool_or("wednesday_flag").alias("wednesday_flag"), F.max("day_of_week").alias("day_of_week"),
    )
    return out.withColumn("billing_time_secs", seconds_of_day(F.col("bill_end_time")) - seconds_of_day(F.col("bill_start_time")))


def daily_store_sales_full(lines: DataFrame) -> DataFrame:
    """Day x store x article with all codes and descriptions, without returns. Bills are counted over the (keys, bill)
    grain, so no row is expanded for the distinct count."""
    keys = ["bill_date", "store_code", "article", "article_desc", "segment", "segment_desc", "family", "family_desc", "class", "class_desc", "brick", "brick_desc", "brand", "brand_name", "store_format", "region", "region_desc", "city", "city_desc"]
    bill = kept(lines).where("article IS NOT NULL").groupBy(*keys, "bill_id").agg(F.sum("billed_qty").alias("q"), F.sum("gross_sale_value").alias("g"), F.sum("total_discount").alias("d"), F.count("*").alias("n"))
    out = bill.groupBy(*keys).agg(
        F.sum("q").cast("decimal(18,3)").alias("quantity"), F.sum("g").cast(MONEY).alias("gross_sales"), F.sum("d").cast(MONEY).alias("discount_amount"), F.sum(F.col("g") - F.coalesce("d", F.lit(0))).cast(MONEY).alias("net_sales"),
        F.sum("n").alias("line_item_count"), F.count("bill_id").alias("num_bills"),
    )
    return out.withColumn("sales_channel", F.lit("OFFLINE")).withColumnsRenamed({"segment": "segment_code", "region": "region_code"})


def total_sales(lines: DataFrame, keys: list[str], cost: str | None = None) -> DataFrame:
    """Sales, net sales and quantity by the keys, without returns; with a cost column also cost and margin."""
    net = F.col("gross_sale_value") - F.col("total_discount")
    out = kept(lines).groupBy(*keys).agg(F.sum("gross_sale_value").cast(MONEY).alias("total_sales"), F.sum(net).cast(MONEY).alias("net_sales"), F.sum("billed_qty").cast("decimal(18,3)").alias("quantity"), *([F.sum(cost).cast(MONEY).alias("total_cost")] if cost else []))
    return out.withColumn("margin", (F.col("net_sales") - F.col("total_cost")).cast(MONEY)) if cost else out


def channel_summary(lines: DataFrame) -> DataFrame:
    return channel_summary_of_bills(bill_channel_grain(lines))


def channel_pivot(channels: DataFrame) -> DataFrame:
    return channels.groupBy("mobile_number").agg(*(F.max(F.when(F.col("delivery_channel") == c, F.col(v))).alias(f"{c.lower()}_{v}") for v in ("spend", "bills") for c in ("Store", "Online")))


def product_summary(lines: DataFrame) -> DataFrame:
    """Bills and days are counted grain by grain (bill, then day, then product); a bill has one date."""
    keys = ["mobile_number", "brick_desc", "segment_desc", "family_desc"]
    bill = kept(lines).groupBy(*keys, "bill_id").agg(F.min("bill_date").alias("d"), F.sum("gross_sale_value").alias("s"), F.sum("billed_qty").alias("q"))
    day_ = bill.groupBy(*keys, "d").agg(F.count("bill_id").alias("b"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return day_.groupBy(*keys).agg(F.sum("b").alias("bills"), F.count("d").alias("visits"), F.sum("s").cast(MONEY).alias("spend"), F.sum("q").cast("decimal(18,3)").alias("quantity"))


def daily_store_sales(lines: DataFrame) -> DataFrame:
    """Bills and customers are counted grain by grain (bill, then customer, then the keys), so no row is expanded for a distinct
    count; a bill has one customer."""
    keys = ["bill_date", "store_code", "store_desc", "store_format", "region_desc", "article", "article_desc", "brand_name", "segment_desc", "family_desc", "delivery_channel"]
    net = F.col("gross_sale_value") - F.col("total_discount")
    bill = kept(lines).groupBy(*keys, "mobile_number", "bill_id").agg(F.sum("gross_sale_value").alias("g"), F.sum("total_discount").alias("d"), F.sum(net).alias("n"), F.sum("billed_qty").alias("q"))
    sums = [F.sum(c).alias(c) for c in "gdnq"]
    who = bill.groupBy(*keys, "mobile_number").agg(F.count("bill_id").alias("b"), *sums)
    out = who.groupBy(*keys).agg(
        F.sum("g").cast(MONEY).alias("gross_sales"), F.sum("d").cast(MONEY).alias("discount"), F.sum("n").cast(MONEY).alias("net_sales"), F.sum("q").cast("decimal(18,3)").alias("quantity"),
        F.sum("b").alias("bills"), F.count("mobile_number").alias("customers"),
    )
    return out.withColumn("channel", F.lit("OFFLINE"))


def article_grain(lines: DataFrame) -> DataFrame:
    """Customer x article: spend and number of bills."""
    return kept(lines).groupBy("mobile_number", "article").agg(F.sum("gross_sale_value").cast(MONEY).alias("spend"), F.count_distinct("bill_id").alias("nob"), F.max("article_desc").alias("article_desc"))


def customer_base(lines: DataFrame, as_of: str) -> DataFrame:
    """Customer grain without returns. Bills are summed up first; a bill has one date and store."""
    bill = kept(lines).groupBy("mobile_number", "bill_id").agg(F.min("bill_date").alias("d"), F.min("store_code").alias("s"), F.sum("gross_sale_value").alias("spend"), F.sum("total_discount").alias("discount"), F.count("*").alias("items"))
    base = bill.groupBy("mobile_number").agg(
        F.min("d").alias("first_bill_date"), F.max("d").alias("last_bill_date"), F.count("*").alias("total_bills"), F.size(F.collect_set("d")).cast("long").alias("total_visits"), F.sum("spend").cast(MONEY).alias("total_spend"), F.sum("items").alias("_items"),
        F.sum("discount").cast(MONEY).alias("total_discount"), F.size(F.collect_set(F.trunc("d", "month"))).cast("long").alias("distinct_months"), F.size(F.collect_set("s")).cast("long").alias("distinct_store_count"),
    )
    base = base.withColumn("recency_days", F.datediff(day(as_of), "last_bill_date")).withColumn("tenure_days", F.datediff(day(as_of), "first_bill_date"))
    base = base.withColumn("spend_per_bill", ratio(F.col("total_spend"), F.col("total_bills"))).withColumn("spend_per_visit", ratio(F.col("total_spend"), F.col("total_visits")))
    articles = article_grain(lines).groupBy("mobile_number").agg(F.count("*").alias("distinct_article_count"))
    return base.withColumn("avg_items_per_bill", ratio(F.col("_items"), F.col("total_bills"))).drop("_items").join(articles, "mobile_number")


def bill_flags(summary: DataFrame) -> DataFrame:
    """Customer grain, returns included, as the flags of bills are counted."""
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias
    t = F.col("billing_time_secs")
    return summary.groupBy("mobile_number").agg(
        F.datediff(F.max("bill_date"), F.min("bill_date")).alias("dgbt_fs"), F.coalesce(F.round(F.sum(F.when((t > 0) & (t < 7200), t)).cast("decimal(20,2)") / F.nullif(F.count(F.when((t > 0) & (t < 7200), 1)), F.lit(0)).cast("decimal(20,0)"), 2), F.lit(0)).cast(MONEY).alias("avg_billing_time_secs"),
        one("has_return")("return_bill_count"), one("has_promo")("promo_bill_count"), one("weekend_flag")("weekend_bill_count"), one("wednesday_flag")("wednesday_bill_count"),
    )


def bill_channel_grain(lines: DataFrame) -> DataFrame:
    """Customer x bill x channel, returns included; _items, _spend and what begins with _ counts lines that aren't returns."""
    sale = ~F.coalesce("sales_return", F.lit(False))
    own = lambda f, c: f(F.when(sale, F.col(c)))
    return lines.groupBy("mobile_number", "bill_id", "delivery_channel").agg(
        F.min("bill_date").alias("bill_date"), own(F.min, "bill_date").alias("_d"), own(F.min, "store_code").alias("_s"), own(F.max, "store_desc").alias("_desc"), own(F.max, "store_format").alias("_format"), own(F.min, "day_of_week").alias("_day"),
        own(F.sum, "gross_sale_value").alias("_spend"), own(F.sum, "total_discount").alias("_discount"), F.count(F.when(sale, 1)).alias("_items"),
        F.bool_or("sales_return").alias("has_return"), F.bool_or(F.col("promo_indicator").eqNullSafe("P")).alias("has_promo"), F.bool_or("weekend_flag").alias("weekend_flag"), F.bool_or("wednesday_flag").alias("wednesday_flag"),
        F.max("end_secs").alias("_end"), F.min("start_secs").alias("_start"),
    )


def bill_channels_of_parts(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """bill_channel_grain where lines (by bill_id) and headers of bills still lie apart: lines are summed up before they meet their
    bill, so no line is sorted or carries its bill's texts. Lines go to their bill once, for the sums and for the join. A bill_id of
    several headers has a row for each; bills_of_channels sums them up."""
    sale = ~F.coalesce("sales_return", F.lit(False))
    own = lambda f, c: f(F.when(sale, F.col(c)))
    sums = lines.repartition("bill_id").groupBy("bill_id", "delivery_channel").agg(
        own(F.sum, "gross_sale_value").alias("_spend"), own(F.sum, "total_discount").alias("_discount"), F.count(F.when(sale, 1)).alias("_items"),
        F.bool_or("sales_return").alias("has_return"), F.bool_or(F.col("promo_indicator").eqNullSafe("P")).alias("has_promo"),
    )
    sold = {"_d": "bill_date", "_s": "store_code", "_desc": "store_desc", "_format": "store_format", "_day": "day_of_week"}
    return sums.join(headers, "bill_id").select(
        "mobile_number", "bill_id", "delivery_channel", "bill_date", *(F.when(F.col("_items") > 0, F.col(c)).alias(name) for name, c in sold.items()),
        "_spend", "_discount", "_items", "has_return", "has_promo", "weekend_flag", "wednesday_flag", F.col("end_secs").alias("_end"), F.col("start_secs").alias("_start"),
    )


def bills_of_channels(grain: DataFrame) -> DataFrame:
    """Customer x bill, from customer x bill x channel; channels: what each channel sold of it."""
    channel = F.when(F.col("_items") > 0, F.col("delivery_channel"))
    least = [F.min(c).alias(c) for c in ("bill_date", "_d", "_s", "_day")]
    most = [F.max(c).alias(c) for c in ("_desc", "_format")]
    sums = [F.sum(c).alias(c) for c in ("_spend", "_discount", "_items")]
    flags = [F.bool_or(c).alias(c) for c in ("has_return", "has_promo", "weekend_flag", "wednesday_flag")]
    return grain.groupBy("mobile_number", "bill_id").agg(*least, *most, *sums, *flags, F.min(channel).alias("_lo"), F.max(channel).alias("_hi"), (F.max("_end") - F.min("_start")).alias("billing_time_secs"), F.collect_list(F.when(F.col("_items") > 0, F.struct("delivery_channel", "_d", "_spend", "_items"))).alias("channels"))


def channels_of_bills(bills: DataFrame) -> DataFrame:
    """Customer x bill x channel again, of what was sold, from the bill grain."""
    return bills.select("mobile_number", "bill_id", F.inline("channels"))


def channel_summary_of_bills(grain: DataFrame) -> DataFrame:
    """channel_summary from customer x bill x channel: bills are counted, not gathered."""
    day_grain = grain.where("_items > 0").groupBy("mobile_number", "delivery_channel", "_d").agg(F.count("bill_id").alias("b"), F.sum("_spend").alias("s"))
    g = day_grain.groupBy("mobile_number", "delivery_channel").agg(F.sum("b").alias("bills"), F.count("_d").alias("visits"), F.sum("s").cast(MONEY).alias("spend"))
    return g.withColumn("spend_per_bill", ratio(F.col("spend"), F.col("bills"))).withColumn("spend_per_visit", ratio(F.col("spend"), F.col("visits")))


def spending_of_parts(lines: DataFrame, headers: DataFrame, as_of: str) -> DataFrame:
    """Of customers_of_bills the columns that need no sets, modes or texts of bills: SPENDING, from lines (by bill_id) and headers of
    bills. Lines are summed up before they meet their bill, channels are told apart by their hashes, so that all is aggregated by
    hash, without a sort; no bill is written."""
    sold = lines.where(~F.coalesce("sales_return", F.lit(False))).select("bill_id", "gross_sale_value", F.when(F.col("delivery_channel").isNotNull(), F.xxhash64("delivery_channel")).alias("_channel"))
    channels = [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    sums = sold.repartition("bill_id").groupBy("bill_id").agg(F.sum("gross_sale_value").alias("_spend"), F.min("_channel").alias("_lo"), F.max("_channel").alias("_hi"))
    bills = sums.join(headers.select("bill_id", "mobile_number", "bill_date"), "bill_id").groupBy("mobile_number", "bill_id").agg(F.min("bill_date").alias("_d"), F.sum("_spend").alias("_spend"), *channels)
    out = bills.groupBy("mobile_number").agg(F.min("_d").alias("first_bill_date"), F.max("_d").alias("last_bill_date"), F.count("*").alias("total_bills"), F.sum("_spend").cast(MONEY).alias("total_spend"), *channels)
    presence = F.when(F.col("_lo") != F.col("_hi"), "Omni").when(F.col("_hi") == F.xxhash64(F.lit("Online")), "Online").otherwise("Offline")
    out = out.withColumns({"recency_days": F.datediff(day(as_of), "last_bill_date"), "tenure_days": F.datediff(day(as_of), "first_bill_date"), "spend_per_bill": ratio(F.col("total_spend"), F.col("total_bills")), "channel_presence": presence})
    return out.select("mobile_number", *SPENDING)


def bill_grain(lines: DataFrame) -> DataFrame:
    """Customer x bill, returns included; _items, _spend and what begins with _ counts lines that aren't returns."""
    return bills_of_channels(bill_channel_grain(lines))


def customer_grain(bills: DataFrame, as_of: str) -> DataFrame:
    """What customer_base (but for articles), bill_flags, favourite_day and channel_presence say, in one aggregation of the
    bill grain. Customers with returns only are left out."""
    sold = F.col("_items") > 0
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias
    t = F.col("billing_time_secs")
    timed = F.when((t > 0) & (t < 7200), t)
    out = bills.groupBy("mobile_number").agg(
        F.min("_d").alias("first_bill_date"), F.max("_d").alias("last_bill_date"), F.count(F.when(sold, 1)).alias("total_bills"), F.size(F.collect_set("_d")).cast("long").alias("total_visits"), F.sum("_spend").cast(MONEY).alias("total_spend"), F.sum("_items").alias("_n"),
        F.sum("_discount").cast(MONEY).alias("total_discount"), F.size(F.collect_set(F.trunc("_d", "month"))).cast("long").alias("distinct_months"), F.size(F.collect_set("_s")).cast("long").alias("distinct_store_count"),
        F.datediff(F.max("bill_date"), F.min("bill_date")).alias("dgbt_fs"), F.coalesce(F.round(F.sum(timed).cast("decimal(20,2)") / F.nullif(F.count(timed), F.lit(0)).cast("decimal(20,0)"), 2), F.lit(0)).cast("decimal(15,2)").alias("avg_billing_time_secs"),
        one("has_return")("return_bill_count"), one("has_promo")("promo_bill_count"), one("weekend_flag")("weekend_bill_count"), one("wednesday_flag")("wednesday_bill_count"),
        F.mode("_day", True).alias("fav_day"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
    ).where("total_bills > 0")
    out = out.withColumn("recency_days", F.datediff(day(as_of), "last_bill_date")).withColumn("tenure_days", F.datediff(day(as_of), "first_bill_date"))
    out = out.withColumn("spend_per_bill", ratio(F.col("total_spend"), F.col("total_bills"))).withColumn("spend_per_visit", ratio(F.col("total_spend"), F.col("total_visits")))
    presence = F.when(F.col("_lo") != F.col("_hi"), "Omni").when(F.col("_hi") == "Online", "Online").otherwise("Offline")
    return out.withColumn("avg_items_per_bill", ratio(F.col("_n"), F.col("total_bills"))).withColumn("channel_presence", presence).drop("_n", "_lo", "_hi")


def favourite_store(lines: DataFrame) -> DataFrame:
    """The store with most visits, then most spend."""
    g = kept(lines).groupBy("mobile_number", "store_code").agg(F.max("store_desc").alias("fav_store_name"), F.max("store_format").alias("fav_store_type"), F.size(F.collect_set("bill_date")).alias("v"), F.sum("gross_sale_value").alias("s"))
    return _first_store(g)


def favourite_store_of_bills(bills: DataFrame) -> DataFrame:
    """favourite_store from the bill grain."""
    sold = bills.where("_items > 0").groupBy("mobile_number", F.col("_s").alias("store_code"))
    return _first_store(sold.agg(F.max("_desc").alias("fav_store_name"), F.max("_format").alias("fav_store_type"), F.size(F.collect_set("_d")).alias("v"), F.sum("_spend").alias("s")))


def _first_store(g: DataFrame) -> DataFrame:
    # An aggregation, not a window: who asks for no favourite store has it pruned, and a customer's stores needn't be sorted.
    best = F.min_by(F.struct("store_code", "fav_store_name", "fav_store_type"), F.struct(-F.col("v"), F.col("s").isNull(), -F.col("s"), "store_code"))
    return g.groupBy("mobile_number").agg(best.alias("b")).select("mobile_number", F.col("b.store_code").alias("fav_store_code"), "b.fav_store_name", "b.fav_store_type")


def favourite_day(lines: DataFrame) -> DataFrame:
    g = kept(lines).groupBy("mobile_number", "day_of_week").agg(F.count_distinct("bill_id").alias("b"))
    return first_rows(g, ["mobile_number"], [F.desc("b"), F.asc("day_of_week")]).select("mobile_number", F.col("day_of_week").alias("fav_day"))


def favourite_articles(lines: DataFrame, count: bool = False) -> DataFrame:
    """First and second article by spend and by number of bills, from one pass over customer x article; count adds the
    number of articles. Bills go to their customer once, for the articles and for their ranks."""
    bill = kept(lines).groupBy("mobile_number", "article", "bill_id").agg(F.sum("gross_sale_value").alias("spend"), F.max("article_desc").alias("article_desc"))
    g = bill.repartition("mobile_number").groupBy("mobile_number", "article").agg(F.sum("spend").cast(MONEY).alias("spend"), F.count("bill_id").alias("nob"), F.max("article_desc").alias("article_desc"))
    rank = lambda *order: F.row_number().over(Window.partitionBy("mobile_number").orderBy(*order, F.asc("article")))
    g = g.withColumn("rs", rank(F.desc_nulls_last("spend"))).withColumn("rn", rank(F.desc("nob")))
    if not count:
        g = g.where("rs <= 2 OR rn <= 2")
    pick = lambda r, n, c, name: F.max(F.when(F.col(r) == n, F.col(c))).alias(name)
    return g.groupBy("mobile_number").agg(
        pick("rs", 1, "article", "fav_article_by_spend"), pick("rs", 1, "article_desc", "fav_article_by_spend_desc"), pick("rn", 1, "article", "fav_article_by_nob"), pick("rn", 1, "article_desc", "fav_article_by_nob_desc"),
        pick("rs", 2, "article", "second_fav_article_by_spend"), pick("rn", 2, "article", "second_fav_article_by_nob"),
        *([F.count("*").alias("distinct_article_count")] if count else []),
    )


def channel_presence(lines: DataFrame) -> DataFrame:
    g = kept(lines).groupBy("mobile_number").agg(F.min("delivery_channel").alias("lo"), F.max("delivery_channel").alias("hi"))
    return g.select("mobile_number", F.when(F.col("lo") != F.col("hi"), "Omni").when(F.col("hi") == "Online", "Online").otherwise("Offline").alias("channel_presence"))


def l1_segment(thresholds: Mapping[str, tuple[float, int]] = L1_DEFAULT) -> Column:
    """High or low value and frequency, by the favourite store's size."""

    def cells(spend: float, visits: int) -> Column:
        v, f = F.col("spend_per_bill") >= spend, F.col("total_visits") > visits
        return F.when(v & f, "HVHF").when(~v & f, "LVHF").when(v & ~f, "HVLF").otherwise("LVLF")

    return F.when(F.col("fav_store_type").isin(*LARGE_FORMATS), cells(*thresholds["large"])).otherwise(cells(*thresholds["small"]))


def l2_segment(visits: tuple[int, int] = (4, 5), months: int = 3, days: tuple[int, int, int, int] = L2_DAYS) -> Column:
    """Loyalty by recency, visits and months with bills."""
    r, v, m = F.col("recency_days"), F.col("total_visits"), F.col("distinct_months")
    high = F.when(F.col("fav_store_type").isin(*LARGE_FORMATS), v >= visits[0]).otherwise(v >= visits[1])
    new = F.col("tenure_days") <= days[0]
    return (
        F.when((r <= days[0]) & high & (m >= months), "STAR").when((r <= days[1]) & (v >= visits[0]) & (m >= months), "LOYAL").when(new, "New")
        .when((r <= days[0]) & (F.col("dgbt_fs") > days[3]), "Win Back").when(r <= days[1], "ACTIVE").when(r <= days[2], "Inactive").when(r <= days[3], "LAPSER").otherwise("Deep Lapsed")
    )


def transaction_summary(lines: DataFrame, as_of: str, l1: Mapping[str, tuple[float, int]] = L1_DEFAULT, deciles: bool = True) -> DataFrame:
    """The customer transaction summary, from two grains: bills and customer x article. All parts share the key
    mobile_number, so the joins keep its partitioning. The bounds of the deciles are counted at once, over the ranked columns
    alone, and the bills are written once for them; deciles=False leaves these columns out."""
    bills = bill_grain(lines)
    return transactions_of_grains(written(bills) if deciles else bills, favourite_articles(lines, count=True), as_of, l1, deciles)


def transactions_of_grains(bills: DataFrame, articles: DataFrame, as_of: str, l1: Mapping[str, tuple[float, int]] = L1_DEFAULT, deciles: bool = True) -> DataFrame:
    """transaction_summary from its grains: bills, and the favourite articles of each customer. With deciles the customers are
    written once, before their articles are joined: bounds, ranks and whoever asks read these."""
    out = customers_of_bills(bills, as_of)
    return transactions_of_customers(with_deciles(written(out)) if deciles else out, articles, l1)


def customers_of_bills(bills: DataFrame, as_of: str) -> DataFrame:
    """Customer grain with the favourite store."""
    return customer_grain(bills, as_of).join(favourite_store_of_bills(bills), "mobile_number", "left")


def with_deciles(customers: DataFrame) -> DataFrame:
    return ntiles(customers, "mobile_number", {"spend_decile": (10, F.col("total_spend"), False), "nob_decile": (10, F.col("total_bills"), False)})


def transactions_of_customers(customers: DataFrame, articles: DataFrame, l1: Mapping[str, tuple[float, int]] = L1_DEFAULT) -> DataFrame:
    """The customers with their favourite articles and segments."""
    return customers.join(articles, "mobile_number", "left").withColumn("l1_segment", l1_segment(l1)).withColumn("l2_segment", l2_segment())


def lifecycle(recency: Column) -> Column:
    out = F.when(recency.isNull(), "Registered")
    for days, name in LIFECYCLE_DAYS:
        out = out.when(recency <= days, name)
    return out.otherwise("Churned")


def profiled(profiles: DataFrame, transactions: DataFrame) -> DataFrame:
    """The profiles' own columns, as the mart names them, with what is known of each customer."""
    p = profiles.select(F.col("unified_id").alias("customer_id"), F.col("canonical_mobile").alias("mobile"), *[c for c in profiles.columns if c not in ("unified_id", "canonical_mobile", "mobile", "customer_id")])
    return p.join(transactions.withColumnRenamed("mobile_number", "mobile"), "mobile", "left")


def behavioral(profiles: DataFrame, transactions: DataFrame, channels: DataFrame, scores: bool = True) -> DataFrame:
    """One wide row for each profile: its own columns, transactions, channels, lifecycle and RFM scores (left out by scores=False)."""
    out = profiled(profiles, transactions).join(channel_pivot(channels).withColumnRenamed("mobile_number", "mobile"), "mobile", "left")
    out = out.withColumn("lifecycle_stage", lifecycle(F.col("recency_days")))
    if not scores:
        return out
    asked = {"rfm_recency_score": (F.coalesce("recency_days", F.lit(9999)), True), "rfm_frequency_score": (F.coalesce("total_bills", F.lit(0)), False), "rfm_monetary_score": (F.coalesce("total_spend", F.lit(0).cast(MONEY)), False)}
    return ntiles(out, "customer_id", {name: (5, value, down) for name, (value, down) in asked.items()})


def intended_nob(lines: DataFrame, level: str) -> DataFrame:
    """Bills, amount and average bill by customer and product level (class, family, segment ...)."""
    g = kept(lines).groupBy("mobile_number", level).agg(F.count_distinct("bill_id").alias("num_bills"), F.sum("gross_sale_value").cast(MONEY).alias("total_amount"))
    return g.withColumn("avg_bill_value", ratio(F.col("total_amount"), F.col("num_bills")))


def target_achievement(actual: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with actuals (0 where there are none), variance and achievement in percent."""
    out = targets.join(actual, keys, "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast(MONEY))
    return out.withColumn("variance", F.col("actual") - F.col("target")).withColumn("achievement_pct", F.round(F.try_divide(F.col("actual") * 100, F.col("target")), 2))
