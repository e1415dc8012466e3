"""Metrics of the lake tables by customer. All metrics that are asked of one table come from one groupBy over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions.cleaning import day


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(F.sum(part).cast("double") * 100.0, F.sum(whole).cast("double"))


def _when(c: Column, v: Column | None = None) -> Column:
    return F.when(c, F.lit(1) if v is None else v)


def _share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def basket(as_of: str) -> dict[str, Column]:
    """Over transactions, all channels: bill_id, customer_id, bill_date, channel, store_id, bill_total, discount_amount,
    line_item_count. Store metrics count store bills only, so that store-only customers can be told."""
    today, d = day(as_of), F.col("bill_date")
    store = F.col("channel") == "in_store"
    weekend = F.dayofweek(d).isin(1, 7)
    recent = lambda n: F.count_distinct(_when(store & (d >= F.date_sub(today, n)), F.col("bill_id")))
    return {
        "total_store_visits": F.count_distinct(_when(store, F.col("bill_id"))), "store_visits_30d": recent(30), "store_visits_90d": recent(90), "last_store_visit_date": F.max(_when(store, d)), "days_since_last_store_visit": F.datediff(today, F.max(_when(store, d))),
        "home_store_id": F.mode(_when(store, F.col("store_id")), True), "distinct_stores_visited": F.count_distinct(_when(store, F.col("store_id"))), "is_multi_store_shopper": F.count_distinct(_when(store, F.col("store_id"))) > 1,
        "in_store_revenue_total": F.sum(_when(store, F.col("bill_total"))), "in_store_aov": F.avg(_when(store, F.col("bill_total"))), "is_store_only_customer": F.bool_and(store), "is_weekend_shopper": F.avg(_when(store, F.when(weekend, 1.0).otherwise(0.0))) > 0.5, "weekend_visit_pct": F.avg(_when(store, F.when(weekend, 100.0).otherwise(0.0))),
        "avg_items_per_bill": F.avg(_when(store, F.col("line_item_count"))), "avg_basket_value": F.avg(_when(store, F.col("bill_total"))), "max_basket_value": F.max(_when(store, F.col("bill_total"))), "avg_unit_price": F.try_divide(F.sum(_when(store, F.col("bill_total"))), F.sum(_when(store, F.col("line_item_count")))),
        "avg_bill_discount_pct": F.avg(_when(store, F.try_divide(F.col("discount_amount") * 100.0, F.col("bill_total") + F.col("discount_amount")))),
    }


def basket_lines(none: float | None = 0) -> dict[str, Column]:
    """Over line items with their customer: sku_id, department, category, line_total, quantity, is_private_label, is_promo.
    none: the share of a department of which a customer has no line."""
    total = F.col("line_total")
    share = lambda c, other=0: _pct(F.when(c, total).otherwise(other), total)
    has = lambda name: F.coalesce(F.bool_or(F.col("category") == name), F.lit(False))
    return {
        "distinct_skus_purchased": F.count_distinct("sku_id"), "total_quantity_purchased": F.sum("quantity"), "fresh_produce_pct": share(F.col("department") == "fresh_produce", none), "packaged_food_pct": share(F.col("department") == "packaged_food", none), "non_food_pct": share(F.col("department") == "non_food", none),
        "private_label_pct": share(F.col("is_private_label")), "promo_items_pct": F.try_divide(F.count(_when(F.col("is_promo"))) * 100.0, F.count("sku_id")), "has_alcohol": has("alcohol"), "has_baby_products": has("baby"), "has_pet_products": has("pet"), "has_health_wellness": has("health_wellness"),
    }


def billing(as_of: str) -> dict[str, Column]:
    """Over utility bills."""
    today, d = day(as_of), F.col("bill_date")
    year = d >= F.add_months(today, -12)
    paid = F.col("payment_date")
    return {
        "total_bills_generated": F.count("*"), "current_outstanding": F.sum(_when(F.col("is_current"), F.col("outstanding_amount"))), "total_outstanding": F.sum("outstanding_amount"), "last_bill_amount": F.max_by("bill_amount", d), "last_bill_date": F.max(d), "last_payment_date": F.max(paid), "last_payment_amount": F.max_by("payment_amount", paid),
        "avg_bill_amount_12m": F.avg(_when(year, F.col("bill_amount"))), "consumption_kwh_last_month": F.max_by("consumption_kwh", d), "on_time_payment_rate": F.try_divide(F.count(_when(paid <= F.col("due_date"))) * 100.0, F.count(paid)), "late_payment_count_12m": F.count(_when((paid > F.col("due_date")) & year)),
        "avg_days_to_pay": F.avg(F.datediff(paid, d)), "has_partial_payments": F.coalesce(F.bool_or((F.col("payment_amount") > 0) & (F.col("payment_amount") < F.col("bill_amount"))), F.lit(False)), "disconnection_notice_count": F.count(_when(F.col("disconnection_notice"))),
    }


def complaints(as_of: str) -> dict[str, Column]:
    today, made = day(as_of), F.to_date("created_at")
    year = made >= F.add_months(today, -12)
    kind = F.col("complaint_type")
    return {
        "total_complaints": F.count("*"), "complaints_12m": F.count(_when(year)), "open_complaints": F.count(_when(F.col("status").isin("open", "in_progress", "assigned", "escalated"))), "last_complaint_date": F.max(made), "last_complaint_type": F.max_by("complaint_type", "created_at"), "last_complaint_status": F.max_by("status", "created_at"),
        "avg_resolution_time_hours": F.avg(F.timestamp_diff("HOUR", F.col("created_at"), F.col("resolved_at"))), "escalation_count": F.count(_when(F.col("is_escalated"))), "escalation_rate": F.try_divide(F.count(_when(F.col("is_escalated"))) * 100.0, F.count("*")),
        "outage_complaints_12m": F.count(_when((kind == "outage") & year)), "billing_dispute_count": F.count(_when(kind == "billing_dispute")), "has_regulatory_complaint": F.coalesce(F.bool_or(kind == "regulatory"), F.lit(False)),
    }


def digital(as_of: str) -> dict[str, Column]:
    d, channel, action = F.col("event_date"), F.col("channel"), F.col("action_type")
    recent = d >= F.date_sub(day(as_of), 90)
    login = action == "login"
    return {
        "portal_login_count_90d": F.count(_when((channel == "portal") & login & recent)), "app_login_count_90d": F.count(_when((channel == "app") & login & recent)), "last_digital_login_date": F.max(_when(login, d)),
        "self_service_usage_count_90d": F.count(_when((action == "self_service") & recent)), "whatsapp_bot_interactions": F.count(_when(channel == "whatsapp_bot")),
    }


def metrics(rows: DataFrame, of: dict[str, Column], asked: Sequence[str] | None = None, key: str = "customer_id") -> DataFrame:
    """The asked metrics (all, if none are named) by customer, in one aggregation."""
    names = list(of) if asked is None else list(asked)
    if unknown := [n for n in names if n not in of]:
        raise ValueError(f"unknown metrics {unknown}")
    return rows.groupBy(key).agg(*(of[n].alias(n) for n in names))


def with_customer(lines: DataFrame, transactions: DataFrame) -> DataFrame:
    """Line items with their bill's customer."""
    return lines.join(transactions.select("bill_id", "customer_id"), "bill_id")


def month_predicate(column: str, since: str) -> Column:
    """Partitions (yyyy-mm) that can hold dates from `since` on."""
    return F.col(column) >= F.lit(str(since)[:7])


#: Tables that the metrics of rule trees read, by the prefix of their keys.
PREFIXES = {"basket": ("transactions", "line_items"), "store": ("transactions",), "product": ("line_items",), "billing": ("utility_billing",), "complaint": ("complaints",), "complaints": ("complaints",), "digital": ("digital_interactions",)}


def _of(source: str, as_of: str) -> dict[str, Column]:
    return {"transactions": basket, "utility_billing": billing, "complaints": complaints, "digital_interactions": digital}[source](as_of) if source != "line_items" else basket_lines()


def metric(key: str, as_of: str) -> tuple[str, str, Column, str] | None:
    """Table, name, aggregate and catalogue type of a metric's key (basket.total_store_visits); None for other keys."""
    prefix, _, name = key.partition(".")
    for source in PREFIXES.get(prefix, ()):
        if (column := _of(source, as_of).get(name)) is not None:
            text = name in ("home_store_id", "last_complaint_type", "last_complaint_status")
            kind = "boolean" if name.startswith(("is_", "has_")) else "date" if name.endswith("_date") else "string" if text else "float"
            return source, name, column, kind
    return None


def source_rows(source: str, table: Callable[[str], DataFrame]) -> DataFrame:
    """The rows that a metric table is aggregated from; line items take their customer from store bills."""
    if source == "line_items":
        return with_customer(table("line_items"), table("transactions").where("channel = 'in_store'"))
    return table(source)
