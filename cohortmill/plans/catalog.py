"""The attribute catalogue: keys of rule trees, their types, and the columns they read; operators by type; templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_OPS = ("equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with", "in_list", "not_in_list", "is_empty", "is_not_empty", "regex_match")
NUMERIC_OPS = ("equals", "not_equals", "greater_than", "less_than", "greater_than_or_equal", "less_than_or_equal", "between", "not_between", "is_empty", "is_not_empty")
DATE_OPS = ("equals", "not_equals", "before", "after", "between", "not_between", "in_last_n_days", "not_in_last_n_days", "in_next_n_days", "is_today", "is_this_week", "is_this_month", "is_this_quarter", "is_this_year", "is_anniversary", "day_of_week_is", "is_empty")
BOOLEAN_OPS = ("is_true", "is_false", "is_empty")
ARRAY_OPS = ("contains_any", "contains_all", "contains", "not_contains", "array_length_equals", "array_length_greater", "array_length_less", "is_empty", "is_not_empty")
EXISTS_OPS = ("exists", "not_exists")
#: Beyond the sets above: lists of numbers, and emptiness where the sets lack it, are told unambiguously by the type.
MORE = {"integer": ("in_list", "not_in_list"), "float": ("in_list", "not_in_list"), "date": ("is_not_empty", "greater_than", "less_than", "greater_than_or_equal", "less_than_or_equal"), "boolean": ("equals", "not_equals", "is_not_empty"), "string": (), "array_string": (), "array_integer": ()}
OPS = {"string": STRING_OPS, "integer": NUMERIC_OPS, "float": NUMERIC_OPS, "date": DATE_OPS, "boolean": BOOLEAN_OPS, "array_string": ARRAY_OPS, "array_integer": ARRAY_OPS}


@dataclass(frozen=True)
class AttributeDef:
    """alias: p (profiles), ba (behaviour), loc (locations), gs (graph summary) or bt (bill lines)."""

    key: str
    kind: str
    alias: str
    column: str

    @property
    def category(self) -> str:
        return self.key.split(".")[0]

    def expr(self) -> Column:
        return _DERIVED[self.key]() if self.key in _DERIVED else F.trim(self.column) if self.alias == "loc" else F.col(self.column)


#: Keys, types and columns that rule trees of the reference use. Fixed values.
_ALL = [
    AttributeDef("identity.customer_id", "string", "p", "unified_id"),
    AttributeDef("identity.email", "string", "p", "email"),
    AttributeDef("identity.phone", "string", "p", "canonical_mobile"),
    AttributeDef("identity.mobile", "string", "p", "canonical_mobile"),
    AttributeDef("identity.surrogate_id", "string", "p", "surrogate_id"),
    AttributeDef("identity.primary_source", "string", "p", "primary_source"),
    AttributeDef("identity.has_transactions", "boolean", "p", "has_transactions"),
    AttributeDef("demographic.full_name", "string", "p", "display_name"),
    AttributeDef("demographic.first_name", "string", "p", "first_name"),
    AttributeDef("demographic.last_name", "string", "p", "last_name"),
    AttributeDef("demographic.name", "string", "p", "display_name"),
    AttributeDef("demographic.dob", "string", "p", "dob"),
    AttributeDef("demographic.age", "integer", "ba", "age"),
    AttributeDef("demographic.customer_group", "string", "ba", "customer_group"),
    AttributeDef("demographic.occupation", "string", "ba", "occupation"),
    AttributeDef("demographic.whatsapp", "string", "ba", "whatsapp"),
    AttributeDef("geo.pincode", "string", "p", "pincode"),
    AttributeDef("geo.city", "string", "p", "city"),
    AttributeDef("geo.street", "string", "p", "street"),
    AttributeDef("geo.region", "string", "p", "region"),
    AttributeDef("geo.home_store_id", "string", "p", "registered_store"),
    AttributeDef("geo.state", "string", "loc", "store_state"),
    AttributeDef("geo.zone", "string", "loc", "store_zone"),
    AttributeDef("geo.store_format", "string", "loc", "store_format"),
    AttributeDef("txn.total_bills", "integer", "ba", "total_bills"),
    AttributeDef("txn.total_visits", "integer", "ba", "total_visits"),
    AttributeDef("txn.distinct_months", "integer", "ba", "distinct_months"),
    AttributeDef("txn.distinct_store_count", "integer", "ba", "distinct_store_count"),
    AttributeDef("txn.distinct_article_count", "integer", "ba", "distinct_article_count"),
    AttributeDef("txn.return_bill_count", "integer", "ba", "return_bill_count"),
    AttributeDef("txn.promo_bill_count", "integer", "ba", "promo_bill_count"),
    AttributeDef("txn.weekend_bill_count", "integer", "ba", "weekend_bill_count"),
    AttributeDef("txn.wednesday_bill_count", "integer", "ba", "wednesday_bill_count"),
    AttributeDef("txn.total_spend", "float", "ba", "total_spend"),
    AttributeDef("txn.spend_per_bill", "float", "ba", "spend_per_bill"),
    AttributeDef("txn.spend_per_visit", "float", "ba", "spend_per_visit"),
    AttributeDef("txn.avg_items_per_bill", "float", "ba", "avg_items_per_bill"),
    AttributeDef("txn.total_discount", "float", "ba", "total_discount"),
    AttributeDef("txn.avg_billing_time_secs", "float", "ba", "avg_billing_time_secs"),
    AttributeDef("temporal.first_bill_date", "date", "ba", "first_bill_date"),
    AttributeDef("temporal.last_bill_date", "date", "ba", "last_bill_date"),
    AttributeDef("temporal.recency_days", "integer", "ba", "recency_days"),
    AttributeDef("temporal.tenure_days", "integer", "ba", "tenure_days"),
    AttributeDef("temporal.dgbt_fs", "integer", "ba", "dgbt_fs"),
    AttributeDef("lifecycle.l1_segment", "string", "ba", "l1_segment"),
    AttributeDef("lifecycle.l2_segment", "string", "ba", "l2_segment"),
    AttributeDef("lifecycle.lifecycle_stage", "string", "ba", "lifecycle_stage"),
    AttributeDef("lifecycle.rfm_recency_score", "integer", "ba", "rfm_recency_score"),
    AttributeDef("lifecycle.rfm_frequency_score", "integer", "ba", "rfm_frequency_score"),
    AttributeDef("lifecycle.rfm_monetary_score", "integer", "ba", "rfm_monetary_score"),
    AttributeDef("lifecycle.is_first_time_buyer", "boolean", "ba", "is_first_time_buyer"),
    AttributeDef("lifecycle.is_repeat_buyer", "boolean", "ba", "is_repeat_buyer"),
    AttributeDef("lifecycle.is_active", "boolean", "ba", "is_active"),
    AttributeDef("lifecycle.is_churned", "boolean", "ba", "is_churned"),
    AttributeDef("decile.spend_decile", "integer", "ba", "spend_decile"),
    AttributeDef("decile.nob_decile", "integer", "ba", "nob_decile"),
    AttributeDef("store.fav_store_code", "string", "ba", "fav_store_code"),
    AttributeDef("store.fav_store_name", "string", "ba", "fav_store_name"),
    AttributeDef("store.fav_store_type", "string", "ba", "fav_store_type"),
    AttributeDef("store.fav_day", "string", "ba", "fav_day"),
    AttributeDef("product.fav_article_by_spend", "string", "ba", "fav_article_by_spend"),
    AttributeDef("product.fav_article_by_spend_desc", "string", "ba", "fav_article_by_spend_desc"),
    AttributeDef("product.fav_article_by_nob", "string", "ba", "fav_article_by_nob"),
    AttributeDef("product.fav_article_by_nob_desc", "string", "ba", "fav_article_by_nob_desc"),
    AttributeDef("product.second_fav_article_by_spend", "string", "ba", "second_fav_article_by_spend"),
    AttributeDef("product.second_fav_article_by_nob", "string", "ba", "second_fav_article_by_nob"),
    AttributeDef("channel.channel_presence", "string", "ba", "channel_presence"),
    AttributeDef("channel.store_spend", "float", "ba", "store_spend"),
    AttributeDef("channel.online_spend", "float", "ba", "online_spend"),
    AttributeDef("channel.store_bills", "integer", "ba", "store_bills"),
    AttributeDef("channel.online_bills", "integer", "ba", "online_bills"),
    AttributeDef("consent.dnd", "string", "p", "dnd"),
    AttributeDef("consent.accepts_email_marketing", "string", "p", "accepts_email_marketing"),
    AttributeDef("consent.accepts_sms_marketing", "string", "p", "accepts_sms_marketing"),
    AttributeDef("consent.gw_customer_flag", "string", "p", "gw_customer_flag"),
    AttributeDef("identity_graph.total_edge_count", "integer", "gs", "total_edge_count"),
    AttributeDef("identity_graph.distinct_id_types", "integer", "gs", "distinct_id_types"),
    AttributeDef("identity_graph.source_system_count", "integer", "gs", "source_system_count"),
    AttributeDef("identity_graph.mobile_count", "integer", "gs", "mobile_count"),
    AttributeDef("identity_graph.email_count", "integer", "gs", "email_count"),
    AttributeDef("identity_graph.store_count", "integer", "gs", "store_count"),
    AttributeDef("identity_graph.source_systems", "string", "gs", "source_systems"),
    AttributeDef("identity_graph.avg_confidence", "float", "gs", "avg_confidence"),
    AttributeDef("identity_graph.completeness_score", "float", "gs", "completeness_score"),
    AttributeDef("bt.bill_date", "date", "bt", "bill_date"),
    AttributeDef("bt.brand_name", "string", "bt", "brand_name"),
    AttributeDef("bt.segment_desc", "string", "bt", "segment_desc"),
    AttributeDef("bt.family_desc", "string", "bt", "family_desc"),
    AttributeDef("bt.class_desc", "string", "bt", "class_desc"),
    AttributeDef("bt.brick_desc", "string", "bt", "brick_desc"),
    AttributeDef("bt.article_desc", "string", "bt", "article_desc"),
    AttributeDef("bt.article", "string", "bt", "article"),
    AttributeDef("bt.manufacturer_name", "string", "bt", "manufacturer_name"),
    AttributeDef("bt.store_code", "string", "bt", "store_code"),
    AttributeDef("bt.store_desc", "string", "bt", "store_desc"),
    AttributeDef("bt.store_format", "string", "bt", "store_format"),
    AttributeDef("bt.city_desc", "string", "bt", "city_desc"),
    AttributeDef("bt.region_desc", "string", "bt", "region_desc"),
    AttributeDef("bt.delivery_channel", "string", "bt", "delivery_channel"),
    AttributeDef("bt.promo_indicator", "string", "bt", "promo_indicator"),
    AttributeDef("bt.day_of_week", "string", "bt", "day_of_week"),
    AttributeDef("bt.gross_sale_value", "float", "bt", "gross_sale_value"),
    AttributeDef("bt.total_discount", "float", "bt", "total_discount"),
    AttributeDef("bt.total_mrp_value", "float", "bt", "total_mrp_value"),
    AttributeDef("bt.billed_qty", "float", "bt", "billed_qty"),
    AttributeDef("bt.sales_return", "boolean", "bt", "sales_return"),
    AttributeDef("bt.weekend_flag", "boolean", "bt", "weekend_flag"),
    AttributeDef("bt.wednesday_flag", "boolean", "bt", "wednesday_flag"),
]
#: Keys beside the catalogue's that rules over bill lines use. Fixed values.
_MAPPED = [
    AttributeDef("bt.region", "string", "bt", "region"),
    AttributeDef("bt.state", "string", "bt", "region_desc"),
    AttributeDef("bt.business_region", "string", "bt", "store_business_region"),
    AttributeDef("bt.city", "string", "bt", "city"),
    AttributeDef("bt.mobile_number", "string", "bt", "mobile_number"),
    AttributeDef("bt.billed_mrp", "float", "bt", "billed_mrp"),
]
CATALOG = {a.key: a for a in _ALL}
EXTRA = {a.key: a for a in _MAPPED}
_DERIVED = {
    "lifecycle.is_first_time_buyer": lambda: F.coalesce(F.col("total_bills") == 1, F.lit(False)),
    "lifecycle.is_repeat_buyer": lambda: F.coalesce(F.col("total_bills") > 1, F.lit(False)),
    "lifecycle.is_active": lambda: F.coalesce(F.col("lifecycle_stage") == "Active", F.lit(False)),
    "lifecycle.is_churned": lambda: F.coalesce(F.col("lifecycle_stage") == "Churned", F.lit(False)),
}


def attribute(key: str) -> AttributeDef:
    found = CATALOG.get(key) or EXTRA.get(key)
    if not found:
        raise ValueError(f"unknown attribute {key!r}")
    return found


def allowed(kind: str) -> tuple[str, ...]:
    return OPS[kind] + MORE[kind] + EXISTS_OPS


def listing(category: str | None = None) -> list[AttributeDef]:
    return [a for a in CATALOG.values() if not category or a.category == category]


#: What people commonly ask for. Fixed values.
PATTERNS = (
    "High spenders in {city}",
    "Customers who haven't bought in {N} days",
    "STAR segment customers",
    "Weekend shoppers with spend > {amount}",
    "Omni-channel customers in {region}",
    "New customers (first-time buyers)",
    "Churned customers with high lifetime value",
    "Promo lovers (promo bills > {N})",
    "Top decile customers by spend",
    "Customers who accept SMS marketing",
)


def suggest(partial: str, most: int = 10, patterns: bool = False) -> list[str]:
    """Keys of the catalogue and names of templates that hold the text; with patterns also common questions that do."""
    p = partial.lower().strip()
    found = [x for x in (*CATALOG, *TEMPLATES) if p and (p in x.lower() or p in x.replace("-", " ").replace("_", " ").lower())]
    if patterns:
        found += [x for x in PATTERNS if p and p in x.lower()]
    return found[:most]


def _t(*conditions: tuple) -> dict:
    return {"type": "group", "logical_operator": "and", "conditions": [{"type": "attribute", "attribute_key": k, "operator": o, "value": v} for k, o, v in conditions]}


#: Audiences ready to use. Fixed values.
TEMPLATES = {
    "star-customers": _t(("lifecycle.l2_segment", "equals", "STAR")),
    "hvhf": _t(("lifecycle.l1_segment", "equals", "HVHF")),
    "at-risk-high-spenders": _t(("lifecycle.lifecycle_stage", "equals", "At Risk"), ("txn.total_spend", "greater_than", 10000)),
    "churned": _t(("lifecycle.lifecycle_stage", "equals", "Churned")),
    "new-first-time-buyers": _t(("lifecycle.is_first_time_buyer", "is_true", True), ("temporal.recency_days", "less_than", 30)),
    "weekend-shoppers": _t(("txn.weekend_bill_count", "greater_than", 3)),
    "promo-lovers": _t(("txn.promo_bill_count", "greater_than", 5)),
    "omni-channel": _t(("channel.channel_presence", "equals", "Omni")),
    "online-only": _t(("channel.channel_presence", "equals", "Online")),
    "top-spend-decile": _t(("decile.spend_decile", "greater_than_or_equal", 9)),
    "deep-lapsed-winback": _t(("lifecycle.l2_segment", "in_list", ["Deep Lapsed", "LAPSER"])),
    "multi-store-shoppers": _t(("txn.distinct_store_count", "greater_than_or_equal", 3)),
    "sms-marketable": _t(("consent.accepts_sms_marketing", "not_equals", "No"), ("consent.dnd", "not_equals", "Y")),
    "repeat-buyers-trending-up": _t(("lifecycle.is_repeat_buyer", "is_true", True), ("decile.spend_decile", "greater_than_or_equal", 7)),
    "cih-registered-no-purchase": _t(("identity.has_transactions", "is_false", False), ("identity.primary_source", "equals", "CIH")),
}
#: Audiences that the sinks export: filters over the behaviour mart. The mart has no survey scores, churn risk or feedback
#: flags; the nearest of its columns stand for them.
EXPORTS = {
    "high_value_promoters": "l1_segment = 'HVHF' AND lifecycle_stage IN ('Active', 'At Risk') AND promo_bill_count > 0",
    "at_risk_customers": "recency_days > 90 AND lifecycle_stage IN ('Lapsed', 'Churned')",
    "new_customers_no_feedback": "tenure_days <= 30",
    "promo_responsive": "promo_bill_count >= 2 AND lifecycle_stage IN ('Active', 'At Risk')",
}
