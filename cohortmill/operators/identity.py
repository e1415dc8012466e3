"""Identity resolution and the relational identity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions.cleaning import email_hash, mobile_or_raw, phone
from cohortmill.functions.windows import first_rows
from cohortmill.operators import links as shared

#: How sure each kind of identifier makes a link. Fixed values.
CONFIDENCE = {"mobile": 1.0, "email": 0.9, "store_affinity": 0.8, "name": 0.7}
PROFILE = ["surrogate_id", "name", "first_name", "last_name", "email", "city", "pincode", "region", "registered_store", "age", "customer_group", "occupation", "whatsapp", "dnd", "gw_customer_flag", "accepts_email_marketing", "accepts_sms_marketing"]


def display_name(name: Column, first: Column, last: Column) -> Column:
    return F.coalesce(name, F.nullif(F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))), F.lit("")))


def one_per_mobile(cih: DataFrame) -> DataFrame:
    """The customer master's row with the smallest surrogate id of each mobile."""
    return first_rows(cih, ["mobile"], [F.asc_nulls_last("surrogate_id")]).drop("rn")


def resolve(cih: DataFrame, identifiers: DataFrame, strategy: str = "cih_first") -> DataFrame:
    """Unified profiles. cih_first: all of the master, then mobiles that only bills know. pos_first: mobiles of bills alone,
    with what the master knows of them. identifiers: mobile, store_code, last_bill_date."""
    master = one_per_mobile(cih)
    seen = first_rows(identifiers, ["mobile"], [F.desc_nulls_last("last_bill_date"), F.asc("store_code")]).select("mobile", F.col("store_code").alias("pos_store"))
    pos_id = F.concat(F.lit("POS_"), F.md5("mobile"))
    if strategy == "pos_first":
        out = seen.join(master, "mobile", "left").withColumn("primary_source", F.when(F.col("surrogate_id").isNotNull(), "CIH+POS").otherwise("POS")).withColumn("has_transactions", F.lit(True))
        out = out.withColumn("surrogate_id", F.coalesce("surrogate_id", pos_id)).withColumn("registered_store", F.coalesce("registered_store", "pos_store"))
    elif strategy == "cih_first":
        # One full join: bills are read once for those the master knows and for the others.
        known, billed = F.col("_known").isNotNull(), F.col("pos_store").isNotNull()
        out = master.withColumn("_known", F.lit(True)).join(seen, "mobile", "full").withColumns({
            "has_transactions": F.when(known, billed).otherwise(True), "primary_source": F.when(known & billed, "CIH+POS").when(known, "CIH").otherwise("POS"),
            "surrogate_id": F.when(known, F.col("surrogate_id")).otherwise(pos_id), "registered_store": F.when(known, F.col("registered_store")).otherwise(F.col("pos_store")),
        })
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return out.select(
        F.md5("mobile").alias("unified_id"), F.col("mobile").alias("canonical_mobile"), display_name(F.col("name"), F.col("first_name"), F.col("last_name")).alias("display_name"),
        *[c for c in PROFILE if c != "name"], "primary_source", "has_transactions",
    )


def spine(sources: dict[str, DataFrame]) -> DataFrame:
    """Observations of identifiers: mobile, and email, name and store where a source has them; md5 of the mobile."""
    out = None
    for system, df in sources.items():
        have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")  # noqa: B023, E731
        rows = df.select(mobile_or_raw(F.col("mobile")).alias("mobile"), have("email").alias("email"), have("name").alias("name"), have("store_code").alias("store_code"), F.lit(system).alias("source_system"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("identifier_hash", F.md5("mobile"))


def edges(observed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct person -> identifier edges: one join of the spine with the profiles, each row's identifiers as an array."""
    rows = observed.join(profiles.select("unified_id", F.col("canonical_mobile").alias("mobile")), "mobile")

    def edge(kind: str, value: Column, ok: Column) -> Column:
        return F.when(ok, F.struct(F.lit(kind).alias("identifier_type"), value.alias("identifier_value"), F.lit(CONFIDENCE[kind]).alias("confidence_score")))

    found = F.array(
        edge("mobile", F.col("mobile"), F.col("mobile").isNotNull()), edge("email", F.lower(F.trim("email")), F.col("email").isNotNull() & (F.trim("email") != "")),
        edge("name", F.trim("name"), F.length(F.trim("name")) > 1), edge("store_affinity", F.col("store_code"), F.col("store_code").isNotNull()),
    )
    return rows.select("unified_id", "source_system", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("unified_id", "e.*", "source_system").distinct()


def graph_summary(profiles: DataFrame, links: DataFrame) -> DataFrame:
    """Counts come from the grain of (person, kind, value): no row is expanded for a distinct count. Sets are those of source
    systems only."""
    kinds = list(CONFIDENCE)
    values = links.groupBy("unified_id", "identifier_type", "identifier_value").agg(F.count("*").alias("n"), F.sum("confidence_score").alias("c"), F.collect_set("source_system").alias("s"))
    systems = F.array_sort(F.array_distinct(F.flatten(F.collect_set("s"))))
    count = lambda k: F.count(F.when(F.col("identifier_type") == k, 1))
    stats = values.groupBy("unified_id").agg(
        F.sum("n").alias("total_edge_count"), sum((F.when(count(k) > 0, 1).otherwise(0) for k in kinds), F.lit(0)).cast("long").alias("distinct_id_types"), F.size(systems).cast("long").alias("source_system_count"), F.array_join(systems, ", ").alias("source_systems"),
        count("mobile").alias("mobile_count"), count("email").alias("email_count"), count("store_affinity").alias("store_count"), F.round(F.sum("c") / F.sum("n"), 4).alias("avg_confidence"),
    )
    flags = ["canonical_mobile", "email", "display_name", "pincode", "city", "age", "registered_store"]
    complete = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in flags[1:]), F.when(F.col(flags[0]).isNotNull(), 1).otherwise(0)) / 7.0
    out = profiles.select("unified_id", "canonical_mobile", "display_name", "primary_source", "has_transactions", F.round(complete, 4).alias("completeness_score")).join(stats, "unified_id", "left")
    return out.fillna(0, ["total_edge_count", "distinct_id_types", "source_system_count", "mobile_count", "email_count", "store_count"])


def _valued(profiles: DataFrame, by: str) -> DataFrame:
    value = F.lower(F.trim("email")) if by == "email" else phone(F.col("canonical_mobile"))
    return profiles.select(value.alias("value"), "unified_id").where("value <> ''")


def cluster_classes(profiles: DataFrame, by: str) -> DataFrame:
    """Emails or phones that several profiles of one tenant share: the value, how many share it, the smallest id."""
    return shared.classes(_valued(profiles, by), ["value"], ["unified_id"]).select("value", F.col("members").alias("profiles"), "first.unified_id")


def cluster_members(profiles: DataFrame, by: str) -> DataFrame:
    """value, unified_id, profiles: one row for each profile that shares its email or phone."""
    return shared.memberships(_valued(profiles, by), ["value"], ["unified_id"]).withColumnRenamed("members", "profiles")


def clusters(profiles: DataFrame, by: str, most: int | None = 1000) -> DataFrame:
    """The value, how many profiles share it, and their sorted ids, in lists of about `most` (block numbers them; None: one list)."""
    members = shared.memberships(_valued(profiles, by), ["value"], ["unified_id"])
    return shared.listed(members, ["value"], "unified_id", most).select("value", F.col("members").alias("profiles"), "block", F.col("ids").alias("unified_ids"))


def _linkable(customers: DataFrame) -> DataFrame:
    """method, value, brand, customer_id of those who opted in: by email hash, and by phone of ten digits or more."""
    email = F.when(F.trim("email") != "", email_hash(F.col("email")))
    number = phone(F.col("phone"))
    found = F.array(F.struct(F.lit("email_hash").alias("method"), email.alias("value")), F.struct(F.lit("phone").alias("method"), F.when(F.length(number) >= 10, number).alias("value")))
    rows = customers.where("opt_in").select("brand", "customer_id", F.explode(found).alias("f"))
    return rows.select("f.method", "f.value", "brand", "customer_id").where("value IS NOT NULL")


def _confidence() -> Column:
    return F.when(F.col("method") == "phone", 0.95).otherwise(1.0).alias("confidence")


def cross_brand_classes(customers: DataFrame) -> DataFrame:
    """Emails and phones that customers of several tenants share: method, value, how many customers and brands, confidence."""
    g = _linkable(customers).distinct().groupBy("method", "value", "brand").agg(F.count("*").alias("n"))
    g = g.groupBy("method", "value").agg(F.sum("n").alias("customers"), F.count("*").alias("brands")).where("brands > 1")
    return g.select("method", "value", "customers", "brands", _confidence())


def cross_brand_members(customers: DataFrame) -> DataFrame:
    """method, value, brand, customer_id, members: one row for each customer of a value that several customers share."""
    return shared.memberships(_linkable(customers), ["method", "value"], ["brand", "customer_id"])


def cross_brand_links(customers: DataFrame) -> DataFrame:
    """The pairs of cross_brand_members in different tenants, by email hash (1.0) or by phone (0.95). customers: brand, customer_id,
    email, phone, opt_in. The smaller brand comes first."""
    out = shared.pairs(cross_brand_members(customers), ["method", "value"], ["brand", "customer_id"], "brand")
    return out.select(F.col("brand_1").alias("brand_a"), F.col("customer_id_1").alias("customer_a"), F.col("brand_2").alias("brand_b"), F.col("customer_id_2").alias("customer_b"), "method", _confidence())


def _named(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.upper(F.trim("display_name")).alias("name"), "pincode", "unified_id")


def merge_classes(profiles: DataFrame) -> DataFrame:
    """Names and pincodes that several profiles share: how many, and the smallest id."""
    return shared.classes(_named(profiles), ["name", "pincode"], ["unified_id"]).select("name", "pincode", F.col("members").alias("profiles"), "first.unified_id")


def merge_members(profiles: DataFrame) -> DataFrame:
    """name, pincode, unified_id, profiles: one row for each profile of merge_classes."""
    return shared.memberships(_named(profiles), ["name", "pincode"], ["unified_id"]).withColumnRenamed("members", "profiles")


def merge_candidates(profiles: DataFrame) -> DataFrame:
    """The pairs of merge_members, the smaller id first."""
    members = shared.memberships(_named(profiles), ["name", "pincode"], ["unified_id"])
    return shared.pairs(members, ["name", "pincode"], ["unified_id"], "unified_id").withColumnsRenamed({"unified_id_1": "id_1", "unified_id_2": "id_2"})


def lookup(profiles: DataFrame, mobile: str) -> DataFrame:
    return profiles.where(F.col("canonical_mobile") == mobile)


def edges_of(links: DataFrame, unified_id: str) -> DataFrame:
    return links.where(F.col("unified_id") == unified_id).orderBy(F.desc("confidence_score"), "identifier_type", "identifier_value")


def reverse_lookup(links: DataFrame, profiles: DataFrame, kind: str, value: str) -> DataFrame:
    """Profiles that an identifier leads to."""
    return profiles.join(links.where((F.col("identifier_type") == kind) & (F.col("identifier_value") == value)).select("unified_id").distinct(), "unified_id", "left_semi")


def cross_system(links: DataFrame, least: int = 2) -> DataFrame:
    """People seen in several systems."""
    g = links.groupBy("unified_id").agg(F.count_distinct("source_system").alias("systems"), F.array_join(F.array_sort(F.collect_set("source_system")), ", ").alias("names"))
    return g.where(F.col("systems") >= least)


def store_affinity(links: DataFrame, locations: DataFrame) -> DataFrame:
    """Profiles by store, for current stores."""
    g = links.where("identifier_type = 'store_affinity'").groupBy(F.col("identifier_value").alias("store_code")).agg(F.count_distinct("unified_id").alias("customers"))
    return g.join(locations.where("is_latest").select("store_code", "store_name", "store_state"), "store_code", "left")


def quality_tiers(summary: DataFrame, high: float = 0.8, medium: float = 0.5) -> DataFrame:
    tier = F.when(F.col("completeness_score") >= high, "High").when(F.col("completeness_score") >= medium, "Medium").otherwise("Low")
    return summary.groupBy(tier.alias("tier")).agg(F.count("*").alias("profiles"), F.round(F.avg("total_edge_count"), 4).alias("avg_edges"))


def customer_360(profiles: DataFrame, locations: DataFrame, behavior: DataFrame, graph: DataFrame) -> DataFrame:
    """Each profile with its current store, behaviour and graph summary; people without them keep their row."""
    loc = locations.where("is_latest").groupBy("store_code").agg(F.max("store_name").alias("primary_store_name"), F.max("store_state").alias("primary_store_city"))
    ba = behavior.select("customer_id", "lifecycle_stage", "total_bills", "total_spend", "promo_bill_count", "tenure_days", "recency_days", "l1_segment")
    gs = graph.select("unified_id", "completeness_score", "source_systems", "store_count")
    p = profiles.select("unified_id", "canonical_mobile", "display_name", "email", F.trim("registered_store").alias("store_code"))
    return p.join(loc, "store_code", "left").join(ba, p.unified_id == ba.customer_id, "left").drop("customer_id").join(gs, "unified_id", "left").withColumnRenamed("store_code", "primary_store_code")


def connected_people(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """id, root: smallest id in reach over pairs (id_1, id_2). Every round takes the smallest root of the neighbours and
    the root of that root; the table is written each time through checkpoint()."""
    both = pairs.select(F.col("id_1").alias("id"), F.col("id_2").alias("to")).unionByName(pairs.select(F.col("id_2").alias("id"), F.col("id_1").alias("to"))).distinct().checkpoint()
    state = both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("root")).checkpoint()
    for _ in range(rounds):
        # The smaller root also goes to the old root, so chains of roots shrink as fast as paths.
        near = both.join(state.select(F.col("id").alias("to"), "root"), "to").groupBy("id").agg(F.min("root").alias("near"))
        seen = state.join(near, "id").select("id", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        low = seen.unionByName(seen.select(F.col("old").alias("id"), "low", F.lit(None).cast(seen.schema["old"].dataType).alias("old")))
        low = low.groupBy("id").agg(F.min("low").alias("root"), F.max("old").alias("old"))
        hop = low.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = low.join(hop, "root", "left").select("id", "old", F.coalesce("further", "root").alias("root")).checkpoint()
        state = after.drop("old")
        if not after.where("root <> old").limit(1).count():
            return state
    raise RuntimeError(f"the groups did not settle in {rounds} rounds")


def elected(people: DataFrame, roots: DataFrame) -> DataFrame:
    """Primary profile of each group: the one with most known columns, ties to the smallest id; one row for each member."""
    known = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in people.columns), F.lit(0))
    rows = people.select(F.col("unified_id").alias("id"), known.alias("known")).join(roots, "id")
    best = first_rows(rows, ["root"], [F.desc("known"), F.asc("id")]).select("root", F.col("id").alias("primary_id"))
    return rows.join(best, "root").select(F.col("id").alias("unified_id"), "primary_id")
