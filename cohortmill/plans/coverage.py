"""Further registered queries with their SQL: sources and sinks read back, staging of raw text, predicates, rule trees over domain
metrics and mart events, data tests, helpers. Importing this module adds them to the catalogue."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from cohortmill.functions import sqlutils
from cohortmill.functions.storage import written
from cohortmill.operators import domain, dq, identity, marts, segment, segments, sketches, staging
from cohortmill.operators.predicates import predicate
from cohortmill.plans import adapter as A
from cohortmill.plans import catalog
from cohortmill.plans import catalogue as C
from cohortmill.plans import tenant
from cohortmill.plans.catalog import TEMPLATES
from cohortmill.plans.catalogue import attr, engine, ev, query, tree
from cohortmill.sources import execution, ledger, publish, readers, sinks

_ALL = C._ALL


def _strings(df):
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


# -- sources, written first and read back ------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS store_code, s_name AS store_name, CAST(s_nationkey AS VARCHAR) AS store_state, NULL::VARCHAR AS store_zone FROM supplier")
def src_pipe_csv(s, d):
    at = A.scratch(s)
    rows = _strings(A.table(s, d, "supplier")).select(F.col("s_suppkey").alias(" Store Code "), F.col("s_name").alias("STORE NAME"), F.col("s_nationkey").alias("State"), F.lit("x").alias("left out"))
    rows.write.option("header", True).option("sep", "|").option("ignoreLeadingWhiteSpace", False).csv(at)
    return readers.read_csv(s, at, ["store_code", "store_name", "store_state", "store_zone"], "|", {"store code": "store_code", "store name": "store_name", "state": "store_state"})


@query("SELECT CAST(c_custkey AS VARCHAR) AS mobile, upper(trim(c_name)) AS name FROM customer")
def src_comma_csv(s, d):
    at = A.scratch(s)
    _strings(A.table(s, d, "customer").select("c_custkey", "c_name")).write.option("header", True).csv(at)
    rows = readers.read_csv(s, at, ["mobile", "name", "address"], renames={"c_custkey": "mobile", "c_name": "name"})
    return rows.select("mobile", F.upper(F.trim("name")).alias("name"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS article, p_name AS description, CAST(p_size AS VARCHAR) AS length_uom, CAST(p_size + 1 AS VARCHAR) AS width_uom FROM part")
def src_positional(s, d):
    """Two columns of one name, told apart by their place."""
    at = A.scratch(s)
    rows = A.table(s, d, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")).alias("value"))
    head = s.range(1).select(F.lit("Article|Description|Unit of Dimension|Unit of Dimension").alias("value"))
    head.coalesce(1).write.text(f"{at}/head")
    rows.write.text(f"{at}/rows")
    # Every file has the header row.
    with_head = readers.read_positional(s, f"{at}/head", ["article", "description", "length_uom", "width_uom"])
    return with_head.unionByName(readers.read_positional(s, f"{at}/rows", ["article", "description", "length_uom", "width_uom"], header=False))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS store_code, CASE WHEN s_suppkey % 2 = 0 THEN 'second' ELSE 'first' END AS load FROM supplier""")
def src_dated_folders_last_file_wins(s, d):
    """Folders of all digits only; of the rows of a key the last file's stays."""
    at = A.scratch(s)
    rows = A.table(s, d, "supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("store_code"))
    rows.withColumn("load", F.lit("first")).write.option("header", True).csv(f"{at}/20240101")
    rows.where("CAST(store_code AS INT) % 2 = 0").withColumn("load", F.lit("second")).write.option("header", True).csv(f"{at}/20240102")
    rows.withColumn("load", F.lit("notes")).write.option("header", True).csv(f"{at}/notes")
    read = s.read.option("header", True).csv(readers.dated_glob(at)).select("store_code", "load", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/[^/]*$", 1).alias("_source_file"), F.lit(0).alias("_line"))
    return staging.last_file_wins(read, "store_code").select("store_code", "load")


@query("SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_nationkey <> 1 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer")
def src_parquet_as_text(s, d):
    at = A.scratch(s)
    c = A.table(s, d, "customer")
    c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "nan").otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_nationkey") == 1, -1).otherwise(F.col("c_nationkey")).alias("nation"), "c_acctbal").write.parquet(at)
    return readers.read_parquet_as_text(s, at, {"c_custkey": "customer_id", "c_name": "name"}, ["C_ACCTBAL"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS mobile, n_name AS name FROM nation")
def src_utf8_bom(s, d):
    at = A.scratch(s)
    n = A.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    head = s.range(1).select(F.lit(-1).alias("k"), F.lit("﻿Mobile,Name").alias("value"))
    head.unionByName(n).coalesce(1).sortWithinPartitions("k").select("value").write.text(at)
    return readers.read_csv(s, at, ["mobile", "name"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS mobile, 'Züge é ' || c_mktsegment AS overall_rating FROM customer")
def src_latin1_fuzzy(s, d):
    at = A.scratch(s)
    c = A.table(s, d, "customer").select(F.col("c_custkey").alias("Your Mobile No."), F.concat(F.lit("Züge é "), F.col("c_mktsegment")).alias("Overall, how was it?"))
    c.write.option("header", True).option("encoding", "iso-8859-1").csv(at)
    names = readers.fuzzy_renames(c.columns, {"mobile": "mobile", "overall": "overall_rating"})
    return readers.read_csv(s, at, ["mobile", "overall_rating"], encoding="iso-8859-1", renames=names)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS bill_no, n_name AS plant, NULL::VARCHAR AS till_no, 'part' || CAST(n_nationkey % 2 AS VARCHAR) || '.csv' AS _source_file FROM nation")
def src_zipped_csv(s, d):
    """Two files of an archive, one of them in a folder; a broken archive beside it gives nothing."""
    at = A.scratch(s)
    rows = [(r.n_nationkey, r.n_name) for r in A.table(s, d, "nation").collect()]
    folder = Path(at.removeprefix("file:").replace("//", "/"))
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "bills.zip", "w") as z:
        for k in (0, 1):
            z.writestr(f"{'deep/' * k}part{k}.csv", "Plant,BILL_NO\r\n" + "".join(f"{name},{n}\r\n" for n, name in rows if n % 2 == k))
    (folder / "broken.zip").write_bytes(b"PK no archive")
    return readers.read_zipped_csv(s, at, ["bill_no", "plant", "till_no"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bill_month, count(*) AS bills FROM orders WHERE strftime(o_orderdate, '%Y-%m') >= '1998-03' GROUP BY 1")
def partitioned_write_and_scan(s, d):
    """Partitions by month, written twice (the second time replaces them), scanned from a month on."""
    at = A.scratch(s)
    rows = A.bills(s, d).select("bill_id", F.concat(F.lit("a\tb"), F.col("bill_id")).alias("note"), F.date_format("bill_date", "yyyy-MM").alias("bill_month"))
    for _ in range(2):
        sinks.write_table(rows, at, ("bill_month",))
    kept = s.read.parquet(at).where(domain.month_predicate("bill_month", "1998-03-15")).where("note NOT LIKE '%\t%'")
    return kept.groupBy(F.col("bill_month").cast("string").alias("bill_month")).agg(F.count("*").alias("bills"))


@query("SELECT 'r_name' AS name, 'string' AS type, count(r_name) AS n FROM region UNION ALL SELECT 'r_regionkey', 'int', count(r_regionkey) FROM region UNION ALL SELECT 'scan', 'priced', count(*) FROM lineitem")
def table_metadata_and_scan_cost(s, d):
    """Columns by the metadata, with their values; the larger table's scan costs more."""
    r, lines = A.table(s, d, "region"), A.table(s, d, "lineitem")
    out = lines.agg(F.lit("scan").alias("name"), F.lit("priced" if readers.scan_cost(lines) > readers.scan_cost(r) >= 0 else "wrong").alias("type"), F.count("*").alias("n"))
    for x in readers.table_metadata(r):
        out = out.unionByName(r.agg(F.lit(x["name"]).alias("name"), F.lit(x["type"]).alias("type"), F.count(x["name"]).alias("n")))
    return out


@query("SELECT n_nationkey AS k, n_name AS name FROM nation ORDER BY 1 LIMIT 7")
def fetch_rows(s, d):
    rows = readers.fetch(A.table(s, d, "nation").orderBy("n_nationkey"), 7)
    return s.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "k int, name string")


@query("SELECT count(*) AS synced, 0::BIGINT AS failed FROM customer")
def sink_webhook(s, d):
    got = sinks.webhook(_strings(A.table(s, d, "customer").select("c_custkey")), _taken, 100)
    return s.createDataFrame([(got["synced"], got["failed"])], "synced long, failed long")


def _taken(rows: list[dict]) -> bool:
    return 0 < len(rows) <= 100


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
def sink_csv_export(s, d):
    """An export to a CSV file and to a kind that doesn't exist, which is reported; the file is read back."""
    at = sinks.export_path(A.scratch(s), "nation_3", "20240101_000000")
    c = A.table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    done = sinks.export(c, "c_nationkey = 3", [{"type": "csv", "path": at, "single": True}, {"type": "fax"}], ["c_custkey", "c_mktsegment"])
    if done[0]["synced"] != c.where("c_nationkey = 3").count() or not done[1].get("skipped"):
        raise AssertionError(done)
    return readers.read_csv(s, at, ["c_custkey", "c_mktsegment"])


@query("SELECT 'nation_' || c_nationkey AS audience, CASE WHEN c_nationkey % 2 = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status, CASE WHEN c_nationkey % 2 = 0 THEN count(*) ELSE 0 END AS synced, CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE count(*) END AS failed FROM customer WHERE c_nationkey < 4 GROUP BY c_nationkey")
def sink_audit_log(s, d):
    """The log of four exports; a receiver refuses two of them."""
    at, c = A.scratch(s), A.table(s, d, "customer")
    for nation in range(4):
        got = sinks.webhook(_strings(c.where(F.col("c_nationkey") == nation).select("c_custkey")), _taken if nation % 2 == 0 else _refused)
        sinks.audit(s, at, f"nation_{nation}", got["synced"], got["failed"])
    return s.read.parquet(at).select("audience", "status", "synced", "failed")


def _refused(rows: list[dict]) -> bool:
    return False


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment FROM customer")
def upsert_keep_old(s, d):
    """New rows for all customers; those that are there already stay as they are."""
    c = A.table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return sinks.upsert(c.where("c_custkey % 4 <> 0"), c.withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"], update=False)


@query("SELECT c_custkey, 'x-1' AS tag FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' OR c_nationkey = 5")
def env_expansion(s, d):
    """A condition and a value that the environment completes."""
    env = {"ONE": "1", "SEGMENT": "BUILDING"}
    where = readers.expand_env("c_nationkey = ${NATION:-3} AND c_mktsegment = '${SEGMENT}' OR c_nationkey = ${OTHER:-5}${NOTHING}", env)
    return A.table(s, d, "customer").where(where).select("c_custkey", F.lit(readers.expand_env("x-${ONE}", env)).alias("tag"))


@query("SELECT 'cov_bills_one' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'cov_bills_two', count(*) FROM orders WHERE o_orderstatus <> 'O'")
def relations_by_pattern(s, d):
    """Rows of the relations that a pattern and a prefix find."""
    o = A.table(s, d, "orders")
    for name, rows in (("cov_bills_one", o.where("o_orderstatus = 'O'")), ("cov_bills_two", o.where("o_orderstatus <> 'O'")), ("cov_bills_old", o), ("cov_other", o)):
        rows.createOrReplaceTempView(name)
    both = sorted(set(sqlutils.relations_by_pattern(s, "COV_b%s_%", "%old")) & set(sqlutils.relations_by_prefix(s, "cov_bills")))
    both = [n for n in both if n != "cov_bills_old"]
    whole = sqlutils.union_relations({n: s.table(n).select("o_orderkey") for n in both})
    return whole.groupBy(F.col("_source_relation").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS n, CASE WHEN p_size % 3 <> 0 THEN DATE '2024-02-01' + CAST(p_size AS INTEGER) END AS held_on, CASE WHEN p_size % 3 <> 0 THEN 2024 END::INTEGER AS year FROM part")
def sheet_dates_and_year(s, d):
    """What a sheet's text cells become: dates where they are, and the year."""
    p = A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("n"), F.when(F.col("p_size") % 3 == 0, "soon").otherwise(F.concat(F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size").cast("int")).cast("string"), F.lit(" 00:00:00"))).alias("held_on"))
    return readers.with_year(p, ["held_on"], "held_on")


# -- staging of raw text -----------------------------------------------------------------------------------------------

_RAW_LINES = """SELECT o_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'bill_date' WHEN 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS bill_date, CAST(o_orderkey % 10 AS VARCHAR) AS plant, l_quantity, l_returnflag, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(f"""WITH r AS ({_RAW_LINES}) SELECT plant || '-' || CAST(o_orderkey AS VARCHAR) || '-' || bill_date AS bill_id, CAST(l_linenumber AS INTEGER) AS line_item_no, CAST(bill_date AS DATE) AS bill_date, plant AS store_code,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DECIMAL(12,3)) END AS billed_qty, l_returnflag = 'R' AS sales_return, CASE WHEN l_linestatus = 'O' THEN 'Online' ELSE 'Store' END AS delivery_channel,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE 3723 END::INTEGER AS start_secs, substr(bill_date, 1, 7) AS bill_month FROM r WHERE regexp_matches(bill_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')""")
def stg_bill_transactions(s, d):
    o, l = A.table(s, d, "orders"), A.table(s, d, "lineitem")
    k = F.col("l_linenumber") % 5
    raw = l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.when(k == 0, "bill_date").when(k == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("bill_date"), F.concat(F.lit(" "), (F.col("o_orderkey") % 10).cast("string")).alias("plant"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" ")).alias("bill_no"),
        F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("line_item_no"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).otherwise(" ").alias("billed_qty"),
        F.when(F.col("l_returnflag") == "R", "+").otherwise("-").alias("sales_return"), F.when(F.col("l_linestatus") == "O", "9998").otherwise("12").alias("till_no"), F.when(F.col("l_linenumber") == 3, "1:2").otherwise("01:02:03").alias("bill_start_time"),
    )
    return staging.bill_transactions(raw).select("bill_id", "line_item_no", "bill_date", "store_code", "billed_qty", "sales_return", "delivery_channel", F.col("start_secs").cast("int").alias("start_secs"), "bill_month")


@query("""SELECT '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS mobile, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 90 AS INTEGER) END AS age,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST('12.5' AS DECIMAL(15,2)) END AS total_spent, 'CIH_' || md5('9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS surrogate_id FROM customer WHERE c_custkey % 7 <> 0""")
def stg_cih_profiles(s, d):
    k = F.col("c_custkey")
    raw = A.table(s, d, "customer").select(
        F.when(k % 7 == 0, F.when(k % 2 == 0, "-1").otherwise(" ")).otherwise(F.concat(F.lit(" "), A.mobile("c_custkey"))).alias("brand_id"), F.when(k % 4 == 0, "-1").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 3 == 0, "old").otherwise((k % 90).cast("string")).alias("age"), F.when(k % 5 == 0, "-").otherwise("12.5").alias("total_spent"),
    )
    return staging.cih_profiles(raw).select("mobile", "name", "age", "total_spent", "surrogate_id")


@query("SELECT CASE WHEN c_custkey % 3 <> 0 THEN '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS mobile, upper(c_name) AS name, CAST(c_nationkey AS VARCHAR) AS pincode FROM customer WHERE c_custkey % 3 <> 0")
def stg_customers(s, d):
    k = F.col("c_custkey")
    raw = A.table(s, d, "customer").select(F.when(k % 3 == 0, "123").otherwise(A.mobile("c_custkey")).alias("mobile"), F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("name"), F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("pincode"))
    return staging.customers(raw).select("mobile", "name", "pincode").where("mobile IS NOT NULL")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS article_code, p_name AS article_description, CASE WHEN p_size % 4 <> 0 THEN DATE '2024-01-31' END AS created_on, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DECIMAL(12,3)) END AS net_weight,
  CASE WHEN p_partkey % 2 = 0 THEN 'offline' ELSE 'online' END AS catalogue, CASE WHEN p_partkey % 2 = 0 THEN 'A' END AS status FROM part""")
def stg_article_dimension(s, d):
    k = F.col("p_size")
    raw = A.table(s, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("article"), F.concat(F.lit(" "), F.col("p_name")).alias("article_description"), F.when(k % 4 == 0, "2024-1-31").otherwise("20240131").alias("created_on"), F.when(k % 3 == 0, "kg").otherwise(k.cast("string")).alias("net_weight"), F.lit("A ").alias("status"))
    keep = ["article_code", "article_description", "created_on", "net_weight"]
    offline, online = staging.articles(raw.where("p_partkey % 2 = 0")), staging.articles(raw.where("p_partkey % 2 = 1"))
    return staging.article_dimension(offline.select(*keep, "status"), online.select(*keep))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS store_code, s_name AS store_name, DATE '2020-02-03' AS store_opening_date, true AS is_latest, DATE '2024-05-06' AS valid_from, DATE '9999-12-31' AS valid_to FROM supplier")
def stg_current_locations(s, d):
    raw = A.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("store_code"), F.concat("s_name", F.lit(" ")).alias("store_name"), F.lit("20200203").alias("store_opening_date"))
    history = staging.location_history(staging.locations(raw), "2024-05-06")
    return staging.current_locations(history).select("store_code", "store_name", "store_opening_date", "is_latest", "valid_from", "valid_to")


@query("""SELECT '9' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS mobile, CAST(o_orderdate AS DATE) AS bill_date, CASE WHEN o_orderkey % 12 <= 10 THEN CAST(o_orderkey % 12 AS INTEGER) END AS nps_score,
  CASE WHEN o_orderkey % 12 IN (9, 10) THEN 'Promoter' WHEN o_orderkey % 12 IN (7, 8) THEN 'Passive' ELSE 'Detractor' END AS nps_category FROM orders""")
def stg_nps(s, d):
    k = F.col("o_orderkey") % 12
    raw = A.table(s, d, "orders").select(A.mobile("o_orderkey").alias("mobile"), F.lit("1").alias("store_code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("bill_date"), F.when(k <= 10, k).alias("overall_rating"))
    return staging.nps(raw).select("mobile", "bill_date", "nps_score", "nps_category")


# -- marts at the full grain -------------------------------------------------------------------------------------------


def _full(s, d):
    """Bill lines with the further columns of the full grain."""
    k = F.col("line_item_no")
    return C._lines(s, d).withColumns({
        "till_no": F.concat(F.lit("T"), "store_code"), "bill_no": F.concat(F.lit("N"), "bill_id"), "region": F.substring("region_desc", 1, 3), "city": F.col("store_format"), "city_desc": F.upper("store_format"),
        "total_mrp_value": F.col("gross_sale_value") + F.col("total_discount"), "gift_item_indicator": F.when(k == 5, "Y"), "liquidity_type": F.when(k == 4, " LQ "), "bill_start_time": F.lit("10:00:00"), "bill_end_time": F.when(k > 1, "10:05:30").otherwise("10:01:00"),
        "segment": F.col("segment_desc"), "family": F.col("family_desc"), "class": F.col("brick_desc"), "class_desc": F.col("brick_desc"), "brick": F.col("brick_desc"), "brand": F.col("brand_name"),
    })


_FULL = """, fl AS (SELECT *, 'T' || store_code AS till_no, 'N' || bill_id AS bill_no, substr(region_desc, 1, 3) AS region, store_format AS city, upper(store_format) AS city_desc, segment_desc AS segment, family_desc AS family, brick_desc AS class,
  brick_desc AS class_desc, brick_desc AS brick, brand_name AS brand FROM bl)"""


@query(A.head("bl") + _FULL + """ SELECT bill_date, store_code, store_format, till_no, bill_no, bill_id, mobile_number, region, city, delivery_channel, max(store_desc) AS store_desc, count(*) AS line_item_count, CAST(sum(gross_sale_value) AS DECIMAL(15,2)) AS gross_sale_value,
  CAST(sum(total_discount) AS DECIMAL(15,2)) AS total_discount, CAST(sum(gross_sale_value + total_discount) AS DECIMAL(15,2)) AS total_mrp_value, '10:00:00' AS bill_start_time, CASE WHEN max(line_item_no) > 1 THEN '10:05:30' ELSE '10:01:00' END AS bill_end_time,
  CASE WHEN max(line_item_no) > 1 THEN 330 ELSE 60 END AS billing_time_secs, bool_or(sales_return) AS sales_return, bool_or(promo_indicator IS NOT DISTINCT FROM 'P') AS promo_applied, bool_or(line_item_no = 5) AS gift_indicator, bool_or(line_item_no = 4) AS liquidity_indicator,
  bool_or(weekend_flag) AS weekend_flag, bool_or(wednesday_flag) AS wednesday_flag, max(day_of_week) AS day_of_week FROM fl GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10""")
def bill_summary_full(s, d):
    return marts.bill_summary_full(_full(s, d))


@query(A.head("bl") + _FULL + """ SELECT bill_date, store_code, article, article_desc, segment AS segment_code, segment_desc, family, family_desc, class, class_desc, brick, brick_desc, brand, brand_name, store_format, region AS region_code, region_desc, city, city_desc,
  'OFFLINE' AS sales_channel, CAST(sum(billed_qty) AS DECIMAL(18,3)) AS quantity, CAST(sum(gross_sale_value) AS DECIMAL(15,2)) AS gross_sales, CAST(sum(total_discount) AS DECIMAL(15,2)) AS discount_amount, CAST(sum(gross_sale_value - total_discount) AS DECIMAL(15,2)) AS net_sales,
  count(*) AS line_item_count, count(DISTINCT bill_id) AS num_bills FROM fl WHERE NOT sales_return GROUP BY ALL""")
def daily_store_sales_full(s, d):
    return marts.daily_store_sales_full(_full(s, d))


@query(A.head("bl") + """ SELECT store_code, article, CAST(sum(gross_sale_value) AS DECIMAL(15,2)) AS total_sales, CAST(sum(gross_sale_value - total_discount) AS DECIMAL(15,2)) AS net_sales, CAST(sum(cost) AS DECIMAL(15,2)) AS total_cost,
  CAST(sum(gross_sale_value - total_discount) - sum(cost) AS DECIMAL(15,2)) AS margin, CAST(sum(billed_qty) AS DECIMAL(18,3)) AS quantity FROM (SELECT *, CAST(billed_qty * 100 AS DECIMAL(15,2)) AS cost FROM bl) WHERE NOT sales_return GROUP BY 1, 2""")
def total_sales_margins(s, d):
    lines = C._lines(s, d).withColumn("cost", (F.col("billed_qty") * 100).cast(marts.MONEY))
    return marts.total_sales(lines, ["store_code", "article"], "cost")


# -- predicates --------------------------------------------------------------------------------------------------------

_DAYS = [("after", "1998-01-01", "o > DATE '1998-01-01'"), ("in_next_n_days", 30, "o BETWEEN DATE '1998-03-04' AND DATE '1998-03-04' + 30"), ("is_today", None, "o = DATE '1998-03-04'"), ("is_this_week", None, "date_trunc('week', o) = date_trunc('week', DATE '1998-03-04')"), ("is_this_month", None, "date_trunc('month', o) = date_trunc('month', DATE '1998-03-04')"), ("not_exists", None, "o IS NULL")]


@query("SELECT o_orderkey, " + ", ".join(f"{sql} AS {op}" for op, _, sql in _DAYS) + " FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS o FROM orders)")
def pred_dates_of_a_day(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")).alias("o"))
    as_of = F.lit("1998-03-04").cast("date")
    return o.select("o_orderkey", *(predicate(F.col("o"), "date", op, v, as_of=as_of).alias(op) for op, v, _ in _DAYS))


_LISTS = [
    ("contains_any", ["0", "3"], "list_has_any(w, ['0', '3'])"), ("contains_all", ["0", "1"], "list_has_all(w, ['0', '1'])"), ("contains", "2", "list_contains(w, '2')"), ("array_length_equals", 2, "nullif(len(w), 0) = 2"),
    ("array_length_greater", 1, "nullif(len(w), 0) > 1"), ("array_length_less", 2, "nullif(len(w), 0) < 2"), ("is_empty", None, "w IS NULL OR len(w) = 0"), ("exists", None, "w IS NOT NULL"), ("not_exists", None, "w IS NULL"),
]


@query("SELECT p_partkey, " + ", ".join(f"{sql} AS {op}" for op, _, sql in _LISTS) + " FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN [CAST(x AS VARCHAR) FOR x IN range(0, p_size % 4)] END AS w FROM part)")
def pred_arrays(s, d):
    k = (F.col("p_size") % 4).cast("int")
    words = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    p = A.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, words).alias("w"))
    return p.select("p_partkey", *(predicate(F.col("w"), "array_string", op, v, as_of=F.lit(A.AS_OF).cast("date")).alias(op) for op, v, _ in _LISTS))


# -- rule trees: events of the mart, windows, domain metrics -----------------------------------------------------------


def _mart_engine(s, d):
    brand = C._brand(s, d)
    brand.tables = {k: v for k, v in brand.tables.items() if k != "events"}
    return segment.Engine(brand, A.AS_OF)


@query(_ALL + f" SELECT customer_id FROM cba WHERE (total_bills > 0 AND last_bill_date >= DATE '{A.AS_OF}' - 120) OR (coalesce(total_bills, 0) > 14)")
def mart_event_purchase(s, d):
    return _mart_engine(s, d).segment(tree(ev("purchase", time_window={"type": "last_n_days", "days": 120}), ev("transaction", "performed_count_greater_than", 14, logical_operator="or")))


@query(_ALL + " SELECT customer_id FROM cba WHERE coalesce(promo_bill_count, 0) > 0 AND NOT (coalesce(total_bills, 0) > 0 AND coalesce(last_bill_date < DATE '1998-01-01', false))")
def mart_event_promo(s, d):
    return _mart_engine(s, d).segment(tree(ev("promo_usage"), ev("purchase", "has_not_performed", time_window={"type": "before_date", "end": "1998-01-01"})))


_EVC = "(SELECT md5('9' || lpad(CAST(user_id AS VARCHAR), 9, '0')) FROM events WHERE event_type = '{}' AND {})"
C._rule("event_after", tree(ev("error", time_window={"type": "after_date", "start": "2024-01-20"}), ev("signup", time_window={"type": "before_date", "end": "2024-01-20"})), f"customer_id IN {_EVC.format('error', 'ts > TIMESTAMP ' + repr('2024-01-20'))} AND customer_id IN {_EVC.format('signup', 'ts < TIMESTAMP ' + repr('2024-01-20'))}")
C._rule("event_not_performed_since", tree(ev("signup", "has_not_performed", time_window={"type": "after_date", "start": "2024-01-25"}), ev("click")), f"customer_id NOT IN {_EVC.format('signup', 'ts > TIMESTAMP ' + repr('2024-01-25'))} AND customer_id IN {_EVC.format('click', 'true')}")


def _domain_engine(s, d):
    """The lake tables from the driver's: orders as transactions, line items, orders as utility bills and as complaints, events as
    digital interactions."""
    o, l, e = A.table(s, d, "orders"), A.table(s, d, "lineitem"), A.table(s, d, "events")
    k, who, on = F.col("o_orderkey"), F.md5(A.mobile("o_custkey")), F.to_date("o_orderdate")
    brand = C._brand(s, d)
    brand.tables = {
        **brand.tables,
        "transactions": o.select(k.cast("string").alias("bill_id"), who.alias("customer_id"), on.alias("bill_date"), F.when(k % 3 == 0, "online").otherwise("in_store").alias("channel"), (k % 10).cast("string").alias("store_id"), "o_totalprice", F.col("o_totalprice").alias("bill_total"), F.lit(0.0).alias("discount_amount"), F.lit(1).alias("line_item_count")),
        "line_items": l.select(F.col("l_orderkey").cast("string").alias("bill_id"), F.col("l_partkey").alias("sku_id"), F.when(F.col("l_linenumber") % 2 == 0, "fresh_produce").otherwise("other").alias("department"), F.when(F.col("l_partkey") % 50 == 0, "baby").otherwise("x").alias("category"), F.col("l_extendedprice").alias("line_total"), F.col("l_quantity").cast("long").alias("quantity"), F.lit(False).alias("is_private_label"), F.lit(False).alias("is_promo")),
        "utility_billing": o.select(who.alias("customer_id"), on.alias("bill_date"), F.date_add(on, 10).alias("due_date"), F.date_add(on, (k % 20).cast("int")).alias("payment_date"), F.col("o_totalprice").alias("bill_amount"), F.col("o_totalprice").alias("payment_amount"), F.lit(0.0).alias("outstanding_amount"), F.lit(1.0).alias("consumption_kwh"), F.lit(False).alias("is_current"), F.lit(False).alias("disconnection_notice")),
        "complaints": o.select(who.alias("customer_id"), F.when(k % 2 == 0, "outage").otherwise("billing_dispute").alias("complaint_type"), F.when(k % 5 == 0, "open").otherwise("closed").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("resolved_at"), (k % 4 == 0).alias("is_escalated")),
        "digital_interactions": e.select(F.md5(A.mobile("user_id")).alias("customer_id"), F.lit("portal").alias("channel"), F.when(F.col("event_type") == "view", "login").otherwise("other").alias("action_type"), F.to_date("ts").alias("event_date")),
    }
    return segment.Engine(brand, A.AS_OF)


_WHO = "md5('9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'))"
_BASKET = f"SELECT {_WHO} FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END) >= 8"
_LINES_OF = f"SELECT {_WHO} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0 GROUP BY 1 HAVING bool_or(l_partkey % 50 = 0)"


@query(_ALL + f" SELECT customer_id FROM cba WHERE customer_id IN ({_BASKET}) AND customer_id IN ({_LINES_OF})")
def domain_basket_tree(s, d):
    return _domain_engine(s, d).segment(tree(attr("basket.total_store_visits", "greater_than_or_equal", 8), attr("basket.has_baby_products", "is_true")))


@query(_ALL + f" SELECT customer_id FROM cba WHERE customer_id IN (SELECT {_WHO} FROM orders GROUP BY 1 HAVING count(CASE WHEN o_orderkey % 20 <= 10 THEN 1 END) * 100.0 / count(*) > 70) OR customer_id IN (SELECT {_WHO} FROM orders GROUP BY 1 HAVING count(CASE WHEN o_orderkey % 4 = 0 THEN 1 END) > 4)")
def domain_billing_or_complaints_tree(s, d):
    return _domain_engine(s, d).segment(tree(attr("billing.on_time_payment_rate", "greater_than", 70), attr("complaint.escalation_count", "greater_than", 4, logical_operator="or")))


@query(_ALL + " SELECT customer_id FROM cba WHERE customer_id IN (SELECT md5('9' || lpad(CAST(user_id AS VARCHAR), 9, '0')) FROM events GROUP BY 1 HAVING max(CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END) >= DATE '2024-01-20') AND spend_decile >= 3")
def domain_digital_tree(s, d):
    return _domain_engine(s, d).segment(tree(attr("digital.last_digital_login_date", "after", "2024-01-19"), attr("decile.spend_decile", "greater_than_or_equal", 3)))


# -- audiences ---------------------------------------------------------------------------------------------------------


@query(_ALL + " SELECT customer_id FROM cba WHERE channel_presence = 'Omni' AND NOT coalesce(spend_decile >= 9, false) AND NOT coalesce(lifecycle_stage = 'Churned', false)")
def set_exclude_overlap(s, d):
    e = C.shared_engine(s, d)
    return segment.set_operation("exclude_overlap", [e.segment(x) for x in C._SETS])


@query(_ALL + " SELECT * FROM cba")
def registry_mart(s, d):
    """The mart as the registry builds it: from bills by channel, written once."""
    return tenant.models(s, d).frame("behavior")


@query(_ALL + ", x AS (SELECT 'behavior' AS name, count(*) AS n, sum(total_spend) AS spend FROM cba UNION ALL SELECT 'graph', count(*), NULL FROM up) SELECT name, n, CAST(spend AS DECIMAL(25,2)) AS spend FROM x")
def published_marts(s, d):
    """Rows of the marts that were published twice, as a reader finds them by name."""
    at = A.scratch(s)
    m = tenant.models(s, d, at, publish=True)
    for _ in range(2):
        m.forget("behavior", "graph")
        m.run("behavior", "graph")
    tables = publish.Published(s, at)
    rows = tables.read("behavior").agg(F.lit("behavior").alias("name"), F.count("*").alias("n"), F.sum("total_spend").cast("decimal(25,2)").alias("spend"))
    return rows.unionByName(tables.read("graph").agg(F.lit("graph").alias("name"), F.count("*").alias("n"), F.lit(None).cast("decimal(25,2)").alias("spend")))


@query(_ALL + f" SELECT 'audience' AS part, count(*) AS n FROM cba WHERE {' OR '.join(C._S)} UNION ALL SELECT 'member 1', count(*) FROM cba WHERE {C._S[1]} UNION ALL SELECT 'member 2', count(*) FROM cba WHERE {C._S[2]}")
def estimate_with_members(s, d):
    got = C.shared_engine(s, d).estimate({"root": C._SETS[0], "set_operation": "union", "set_members": C._SETS[1:]})
    return s.createDataFrame([("audience", got["audience_count"]), *((f"member {i + 1}", n) for i, n in enumerate(got["members"]))], "part string, n long")


@query(_ALL + f" SELECT 'union' AS kind, count(*) AS n FROM cba WHERE {' OR '.join(C._S)} UNION ALL SELECT 'overlap', count(*) FROM cba WHERE {' AND '.join(C._S)} UNION ALL SELECT 'exclude', count(*) FROM cba WHERE {C._S[0]} AND NOT coalesce({C._S[1]}, false) AND NOT ({C._S[2]})")
def set_counts_by_sketch(s, d):
    """Exact at every size: audiences are parts of the profiles, whose number says into how many parts the sketches go."""
    e = C.shared_engine(s, d)
    parts = sketches.parts_for(e.brand.table("profiles").count())
    held = written(sketches.sketched({f"a{i}": e.segment(x) for i, x in enumerate(C._SETS)}, parts=parts))
    rows = [sketches.set_count(held, kind, ["a0", "a1", "a2"], exact=True) for kind in ("union", "overlap", "exclude")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT name, 'SUCCEEDED' AS state, n FROM (SELECT 'customers with orders' AS name, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'large lines', count(*) FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'rich suppliers', count(*) FROM supplier WHERE s_acctbal > 5000)""")
def executions(s, d):
    """Three queries by handle, two at a time."""
    t = lambda name: A.table(s, d, name)
    asked = {"customers with orders": t("orders").select("o_custkey").distinct(), "large lines": t("lineitem").where("l_quantity > 40"), "rich suppliers": t("supplier").where("s_acctbal > 5000")}
    runs = execution.Executions(s, at_most=2)
    ids = {name: runs.submit(df, lambda x: x.count()) for name, df in asked.items()}
    got = [(name, runs.wait(i), runs.poll(i).state) for name, i in ids.items()]
    runs.close()
    return s.createDataFrame(got, "name string, n long, state string")


@query("""SELECT 'customers-' || lpad(CAST(b AS VARCHAR), 10, '0') AS batch, count(*) AS n, CASE WHEN min(c_custkey) % 2 = 1 THEN 'taken before' ELSE 'failed' END AS outcome FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 75 AS b FROM customer) GROUP BY b""")
def sink_ledger(s, d):
    """Customers in batches, sent twice to a receiver that refuses every other batch: what was taken isn't sent again."""
    rows = ledger.batched(A.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], "customers", 75)
    noted = ledger.Ledger(A.scratch(s))
    sent = lambda: ledger.send_batches(rows, lambda name, batch: batch[0]["c_custkey"] % 2 == 1, noted, ["c_custkey"])
    sent().write.format("noop").mode("overwrite").save()
    return written(sent()).withColumnRenamed("_batch", "batch")


@query(_ALL + " SELECT customer_id FROM cba WHERE lifecycle_stage = 'Churned'")
def set_of_none(s, d):
    """An audience without the members of no audience."""
    return segment.set_operation("exclude", [engine(s, d).segment(C._ATRISK), segment.set_operation("union", [])])


@query(_ALL + """, t AS (SELECT customer_id, lower(l1_segment) AS v FROM cba WHERE lifecycle_stage = 'Churned') SELECT 'audience' AS part, count(*) AS n FROM t UNION ALL SELECT 'HVHF', count(*) FROM t WHERE v = 'hvhf' HAVING count(*) > 0 UNION ALL SELECT 'Remainder', count(*) FROM t WHERE v IS DISTINCT FROM 'hvhf' HAVING count(*) > 0""")
def estimate_with_split(s, d):
    got = engine(s, d).estimate({"root": C._ATRISK, "split": {"type": "attribute", "attribute_key": "lifecycle.l1_segment", "splits": [{"value": "HVHF"}]}})
    return s.createDataFrame([("audience", got["audience_count"]), *got["splits"].items()], "part string, n long")


@query(_ALL + " SELECT customer_id FROM cba WHERE lifecycle_stage = 'Churned' AND spend_decile >= 9")
def materialized_segment(s, d):
    e = engine(s, d)
    e.materialize("gone", C._ATRISK, A.scratch(s))
    return e.segment(tree(C.member("gone"), attr("decile.spend_decile", "greater_than_or_equal", 9)))


_OF_MART = [a for a in catalog.CATALOG.values() if a.alias == "ba" and a.key not in catalog._DERIVED]


@query(_ALL + " " + " UNION ALL ".join(f"SELECT '{a.key}' AS key, '{a.kind}' AS kind, count({a.column}) AS known FROM cba" for a in _OF_MART))
def attribute_catalogue(s, d):
    """The attributes of the mart, and how many customers have a value of each: one pass over the mart."""
    listed = {x["key"]: x["type"] for x in segment.Engine.attributes() if x["key"] in {a.key for a in _OF_MART}}
    counts = C._behavior(s, d).agg(*(F.count(catalog.attribute(k).column).alias(k) for k in listed))
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), F.col(f"`{k}`").alias("known")) for k, kind in listed.items()))
    return counts.select(F.inline(rows))


@query(_ALL + " SELECT 'decile.spend_decile' AS found, count(DISTINCT spend_decile) AS n FROM cba UNION ALL SELECT 'decile.nob_decile', count(DISTINCT nob_decile) FROM cba UNION ALL SELECT 'top-spend-decile', count(*) FROM cba WHERE spend_decile >= 9")
def suggestions(s, d):
    """What a part of a name finds: attributes with their number of values, audiences with their size."""
    e = C.shared_engine(s, d)
    out = None
    for found in catalog.suggest("decile"):
        rows = e.count(TEMPLATES[found]).withColumnRenamed("audience_count", "n") if found in TEMPLATES else e.distinct_values(found).agg(F.count("*").alias("n"))
        rows = rows.select(F.lit(found).alias("found"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_ALL + " SELECT true AS planned, count(*) AS n FROM cba WHERE lifecycle_stage = 'Churned'")
def explained(s, d):
    """The plan of an audience names what it gives, and the audience is what was planned."""
    e = engine(s, d)
    return e.count(C._ATRISK).select(F.lit("customer_id" in e.explain(C._ATRISK)).alias("planned"), F.col("audience_count").alias("n"))


@query(_ALL + " SELECT customer_id, email, NULL::VARCHAR AS first_name, NULL::VARCHAR AS last_name, city, NULL::VARCHAR AS state FROM cba WHERE lifecycle_stage = 'Churned' ORDER BY customer_id LIMIT 50")
def preview_athena(s, d):
    return engine(s, d, "athena").preview(C._ATRISK, 50)


@query(_ALL + """ SELECT customer_id, cba.mobile, email, lifecycle_stage AS user_lifecycle, CAST(round(promo_bill_count * 100.0 / total_bills) AS INTEGER) AS promo_share, l1_segment AS value_segment, round(total_spend, 0)::DOUBLE AS total_spend_rounded,
  tenure_days AS days_since_signup, fav_store_code AS preferred_store FROM cba WHERE promo_bill_count >= 2 AND lifecycle_stage IN ('Active', 'At Risk')""")
def reverse_etl_rows(s, d):
    m = tenant.models(s, d, kind="view")
    rows = sinks.audience_rows(tenant.mart(m, set()), m.frame("profiles"), catalog.EXPORTS["promo_responsive"])
    return rows.withColumn("total_spend_rounded", F.col("total_spend_rounded").cast("double"))


# -- identity ----------------------------------------------------------------------------------------------------------


@query(_ALL + f""", {C._GS} SELECT gs.unified_id, gs.canonical_mobile, gs.display_name, cba.email, trim(registered_store) AS primary_store_code, store_name AS primary_store_name, store_state AS primary_store_city, lifecycle_stage, total_bills, total_spend, promo_bill_count, tenure_days,
  recency_days, l1_segment, completeness_score, source_systems, store_count FROM gs JOIN cba ON customer_id = unified_id LEFT JOIN loc ON store_code = trim(registered_store)""")
def customer_360(s, d):
    m = tenant.models(s, d, kind="view")
    return identity.customer_360(m.frame("profiles"), m.frame("locations"), tenant.mart(m, set()), m.frame("graph"))


@query(f"{C._ID}, {C._UP} SELECT unified_id, display_name FROM up WHERE canonical_mobile = '9000000007'")
def lookup_mobile(s, d):
    return identity.lookup(C._profiles(s, d), "9000000007").select("unified_id", "display_name")


@query(f"{C._ID}, {C._UP}, {C._EDGES} SELECT * FROM ed WHERE unified_id = md5('9000000007')")
def edges_of_profile(s, d):
    key = s.range(1).select(F.md5(F.lit("9000000007"))).first()[0]
    return identity.edges_of(C._edges(s, d), key)


@query("SELECT c_custkey AS id, greatest(c_custkey - c_custkey % 5, (SELECT min(c_custkey) FROM customer)) AS root FROM customer")
def connected_people(s, d):
    """Chains of five; the last one has as many as there are, and who is alone is linked with themselves."""
    A.checkpoints(s)
    c = A.table(s, d, "customer").select(F.col("c_custkey").alias("id_1"))
    next_ = c.select((F.col("id_1") - 1).alias("id_1"), F.col("id_1").alias("id_2")).where("id_1 % 5 <> 4")
    pairs = c.join(next_, "id_1", "left").select("id_1", F.coalesce("id_2", "id_1").alias("id_2"))
    return identity.connected_people(pairs)


# -- data tests --------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_nationkey AS value, count(*) AS num_rows FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS value, count(*) AS num_rows FROM supplier GROUP BY 1)
  (SELECT *, 'a' AS side FROM a EXCEPT SELECT *, 'a' FROM b) UNION ALL (SELECT *, 'b' FROM b EXCEPT SELECT *, 'b' FROM a)""")
def dq_cardinality_equality(s, d):
    """Values that the two tables hold a different number of times, with each side's number."""
    a, b = A.table(s, d, "customer"), A.table(s, d, "supplier")
    differ = dq.cardinality_equality(a, "c_nationkey", b, "s_nationkey").select("value", "num_rows")
    count = lambda df, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("num_rows"))
    sides = count(a, "c_nationkey").withColumn("side", F.lit("a")).unionByName(count(b, "s_nationkey").withColumn("side", F.lit("b")))
    return sides.join(differ.distinct(), ["value", "num_rows"], "left_semi")


@query("SELECT k, count_a, count_b, count_a - count_b + 1 AS row_count_delta FROM (SELECT p_size % 5 AS k, count(*) AS count_a FROM part WHERE p_size > 20 GROUP BY 1) JOIN (SELECT p_size % 5 AS k, count(*) AS count_b FROM part WHERE p_size < 35 GROUP BY 1) USING (k) WHERE count_a >= count_b")
def dq_fewer_rows_than(s, d):
    p = A.table(s, d, "part").withColumn("k", F.col("p_size") % 5)
    return dq.fewer_rows_than(p.where("p_size > 20"), p.where("p_size < 35"), ["k"])


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def dq_not_accepted_values(s, d):
    return dq.not_accepted_values(A.table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("SELECT n_regionkey, 1::BIGINT AS filler FROM nation GROUP BY 1 HAVING count(DISTINCT CASE WHEN n_regionkey < 3 THEN 'same' ELSE n_name END) = 1")
def dq_not_constant(s, d):
    n = A.table(s, d, "nation").withColumn("v", F.when(F.col("n_regionkey") < 3, "same").otherwise(F.col("n_name")))
    return dq.not_constant(n, "v", ["n_regionkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0")
def dq_not_empty_string(s, d):
    c = A.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "  ").otherwise(F.col("c_name")).alias("v"))
    return dq.not_empty_string(c, "v").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0")
def dq_not_null(s, d):
    c = A.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_name")).alias("v"))
    return dq.not_null(c, "v").select("c_custkey")


@query("SELECT l_orderkey, count(*) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dq_unique(s, d):
    return dq.unique(A.table(s, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <> round(o_totalprice, 0)")
def dq_assert_equal(s, d):
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice", F.round("o_totalprice", 0).alias("expected"))
    return dq.assert_equal(o, "o_totalprice", "expected").select("o_orderkey")


@query("SELECT 'n_regionkey' AS name, count(n_regionkey) AS n FROM nation UNION ALL SELECT 'n_comment', 0")
def dq_column_set(s, d):
    """Columns that the table or the expectation alone has, with their number of values."""
    n = A.table(s, d, "nation")
    differ = dq.column_set_difference(n, ["N_NATIONKEY", "n_name", "n_comment"])
    counts = n.agg(*((F.count(c) if c in n.columns else F.count(F.lit(None))).alias(c) for c in differ))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in differ))))


# -- helpers -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(datediff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(datediff('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS months FROM orders")
def intervals_between(s, d):
    on = F.to_date("o_orderdate")
    parts = {"days": ("1998-01-01", "day"), "months": ("1992-01-01", "month")}
    return A.table(s, d, "orders").select("o_orderkey", *(sqlutils.intervals_between(F.lit(a).cast("date"), on, p).cast("long").alias(n) for n, (a, p) in parts.items()))


@query("SELECT o_orderpriority AS value FROM orders WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3")
def column_values(s, d):
    return s.createDataFrame([(v,) for v in sqlutils.column_values(A.table(s, d, "orders"), "o_orderpriority", "o_totalprice > 1000", 3)], "value string")


@query("SELECT n_nationkey AS x_n_nationkey_y, n_regionkey AS x_n_regionkey_y FROM nation")
def star_and_filtered_columns(s, d):
    n = A.table(s, d, "nation")
    if sqlutils.filtered_columns(n, ["N_NAME"]) != [c for c in n.columns if c != "n_name"]:
        raise AssertionError("filtered_columns")
    return n.select(*sqlutils.star(n, ["N_Name"], "x_", "_y"))


@query("SELECT r_regionkey AS k, r_name AS name, (SELECT count(*) FROM nation) AS nations, 'fallback' AS none FROM region")
def results_and_single_value(s, d):
    got = sqlutils.results_as_dict(A.table(s, d, "region").orderBy("r_regionkey"))
    n = sqlutils.single_value(A.table(s, d, "nation").agg(F.count("*")))
    none = sqlutils.single_value(A.table(s, d, "nation").where("false"), "fallback")
    return s.createDataFrame([(k, name, n, none) for k, name in zip(got["r_regionkey"], got["r_name"])], "k int, name string, nations long, none string")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_first(s, d):
    return sqlutils.group_by_first(A.table(s, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey"), 2).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(t, '^[0-9]') THEN '_' || t ELSE t END AS slug, count(*) AS orders FROM (SELECT regexp_replace(regexp_replace(lower(o_orderpriority), '[ -]+', '_', 'g'), '[^a-z0-9_]+', '', 'g') AS t FROM orders) GROUP BY 1")
def slugs(s, d):
    return A.table(s, d, "orders").groupBy(sqlutils.slug(F.col("o_orderpriority")).alias("slug")).agg(F.count("*").alias("orders"))


@query("SELECT count(DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'blank' ELSE c_name END) AS keys, count(DISTINCT CASE WHEN c_custkey % 3 < 2 THEN 'one' ELSE c_name END) AS legacy_keys FROM customer")
def surrogate_key_legacy(s, d):
    """Keys tell nulls from blanks; those of the old kind don't."""
    k = F.col("c_custkey") % 3
    name = F.when(k == 2, F.col("c_name")).when(k == 1, F.lit(""))
    c = A.table(s, d, "customer")
    return c.agg(F.count_distinct(sqlutils.surrogate_key([name])).alias("keys"), F.count_distinct(sqlutils.surrogate_key([name], null_as="")).alias("legacy_keys"))


# -- exports and stored audiences --------------------------------------------------------------------------------------


@query(_ALL + " " + " UNION ALL ".join(f"SELECT '{name}' AS audience, customer_id FROM cba WHERE {where}" for name, where in catalog.EXPORTS.items()))
def export_audiences(s, d):
    """All audiences that the sinks export, over one mart."""
    mart = tenant.mart(tenant.models(s, d, kind="view"), set())
    found = F.array(*(F.when(F.expr(where), name) for name, where in catalog.EXPORTS.items()))
    return mart.select("customer_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("audience"))


@query(_ALL + " SELECT 'top' AS segment_id, count(*) AS customers FROM cba WHERE spend_decile >= 8 UNION ALL SELECT 'top_gone', count(*) FROM cba WHERE spend_decile >= 8 AND lifecycle_stage = 'Churned'")
def stored_segments(s, d):
    """Two audiences, one a member of the other, after an update, another computation and a deletion."""
    stored = segments.Segments(C.shared_engine(s, d), publish.Published(s, A.scratch(s)))
    stored.create("top", tree(attr("decile.spend_decile", "greater_than_or_equal", 10)))
    stored.create("gone", TEMPLATES["churned"])
    stored.create("top_gone", tree(C.member("top"), attr("lifecycle.lifecycle_stage", "equals", "Churned")))
    stored.update("top", tree(attr("decile.spend_decile", "greater_than_or_equal", 8)))
    stored.compute("top_gone")
    stored.delete("gone")
    out = [stored.ids(x.segment_id).agg(F.lit(x.segment_id).alias("segment_id"), F.count("*").alias("customers")) for x in stored.all()]
    return out[0].unionByName(out[1])
