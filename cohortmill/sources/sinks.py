"""Sinks: files, webhooks, upserts, deltas by row hash, audit log."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.sqlutils import row_hash
from cohortmill.operators.staging import scrubbed


def write_csv(df: DataFrame, path: str, single: bool = False) -> int:
    """With a header; one file only for audiences that one task can hold. Gives the number of rows, counted as they are
    written."""
    from pyspark.sql import Observation

    seen = Observation()
    (df.coalesce(1) if single else df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def export_path(folder: str, audience: str, at: str) -> str:
    """{folder}/{audience}_{yyyymmdd_hhmmss}.csv"""
    return f"{folder.rstrip('/')}/{audience}_{at}.csv"


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Scrubbed rows as Parquet; partitions are replaced one by one."""
    writer = scrubbed(df).write.mode(mode).option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def post(url: str, token: str, timeout: float = 30.0) -> Callable[[list[dict]], bool]:
    """Sends one batch as JSON; True if it was taken."""

    def send(rows: list[dict]) -> bool:
        request = urllib.request.Request(url, json.dumps(rows, default=str).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {token}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return 200 <= answer.status < 300

    return send


def webhook(df: DataFrame, send: Callable[[list[dict]], bool], batch_size: int = 100) -> dict[str, int]:
    """Each task sends its rows in batches; a batch that fails counts as failed and doesn't stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, failed, held = 0, 0, []

        def flush() -> None:
            nonlocal done, failed
            try:
                ok = send(held)
            except Exception:  # whatever the receiver does, the other batches go out
                ok = False
            done, failed = done + len(held) * ok, failed + len(held) * (not ok)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == batch_size:
                    flush()
                    held = []
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"synced": [done], "failed": [failed]})

    r = df.mapInArrow(run, "synced long, failed long").agg(F.coalesce(F.sum("synced"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))).first()
    return {"synced": r[0], "failed": r[1]}


#: Fields that exports send, with their source columns and expressions. Fixed values where the mart has the column.
MAPPINGS = {
    "user_lifecycle": ("lifecycle_stage", None),
    "promo_share": ("promo_bill_count", "CAST(ROUND(promo_bill_count * 100.0 / total_bills) AS INT)"),
    "value_segment": ("l1_segment", None),
    "total_spend_rounded": ("total_spend", "ROUND(total_spend, 0)"),
    "days_since_signup": ("tenure_days", None),
    "preferred_store": ("fav_store_code", None),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """The old rows with the new ones put over them by key; update=False keeps the old ones."""
    if update:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def changed_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new or differ from the old row of their key, with their hash."""
    a, b = new.withColumn("row_hash", row_hash(new)), old.withColumn("row_hash", row_hash(old))
    return a.join(b.select(*keys, "row_hash"), [*keys, "row_hash"], "left_anti").select(*new.columns, "row_hash")


def audit(spark: SparkSession, path: str, audience: str, synced: int, failed: int, error: str | None = None, at: str | None = None) -> None:
    """Appends one line to the sync log."""
    row = (audience, "SUCCESS" if not failed and not error else "PARTIAL", synced, failed, (error or "")[:1000] or None, at)
    spark.createDataFrame([row], "audience string, status string, synced long, failed long, error string, synced_at string").write.mode("append").parquet(path)


ADAPTERS: dict[str, Callable] = {
    "csv": lambda df, options: {"synced": write_csv(df, options["path"], options.get("single", False)), "failed": 0},
    "webhook": lambda df, options: webhook(df, options.get("send") or post(options["url"], options["token"]), options.get("batch_size", 100)),
}


def audience_rows(behavior: DataFrame, identity: DataFrame, audience_filter: str, mappings: Mapping[str, tuple[str, str | None]] = MAPPINGS) -> DataFrame:
    """customer_id, mobile, email and the mapped attributes of an audience: the behaviour mart's rows of the filter that
    have an identity. mappings: destination field -> (source column, expression over it or None)."""
    ids = identity.select(F.col("unified_id").alias("customer_id"), F.col("canonical_mobile").alias("mobile"), "email")
    fields = [F.expr(how or column).alias(name) for name, (column, how) in mappings.items()]
    return behavior.where(audience_filter).select("customer_id", *fields).join(ids, "customer_id")


def export(df: DataFrame, audience_filter: str, destinations: list[dict], columns: list[str] | None = None) -> list[dict]:
    """Rows of the filter to every destination; unknown kinds are reported and left out."""
    rows = df.where(audience_filter)
    rows = rows.select(*columns) if columns else rows
    out = []
    for d in destinations:
        adapter = ADAPTERS.get(d.get("type", ""))
        out.append({"type": d.get("type"), **(adapter(rows, d) if adapter else {"skipped": True})})
    return out
