"""Handles of running queries, exports that survive a retry, sketches of audiences."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cohortmill.functions.storage import scratch
from cohortmill.operators import segment, sketches
from cohortmill.sources import execution as ex
from cohortmill.sources.ledger import Ledger, batched, export, send_batches


def slow(spark, seconds, rows=8):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(0, rows, 1, 1).mapInArrow(wait, "id long")


def until(test, seconds=30):
    end = time.time() + seconds
    while not test():
        assert time.time() < end
        time.sleep(0.05)


def test_submit_poll_result_and_row_cap(spark):
    runs = ex.Executions(spark, at_most=2, row_cap=3)
    a, b = runs.submit(spark.range(5)), runs.submit(lambda: spark.range(7), lambda df: df.count())
    assert runs.wait(a, 60) == [{"id": 0}, {"id": 1}, {"id": 2}] and runs.wait(b, 60) == 7
    assert runs.poll(b).state == ex.SUCCEEDED and runs.poll(b).seconds > 0
    bad = runs.submit(lambda: spark.range(1).select("nothing"))
    with pytest.raises(RuntimeError, match="FAILED"):
        runs.wait(bad, 60)
    with pytest.raises(ValueError):
        runs.poll("other")
    assert not runs.cancel(a)
    runs.close()


def test_cancel_ends_the_jobs_of_one_query_only(spark):
    runs = ex.Executions(spark, at_most=2)
    a, b = runs.submit(slow(spark, 60)), runs.submit(slow(spark, 2), lambda df: df.count())
    until(lambda: len(runs.running()) == 2)
    time.sleep(1)
    began = time.time()
    assert runs.cancel(a)
    with pytest.raises(RuntimeError, match="CANCELLED: cancelled"):
        runs.wait(a, 30)
    assert time.time() - began < 25 and runs.wait(b, 60) == 8
    runs.close()


def test_time_limit(spark):
    runs = ex.Executions(spark, at_most=1, limit=1.5)
    a = runs.submit(slow(spark, 60))
    with pytest.raises(RuntimeError, match="more than 1.5 s"):
        runs.wait(a, 30)
    assert runs.wait(runs.submit(spark.range(2), lambda df: df.count(), limit=60), 60) == 2
    runs.close()


def test_no_more_than_the_cap_run_at_once(spark):
    runs = ex.Executions(spark, at_most=2)
    ids = [runs.submit(slow(spark, 1, 1), lambda df: df.count()) for _ in range(5)]
    seen = []
    waiting = ids[-1]
    until(lambda: seen.append(len(runs.running())) or any(runs.poll(i).state == ex.SUCCEEDED for i in ids))
    assert max(seen) == 2 and runs.poll(waiting).state == ex.QUEUED
    assert runs.cancel(waiting) and runs.poll(waiting).state == ex.CANCELLED
    assert [runs.wait(i, 60) for i in ids[:-1]] == [1] * 4 and runs.poll(waiting).began is None
    runs.close()


def receiver(folder, refuse=()):
    """Notes each batch that reaches it, as a file for each time."""

    def send(name, rows):
        number = len([x for x in os.listdir(folder) if x.startswith(name)])
        open(f"{folder}/{name}.{number}.{len(rows)}", "w").close()
        return name not in refuse

    return send


def test_a_task_that_fails_after_its_first_batch_sends_no_batch_twice(spark, tmp_path):
    rows = batched(spark.range(50).withColumn("v", F.col("id") * 2), ["id"], "x", 10)
    assert sorted((r["_batch"], r.n) for r in rows.groupBy("_batch").agg(F.count("*").alias("n")).collect()) == [(f"x-{i:010d}", 10) for i in range(5)]
    ledger, got = Ledger(scratch(spark)), tmp_path / "got"
    got.mkdir()
    send, broke = receiver(got), tmp_path / "broke"

    class Lost(BaseException):
        """What no receiver raises: the task itself ends."""

    def breaks_once(name, batch):
        if len(os.listdir(got)) >= 1 and not broke.exists():
            broke.touch()
            raise Lost
        return send(name, batch)

    # One task holds all batches; it is lost after the first, and runs again.
    try:
        send_batches(rows.coalesce(1), breaks_once, ledger, ["id"]).collect()
    except Exception:
        assert broke.exists() and len(ledger.names()) >= 1
        outcome = {r["_batch"]: r.outcome for r in send_batches(rows, breaks_once, ledger, ["id"]).collect()}
        assert "taken before" in outcome.values()
    assert broke.exists()
    assert sorted(os.listdir(got)) == [f"x-{i:010d}.0.10" for i in range(5)] and len(ledger.names()) == 5


def test_export_counts_by_the_ledger_and_resends_what_failed(spark, tmp_path):
    ledger, got = Ledger(scratch(spark)), tmp_path / "got"
    got.mkdir()
    df = spark.range(25)
    assert export(df, ["id"], "e", receiver(got, ["e-0000000001"]), ledger, 10) == {"synced": 15, "failed": 10}
    assert export(df, ["id"], "e", receiver(got), ledger, 10) == {"synced": 25, "failed": 0}
    assert sorted(os.listdir(got)) == ["e-0000000000.0.10", "e-0000000001.0.10", "e-0000000001.1.10", "e-0000000002.0.5"]
    assert export(df.where("false"), ["id"], "none", receiver(got), ledger, 10) == {"synced": 0, "failed": 0}


def test_sketches_are_exact_when_small_and_near_when_large(spark):
    ids = lambda a, b: spark.range(a, b).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("customer_id"))
    for scale, error in ((1, 0), (100, 0.05)):
        audiences = {"a": ids(0, 600 * scale), "b": ids(300 * scale, 900 * scale), "c": ids(500 * scale, 550 * scale)}
        held = sketches.sketched(audiences)
        for kind in ("union", "overlap", "exclude", "exclude_overlap"):
            exact = segment.set_operation(kind, list(audiences.values())).count()
            n = sketches.set_count(held, kind, ["a", "b", "c"]).first().n
            assert abs(n - exact) <= error * 900 * scale, (kind, scale, n, exact)
    empty = sketches.sketched({"a": ids(0, 5), "none": ids(0, 0)})
    assert sketches.set_count(empty, "union", ["a", "none"]).first().n == 5 and sketches.set_count(empty, "overlap", ["a", "none"]).first().n == 0
    with pytest.raises(ValueError):
        sketches.set_count(held, "other", ["a", "b"])
