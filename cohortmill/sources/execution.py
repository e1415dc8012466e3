"""Handles of running queries: submit, poll, wait, cancel, with a time limit and at most so many at a time.

Each query runs in a thread of its own under a job tag, so cancelling it ends its Spark jobs and no others. Queries beyond
`at_most` wait for a place in the order in which they came.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

QUEUED, RUNNING, SUCCEEDED, FAILED, CANCELLED = "QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"
ENDED = (SUCCEEDED, FAILED, CANCELLED)


@dataclass
class Execution:
    """id is the tag of the query's jobs. error says why it failed or was cancelled."""

    id: str
    state: str = QUEUED
    error: str | None = None
    result: Any = None
    submitted: float = field(default_factory=time.time)
    began: float | None = None
    ended: float | None = None
    done: threading.Event = field(default_factory=threading.Event, repr=False)

    @property
    def seconds(self) -> float:
        """Time that it ran so far, or in all."""
        return ((self.ended or time.time()) - self.began) if self.began else 0.0


class Executions:
    """at_most queries run at once, each for `limit` seconds at most. The defaults are those of the reference's connector."""

    def __init__(self, spark: SparkSession, at_most: int = 5, limit: float = 300.0, row_cap: int = 10_000):
        self.spark, self.limit, self.row_cap = spark, limit, row_cap
        self._pool = ThreadPoolExecutor(at_most, "cohortmill-query")
        self._lock = threading.Lock()
        self._all: dict[str, Execution] = {}

    def submit(self, query: DataFrame | Callable[[], DataFrame], act: Callable[[DataFrame], Any] | None = None, limit: float | None = None) -> str:
        """Queue a query (or a function that builds it, so that what it computes while it is built is tagged too); act is
        what is done with it: its first row_cap rows as dicts, if nothing is named. Gives the id."""
        e = Execution(f"query-{uuid.uuid4().hex}")
        self._all[e.id] = e
        self._pool.submit(self._run, e, query, act or self._rows, self.limit if limit is None else limit)
        return e.id

    def poll(self, id: str) -> Execution:
        if id not in self._all:
            raise ValueError(f"unknown execution {id!r}")
        return self._all[id]

    def wait(self, id: str, timeout: float | None = None) -> Any:
        """The result; raises what the query failed of, or that it was cancelled."""
        e = self.poll(id)
        if not e.done.wait(timeout):
            raise TimeoutError(f"{id} is {e.state}")
        if e.state != SUCCEEDED:
            raise RuntimeError(f"{id} {e.state}: {e.error}")
        return e.result

    def cancel(self, id: str, why: str = "cancelled") -> bool:
        """Ends a query that waits or runs; False if it has ended."""
        e = self.poll(id)
        with self._lock:
            if e.state in ENDED:
                return False
            waiting, e.state, e.error = e.state == QUEUED, CANCELLED, why
            e.ended = time.time()
        if waiting:
            e.done.set()
        else:
            self.spark.sparkContext.cancelJobsWithTag(e.id)
        return True

    def running(self) -> list[str]:
        return [e.id for e in self._all.values() if e.state == RUNNING]

    def close(self) -> None:
        for id in list(self._all):
            self.cancel(id, "closed")
        self._pool.shutdown(wait=True)

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict() for r in df.limit(self.row_cap).collect()]

    def _run(self, e: Execution, query: DataFrame | Callable[[], DataFrame], act: Callable[[DataFrame], Any], limit: float) -> None:
        with self._lock:
            if e.state == CANCELLED:
                return
            e.state, e.began = RUNNING, time.time()
        sc = self.spark.sparkContext
        timer = threading.Timer(limit, self.cancel, (e.id, f"took more than {limit:g} s"))
        timer.daemon = True
        timer.start()
        sc.addJobTag(e.id)
        # Between two jobs there is nothing to cancel: a query that was cancelled there is cancelled again until it ends.
        watch = threading.Thread(target=self._insist, args=(e,), daemon=True)
        watch.start()
        try:
            result, state, error = act(query() if callable(query) else query), SUCCEEDED, None
        except Exception as x:
            result, state, error = None, FAILED, f"{type(x).__name__}: {x}"
        finally:
            sc.removeJobTag(e.id)
            timer.cancel()
        with self._lock:
            if e.state != CANCELLED:
                e.state, e.error, e.result, e.ended = state, error, result, time.time()
        e.done.set()

    def _insist(self, e: Execution) -> None:
        while not e.done.wait(0.5):
            if e.state == CANCELLED:
                self.spark.sparkContext.cancelJobsWithTag(e.id)
