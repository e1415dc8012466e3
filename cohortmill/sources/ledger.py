"""Exports in batches that survive a retry.

Rows are numbered once, in the order of their key, and written with their batch: a batch has the same rows and the same id
(`<export>-<number>`) whoever sends it again. A batch that was taken is noted in the ledger, a folder that all executors
share, by a file of its name; before a batch is sent, the ledger is asked. So a task that runs again, or a second run of
the export, sends only what wasn't taken. Between the receiver's answer and the note lies a moment in which an executor can be
lost: for that case the receiver gets the batch's id, which is the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.storage import importable
from cohortmill.functions.windows import global_rank

#: Sends the rows of a batch under its id; True if they were taken.
Send = Callable[[str, list[dict]], bool]


class Ledger:
    """Names of batches in a folder, by what pyarrow can open (file, hdfs, viewfs, s3, gs)."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def taken(self, name: str) -> bool:
        where, at = self._open()
        return where.get_file_info(f"{at}/{name}").type != fs.FileType.NotFound

    def note(self, name: str) -> None:
        where, at = self._open()
        where.create_dir(at, recursive=True)
        with where.open_output_stream(f"{at}/{name}"):
            pass

    def names(self) -> list[str]:
        where, at = self._open()
        return sorted(x.base_name for x in where.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def batched(df: DataFrame, keys: list[str], export: str, batch_size: int = 100) -> DataFrame:
    """df with `_batch`, the id of each row's batch, written once; keys should be unique."""
    numbered = global_rank(df, [F.asc(k) for k in keys], "_n")
    return numbered.withColumn("_batch", F.concat(F.lit(f"{export}-"), F.lpad(F.floor((F.col("_n") - 1) / batch_size).cast("string"), 10, "0"))).drop("_n")


def send_batches(rows: DataFrame, send: Send, ledger: Ledger, keys: list[str]) -> DataFrame:
    """_batch, n, outcome (sent, taken before, or failed) of each batch of `batched`; lazy: each run sends what isn't taken."""
    importable(rows.sparkSession)
    columns = [c for c in rows.columns if c != "_batch"]

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        name = key[0].as_py()
        if ledger.taken(name):
            outcome = "taken before"
        else:
            try:
                taken = send(name, batch.select(columns).sort_by([(k, "ascending") for k in keys]).to_pylist())
            except Exception:  # whatever the receiver does, the other batches go out
                taken = False
            if taken:
                ledger.note(name)
            outcome = "sent" if taken else "failed"
        return pa.table({"_batch": [name], "n": [batch.num_rows], "outcome": [outcome]})

    return rows.groupBy("_batch").applyInArrow(run, "_batch string, n long, outcome string")


def export(df: DataFrame, keys: list[str], name: str, send: Send, ledger: Ledger, batch_size: int = 100) -> dict[str, int]:
    """Send all rows; gives how many are synced (now or before) and how many failed, by the ledger, not by tasks' counts."""
    rows = batched(df, keys, name, batch_size)
    send_batches(rows, send, ledger, keys).write.format("noop").mode("overwrite").save()
    return counts(df.sparkSession, rows, ledger)


def counts(spark: SparkSession, rows: DataFrame, ledger: Ledger) -> dict[str, int]:
    """Rows of the batches that the ledger holds, and of the others."""
    sizes = rows.groupBy("_batch").agg(F.count("*").alias("n"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([ledger.taken(x) for x in b.column(0).to_pylist()], pa.bool_())], ["n", "taken"])

    r = sizes.mapInArrow(mark, "n long, taken boolean").agg(F.sum(F.when(F.col("taken"), F.col("n"))).alias("synced"), F.sum(F.when(~F.col("taken"), F.col("n"))).alias("failed")).first()
    return {"synced": r.synced or 0, "failed": r.failed or 0}
