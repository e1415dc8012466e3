"""Tables that cut lineage, in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later readers never recompute it, and a lost
    executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that materialize wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster: --py-files or an image)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
