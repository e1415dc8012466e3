"""Tables in the folder that all executors share: the one named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, computed once: written as Parquet and read back, so that a lost executor costs its running tasks only."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster: --py-files or an image)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
