"""The corpus pipeline: documents without toxic, repeated and benchmark texts, mixed by source weights, in shards.

Every stage takes what its predecessor kept, as rows of `documents`; the last one adds the shard. Without toxic labels of both
classes the first stage keeps every document. Stages call operators of
cohortmill.llm and nothing else. Mixing numbers the rows (mix_position), and the slots of each shard follow these numbers.
Documents that share a line are linked, and links draw documents into one shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.llm import decontamination, mixing, parity_join, sharding, store, toxicity

#: Target weights by source; sources that aren't named weigh 1.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0}
SHARDS = 24


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled documents; those that score 0.5 or more go."""
    store.importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 4/5 hold together, the smallest doc_id stays."""
    store.importable(spark)
    return parity_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, edited or not, go."""
    store.importable(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources' blocks run, with their number in it as the last column: mix_position, or
    the next free name."""
    mixed = mixing.mix_sources(docs, SOURCE_WEIGHTS)
    position = F.col(f"`{mixed.columns[-1]}`.position").alias(mixing.free_name(docs.columns, "mix_position"))
    return mixing.in_mixed_order(mixed, [*(f"`{c}`" for c in docs.columns), position])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, shared lines kept together, and their slot in it, in the order of the mixture."""
    return sharding.shard_documents(docs, SHARDS, sharding.shared_lines(docs), order=docs.columns[-1])


STAGES = [
    ("toxicity", remove_toxic),
    ("jaccard_join", remove_repeats),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: Stages 1 to 3 can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's rows written as Parquet and read by the next, after which they go."""
    store.importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = store.materialize(made, f"pipeline-{name}")
            store.drop(docs)
        docs = made
    return docs
