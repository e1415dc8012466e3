import collections

from pyspark.sql import functions as F

import corpus_pipeline
from cohortmill.llm import decontamination, parity_join


def test_stages_over_the_smallest_tables(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    out = corpus_pipeline.run(spark, smallest)
    rows = {r.doc_id: r for r in out.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "sharding"]
    assert len(rows) == out.count() and set(docs.columns) <= set(out.columns)
    kept = docs.join(out.select("doc_id"), "doc_id", "left_semi")
    assert parity_join.similar_components(kept).where("doc_id <> component_id").count() == 0
    assert decontamination.contamination(kept, spark.read.parquet(f"{smallest}/benchmark.parquet")).count() == 0
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    toxic = labels.where("toxic = 1").count()
    assert labels.where("toxic = 1").join(out.select("doc_id"), "doc_id", "left_semi").count() <= 0.2 * toxic
    assert len(rows) > 0.6 * docs.count()
    sizes = out.groupBy("shard").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1


def test_mixture_and_links_reach_the_shards(spark):
    rows = [(i, f"own {i}\nline of group {i // 5}" if i < 300 else f"own {i}", "en", f"src{i % 4}") for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = corpus_pipeline.mix(spark, docs, "")
    out = corpus_pipeline.shard(spark, mixed, "").collect()
    assert sorted(r.mix_position for r in out) == list(range(720))
    shards = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r.slot):
        shards[r.shard].append(r.mix_position)
    assert len(shards) == corpus_pipeline.SHARDS and all(x == sorted(x) and len(x) == 30 for x in shards.values())
    where = collections.defaultdict(set)
    for r in out:
        if r.doc_id < 300:
            where[r.doc_id // 5].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 6


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, at, docs, labels=(), items=()):
    """A folder with the three tables that the pipeline reads."""
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_rows_without_labels_and_benchmark(spark, tmp_path):
    own = [f"document {i} speaks of " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(own)]
    rows += [(None, "no id " + own[0][::-1], "en", None, 3), (7, None, None, None, None), (7, None, "de", "src1", 0), (8, "", "en", "src0", 0), (9, " \n\t", "en", "src0", 3), (10, "long " + " ".join(f"q{j}" for j in range(20_000)), "en", "src9", 1)]
    rows += [(0, own[0], "en", "src0", len(own[0])), (11, own[1], "fr", "src2", len(own[1]))]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("mix", "mix_position", "shard", "slot", "size", "y", "term", "score", "component_id", "row", "hub"):
        docs = docs.withColumn(name, F.lit("own"))
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "a", docs)).collect()
    # Texts that repeat leave one row; everything else stays.
    texts = sorted(str(r.text) for r in got if (r.text or "").strip())
    assert texts == sorted(set(str(t) for _, t, *_ in rows if (t or "").strip()))
    assert {r.mix for r in got} == {r.mix_position for r in got} == {r.term for r in got} == {"own"}
    assert sum(r.text is None for r in got) == 2 and sum(r.text is not None and not r.text.strip() for r in got) == 2
    assert len({(r.shard, r.slot) for r in got}) == len(got)


def test_empty_documents(spark, tmp_path):
    labels, items = [(1, 1, 1), (2, 1, 0)], [("i", "some words of an item that nobody has")]
    docs = spark.createDataFrame([], DOCS)
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", docs, labels, items)).count() == 0
