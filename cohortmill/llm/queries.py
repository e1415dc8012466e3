"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.llm import decontamination, hard_negatives, language_id, lattice_lm, merkle, mixing, parity_join, quality_mil, quality_rules, secret_scan, sharding, store, topk, toxicity

#: Target weights of the sources in op7; sources that aren't named weigh 1.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0}

#: Vocabulary whose pieces op5 weighs.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """Fold of a document: the crc32 of its id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold(4) != 2))
    return language_id.predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.learn_identifiers(docs)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_read(spark, sf_dir, "documents"), fold(5) == 1, VOCABULARY)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_components(_read(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, SOURCE_WEIGHTS).select("doc_id", "source", "mix.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(fold(5) != 0), labels.where(fold(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality_mil.train(docs.where(fold(3) != 1), labels.where(fold(3) != 1))
    return quality_mil.score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), merkle.lower_ascii(F.col("text")))
    carried = {"doc_id": F.col("doc_id"), "tampered": F.when(fold(3) == 0, tampered)}
    leaf = merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    out = merkle.manifest(docs, leaf, F.col("lang"), F.col("doc_id"), carried)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn_references(docs))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", turned), F.col("vec_id") % 50 == 0)


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_secret_scan": op3_secret_scan,
        "op4_sharding": op4_sharding,
        "op5_lattice_lm": op5_lattice_lm,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_source_mixing": op7_source_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_topk": op10_topk,
        "op11_merkle": op11_merkle,
        "op12_quality_rules": op12_quality_rules,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_topk": """
            WITH v AS (
              SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
            ), s AS (
              SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
            ), r AS (
              SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
            ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op11_merkle": """
            WITH RECURSIVE v AS (
              SELECT doc_id, lang, 3 AS fields, concat(
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
                text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                -- CRC-32 of the decimal id, bit by bit.
                xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
              FROM documents
            ), leaves AS (
              SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM v
            ), up AS (
              SELECT lang, 0 AS level, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
              UNION ALL
              SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, i // 8
            ), sub AS (
              SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM up WHERE n = 1
            ), top AS (
              SELECT 0 AS level, place AS i, subroot AS h, count(*) OVER () AS n FROM sub
              UNION ALL
              SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8
            ), runs AS (
              SELECT lang, false AS above, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY ALL
              UNION ALL SELECT NULL, true, level, i // 8, list(h ORDER BY i) FROM top WHERE n > 1 GROUP BY ALL
            ), paths AS (
              SELECT doc_id, leaf, leaves.lang, false AS above, 0 AS level, row_number() OVER (PARTITION BY leaves.lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS sib, coalesce(tampered, leaf) AS h, place, subroot FROM leaves JOIN sub ON leaves.lang IS NOT DISTINCT FROM sub.lang
              UNION ALL
              SELECT doc_id, leaf, p.lang, CASE WHEN r.hs IS NULL THEN true ELSE p.above END, CASE WHEN r.hs IS NULL THEN 0 ELSE p.level + 1 END, CASE WHEN r.hs IS NULL THEN place ELSE i // 8 END,
                sib || CASE WHEN r.hs IS NULL THEN '' ELSE array_to_string(list_filter(r.hs, lambda x, k: k <> i % 8 + 1), '') END,
                CASE WHEN r.hs IS NULL THEN h ELSE sha256(array_to_string(list_transform(r.hs, lambda x, k: CASE WHEN k = i % 8 + 1 THEN h ELSE x END), '')) END, place, subroot
              FROM paths p LEFT JOIN runs r ON p.above = r.above AND (p.above OR p.lang IS NOT DISTINCT FROM r.lang) AND p.level = r.level AND p.i // 8 = r.run
              WHERE r.hs IS NOT NULL OR NOT p.above
            ), root AS (SELECT h AS root FROM top WHERE n = 1)
            SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified
            FROM paths p, root WHERE above AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.above AND r.level = p.level AND r.run = p.i // 8)""",
        "op13_hard_negatives": """
            WITH v AS (
              SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
            ), s AS (
              SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
            ), p AS (
              SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
            ), n AS (
              SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
            ) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    }
