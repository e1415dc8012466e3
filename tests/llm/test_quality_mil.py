import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortmill.llm import quality_mil


def corpus(spark, n=200):
    """Bad documents have one long shouted stretch among plain words."""
    rng, rows = random.Random(3), []
    for i in range(n):
        words = [rng.choice(["plain", "words", "of", "prose", "stand", "here"]) for _ in range(rng.randint(20, 300))]
        bad = i % 3 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = ["LOUD!!"] * 60
        rows.append((i, " ".join(words), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy_and_attention(spark):
    df = corpus(spark)
    docs, labels = df.drop("quality"), df.select("doc_id", "quality")
    model = quality_mil.train(docs.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 <> 1"))
    got = quality_mil.score(docs, model, attention=True).join(labels, "doc_id").where("doc_id % 4 = 1").collect()
    assert sum((r.score >= 0.5) == bool(r.quality) for r in got) >= 0.95 * len(got)
    assert all(abs(sum(r.attention) - 1) < 1e-6 and 0 <= r.score <= 1 for r in got)


def test_every_word_is_in_a_passage():
    texts = pa.array(["a " * 200, None, "", "b"])
    x, bounds = quality_mil.encode(texts)
    assert np.diff(bounds).tolist() == [4, 1, 1, 1]
    n = np.expm1(x[:, quality_mil.CLASSES + 6] * 5).round()
    assert n.tolist() == [64, 64, 64, 8, 0, 0, 1]


def plain_scores(p, mean, scale, x, bounds):
    """The forward pass by loops over documents, passages and units."""
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        passages = [[min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(row, mean, scale)] for row in x[lo:hi]]
        raw = []
        for row in passages:
            a = 0.0
            for k in range(len(p["w"])):
                t = math.tanh(sum(v * p["V"][j][k] for j, v in enumerate(row)))
                g = 1 / (1 + math.exp(-sum(v * p["U"][j][k] for j, v in enumerate(row))))
                a += p["w"][k] * t * g
            raw.append(math.exp(a))
        total = sum(raw)
        z = [sum(e / total * row[j] for e, row in zip(raw, passages)) for j in range(len(mean))]
        out.append(1 / (1 + math.exp(-(sum(c * v for c, v in zip(p["c"], z)) + p["b"][0]))))
    return out


def test_forward_pass_equals_plain_loops():
    rng = np.random.default_rng(8)
    x, bounds = rng.normal(size=(14, 5)) * 4, np.array([0, 1, 5, 6, 14])
    model = quality_mil.fit(x, bounds, np.array([1.0, 0, 1, 0]), np.ones(4), epochs=7)
    f = model.forward(x, bounds)
    assert np.allclose(f["score"], plain_scores(model.p, model.mean, model.scale, x, bounds), atol=1e-12)
    assert np.allclose(np.add.reduceat(f["e"], bounds[:-1]), 1)


def test_first_step_goes_against_the_gradient_by_differences():
    """Adam's first step moves every parameter by the rate against the sign of its gradient: the differences of the loss tell it."""
    rng = np.random.default_rng(1)
    x, bounds, y, weight, rate, decay = rng.normal(size=(12, 5)), np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0]), 0.02, 0.3
    two = {"epochs": 2, "rate": rate, "decay": decay}
    start = quality_mil.fit(x, bounds, y, weight, **two)  # parameters away from c = 0, where V, U and w have no gradient
    held = {k: v.copy() for k, v in start.p.items()}

    def loss(p):
        s = np.array(plain_scores(p, start.mean, start.scale, x, bounds))
        fit = -(weight * np.where(y == 1, np.log(s), np.log(1 - s))).sum() / weight.sum()
        return fit + decay / 2 * sum((v**2).sum() for k, v in p.items() if k != "b")

    before = quality_mil.fit(x, bounds, y, weight, epochs=0, rate=rate, decay=decay)
    first = quality_mil.fit(x, bounds, y, weight, epochs=1, rate=rate, decay=decay)
    checked = 0
    for k, v in before.p.items():
        for at in np.ndindex(v.shape):
            p = {n: a.copy() for n, a in before.p.items()}
            p[k][at] += 1e-5
            up = loss(p)
            p[k][at] -= 2e-5
            slope = (up - loss(p)) / 2e-5
            if abs(slope) > 1e-4:
                checked += 1
                assert np.isclose(first.p[k][at] - v[at], -rate * np.sign(slope), atol=rate * 1e-3), (k, at)
    assert checked > 100 and {k for k in held} == {"V", "U", "w", "c", "b"}


def test_empty_labels_beside_full_documents_and_empty_documents(spark):
    docs = corpus(spark, 12).drop("quality")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_mil.train(docs, none)
    assert {round(r.score, 6) for r in quality_mil.score(docs, model).collect()} == {0.5}
    again = docs.unionByName(docs.where("doc_id < 3"))
    assert quality_mil.score(again, model).count() == 15


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "x"), (3, "long text " * 30_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = quality_mil.train(docs, docs.limit(0).select("doc_id", F.lit(1).alias("quality")))
    assert [round(r.score, 3) for r in quality_mil.score(docs, model).collect()] == [0.5] * 4
    some = quality_mil.train(docs, spark.createDataFrame([(1, 1), (2, 1), (7, 0)], "doc_id long, quality int"))
    assert all(r.score > 0.9 for r in quality_mil.score(docs, some).collect())
    assert quality_mil.score(docs.limit(0), model).count() == 0
