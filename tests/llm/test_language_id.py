import collections
import math
import random

from pyspark.sql import functions as F

from cohortmill.llm import language_id

WORDS = {"en": ["the", "thing", "hand", "over", "with", "rather"], "de": ["der", "schön", "über", "nicht", "heit", "ung"]}


def corpus(n=120):
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang) for i in range(n) for lang in [rng.choice(["en", "de"])]]


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id % 3 <> 0"))
    got = language_id.predict(df, model).join(df, "doc_id").where("doc_id % 3 = 0")
    assert model.languages == ["de", "en"]
    assert got.where("lang_pred = lang AND score BETWEEN 0.5 AND 1").count() == got.count() > 30


def test_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the hand", "en"), (4, "the hand", "en"), (5, "der " * 50_000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = language_id.predict(df, language_id.train(df)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and [by[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"] and by[1].score == 0.0
    nothing = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), nothing).count() == 0


def plain_posteriors(rows, texts, buckets=1 << 15, smoothing=0.5):
    """Naive Bayes by dictionaries over the same hashed n-grams of single texts."""
    grams = lambda t: collections.Counter(int(b) for h, own in language_id.gram_buckets(*language_id.code_points([t]), buckets) for b in h[own[0] : own[-1]])
    counts, seen = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts[lang] += grams(text)
            seen[lang] += 1
    out = []
    for t in texts:
        g = grams(t)
        share = min(sum(g.values()), language_id.EFFECTIVE_LENGTH) / sum(g.values())
        logs = {x: math.log(seen[x] / sum(seen.values())) + share * sum(n * math.log((counts[x][b] + smoothing) / (sum(counts[x].values()) + smoothing * buckets)) for b, n in g.items()) for x in counts}
        top = max(logs.values())
        best = min(x for x in logs if logs[x] == top)
        out.append((best, 1 / sum(math.exp(v - top) for v in logs.values())))
    return out


def test_equals_plain_naive_bayes(spark):
    rows = [*corpus(80), (900, "Ünïcode ½ 東京 thing", "en"), (901, None, "de"), (902, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language_id.predict(df, language_id.train(df)).collect()}
    for (i, t, _), (lang, p) in zip([r for r in rows if r[1]], plain_posteriors(rows, [r[1] for r in rows if r[1]])):
        assert got[i].lang_pred == lang and math.isclose(got[i].score, p, rel_tol=1e-4)


def test_letters_and_ties(spark):
    df = spark.createDataFrame([(1, "½ ² Ⅷ _ 7"), (2, "東"), (3, "ª")], "doc_id long, text string")
    same = spark.createDataFrame([("shared words", "fr"), ("shared words", "es")], "text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.train(same)).collect()}
    assert got == {1: "und", 2: "es", 3: "es"}


def test_very_long_text_null_id_and_split_input(spark):
    rows = [(None, "the cat and the dog " * 20_000, "en"), (1, "der hund und die katze", "de"), (2, "the dog", "en"), (3, "die katze", "de"), (4, None, "fr"), (5, "chat", None)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.train(one.repartition(k)) for k in (1, 5)]
    assert models[0].languages == models[1].languages == ["de", "en"]
    assert (models[0].log_prob == models[1].log_prob).all() and (models[0].prior == models[1].prior).all()
    got = {r.doc_id: r.lang_pred for r in language_id.predict(one, models[0]).collect()}
    assert got[None] == "en" and got[1] == "de" and got[4] == "und"
