import math
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortmill.llm import toxicity
from cohortmill.llm.text import text_bytes


def distance(a, b):
    """Edits with swaps of neighbours, no letter edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[-1] = min(new[-1], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", max_size=7), st.text(alphabet="abé", max_size=7), st.integers(0, 2))
def test_automaton_accepts_what_is_near(word, other, k):
    a = toxicity.LevenshteinAutomaton(word, k)
    state = a.start()
    for c in other:
        state = a.step(state, c)
    d = distance(word, other)
    assert a.distance(state) == (d if d <= k else None)


def test_every_word_near_a_term_is_found():
    terms = ["idiot", "worthless", "réêou", "scum", "bomente", "abcde", "abcdefgh", "éàüçñéàüç"]
    loose = frozenset({"worthless", "éàüçñéàüç"})
    lexicon = toxicity.Lexicon(terms, [1.0] * len(terms), loose=loose)
    rng, words = random.Random(1), []
    for _ in range(6000):
        w = list(rng.choice(terms))
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            i = rng.randrange(len(w) + 1)
            how = rng.choice("sidt")
            if how == "t":
                w[i : i + 2] = reversed(w[i : i + 2])
            elif how == "i":
                w.insert(i, rng.choice("aé中z"))
            elif i < len(w):
                w[i : i + 1] = [] if how == "d" and len(w) > 1 else [rng.choice("oéêz")]
        words.append("".join(w))
    _, spans = toxicity.features(pa.array(words), lexicon)
    for w, found in zip(words, spans):
        near = [t for t in terms if distance(w, t) <= (2 if t in loose else toxicity.reach(t))]
        assert bool(found) == bool(near) and (not found or terms[found[0][1]] in near)


def test_swaps_second_slips_and_words_of_their_own():
    terms = ["idiot", "worthless", "degenerate"]
    words = ["idoit", "iditos", "wortlhess", "worthlss", "wrthlss", "generate", "degnerat"]
    for spared in (frozenset(), frozenset({"generate"})):
        lexicon = toxicity.Lexicon(terms, [1.0] * 3, spared, frozenset(terms[1:]))
        _, spans = toxicity.features(pa.array(words), lexicon)
        assert [len(s) for s in spans] == [1, 0, 1, 1, 1, int(not spared), 1]
        # Words that a task has turned down stay so, those found are found again.
        assert toxicity.features(pa.array(words[::-1]), lexicon)[1] == spans[::-1]
        assert lexicon.matches([*words, "", "idiot"]) == [bool(s) for s in spans] + [False, True]


def test_spared_words_are_learned(spark):
    rows = [(i, "you degenerate fool" if i % 4 == 0 else f"they generate power {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    lexicon = toxicity.train(docs, labels).lexicon
    assert "generate" in lexicon.spared and lexicon.match("generate") is None and lexicon.match("degnerat") is not None


def test_look_alikes_and_quotation():
    lexicon = toxicity.Lexicon(["idiot"], [3.0])
    texts = ["you 1D10T", 'he wrote "idiot" there', "an id$ot x", "idiot$$$ now", None, "", "the word idiot is old"]
    x, spans = toxicity.features(pa.array(texts), lexicon)
    assert [len(s) for s in spans] == [1, 1, 1, 1, 0, 0, 1]
    assert spans[0][0][4] and not spans[0][0][3] and spans[1][0][3] and spans[6][0][3]
    assert x[1, 0] == 0 < x[1, 2]


def corpus(spark, n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"w{rng.randint(0, 80)}" for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["gronk", "blarfed", "gronk"])
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy_and_filter(spark):
    df = corpus(spark)
    docs, labels = df.drop("toxic"), df.select("doc_id", "toxic")
    model = toxicity.train(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    got = toxicity.score(docs, model, spans=True).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) == len(got)
    assert all(bool(r.matches) == bool(r.toxic) for r in got)
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and 170 <= kept.count() <= 185


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "you idiot " * 20_000)], "doc_id long, text string").withColumn("score", F.lit(None).cast("int"))
    none = docs.limit(0).select("doc_id", F.lit(1).alias("toxic"))
    model = toxicity.train(docs, none)
    assert [round(r.score, 2) for r in toxicity.score(docs, model).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (2, None), (9, 0)], "doc_id long, toxic int")
    assert all(np.isfinite(r.score) for r in toxicity.score(docs, toxicity.train(docs, one)).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_quoted(line, p):
    """The same by plain strings: p counts code points."""
    left, right = line[:p], line[p:]
    return (left.count('"') % 2 == 1 and '"' in right) or any(left.rfind(x) > left.rfind(y) and y in right for x, y in ("“”", "„“", "«»", "‹›"))


def test_quotation_equals_plain_strings():
    rng = random.Random(12)
    texts = ["".join(rng.choice(['"', "“", "”", "„", "«", "»", "‹", "›", "w", "ü", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    data, off = text_bytes(pa.array(texts))
    at, doc, expected = [], [], []
    for d, t in enumerate(texts):
        begin = 0
        for line in t.split("\n"):
            for p, c in enumerate(line):
                if c in "wü":
                    at.append(off[d] + len(t[: begin + p].encode()))
                    doc.append(d)
                    expected.append(plain_quoted(line, p))
            begin += len(line) + 1
    got = toxicity._quoted(data, off, np.array(at), np.array(doc))
    assert got.tolist() == expected and any(expected) and not all(expected)


def test_words_end_at_punctuation_of_more_bytes():
    lexicon = toxicity.Lexicon(["scum", "worthless"], [3.0, 2.0])
    texts = ["you “scum” …", "«worthless»", "scum—really", "ünscum", "Scum\u00a0x"]
    _, spans = toxicity.features(pa.array(texts), lexicon)
    assert [[lexicon.terms[m[1]] for m in s] for s in spans] == [["scum"], ["worthless"], ["scum"], [], ["scum"]]


def test_score_of_a_small_text_by_hand():
    lexicon = toxicity.Lexicon(["scum", "worthless"], [3.0, 2.0])
    x, _ = toxicity.features(pa.array(['you scum are wortless ok fine ok fine ok fine ok fine "scum" he', None]), lexicon)
    n = 14
    expected = [math.log1p(3), math.log1p(2), math.log1p(3), math.log1p(5), 3.0, 5 / math.sqrt(1 + n), math.log1p(n) / 10]
    assert np.allclose(x[0], expected) and not x[1].any()
    w = np.array([0.5, -1, 0.25, 2, 0.1, 1, -0.3, 0.7])
    model = toxicity.ToxicityModel(lexicon, w)
    assert math.isclose(model.score(x)[0], 1 / (1 + math.exp(-(sum(a * b for a, b in zip(expected, w)) + 0.7))))


def test_without_labels_of_both_classes_nothing_is_dropped(spark):
    docs = spark.createDataFrame([(i, f"text {i} idiot scum" if i % 2 else f"text {i}") for i in range(9)], "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(0, 1, None)], [(1, 1, 1), (3, 1, 1)], [(0, 1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, schema))
        assert not model.both and toxicity.without_toxic(docs, model).count() == 9
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(8)], schema))
    assert model.both and toxicity.without_toxic(docs, model).count() < 9
