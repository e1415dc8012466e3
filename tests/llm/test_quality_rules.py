import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortmill.llm import quality_rules as qr
from cohortmill.llm.text import text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def plain_classes(text):
    def kind(c):
        o = ord(c)
        return 7 if o <= 32 else 3 if o >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in ".,;:'\"-?()" else 5 if c in "#*$%&|<>" else 6

    n = Counter(map(kind, text or ""))
    return [n[k] for k in range(7)]


def plain_js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def strip(word):
    letters = [i for i, c in enumerate(word) if ord(c) >= 128 or (c.isalnum() and ord(c) < 128)]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word[letters[0] : letters[-1] + 1]) if letters else None


TEXTS = [
    None, "", "  \n\t ", "one", "a b c a b c", "a b c\na b c\n\na b c\r\nA b c\n", "x\n\nx\nx ", "#*$%&|<> #", "ünï ñ é 日本語 \U0001f600 x", "\n\n", "a\x0bb\x0cc\x1cd", "a a a a a", "a b c d a b c",
    "same\nsame", "end\n", "\nend", "Word " * 3000 + "\n" + "x" * 100_000, "don't, \"stop\" (now)!! -- ...", "one two three four five one two three",
]


def test_counts_equal_plain_python_across_texts_of_one_slice():
    data, off = text_bytes(pa.array(TEXTS, pa.string()))
    got = qr.rule_counts(data, off)
    assert list(zip(*(x.tolist() for x in got.values()))) == [plain_counts(t) for t in TEXTS]
    assert qr.class_counts(data, off).tolist() == [plain_classes(t) for t in TEXTS]
    h, doc = qr.plain_words(data, off)
    want = [[w for w in map(strip, WORD.findall(t or "")) if w] for t in TEXTS]
    assert [int((doc == i).sum()) for i in range(len(TEXTS))] == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat)))


def test_random_texts():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab \n#é"), 60)) for _ in range(400)]
    data, off = text_bytes(pa.array(texts))
    got = qr.rule_counts(data, off)
    assert list(zip(*(x.tolist() for x in got.values()))) == [plain_counts(t) for t in texts]


def test_js_distance():
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0], [0.2, 0.3, 0.5]])
    for q in ([0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.1, 0.2, 0.7]):
        assert np.allclose(qr.js_distance(p, np.array(q)), [plain_js(a, q) for a in p.tolist()])
    assert qr.js_distance(p[1:2], np.array([0.0, 1.0, 0.0])) == 1.0


def corpus():
    rng = np.random.default_rng(7)
    own = {"en": ["the", "of", "and", "to"], "de": ["der", "die", "und", "für"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        words = [own[lang][int(rng.integers(4))] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(90)]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_references_and_verdicts_equal_plain_python(spark, parts):
    rows = corpus() + [(100, None, "en"), (101, "", "en"), (102, "no language here", None), (103, "THE OF!! AND!! " * 40, None)]
    rows += [(104, " ".join(f"{a}{b}***" for a in "abcdefgh" for b in "klmnopqrst"), "en"), (105, "kurz", "de"), (None, "x " * 60, "de"), (5, rows[5][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts).withColumn("kept", F.lit("clash")).withColumn("word", F.lit(1)).withColumn("n", F.lit(1))
    ref = qr.learn_references(df, common=6)
    assert ref.languages == ["de", "en"]
    share, common = {}, {}
    for lang in ref.languages:
        texts = [t for _, t, x in rows if x == lang and t]
        per = [[c / sum(plain_classes(t)) for c in plain_classes(t)] for t in texts]
        middle = [sorted(int(4096 * x + 0.5) for x in c)[(len(per) - 1) // 2] for c in zip(*per)]
        share[lang] = [x / sum(middle) for x in middle]
        n = Counter(w for t in texts for w in map(strip, WORD.findall(t)) if w)
        common[lang] = (n.most_common(4), sum(n.values()))
    assert np.allclose(ref.classes, [share[x] for x in ref.languages])
    for lang, s in zip(ref.languages, ref.shares):
        top, total = common[lang]
        assert sorted(s[:-1].tolist())[-4:] == pytest.approx(sorted(k / total for _, k in top)) and s.sum() == pytest.approx(1)
    out = qr.judge(df, ref).collect()
    assert len(out) == len(rows)
    for r in out:
        text = [t for i, t, _ in rows if i == r.doc_id][0]
        c = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        if r.class_distance is not None:
            p = plain_classes(text)
            assert r.class_distance == pytest.approx(plain_js([x / sum(p) for x in p], share[r.nearest]))
    of = {r.doc_id: r for r in out}
    assert all(of[i].kept and of[i].nearest == lang for i, _, lang in corpus())
    assert not of[104].base_failed and not of[104].kept and of[104].word_distance is not None
    assert not any(of[i].kept for i in (100, 101, 102, 103, 105)) and of[105].class_distance is None and of[105].word_distance is None


def test_without_references_and_empty(spark):
    df = spark.createDataFrame([(1, "word " + " ".join(f"w{i}" for i in range(60)), None)], "doc_id long, text string, lang string")
    ref = qr.learn_references(df)
    r = qr.judge(df, ref).first()
    assert ref.languages == [] and r.kept and r.class_distance is None and r.nearest is None
    assert qr.judge(df.where("false"), ref).count() == 0
    with pytest.raises(ValueError):
        qr.learn_references(spark.createDataFrame([(i, "a b", f"l{i}") for i in range(5)], "doc_id long, text string, lang string"), max_languages=3)


def test_labelled_rows(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    got = qr.judge(docs, qr.learn_references(docs)).where("NOT base_failed").join(spark.read.parquet(f"{smallest}/labels.parquet"), "doc_id")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] >= 0.97 and share.get(0, 0) <= 0.4
