import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortmill.llm import lattice_lm

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def small_vocabulary():
    mark = lattice_lm.MARK
    pieces = sorted([mark, mark + b"a", mark + b"ab", b"a", b"b", b"ab", b"ba", "é".encode(), *(bytes([x]) for x in "é".encode())])
    first = np.array([p.startswith(mark) for p in pieces])
    rng = np.random.default_rng(1)
    p = rng.random(len(pieces))
    p[first] /= p[first].sum()
    p[~first] *= 0.7 / p[~first].sum()
    return lattice_lm.Vocabulary(pieces, np.append(p, 0.3), np.append(first, False))


def all_paths(v, word):
    """Sum over every segmentation, by trying them all; and the expected uses of each piece."""
    text = lattice_lm.MARK + word.encode()
    total, uses = 0.0, collections.Counter()

    def walk(at, p, path):
        nonlocal total
        if at == len(text):
            total += p * v.prior[-1]
            for k in path:
                uses[k] += p * v.prior[-1]
            return
        for k, piece in enumerate(v.pieces):
            if text.startswith(piece, at) and v.first[k] == (at == 0):
                walk(at + len(piece), p * v.prior[k], [*path, k])

    walk(0, 1.0, [])
    return total, {k: n / total for k, n in uses.items()}


def test_marginals_and_expectations_sum_over_all_paths():
    v = small_vocabulary()
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abé", repeat=n)]
    got = lattice_lm.marginals(v, np.log(v.prior), pa.array(words))
    for w, g in zip(words, got):
        assert math.isclose(math.exp(g), all_paths(v, w)[0], rel_tol=1e-9)
    for own, lattice in lattice_lm.lattices(v, np.log(v.prior), pa.array(["abab", "baéa"])):
        uses = lattice.expected(np.ones(len(own)))
        expected = collections.Counter()
        for i in own:
            expected.update(all_paths(v, ["abab", "baéa"][i])[1])
        assert np.allclose(uses[:-1], [expected[k] for k in range(len(v.pieces))])


def test_base_score_and_the_lattice_alone(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["The", "house", "of", "cards", "fell", "quietly", "ÉTÉ"]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", " \n", "x" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(3)).repartition(3)
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = {r.doc_id: r for r in lattice_lm.score(df, out, PATH, chunk_bytes=300).collect()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, held[i])
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    # The score is the sum of the words' marginals: equal words cost the same in every text, and word order has no part.
    v = lattice_lm.read_vocabulary(PATH)
    rows = [(w, c) for w, c in counts.items() if w]
    log_prob = lattice_lm.fit(spark.createDataFrame(rows, "word string, count long"), v)
    ends = counts[None]
    own = sorted({w for ws in tokens.values() for w in ws if w})
    marginal = dict(zip(own, lattice_lm.marginals(v, log_prob, pa.array(own))))
    for i, ws in tokens.items():
        expected = sum(marginal[w] + math.log((n - ends + 0.5) / (n + 1)) for w in ws if w) / math.log(10) + math.log10((ends + 0.5) / (n + 1))
        assert math.isclose(got[i].score, expected, rel_tol=1e-6)


def test_long_words_have_all_their_paths(monkeypatch):
    """Rolling windows give what the whole lattice gives, at any length, and a longer word costs about as much a letter."""
    v = small_vocabulary()
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 2, 7, 30, 31, 200)]
    whole = lattice_lm.marginals(v, np.log(v.prior), pa.array(words))
    assert np.allclose([lattice_lm.rolling(v, np.log(v.prior), w.encode()) for w in words], whole)
    monkeypatch.setattr(lattice_lm, "WINDOW", 16)
    assert np.allclose(lattice_lm.marginals(v, np.log(v.prior), pa.array(words)), whole)
    cut, times = lattice_lm.parts(pa.array(words), np.arange(6.0) + 1)
    assert "".join(sorted("".join(cut.to_pylist()))) == "".join(sorted("".join(words))) and max(len(w.encode()) for w in cut.to_pylist()) <= 16
    assert sum(t * len(w) for t, w in zip(times, cut.to_pylist())) == sum((i + 1) * len(w) for i, w in enumerate(words))
    monkeypatch.undo()
    big = lattice_lm.read_vocabulary(PATH)
    a, b = lattice_lm.marginals(big, np.log(big.prior), pa.array([("the" * 200)[:512], ("the" * 200)[:513]]))
    assert abs(a - b) < 20


def test_expectations_count_words_as_often_as_they_occur(spark):
    v = small_vocabulary()
    rows = [("abab", 3), ("baéa", 1), ("é", 2)]
    got = lattice_lm.fit(spark.createDataFrame(rows, "word string, count long"), v, rounds=1, prior_words=0.5)
    uses = np.zeros(len(v.prior))
    for w, n in rows:
        for k, x in all_paths(v, w)[1].items():
            uses[k] += n * x
        uses[-1] += n
    expected = np.empty_like(uses)
    for part in (v.first, ~v.first):
        expected[part] = uses[part] + 0.5 * v.prior[part]
        expected[part] /= expected[part].sum()
    assert np.allclose(np.exp(got), expected)


def test_ids_of_any_kind(spark):
    rows = [("a", "one two"), (None, "one two"), ("a", "one"), ("z", None)]
    out = [(r.doc_id, r.n_tokens, r.held_out) for r in lattice_lm.score(spark.createDataFrame(rows, "doc_id string, text string"), F.crc32("doc_id") % 5 == 9, PATH).collect()]
    assert collections.Counter(out) == {("a", 3, False): 1, (None, 3, False): 1, ("a", 2, False): 1, ("z", 1, False): 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lattice_lm.score(df, F.lit(False), PATH).count() == 0


def test_packed_numbers_come_back():
    for numbers in ([], [0], [5, 0, 255, 256, 65536, 2**31 - 1], list(range(3000))):
        data = lattice_lm.packed(np.array(numbers, np.int64))
        assert lattice_lm.unpacked(data, len(numbers)).tolist() == numbers
