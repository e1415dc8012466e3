import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.llm import parity_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, n=5):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute(rows):
    """component of each id by comparing all sets."""
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [w if rng.random() > share else rng.choice("xyzuvw") + str(rng.randint(0, 99)) for w in words]


def corpus(seed, n):
    """Groups of near copies with few and with many edits, a shared passage, short texts, equal texts."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randint(0, 400)}" for _ in range(k)]
    passage, out = fresh(60), []
    while len(out) < n:
        base = fresh(rng.choice([1, 3, 5, 6, 9, 14, 30, 80, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            out.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))))
        if rng.random() < 0.3:
            out.append(" ".join(fresh(rng.choice([2, 20, 60])) + passage + fresh(rng.choice([0, 10, 40]))))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = [*corpus(seed, 300), (900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_components(df).collect()}
    assert got == brute(rows)


def test_a_large_group_of_near_copies_that_are_far_from_each_other(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(140)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(160)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute(rows)
    assert got == expected and len({c for _, c in expected.values()}) > 1


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        d = int(rng.integers(0, len(a) // 4 + 2))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: max(1, len(a) - d)]], rng.integers(0, 2**63, int(rng.integers(0, d + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both):
            (x, slack), (y, other) = parity_join.set_keys(a), parity_join.set_keys(b)
            shared = np.isin(x, y).sum()
            assert shared > max(slack, other)


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for d in (0, 3, 40, 200):
        b = np.concatenate([a[d:], rng.integers(0, 2**63, d, dtype=np.uint64)])
        s = parity_join.bit_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= 2 * d


def test_wide_sketches_bound_the_difference_and_tell_large_sets_apart():
    rng = np.random.default_rng(11)
    for n, more, d in ((3000, 0, 500), (2100, 200, 300), (4096, 1, 0), (3000, 0, 1500)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[d:], rng.integers(0, 2**63, d + more, dtype=np.uint64)])
        far = parity_join.wide_distance(parity_join.wide_sketch(a), parity_join.wide_sketch(b))
        assert far <= 2 * d + more
        assert d < 1500 or far * 9 > len(a) + len(b)
    assert parity_join.wide_sketch(a[:512]) is None


def test_large_texts_that_share_passages_equal_brute_force(spark):
    rng = random.Random(8)
    fresh = lambda k: [f"w{rng.randint(0, 9000)}" for _ in range(k)]
    passage, rows = fresh(1200), []
    for i in range(6):
        text = passage + fresh(rng.choice([250, 700, 1500]))
        rows += [(10 * i + k, " ".join(edited(rng, text, share))) for k, share in enumerate((0, 0.005, 0.018, 0.03))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    expected = brute(rows)
    assert got == expected and 6 <= len({c for _, c in expected.values()}) < len(rows)


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.vertex: r.root for r in parity_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "a b c d e f")], "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.component_id) for r in parity_join.similar_components(df).collect()) == {(1, 0): 2, (0, 0): 1}
    assert parity_join.similar_components(df.limit(0)).count() == 0
    assert [r.doc_id for r in parity_join.keep_one(df).collect()] == [0]


def test_null_and_repeated_ids(spark):
    a, b, c = "a b c d e f", "p q r s t u", "k l m n o p"
    rows = [(None, a, 1), (3, a, 2), (5, b, 3), (5, c, 4), (5, c, 5), (7, c, 6), (None, "x y", 7), (None, "x  y", 8), (None, None, 9), (1, "", 10), (1, " ", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _vertex_id long")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.similar_components(df).collect())
    assert got == {(None, 2, 3): 1, (3, 2, 3): 1, (5, 2, 5): 3, (7, 2, 5): 1, (None, 1, None): 2, (None, 0, None): 1, (1, 0, 1): 2}
    kept = parity_join.keep_one(df)
    assert kept.columns == df.columns
    seen = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    single = seen.pop((None, "x y"), 0) + seen.pop((None, "x  y"), 0)
    assert single == 1 and seen == {(3, a): 1, (5, b): 1, (5, c): 1, (None, None): 1, (1, ""): 1, (1, " "): 1}
    assert parity_join.keep_one(df.limit(0)).count() == 0


def test_many_texts_around_one_passage_and_small_blocks(spark, monkeypatch):
    """Keys of a passage that dissimilar texts share, with near copies among them; blocks smaller than the group."""
    monkeypatch.setattr(parity_join, "BLOCK", 40)
    monkeypatch.setattr(parity_join, "BUSY", 3)
    rng = random.Random(21)
    fresh = lambda k: [f"w{rng.randint(0, 4000)}" for _ in range(k)]
    passage, rows = fresh(60), []
    for i in range(100):
        text = fresh(rng.choice([10, 30, 50, 90])) + passage
        rows += [(10 * i + k, " ".join(edited(rng, text, share))) for k, share in enumerate((0, 0.01, 0.03)[: rng.choice([1, 2, 3])])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_blocks_hold_every_similar_pair_of_sizes(spark):
    rng = random.Random(2)
    rows = [(g, v, rng.randint(1, 300)) for v in range(600) for g in (1, 2)]
    got = parity_join._blocked(spark.createDataFrame(rows, "group long, vertex long, n_shingles long"), 50).collect()
    cells = collections.defaultdict(list)
    for r in got:
        cells[r.group, r.low, r.high].append(r)
    met = {(g, *sorted((x.vertex, y.vertex))) for (g, low, high), rs in cells.items() for x in rs if x.own == low for y in rs if y.own == high}
    size = {(g, v): n for g, v, n in rows}
    need = {(g, a, b) for g in (1, 2) for a in range(600) for b in range(a + 1, 600) if 5 * min(size[g, a], size[g, b]) >= 4 * max(size[g, a], size[g, b])}
    assert need <= met and max(map(len, cells.values())) < 300
