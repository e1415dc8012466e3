import random

import numpy as np
from pyspark.sql import functions as F

from cohortmill.llm import decontamination


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 4, int(rng.integers(1, 9))).astype(np.uint64) for _ in range(80)]
    b = [rng.integers(0, 4, int(rng.integers(1, 14))).astype(np.uint64) for _ in range(80)]
    best, end = decontamination.align(a, b)
    for x, y, s, e in zip(a, b, best, end):
        assert s == smith_waterman(x.tolist(), y.tolist()) == smith_waterman(x.tolist(), y[:e].tolist())


def corpus(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    items = [fresh(rng.randint(12, 40)) for _ in range(12)] + [["short", "item"], []]
    docs, leaks = [], {}
    for i in range(160):
        text = fresh(rng.randint(5, 200))
        if i % 4 == 0:
            k = rng.randrange(12)
            copy = list(items[k])
            if i % 8 == 0:  # edited: a fifth of the words changed, one left out, one put in
                for _ in range(len(copy) // 6):
                    copy[rng.randrange(len(copy))] = "changed"
                del copy[rng.randrange(len(copy))]
                copy.insert(rng.randrange(len(copy)), "more")
            at = rng.randrange(len(text))
            text[at:at] = copy
            leaks[i] = k
        docs.append((i, " ".join(text)))
    docs += [(900, None), (901, ""), (902, "a Short ITEM here"), (902, "a Short ITEM here"), (903, " ".join(fresh(20_000)))]
    leaks[902] = 12
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1)), spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(items)), (50, None)], "item_id int, text string"), leaks


def test_copies_and_edited_copies_are_found_and_nothing_else(spark):
    docs, items, leaks = corpus(spark)
    for part_bytes in (16 << 20, 600):  # one part, and several
        got = decontamination.contamination(docs, items, part_bytes=part_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in got} == set(leaks.items())
    assert sum(r.doc_id == 902 for r in got) == 2 and all(r.score == 1.0 for r in got if r.doc_id % 8 == 4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = next(r for r in got if r.doc_id == 902)
    assert texts[902][short.begin : short.end] == "Short ITEM"
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - set(leaks)


def test_empty_tables(spark):
    docs, items, _ = corpus(spark)
    assert decontamination.contamination(docs, items.limit(0)).count() == 0
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


def plain_seeds(items, docs, n, share, always, spread):
    """(item, words) of the seeds, by plain counting."""
    grams = [{tuple(t[i : i + min(n, len(t))]) for i in range(len(t) - min(n, len(t)) + 1)} if t else set() for t in items]
    held = {g: sum(any(tuple(d[i : i + len(g)]) == g for i in range(len(d))) for d in docs) for gs in grams for g in gs}
    often = {g: held[g] + sum(g in gs for gs in grams) for g in held}
    out = set()
    for k, t in enumerate(items):
        m = min(n, len(t))
        own = [tuple(t[i : i + m]) for i in range(len(t) - m + 1)] if t else []
        own = [g for g in own if held[g]]
        if own:
            most = sorted(often[g] for g in own)[max(0, int(np.ceil(share * len(own))) - 1)]
            out |= {(k, g) for g in own if often[g] <= max(always, spread * most)}
    return out


def test_seeds_equal_plain_counting(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randint(0, 12)}" for _ in range(n)]
    opening = fresh(5)
    items = [opening + fresh(rng.randint(0, 9)) for _ in range(9)] + [["w1", "w2"], []]
    docs = [fresh(rng.randint(0, 40)) for _ in range(25)] + [opening + items[0][5:] for _ in range(4)]
    part = decontamination.Part.of(list(range(len(items))), [" ".join(t) for t in items], 3)
    df = spark.createDataFrame([(" ".join(t),) for t in docs], "text string").repartition(3)
    sizes = []
    for always, spread in ((0, 1), (4, 1), (0, 2)):
        got = decontamination.seeds(part, decontamination.gram_counts(df, part), 0.6, always, spread)
        seen = set()
        for size, (_, first, item, word) in got.grams.items():
            assert first[-1] == len(item)
            seen |= {(int(i), tuple(items[i][w : w + size])) for i, w in zip(item, word)}
        assert seen == plain_seeds(items, docs, 3, 0.6, always, spread)
        sizes.append(len(seen))
    assert sizes[0] <= sizes[1] and sizes[0] < sizes[2]


def test_an_opening_that_all_items_share_is_no_seed(spark):
    rng = random.Random(9)
    opening = "answer the following question in one word please :".split()
    items = [(i, " ".join(opening + [f"q{i}x{k}" for k in range(14)])) for i in range(300)]
    docs = spark.createDataFrame([(0, " ".join(opening * 60 + [f"z{rng.random()}" for _ in range(300)])), (1, items[7][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    part = decontamination.Part.of([i for i, _ in items], [t for _, t in items], 3)
    part = decontamination.seeds(part, decontamination.gram_counts(docs, part), 0.6)
    assert sum(len(i) for _, _, i, _ in part.grams.values() if len(i)) >= 1
    assert [(r.doc_id, r.item_id, r.score) for r in decontamination.contamination(docs, benchmark).collect()] == [(1, 7, 1.0)]


def test_ids_of_any_kind_and_a_long_repeated_text(spark):
    item = [f"w{k}" for k in range(20)]
    rows = [("d1", " ".join(item)), (None, " ".join(["lead", *item] * 400)), ("d3", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    benchmark = spark.createDataFrame([("x", " ".join(item)), ("x", " ".join(item)), (None, " ".join(item[:18])), ("y", None)], "item_id string, text string")
    got = [(r.doc_id, r.item_id, r.score, r.begin) for r in decontamination.contamination(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted([("d1", "x", 1.0, 0)] * 2 + [("d1", None, 1.0, 0)] + [(None, "x", 1.0, 5)] * 2 + [(None, None, 1.0, 5)], key=str)
    assert [r.doc_id for r in decontamination.decontaminate(docs, benchmark).collect()] == ["d3"]


def test_parts_follow_sizes_whatever_the_ids(spark):
    texts = [f"item {i} " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(50)]
    items = spark.createDataFrame([(None if i % 2 else "same", t) for i, t in enumerate(texts)] + [("none", None), ("long", "long " * 3000)], "item_id string, text string")
    parts = list(decontamination._parts(items, 3, 4000))
    assert sum(len(p.ids) for p in parts) == 51 and len(parts) >= 6
    assert sum(len(p.ids) > 12 for p in parts) == 0
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in enumerate(texts)], "doc_id long, text string")
    got = decontamination.contamination(docs, items, part_bytes=4000).collect()
    assert sorted(r.doc_id for r in got if r.score == 1.0) == list(range(50))
    assert list(decontamination._parts(items.where("false"), 3, 4000)) == []
