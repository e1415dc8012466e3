import collections
import random
import zlib

from pyspark.sql import functions as F

from cohortmill.llm import sharding


def check(rows, texts, shards):
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "rows" and r.grown_shard is None


def test_groups_stay_together_and_counts_even(spark):
    texts = {i: (f"group {i % 40}" if i < 160 else f"own {i}") for i in range(480)} | {480: None, 481: None, 482: "", 483: "é" * 40_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.shard_documents(df, 24).collect()
    check(rows, texts, 24)
    where = collections.defaultdict(set)
    for r in rows:
        if r.doc_id < 160:
            where[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 2


def test_a_group_of_a_third_of_the_rows_fills_few_shards(spark):
    texts = {i: "hot" if i % 3 == 0 else f"t{i}" for i in range(720)}
    rows = sharding.shard_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 24).collect()
    check(rows, texts, 24)
    assert len({r.shard for r in rows if texts[r.doc_id] == "hot"}) <= 9


def test_links_draw_documents_together(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(240)], "doc_id long, text string")
    links = spark.createDataFrame([(i, i // 5) for i in range(100)], "doc_id long, hub long")
    rows = sharding.shard_documents(df, 12, links).collect()
    where = collections.defaultdict(set)
    for r in rows:
        if r.doc_id < 100:
            where[r.doc_id // 5].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 2


def test_repeated_ids_extra_columns_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (1, None, 9), (2, "b", 9)], "doc_id long, text string, shard int").withColumn("lang", F.lit("en"))
    rows = sharding.shard_documents(df, 24).collect()
    assert len(rows) == 4 and rows[0].lang == "en" and max(collections.Counter(r.shard for r in rows).values()) == 1
    assert sharding.shard_documents(df.limit(0), 24).count() == 0


def test_slots_follow_an_order(spark):
    df = spark.createDataFrame([(i, f"t{i}", (i * 37) % 200 if i != 9 else None) for i in range(200)] + [(200, "t200", 10**12)], "doc_id long, text string, at long")
    rows = sharding.shard_documents(df, 3, order="at").collect()
    check(rows, {i: f"t{i}" for i in range(201)}, 3)
    for s in range(3):
        at = [r.at for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        known = [x for x in at if x is not None]
        assert known == sorted(known) and None not in at[:-1]


def test_shared_lines_are_links(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (2, "x\r\n  c \n\n c"), (3, None), (4, " \n")], "doc_id long, text string")
    hubs = collections.defaultdict(list)
    for r in sharding.shared_lines(df).collect():
        hubs[r.hub].append(r.doc_id)
    assert sorted(map(sorted, hubs.values())) == [[1], [1, 2], [2]]


def test_null_ids_and_clashing_names(spark):
    rows = [(None, "a", 1, 5), (None, "a", 2, 6), (None, None, 3, 7), (1, "b", 4, 8), (1, "b", 5, 9), (2, "c", 6, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy int, _copy_id int")
    got = sharding.shard_documents(df, 3).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.copy, r._copy_id) for r in got) == sorted((i or 0, t or "", c, x) for i, t, c, x in rows)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == [0, 1]


def test_fewer_cut_edges_than_hashing_and_than_no_rounds(spark):
    """Planted communities: propagation keeps most pairs of a hub together, against shards by hash."""
    rng = random.Random(3)
    n, shards = 600, 6
    df = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "doc_id long, text string")
    links = [(i, i // 12) for i in range(n)] + [(rng.randrange(n), 1000 + k // 2) for k in range(120)]
    table = spark.createDataFrame(links, "doc_id long, hub long")

    def cut(shard_of):
        hubs = collections.defaultdict(list)
        for i, h in set(links):
            hubs[h].append(shard_of[i])
        return sum(len(s) * (len(s) - 1) // 2 - sum(c * (c - 1) // 2 for c in collections.Counter(s).values()) for s in hubs.values())

    placed = {r.doc_id: r.shard for r in sharding.shard_documents(df, shards, table).collect()}
    hashed = {i: zlib.crc32(str(i).encode()) % shards for i in range(n)}
    sizes = collections.Counter(placed.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert cut(placed) < 0.35 * cut(hashed)
    # Plain propagation: row by row, each takes the commonest shard of its neighbours that has room, until nothing moves.
    plain = {i: i % shards for i in range(n)}
    by_hub, of = collections.defaultdict(set), collections.defaultdict(set)
    for i, h in links:
        by_hub[h].add(i)
        of[i].add(h)
    for _ in range(20):
        moved = 0
        for i in sorted(of):
            votes = collections.Counter(plain[j] for h in of[i] for j in by_hub[h] if j != i)
            sizes = collections.Counter(plain.values())
            open_ = [s for s in range(shards) if s == plain[i] or sizes[s] < 1.1 * n / shards]
            best = max(open_, key=lambda s: (votes[s], s == plain[i], -s))
            moved += best != plain[i]
            plain[i] = best
        if not moved:
            break
    assert cut(placed) <= 1.1 * cut(plain)


def test_votes_of_all_hubs_count(spark):
    """24 neighbours through three narrow hubs outweigh 9 through the widest one."""
    df = spark.createDataFrame([(i, f"t{i}") for i in range(480)], "doc_id long, text string")
    x, far, near = 0, list(range(1, 25)), list(range(25, 34))
    links = [(d, "all") for d in far] + [(d, f"far{k}") for k in range(3) for d in [x, *far[8 * k : 8 * k + 8]]] + [(d, "near") for d in [x, *near]] + [(d, "near too") for d in near]
    rows = {r.doc_id: r.shard for r in sharding.shard_documents(df, 12, spark.createDataFrame(links, "doc_id long, hub string")).collect()}
    home = collections.Counter(rows[d] for d in far).most_common(1)[0]
    assert home[1] == 24 and rows[x] == home[0] != rows[near[0]]
    assert max(collections.Counter(rows.values()).values()) == 40


def test_allowed_moves_fit_the_room():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(2, 6)
        asked = {(a, b): rng.randrange(1, 50) for a in range(n) for b in range(n) if a != b and rng.random() < 0.7}
        room = {s: rng.choice([0, 0, 3, 40]) for s in range(n)}
        got = sharding.allowed(asked, room)
        assert all(0 < k <= asked[w] for w, k in got.items())
        for s in range(n):
            assert sum(k for (_, b), k in got.items() if b == s) - sum(k for (a, _), k in got.items() if a == s) <= room[s]
    assert sharding.allowed({(0, 1): 5, (1, 0): 3}, {0: 0, 1: 0}) == {(0, 1): 3, (1, 0): 3}
    assert sharding.allowed({(0, 1): 5, (1, 2): 5, (2, 0): 5}, {0: 0, 1: 0, 2: 0}) == {(0, 1): 5, (1, 2): 5, (2, 0): 5}


def test_a_wide_hub_meets_its_documents_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(120)], "doc_id long, text string")
    links = spark.createDataFrame([(i, "one") for i in range(60)] + [(i, f"h{i // 6}") for i in range(60)], "doc_id long, hub string")
    want = sorted(sharding.shard_documents(df, 4, links).select("doc_id", "shard").collect())
    monkeypatch.setattr(sharding, "PIECE", 7)
    assert sorted(sharding.shard_documents(df, 4, links).select("doc_id", "shard").collect()) == want
