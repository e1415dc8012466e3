"""Sharding: balanced label propagation under capacity quotas, then gapless slots.

Documents are linked through hubs: all members of a hub are neighbours of each other (equal texts share the hub of their
text; an edge list makes a hub of each edge; shared_lines makes one of each line). A document's label is its shard.

The first labels fill the shards hub by hub: in a few rounds each linked document asks through its widest hub for the shard
that holds most of it, and a hub that needs several shards fills one after the other. Then the labels propagate: in each
round every linked document adds up its neighbours by shard over all its hubs (from the hubs' counts by shard, so a hub costs as many
rows as it has members, not pairs) and asks for the shard with most of them, if that is more than where it is. Half the documents ask
at a time, by a hash of row and round, so that two neighbours don't change places for ever. How many may move from shard
to shard follows from the counts of requests and the room: moves into a full shard are granted as far as others leave it,
the largest gains first. Rounds end when no document asks, when two in a row move nothing, or after `rounds`. Documents without links fill what
is left, so that counts differ by one at most (law `rows`). Slots within a shard follow a hash of the row, or a given order.

Ranks are exact and distributed: rows are numbered within (key, bucket), and the buckets' sizes are added up in front.
Only tables of shards x shards x BUCKETS rows are broadcast, no group is gathered anywhere, and a wide hub meets its
documents in as many pieces as its members need (PIECE).

Defined results: a null text has size 8 and crc32 0 and is linked with nothing; rows that repeat count each, those with a null
id among them (links by id don't reach these); empty tables give an empty result. Ties go to the shard a row is in, then to the
lower one. Extra columns are kept by shard_documents; clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm import store

BUCKETS = 64
#: Rows of a bucket where all rows are numbered in one order.
WIDE = 1 << 17
#: Members of a hub that meet its counts in one task.
PIECE = 1 << 12


def ranked(df: DataFrame, key: str, bucket: Column, order: list[Column], name: str, few_keys: bool = True) -> DataFrame:
    """df with the row's number (from 0) within its key, by bucket, then order. Buckets are numbers below BUCKETS. The
    sizes of the buckets are broadcast only where the keys are few (shards)."""
    rows = df.withColumn("_bucket", bucket.cast("int"))
    sizes = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1)
    return rows.join(F.broadcast(sizes) if few_keys else sizes, [key, "_bucket"]).withColumn(name, F.col("_at") + F.col("_before")).drop("_at", "_before", "_bucket")


def spread(c: Column) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(5)), F.lit(BUCKETS))


def allowed(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many may move from shard to shard, of those that ask, so that no shard takes more than its room and what leaves it.
    Requests for shards that would overflow are cut in proportion until all fit: cuts only grow, so this ends."""
    moves = dict(asked)
    while True:
        over = {s: sum(n for (_, b), n in moves.items() if b == s) - sum(n for (a, _), n in moves.items() if a == s) - r for s, r in room.items()}
        over = {s: x for s, x in over.items() if x > 0}
        if not over:
            return {k: n for k, n in moves.items() if n}
        for s, x in over.items():
            into = sorted((k for k in moves if k[1] == s and moves[k]), key=lambda k: (-moves[k], k))
            total = sum(moves[k] for k in into)
            for k in into:
                cut = min(moves[k], -(-x * moves[k] // total), x)
                cut = min(cut, over[s])
                moves[k] -= cut
                over[s] -= cut


def propagate_labels(links: DataFrame, placed: DataFrame, n_shards: int, quota: int, rounds: int = 4) -> tuple[DataFrame, dict[int, int]]:
    """placed (row, shard) after label propagation over links (row, hub, members), no shard above its quota; and the shards' sizes."""
    spark = links.sparkSession
    shards = range(n_shards)
    held = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    state, still = placed, 0
    for turn in range(rounds):
        of = links.join(state, "row")
        counts = of.groupBy("hub").agg(F.first("members").alias("members"), *(F.count(F.when(F.col("shard") == s, 1)).alias(f"n{s}") for s in shards))
        # A wide hub's counts are copied for each piece of its members; narrow hubs have one piece.
        pieces = F.ceil(F.col("members") / PIECE).cast("int")
        counts = counts.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("members")
        met = of.withColumn("piece", F.pmod(F.xxhash64("row", F.lit(3)), pieces).cast("int")).join(counts, ["hub", "piece"])
        votes = met.groupBy("row").agg(F.first("shard").alias("shard"), F.count("*").alias("hubs"), *(F.sum(f"n{s}").alias(f"n{s}") for s in shards))
        # A row is no neighbour of its own.
        here = F.element_at(F.array(*(F.col(f"n{s}") for s in shards)), F.col("shard") + 1) - F.col("hubs")
        best = F.array_max(F.array(*(F.struct(F.when(F.col("shard") == s, F.col(f"n{s}") - F.col("hubs")).otherwise(F.col(f"n{s}")).alias("n"), (F.col("shard") == s).alias("own"), F.lit(-s).alias("low")) for s in shards)))
        wishes = votes.select("row", "shard", best.alias("best"), here.alias("here")).where("best.n > here")
        turns = (F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(2)) == 0).alias("asks")
        wishes = store.materialize(wishes.select("row", F.col("shard").alias("from"), (-F.col("best.low")).alias("to"), (F.col("best.n") - F.col("here")).alias("gain"), turns), "shard-asking")
        asked = {(r["from"], r.to, r.asks): r.n for r in wishes.groupBy("from", "to", "asks").agg(F.count("*").alias("n")).collect()}
        moves = allowed({(a, b): n for (a, b, asks), n in asked.items() if asks}, {s: quota - held.get(s, 0) for s in shards})
        still = 0 if moves else still + 1
        if moves:
            granted = spark.createDataFrame([(a * n_shards + b, n) for (a, b), n in moves.items()], "way int, most long")
            ways = wishes.where("asks").withColumn("way", (F.col("from") * n_shards + F.col("to")).cast("int")).join(F.broadcast(granted), "way")
            # Largest gains first: buckets by the gain's size, then the gain itself.
            level = F.greatest(F.lit(0), F.lit(BUCKETS - 1) - F.floor(4 * F.log2(F.col("gain").cast("double"))))
            ways = ranked(ways, "way", level, [F.desc("gain"), F.xxhash64("row"), F.col("row")], "turn").where("turn < most")
            after = state.join(ways.select("row", "to"), "row", "left").select("row", F.coalesce("to", "shard").cast("int").alias("shard"))
            after = store.materialize(after, "shard-state")
            store.drop(state)
            state = after
            for (a, b), n in moves.items():  # each way has as many requests as are granted, or more
                held[a], held[b] = held.get(a, 0) - n, held.get(b, 0) + n
        store.drop(wishes)
        if still == 2 or not asked:
            break
    return state, held


def propagate(docs: DataFrame, links: DataFrame, n_shards: int, rounds: int = 2) -> DataFrame:
    """row, shard: of the rows in docs (row: unique), linked by links (row, hub; several hubs per row are allowed). rounds: of the
    filling of hubs, and twice as many of the propagation."""
    total = docs.count()
    quota = total // n_shards
    wide = links.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1")
    links = store.materialize(links.join(wide, "hub"), "shard-links")
    state = store.materialize(links.select("row").distinct().withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")).withColumn("stay", F.lit(False)), "shard-state")
    for _ in range(rounds if quota else 0):
        # How many members of each hub a shard holds; a hub's shards in order of preference.
        held = links.join(state, "row").groupBy("hub", "shard").agg(F.count("*").alias("n"))
        room = {r.shard: quota - r.n for r in state.where("stay").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = {s: max(0, room.get(s, quota)) for s in range(n_shards)}
        free = state.sparkSession.createDataFrame([(s, n) for s, n in room.items() if n > 0], "shard int, room long")
        if not any(room.values()):
            break
        # All shards with room, for hubs that are wider than their own shards' room; n_shards rows per hub.
        wished = links.select("hub", "members").distinct().join(F.broadcast(free)).join(held, ["hub", "shard"], "left").fillna(0, ["n"])
        best = Window.partitionBy("hub").orderBy(F.desc("n"), F.desc("room"), F.pmod(F.xxhash64("hub", "shard"), F.lit(1 << 20)), "shard")
        wished = wished.withColumn("room_before", F.sum("room").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("room"))
        # A row asks in its hub with most members. Its number in the hub picks the hub's shard with room for that number.
        first = Window.partitionBy("row").orderBy(F.desc("members"), "hub")
        asking = links.join(state.where("NOT stay"), "row").withColumn("_p", F.row_number().over(first)).where("_p = 1").select("row", "hub", "members", "shard")
        asking = ranked(asking, "hub", spread(F.col("row")), [F.col("row")], "number", few_keys=False)
        asking = asking.join(wished.select("hub", F.col("shard").alias("to"), "room", "room_before"), "hub").where("number >= room_before AND number < room_before + room")
        # Requests are granted hub by hub, the widest class of hubs first.
        order = F.least(F.lit(BUCKETS - 1), F.lit(BUCKETS // 2) - F.floor(F.log2(F.col("members"))) + F.pmod(F.xxhash64("hub"), F.lit(BUCKETS // 2)))
        granted = ranked(asking, "to", F.greatest(F.lit(0), order), [F.xxhash64("hub"), F.col("hub"), F.col("number")], "turn").where("turn < room")
        after = state.join(granted.select("row", "to"), "row", "left")
        # Granted rows stay where they are; the rest tries again. A hub's rows follow the granted ones next time.
        after = store.materialize(after.select("row", F.coalesce("to", "shard").cast("int").alias("shard"), (F.col("stay") | F.col("to").isNotNull()).alias("stay")), "shard-state")
        moved = after.where("stay").count() - state.where("stay").count()
        store.drop(state)
        state = after
        if not moved:
            break
    settled = store.materialize(state.where("stay").select("row", "shard"), "shard-state")
    store.drop(state)
    settled, taken = propagate_labels(links, settled, n_shards, quota, 2 * rounds) if quota else (settled, {})
    # Quotas in full: what has no granted place fills the gaps, rows without links among it.
    gaps, at = [], 0
    for s in range(n_shards):
        n = quota + (s < total % n_shards) - taken.get(s, 0)
        gaps.append((s, at, at + n))
        at += n
    gap = docs.sparkSession.createDataFrame(gaps, "shard int, low long, high long")
    rest = docs.select("row").join(settled.select("row"), "row", "left_anti")
    # One key, so more buckets: about WIDE rows each, whatever their number.
    buckets = max(BUCKETS, -(-total // WIDE))
    rest = rest.withColumn("_bucket", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(buckets)))
    sizes = rest.groupBy("_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rest = rest.withColumn("turn", F.row_number().over(Window.partitionBy("_bucket").orderBy(F.xxhash64("row"), "row")) - 1)
    rest = rest.join(sizes, "_bucket").select("row", (F.col("turn") + F.col("_before")).alias("turn"))
    # Each turn falls into one of n_shards ranges: a lookup in a table of n_shards rows.
    rest = rest.join(F.broadcast(gap), (F.col("turn") >= F.col("low")) & (F.col("turn") < F.col("high"))).select("row", "shard")
    return settled.unionByName(rest)


def _text_hub() -> Column:
    """The same for equal texts, null for null."""
    return F.when(F.col("text").isNotNull(), F.concat_ws("-", F.xxhash64("text").cast("string"), F.crc32(F.col("text").cast("binary")).cast("string"), F.octet_length("text").cast("string")))


def shared_lines(docs: DataFrame) -> DataFrame:
    """doc_id, hub: a hub for each line that isn't blank, without the blanks around it. All lines of all texts are taken;
    those that stand in one document only link nothing."""
    lines = F.array_distinct(F.transform(F.split("text", r"\R"), lambda x: F.trim(x)))
    return docs.select("doc_id", F.explode(lines).alias("line")).where("line <> ''").select("doc_id", F.xxhash64("line").alias("hub"))


def _order_bucket(narrow: DataFrame) -> Column:
    """Buckets of equal width in the rows' order; nulls are in the last one."""
    low, high = narrow.agg(F.min("order"), F.max("order")).first()
    width = (high or 0) - (low or 0) + 1
    return F.coalesce(F.least(F.floor((F.col("order") - F.lit(low or 0)) / F.lit(float(width)) * BUCKETS), F.lit(BUCKETS - 1)), F.lit(BUCKETS - 1))


def shard_documents(docs: DataFrame, n_shards: int = 24, links: DataFrame | None = None, law: str = "rows", order: str | None = None) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null under this law).
    links: (doc_id, hub) further links beside equal texts. order: a column of whole numbers that the slots of each shard
    follow, nulls last; without it they follow a hash of the row."""
    if law != "rows":
        raise ValueError("only the law `rows` is built")
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce("text", F.lit(""))
    place = [F.col(order).cast("long").alias("order")] if order else []
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _text_hub().alias("hub"), *place)
    # Rows that repeat an id are told apart by their number.
    narrow = narrow.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("hub", *(["order"] if order else []))))
    narrow = store.materialize(narrow.withColumn("row", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy")), "shard-rows")
    hubs = narrow.where("hub IS NOT NULL").select("row", "hub")
    if links is not None:
        more = links.select("doc_id", F.concat(F.lit("link-"), F.col("hub").cast("string")).alias("hub")).distinct()
        hubs = hubs.unionByName(narrow.select("doc_id", "row").join(more, "doc_id").select("row", "hub"))
    placed = narrow.join(propagate(narrow, hubs, n_shards), "row")
    bucket = _order_bucket(narrow) if order else spread(F.col("row"))
    placed = ranked(placed, "shard", bucket, [*([F.col("order").asc_nulls_last()] if order else []), F.xxhash64("row"), F.col("row")], "slot")
    placed = placed.select("doc_id", "copy", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    rest = [c for c in docs.columns if c not in made]
    if rest == ["doc_id"] or rest == ["doc_id", "text"]:
        return placed.drop("copy")
    # Copies of an id are numbered again, in a column whose name nothing has, and ids meet null-safely.
    name = "_copy"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(_text_hub(), *([F.col(order).cast("long")] if order else [])))
    whole = docs.select(*rest, (again if _repeats(narrow) else F.lit(1)).alias(name))
    placed = placed.withColumnsRenamed({"doc_id": f"{name}_id", "copy": f"{name}_of"})
    met = whole.join(placed, F.col("doc_id").eqNullSafe(F.col(f"{name}_id")) & (F.col(name) == F.col(f"{name}_of")))
    return met.select(*rest, *made)


def _repeats(narrow: DataFrame) -> bool:
    return bool(narrow.where("copy > 1").limit(1).count())
