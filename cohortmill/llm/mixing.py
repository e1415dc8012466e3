"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents form blocks of `block_rows` rows. Time is a sequence of slots, one block each. Source s with
weight w may run its block k from slot floor(k / w) (release) and must have run it by slot ceil((k + 1) / w) (deadline);
running the released block with the earliest deadline first keeps each source within one block of w * t at every slot t.

Weights are exact: the given numbers, as they are written, become integers in the same ratio (`parts`), and releases and
deadlines are whole-number arithmetic on them. After as many slots as the parts add up to, every source has run its part
and the schedule repeats; so of each phase that many slots are laid out, or the whole phase where that is shorter, from
the sources' numbers of blocks alone. When a source has run its last block, the schedule goes on in a next phase without
it, the weights of the others in their old ratio; there are no more phases than sources. Every row is kept, once.

Defined results: null sources are a source of their own, named ''. Rows of one source are taken in the order of a hash
of the id, then the id; rows that repeat keep their own places. An empty input gives an empty output. Weights are for
named sources; sources that aren't named get `default_weight`; a weight must be above 0. Extra columns are kept, even
where their names clash with those that are made here: the made ones are in one struct, `mix`, or where docs has that
name, `mix_`, `mix__` and so on (free_name). More than max_sources sources are an error, as the schedule is laid out by source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets within which rows of a source are numbered; the buckets' sizes are added up in front.
BUCKETS = 256


#: Slots up to which the layout is broadcast; a longer one is joined by a shuffle.
BROADCAST_SLOTS = 100_000


def whole_parts(weights: Mapping[str, Fraction]) -> dict[str, int]:
    """The smallest integers in exactly the ratio of the weights."""
    unit = math.lcm(*(w.denominator for w in weights.values()))
    parts = {s: int(w * unit) for s, w in weights.items()}
    shared = math.gcd(*parts.values())
    return {s: p // shared for s, p in parts.items()}


def earliest_deadlines(parts: list[int], blocks: list[int]) -> list[int]:
    """Which source runs in each slot: over one cycle (as many slots as the parts add up to), or up to the slot in which
    a source runs its last block, if that comes first."""
    total, run, out = sum(parts), [0] * len(parts), []
    ready: list[tuple[int, int, int]] = []
    waiting = [(0, i) for i in range(len(parts))]
    while len(out) < total:
        while waiting and waiting[0][0] <= len(out):
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(run[i] + 1) * total // parts[i]), -parts[i], i))
        i = heapq.heappop(ready)[2]
        out.append(i)
        run[i] += 1
        if run[i] == blocks[i]:
            break
        heapq.heappush(waiting, (run[i] * total // parts[i], i))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, Fraction]) -> list[dict]:
    """Of the sources that still have blocks: their integer weights, the layout that the phase repeats (who runs, and
    with which of its blocks in the layout), the slots that the phase runs, and the blocks of each source before and in it."""
    left, first, out = {s: n for s, n in blocks.items() if n > 0}, {s: 0 for s in blocks}, []
    while left:
        names = sorted(left)
        parts = whole_parts({s: weights[s] for s in names})
        who = earliest_deadlines([parts[s] for s in names], [left[s] for s in names])
        seen, k, at = [0] * len(names), [], [[] for _ in names]
        for t, i in enumerate(who):
            k.append(seen[i])
            seen[i] += 1
            at[i].append(t)
        # The phase ends after the first last block of a source. Sources that the layout leaves out can't be the first.
        ends = [(left[s] - 1) // seen[i] * len(who) + at[i][(left[s] - 1) % seen[i]] + 1 for i, s in enumerate(names) if seen[i]]
        slots = len(who) if len(who) < sum(parts.values()) else min(ends)
        cycles, rest = divmod(slots, len(who))
        ran = [cycles * n for n in seen]
        for i in who[:rest]:
            ran[i] += 1
        out.append({"names": names, "parts": [parts[s] for s in names], "who": who, "k": k, "per": seen, "slots": slots, "first": [first[s] for s in names], "ran": ran})
        for s, n in zip(names, ran):
            first[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n > 0}
    return out


def cycle_slots(parts: Column, total: Column) -> Column:
    """earliest_deadlines over one cycle, as a column. parts: array of the integer weights; gives, for each slot, the place of
    the source that runs and the number of its block within the cycle."""
    state = F.struct(F.transform(parts, lambda p: F.lit(0)).alias("run"), F.array().cast("array<struct<who:int,k:int>>").alias("out"))

    def deadline(p, k, i):
        return F.struct(F.ceil((k + 1) * total / p).cast("long").alias("deadline"), (F.lit(0) - p).alias("lighter"), i.alias("who"))

    def step(s, t):
        open_ = F.filter(F.transform(parts, lambda p, i: F.when((F.element_at(s["run"], i + 1) < p) & (F.floor(F.element_at(s["run"], i + 1) * total / p) <= t), deadline(p, F.element_at(s["run"], i + 1), i))), lambda x: x.isNotNull())
        who = F.array_min(open_)["who"]
        ran = F.transform(s["run"], lambda k, i: k + F.when(i == who, 1).otherwise(0))
        return F.struct(F.coalesce(ran, s["run"]).alias("run"), F.concat(s["out"], F.array(F.struct(who.cast("int").alias("who"), F.element_at(s["run"], who + 1).alias("k")))).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), (total - 1).cast("int")), state, step, lambda s: s["out"])


def _exact(weight: float) -> Fraction:
    """The number as it is written: 0.1 is one tenth."""
    return Fraction(weight) if isinstance(weight, (int, Fraction, Decimal)) else Fraction(repr(float(weight)))


def free_name(columns: list[str], name: str = "mix") -> str:
    """The name, followed by as many underscores as set it apart from the columns' names (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", block_rows: int = 4, resolution: int = 240, default_weight: float = 1.0, max_sources: int = 10_000) -> DataFrame:
    """docs with a struct (`mix`, or the next free name, as the last column): phase, weight (the source's exact share in it), block (of the source, from 0), release, deadline and
    slot (within the phase), position (from 0, without gaps, over all rows). Order by mix.position to get the mixture.
    resolution: slots of the layout that one row of its table holds; it has no bearing on the result."""
    key = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_source"), F.xxhash64(F.col(doc_id)).alias("_hash"))
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
    # Sizes of (source, bucket): small, whatever the rows. Their running sums number the rows without a global sort.
    sizes = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("n"))
    counts = {r["_source"]: r["n"] for r in sizes.groupBy("_source").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    spark = docs.sparkSession
    given = {s: _exact((weights or {}).get(s, default_weight)) for s in counts}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be above 0")
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, given)
    layout, turns, start = [], [], 0
    for p, x in enumerate(plan):
        total, length = sum(x["parts"]), len(x["who"])
        if total * (2 + max(x["ran"])) >= 10**38 or total >= 10**28:
            raise ValueError("the weights have too many digits for exact deadlines")
        layout += [(p, i, [x["names"][w] for w in x["who"][i : i + resolution]], x["k"][i : i + resolution]) for i in range(0, length, resolution)]
        turns += [(s, p, first, ran, per, length, start, w / total, Decimal(w), Decimal(total)) for s, first, ran, per, w in zip(x["names"], x["first"], x["ran"], x["per"], x["parts"]) if ran]
        start += x["slots"]
    turns = spark.createDataFrame(turns, "_source string, phase int, first long, ran long, per long, length long, start long, weight double, part decimal(28,0), total decimal(28,0)")
    layout = spark.createDataFrame(layout, "phase int, begin long, who array<string>, k array<long>")
    slots = layout.select("phase", "begin", F.posexplode(F.arrays_zip("who", "k")).alias("at", "run"))
    slots = slots.select(F.col("run.who").alias("_source"), "phase", F.col("run.k").alias("_k"), (F.col("begin") + F.col("at")).alias("slot"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", F.col(f"_row.{doc_id}"))))
    numbered = numbered.join(F.broadcast(sizes.select("_source", "_bucket", "before")), ["_source", "_bucket"]).withColumn("_n", F.col("_n") - 1 + F.col("before"))
    numbered = numbered.withColumn("_block", F.floor(F.col("_n") / block_rows)).drop("before", "_bucket", "_hash")
    # (phase, source) is bounded by max_sources; (phase, source, k) by the digits of the weights, or else by the blocks.
    held = numbered.join(F.broadcast(turns), "_source").where("_block >= first AND _block < first + ran")
    held = held.withColumn("_k", (F.col("_block") - F.col("first")) % F.col("per")).withColumn("_cycle", ((F.col("_block") - F.col("first") - F.col("_k")) / F.col("per")).cast("long"))
    held = held.join(F.broadcast(slots) if sum(len(x["who"]) for x in plan) <= BROADCAST_SLOTS else slots, ["_source", "phase", "_k"])
    held = held.withColumn("_at", F.col("slot") + F.col("_cycle") * F.col("length"))
    # Close the gaps: rows per slot group, added up in front, then the rank within the slot.
    held = held.withColumn("_place", (F.col("start") + F.col("_at")) * block_rows + F.col("_n") % block_rows)
    total = start * block_rows
    width = max(1, -(-total // 4096))
    held = held.withColumn("_range", F.floor(F.col("_place") / width).cast("int"))
    before = held.groupBy("_range").agg(F.count("*").alias("_m")).withColumn("_before", F.sum("_m").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_m")).drop("_m")
    placed = held.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy("_place"))).join(F.broadcast(before), "_range")
    placed = placed.withColumn("_own", (F.col("_block") - F.col("first")).cast("decimal(18,0)"))
    made = F.struct(
        "phase", "weight", F.col("_block").alias("block"), F.expr("(_own * total) DIV part").alias("release"),
        F.expr("((_own + 1) * total + part - 1) DIV part").alias("deadline"), F.col("_at").alias("slot"), (F.col("_before") + F.col("_r") - 1).alias("position"),
    )
    return placed.select("_row.*", made.alias(free_name(docs.columns)))


def in_mixed_order(mixed: DataFrame, columns: list[str | Column]) -> DataFrame:
    """The columns, range-partitioned and sorted by position: files written from it hold the mixture in their order. mixed: as
    mix_sources gives it, the struct last."""
    position = F.col(f"`{mixed.columns[-1]}`.position")
    return mixed.repartitionByRange(position).sortWithinPartitions(position).select(columns)
