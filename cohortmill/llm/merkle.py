"""Merkle manifest of a dataset: blocks of leaves are collapsed by higher-order functions, then blocks of block roots.

A leaf is the SHA-256 of a row's columns. Leaves of one key (a language) are ordered and numbered; every ARITY consecutive
nodes, the last run perhaps fewer, become the SHA-256 of their hex texts, level by level, until one node, the subroot, is
left. The subroots, ordered by key, make the root in the same way. A block holds ARITY ** LEVELS consecutive nodes, so its
levels need nothing from other blocks: one row, an ordered array, is collapsed by sequence, transform, slice and aggregate.
The block roots are the nodes of the next round. On the way back each block hands its nodes the siblings above them, so
every leaf carries its path: per level the hex texts to its left and to its right within its run.

Numbers are exact without a single sort: rows are dealt to sorted ranges, written once with the range they fell into, and
numbered within it; the sizes of the ranges are added up in front. All groups are blocks of bounded size, and a key that
holds most of the rows is as many blocks as any other rows would be.

Defined results: null keys are one key of their own, the first; keys compare by their UTF-8 bytes. Within a key null order
values come first, and ties are ordered by leaf; rows that repeat are leaves of their own. A null column is `-` in its leaf, an empty text
`0:`. A lone leaf is its subroot, a lone subroot the root; its path is empty. An empty table has no rows and no root. Extra
columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm import store

ARITY = 8
#: Levels that one block collapses: 8 ** 3 = 512 nodes.
LEVELS = 3

_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*columns: Column) -> Column:
    """The leaf of a row: of each column the number of its bytes, a colon and its value, or `-` for null."""
    values = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, run: digest(F.concat(run["left"], node, run["right"])))


def proof_digest(path: Column) -> Column:
    """The SHA-256 of all siblings of a path, from the leaf up, each run from left to right."""
    return digest(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""))


def _collapse(nodes: Column, lone: Column, arity: int, levels: int) -> Column:
    """array of levels, from the nodes up. lone: this is the only block of its key, which ends with its one node; another
    block goes through all levels, as its neighbours do."""

    def up(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        runs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(last) / arity).cast("int") - 1))
        above = F.transform(runs, lambda j: digest(F.array_join(F.slice(last, j * arity + 1, arity), "")))
        return F.when(lone & (F.size(last) == 1), done).otherwise(F.concat(done, F.array(above)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(nodes), up)


def _own_path(levels: Column, place: Column, arity: int) -> Column:
    """Per level of a block the siblings of the node at this place (from 0) among the block's nodes."""

    def run(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(arity)), k)).cast("int")
        first, own = F.floor(at / arity).cast("int") * arity, at % arity
        join = lambda begin, n: F.array_join(F.slice(level, begin, n), "")
        return F.struct(join(first + 1, own).alias("left"), join(first + own + 2, F.lit(arity - 1) - own).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), run)


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes (key, order, node, ...) with place (from 0, in its key by order, then node) and total (nodes of the key)."""
    # Equal rows differ by where they were read, so no range is bound to hold all of them.
    # Written before the ranges are drawn, which takes a pass of its own: texts are read and digested once.
    nodes = store.materialize(nodes.withColumn("_read", F.monotonically_increasing_id()), "merkle-nodes")
    ranges = nodes.repartitionByRange("key", F.col("order").asc_nulls_first(), "node", "_read").withColumn("_range", F.spark_partition_id())
    ranges = store.materialize(ranges, "merkle-leaves")
    store.drop(nodes)
    sizes = ranges.groupBy("key", "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("key")
    sizes = sizes.select("key", "_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("total"))
    within = Window.partitionBy("key", "_range").orderBy(F.col("order").asc_nulls_first(), "node", "_read")
    rows = ranges.withColumn("_at", F.row_number().over(within) - 1).join(sizes, ["key", "_range"])
    out = rows.withColumn("place", F.col("_at") + F.col("_before")).drop("_read", "_range", "_at", "_before", "order")
    out._stored_at = ranges._stored_at
    return out


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One row for each block: key, block, total (nodes of the key), items (the nodes' rows in order), levels, top."""
    size = arity**levels
    kept = [c for c in nodes.columns if c not in ("key", "total", "place")]
    grouped = nodes.groupBy("key", F.expr(f"place DIV {size}").alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", *kept))).alias("items"))
    grouped = grouped.withColumn("levels", _collapse(F.col("items.node"), F.col("total") <= size, arity, levels))
    return store.materialize(grouped.withColumn("top", F.element_at(F.element_at("levels", -1), 1)), "merkle-blocks")


def _tree(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The blocks of each round, until every key has one block. nodes: key, place, total, node, ..."""
    size, rounds = arity**levels, []
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        rounds.append(_blocks(nodes, arity, levels))
        if most <= size:
            return rounds
        most = -(-most // size)
        nodes = rounds[-1].where(F.col("total") > size).select("key", F.col("block").alias("place"), F.expr(f"(total + {size - 1}) DIV {size}").alias("total"), F.col("top").alias("node"))


def _subroots(rounds: list[DataFrame], size: int) -> DataFrame:
    """key, subroot: the top of each key's only block in the round where it has one."""
    out = None
    for blocks in rounds:
        tops = blocks.where(F.col("total") <= size).select("key", F.col("top").alias("subroot"))
        out = tops if out is None else out.unionByName(tops)
    return out


def _paths(rounds: list[DataFrame], above: DataFrame, arity: int, levels: int) -> DataFrame:
    """The items of the lowest round with key, path and what `above` (key, path, ...) says of their keys. Blocks meet what is
    above them one to one, by key and block; no row of theirs is larger than a block."""
    size = arity**levels
    held = [c for c in above.columns if c not in ("key", "path")]
    given = None
    for blocks in reversed(rounds):
        top = above.withColumn("block", F.lit(0).cast("long"))
        lone = F.col("total") <= size
        if given is None:
            met = blocks.where(lone).join(top, ["key", "block"])
        else:
            met = blocks.where(lone).join(top, ["key", "block"]).unionByName(blocks.where(~lone).join(given, ["key", "block"]))
        item = lambda x, i: F.struct(x.alias("item"), F.concat(_own_path(F.col("levels"), i, arity), F.col("path")).alias("path"))
        out = met.select("key", *held, F.inline(F.transform("items", item)))
        given = out.select("key", F.col("item.place").alias("block"), "path", *held)
    return out.select("key", "item.*", "path", *held)


def manifest(rows: DataFrame, leaf: Column, key: Column, order: Column, carry: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """leaf, subroot, root and path of every row, beside the columns of carry. fold(leaf, path) gives the root; the siblings
    of the path prove the leaf to whoever knows the root."""
    size = arity**levels
    # '' for null and '=...' for others: null-safe, and in the order of the bytes with null first.
    keyed = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    kept = {f"c{i}": c for i, c in enumerate((carry or {}).values())}
    leaves = _numbered(rows.select(keyed.alias("key"), order.alias("order"), leaf.alias("node"), *(c.alias(name) for name, c in kept.items())))
    low = _tree(leaves, arity, levels)
    store.drop(leaves)
    # The second tree has the subroots as its leaves.
    subroots = _subroots(low, size).select(F.lit("").alias("key"), F.col("key").alias("order"), F.col("subroot").alias("node"), F.col("key").alias("of"))
    subroots = _numbered(subroots)
    high = _tree(subroots, arity, levels)
    store.drop(subroots)
    root = _subroots(high, size).select("key", F.col("subroot").alias("root"), F.lit(None).cast(_PATH).alias("path"))
    root = root.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    above = _paths(high, root, arity, levels).select(F.col("of").alias("key"), "path", F.col("node").alias("subroot"), "root")
    out = _paths(low, store.materialize(above, "merkle-subroots"), arity, levels)
    return out.select(*(F.col(c).alias(name) for c, name in zip(kept, carry or {})), F.col("node").alias("leaf"), "subroot", "root", "path")
