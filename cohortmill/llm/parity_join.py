"""N-gram Jaccard join by parity sketches: which documents share at least 4/5 of their word shingles.

A document's set holds its distinct n-word shingles, hashed. For sets A and B of Jaccard similarity 4/5 or more the
symmetric difference has at most d = (|A| + |B|) / 9 elements. A parity sketch XORs the elements into cells; each element
of the difference changes one cell, so the Hamming distance of two sketches is a lower bound of the difference.

Candidates: sizes are cut into bands. A band has P cells for its sets' elements, 64 bits each. Two similar sets differ in
d cells at most, so among the first d + 1 cells that aren't empty in one of them, one agrees (pigeonhole). Each set gives
those cells' values as keys, d taken for its largest partner in the band, in its own band and, if a larger partner can lie
there, in the next, and some keys more (SLACK). A set with too few cells in use gives all of them, and again under another
hash, where only pairs of such sets need it; after `FAMILIES` hashes it gives its elements one by one. So no similar pair
is missed.

Verification runs in three rounds. First each key's sets are compared with the key's smallest set: bit sketches (BITS
cells of one bit; for large sets also 2 to 4 bits an element) drop what is too far, the rest is verified on the sets, and
links are contracted to components. Only keys whose sets still fall into several components are open, and each set drops
as many of its open keys as its slack allows. Busy open keys that share sets are put into groups, which hold each set once:
the many keys of one common passage become one group. In each group, blocks of sets of similar size meet, and bit
sketches compare the sets of different components: in the second round each component's nearest pair is verified, in the
last one all pairs that are left, those of the other open keys included. Links within a component change nothing, so
no link between components is lost.
Equal sets are one vertex from the start: a task gives each distinct set once, and keys drop repeats. Sets are never
stored whole: sketches and keys come from one pass over the texts each, and the sets of the vertices to be verified, those
of pairs that the sketches let through, from the texts of one document for each of them.

Defined results: null, empty and blank texts have no shingles and form components of their own; a text with fewer words
than n has its whole sequence as one shingle. Rows repeat as often as in the input (repeated ids fall together if their
sets do). Rows with a null id take part; a component of such rows alone has a null component_id. An empty table gives an
empty result. Extra columns are ignored by similar_components and kept by keep_one, whatever their names. Elements,
keys and fingerprints are hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.llm import store
from cohortmill.llm.text import mix, shingle_sets, slices, text_bytes, words

FAMILIES = 3
BITS = 1024
BLOCK = 8192
#: A key of more sets is busy; sets give one key in SLACK more than they need, so that most can do without busy keys.
BUSY = 24
SLACK = 4
_U = np.uint64


def _bands(most: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of the bands: a band spans a factor of about 2.44 (1.25 ** 4)."""
    out = [1, 4]
    while out[-1] < most:
        out.append(int(out[-1] * 2.4414) + 1)
    return np.array(out, np.int64)


BANDS = _bands()


def _cells(band: int) -> int:
    """Cells of a band: some more than the largest difference asks for."""
    d = 2 * (int(BANDS[band + 1]) - 1) // 9
    return 1 if d == 0 else int(1.5 * (d + 1)) + 4


def set_keys(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of one set, given as its distinct 64-bit elements, and its slack: of any similar set's keys it shares more.

    A set gives its first need + need // SLACK cells in use; with fewer cells in use it counts as having too few. Of two
    similar sets take the one whose last given cell comes first (a set with too few cells gives all, so it is the other):
    need - 1 of its cells differ at most, so its need // SLACK + 1 others are keys of both. The smallest partner in the
    band has the smallest need."""
    n = len(values)
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    out, slack = [], n
    for band in (own, own + 1):
        largest = min(n * 5 // 4, int(BANDS[band + 1]) - 1)
        if largest < BANDS[band]:
            break
        need = (n + largest) // 9 + 1
        given = need + need // SLACK
        partner = max(-(-n * 4 // 5), int(BANDS[band]))
        slack = min(slack, ((partner + min(partner * 5 // 4, int(BANDS[band + 1]) - 1)) // 9 + 1) // SLACK)
        cells = _cells(band)
        for family in range(FAMILIES):
            h = values if family == 0 else mix(values + _U(family * 0x632BE59BD9B4E019 % 2**64))
            cell = (h >> _U(20)) % _U(cells)
            order = np.argsort(cell, kind="stable")
            sorted_cell = cell[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_cell[1:] != sorted_cell[:-1]]))
            value = np.bitwise_xor.reduceat(mix(h)[order], first)[:given]
            out.append(mix(value + sorted_cell[first][:given] * _U(0x9E3779B97F4A7C15) + _U((band * 8 + family) * 0xD1342543DE82EF95 % 2**64)))
            if len(first) >= given:
                break
        else:
            out.append(mix(values + _U((band * 8 + FAMILIES) * 0xD1342543DE82EF95 % 2**64)))
    return np.concatenate(out), slack


def bit_sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BITS parities of each set, as rows of bytes."""
    n = len(bounds) - 1
    slot = np.repeat(np.arange(n), np.diff(bounds)) * BITS + (mix(values) >> _U(30)).astype(np.int64) % BITS
    return np.packbits((np.bincount(slot, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def wide_sketch(values: np.ndarray) -> bytes | None:
    """Parities of a large set's elements in 2 to 4 bits for each of them, a power of two; None where BITS are as many.
    Halves XORed onto each other are the sketch of half as many bits, so any two sets can be compared."""
    if 2 * len(values) <= BITS:
        return None
    bits = 1 << (2 * len(values) - 1).bit_length()
    slot = (mix(values) >> _U(30)).astype(np.int64) % bits
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two wide sketches, the longer one folded to the length of the other."""
    length = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, length), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[_U(0)], np.cumsum(mix(values ^ _U(0x5851F42D4C957F2D)))])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(_U)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (doc_id, text) with their texts' sets: elements, bounds, fingerprints (vertices), and which rows are the
    first of their set in this task (an empty set never is)."""
    known: set[int] = set()
    for batch in slices(batches):
        _, _, doc, h = words(*text_bytes(batch.column(1)))
        values, bounds = shingle_sets(h, doc, batch.num_rows, n)
        size = np.diff(bounds)
        vertex = _fingerprints(values, bounds)
        fresh = np.zeros(batch.num_rows, bool)
        for i, v in enumerate(vertex.tolist()):
            fresh[i] = size[i] > 0 and v not in known
            known.add(v)
        if len(known) > 1 << 20:
            known.clear()
        yield batch, values, bounds, vertex, fresh


def shingle_table(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, vertex (fingerprint of the set, null for an empty one) and, once a task and distinct set, its
    bit sketch and, for a large set, its wide one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, bounds, vertex, fresh in _sets(batches, n):
            sketches = [s.tobytes() if f else None for s, f in zip(bit_sketches(values, bounds), fresh)]
            wide = [wide_sketch(values[i:j]) if f else None for i, j, f in zip(bounds[:-1], bounds[1:], fresh)]
            size = np.diff(bounds)
            columns = [batch.column(0), pa.array(size), pa.array(vertex, mask=size == 0), pa.array(sketches, pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "vertex", "sketch", "wide"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, vertex long, sketch binary, wide binary")


def _keys(docs: DataFrame, n: int) -> DataFrame:
    """key, vertex, slack of each distinct set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, bounds, vertex, fresh in _sets(batches, n):
            made = [set_keys(values[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(fresh)]
            if made:
                times = [len(k) for k, _ in made]
                slack = np.minimum([s for _, s in made], 1 << 15).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in made]).view(np.int64)), pa.array(np.repeat(vertex[fresh], times)), pa.array(np.repeat(slack, times))], ["key", "vertex", "slack"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, vertex long, slack short")


def _elements(docs: DataFrame, n: int, table: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertex, elements: the sets of at least the given vertices, read again from the texts of one document for each."""
    ids = table.join(vertices.distinct(), "vertex", "left_semi").groupBy("vertex").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
    texts = docs.select("doc_id", "text")
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, bounds, vertex, fresh in _sets(batches, n):
            rows = [values[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(fresh)]
            yield pa.RecordBatch.from_arrays([pa.array(vertex[fresh]), pa.array(rows, pa.binary())], ["vertex", "elements"])

    return texts.mapInArrow(run, "vertex long, elements binary").dropDuplicates(["vertex"])


def _shared(keys: DataFrame) -> DataFrame:
    """key, vertex, slack, star: the rows of keys with two distinct sets or more; star is the key's smallest vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, low0, last0, slack0, told = None, None, None, 0, False
        for batch in batches:
            k, v, slack = (batch.column(i).to_numpy() for i in range(3))
            if not len(k):
                continue
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            if key0 is not None and k[0] == key0 and v[0] == last0:
                new[0] = False
            k, v, slack = k[new], v[new], slack[new]
            if not len(k):
                continue
            head = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.flatnonzero(head)
            low = v[first].copy()
            size = np.diff(np.append(first, len(k)))
            goes_on = key0 is not None and k[0] == key0
            if goes_on:
                low[0] = low0
            many = size > 1
            if goes_on:
                many[0] = True
            keep = np.repeat(many, size)
            star = np.repeat(low, size)
            ko, vo, lo, so = k[keep], v[keep], slack[keep], star[keep]
            if goes_on and not told:  # the row that was alone so far
                ko, vo, lo, so = np.append(ko, key0), np.append(vo, low0), np.append(lo, slack0).astype(np.int16), np.append(so, low0)
            # A run that may go on in the next batch: its smallest row was told if it has others by now.
            told = bool(many[-1])
            if not (goes_on and len(first) == 1):
                slack0 = slack[first[-1]]
            key0, low0, last0 = k[-1], low[-1], v[-1]
            yield pa.RecordBatch.from_arrays([pa.array(ko), pa.array(vo), pa.array(lo), pa.array(so)], ["key", "vertex", "slack", "star"])

    return keys.repartition("key").sortWithinPartitions("key", "vertex").mapInArrow(run, "key long, vertex long, slack short, star long")


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements with these sketches (rows) can be similar."""
    return np.bitwise_count(a.view(_U) ^ b.view(_U)).sum(-1, dtype=np.int64) * 9 <= n + m


def _sides(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both vertices."""
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("vertex").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def _allowed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bit sketches allow similarity. Sets of much more than BITS elements fill a bit
    sketch with noise; pairs of them are held against their wide sketches too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at = {n: t.column(i) for i, n in enumerate(t.schema.names)}
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(at[f"sketch_{s}"].to_pylist()), np.uint8).reshape(-1, BITS // 8) for s in "ab")
            n, m = (at[f"n_shingles_{s}"].to_numpy() for s in "ab")
            ok = _near(x, y, n, m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            for i in np.flatnonzero(ok):
                v, w = (at[f"wide_{s}"][int(i)].as_py() for s in "ab")
                ok[i] = v is None or w is None or wide_distance(v, w) * 9 <= n[i] + m[i]
            yield pa.RecordBatch.from_arrays([at["a"], at["b"]], ["a", "b"]).filter(pa.array(ok))

    return _sides(pairs, sketches, ["sketch", "wide", "n_shingles"]).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, table: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, as a table."""
    pairs = store.materialize(pairs, "jaccard-pairs")
    ends = pairs.select(F.col("a").alias("vertex")).unionByName(pairs.select(F.col("b").alias("vertex")))
    sets = store.materialize(_elements(docs, n, table, ends), "jaccard-elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at = {n: t.column(i) for i, n in enumerate(t.schema.names)}
            ok = []
            for x, y in zip(at["elements_a"].to_pylist(), at["elements_b"].to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([at["a"], at["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = store.materialize(_sides(pairs, sets, ["elements"]).mapInArrow(run, "a long, b long"), "jaccard-links")
    store.drop(pairs)
    store.drop(sets)
    return links


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """vertex, root: of the vertices that have links, the smallest vertex that links lead to. Each round takes the
    smallest root among the neighbours and then the root of that root, until nothing changes."""
    edges = store.materialize(links.select(F.col(a).alias("v"), F.col(b).alias("w")).unionByName(links.select(F.col(b).alias("v"), F.col(a).alias("w"))), "cc-edges")
    state = store.materialize(edges.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")), "cc-state")
    for _ in range(rounds):
        near = edges.join(state.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("near"))
        # The smallest root also goes to the old root itself (hooking), so chains of roots shrink as fast as paths.
        seen = state.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        hooked = seen.unionByName(seen.select(F.col("old").alias("v"), F.lit(None).cast("long").alias("old"), "low"))
        hooked = hooked.groupBy("v").agg(F.min("low").alias("low"), F.max("old").alias("old"))
        jumped = hooked.join(hooked.select(F.col("v").alias("low"), F.col("low").alias("further")), "low", "left").select("v", "old", F.coalesce("further", "low").alias("root"))
        after = store.materialize(jumped, "cc-state")
        changed = after.where("root <> old").limit(1).count()
        store.drop(state)
        state = after
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    store.drop(edges)
    return state.select(F.col("v").alias("vertex"), "root")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """key, vertex, n: rows of the keys whose sets fall into several components, as far as they are needed. Similar sets
    share more keys than the slack of either, and if their components differ, all of these are open; so each set drops
    as many of its open keys, the busiest first: the least busy key that both share is then never dropped."""
    rooted = shared.join(roots, "vertex", "left").select("key", "vertex", "slack", F.coalesce("root", "vertex").alias("root"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    place = F.row_number().over(Window.partitionBy("vertex").orderBy(F.desc("n"), "key"))
    return shared.join(keys.select("key", "n"), "key").withColumn("place", place).where("place > slack").select("key", "vertex", "n")


def _groups(busy: DataFrame) -> DataFrame:
    """group, vertex: groups that hold every two sets of each busy key (rows key, vertex, n). Keys of one common passage
    have nearly the same sets, and their sets have the same busiest key. So each key joins the group of the busiest key
    of its smallest set, and a group holds its sets once; where that would need more comparisons than its keys on their
    own, each of them is a group."""
    keys = busy.groupBy("key").agg(F.min("vertex").alias("vertex"), F.count("*").cast("double").alias("m"))
    home = busy.groupBy("vertex").agg(F.max(F.struct("n", "key")).alias("top")).select("vertex", F.col("top.key").alias("home"))
    keys = keys.join(home, "vertex").select("key", "home", "m")
    rows = store.materialize(busy.join(keys, "key").select("key", "vertex", "home"), "jaccard-homes")
    whole = rows.select(F.col("home").alias("group"), "vertex").distinct()
    size = whole.groupBy("group").agg(F.count("*").cast("double").alias("size"))
    apart = keys.groupBy(F.col("home").alias("group")).agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    split = store.materialize(size.join(apart, "group").where("size * size > apart").select("group"), "jaccard-split")
    return whole.join(split, "group", "left_anti").unionByName(rows.join(split, rows.home == split.group, "left_semi").select(F.col("key").alias("group"), "vertex"))


def _calm_pairs(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: pairs of one key and different components, from keys of bounded size, sorted by key."""
    rooted = rows.join(roots, "vertex", "left").select("key", "vertex", F.coalesce("root", "vertex").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in _with_end(batches):
            k, v, r = rest if batch is None else (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(rest))
            # The last key of a batch may go on in the next one.
            cut = len(k) if batch is None or not len(k) else int(np.searchsorted(k, k[-1]))
            rest = [k[cut:], v[cut:], r[cut:]]
            k, v, r = k[:cut], v[:cut], r[:cut]
            a, b = [], []
            for step in range(1, BUSY):
                at = np.flatnonzero((k[step:] == k[:-step]) & (r[step:] != r[:-step])) if len(k) > step else np.zeros(0, int)
                a.append(v[at])
                b.append(v[at + step])
            a, b = np.concatenate(a), np.concatenate(b)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return rooted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """rows (group, n_shingles, vertex, ...) in cells (group, low, high) of two blocks at most; own: the row's block. Blocks
    follow the sizes, about `block` rows each, and only blocks with sizes that can be similar meet."""
    sizes = rows.groupBy("group", "n_shingles").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("group").orderBy("n_shingles"))
    sizes = sizes.withColumn("_before", upto - F.col("_m"))
    place = F.col("_before") + F.pmod(F.xxhash64("vertex"), F.col("_m"))
    rows = rows.join(sizes, ["group", "n_shingles"]).withColumn("own", F.floor(place / block).cast("long")).drop("_m", "_before")
    spans = rows.groupBy("group", "own").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    lower = spans.select("group", F.col("own").alias("low"), "most")
    cells = lower.join(spans.select("group", F.col("own").alias("high"), "least"), "group").where("low <= high AND 4 * least <= 5 * most").select("group", "low", "high")
    sides = cells.select("*", F.explode(F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))).alias("own"))
    return rows.join(sides, ["group", "own"])


def _near_pairs(n: np.ndarray, root: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, those y of right, their room): pairs of different components that sizes and bit sketches allow. left and right
    are places in order of size. Where they are the same, the sets of the largest component only come as y: each pair
    comes once or twice."""
    if left is right:
        names, back, times = np.unique(root[left], return_inverse=True, return_counts=True)
        left = left[back != times.argmax()]
    size = n[right]
    for x in left:
        y = right[np.searchsorted(size, -(-4 * n[x] // 5)) : np.searchsorted(size, 5 * n[x] // 4, side="right")]
        y = y[root[y] != root[x]]
        if len(y):
            room = n[y] + n[x] - 9 * np.bitwise_count(sketch[y] ^ sketch[x]).sum(1, dtype=np.int64)
            ok = room >= 0
            if ok.any():
                yield x, y[ok], room[ok]


def _cell_pairs(cells: DataFrame, roots: DataFrame, nearest: bool) -> DataFrame:
    """a, b: pairs of one cell and different components that the bit sketches allow; with nearest, of each component in
    the cell only the pair with most room."""
    rows = cells.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    names = ["group", "low", "high", "own", "vertex", "root", "n_shingles", "sketch"]

    def pairs(t: pa.Table) -> pa.RecordBatch:
        at = {c: t[c].to_numpy() for c in names[:-1]}
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), _U).reshape(t.num_rows, BITS // 64)
        v, root, n = at["vertex"], at["root"], at["n_shingles"]
        turn = np.flatnonzero(np.concatenate([[True], (np.stack([at[c][1:] != at[c][:-1] for c in names[:3]]).any(0))]))
        out_a, out_b = [], []
        for i, j in zip(turn, np.append(turn[1:], t.num_rows)):
            rows = i + np.argsort(n[i:j], kind="stable")
            left = rows if at["low"][i] == at["high"][i] else rows[at["own"][rows] == at["low"][i]]
            right = left if at["low"][i] == at["high"][i] else rows[at["own"][rows] == at["high"][i]]
            best: dict[int, tuple[int, int, int]] = {}
            for x, y, room in _near_pairs(n, root, sketch, left, right):
                if not nearest:
                    out_a.append(np.minimum(v[y], v[x]))
                    out_b.append(np.maximum(v[y], v[x]))
                    continue
                k = int(room.argmax())
                best[root[x]] = max(best.get(root[x], (-1, 0, 0)), (int(room[k]), int(v[x]), int(v[y[k]])))
                order = np.argsort(-room, kind="stable")
                for k in order[np.unique(root[y[order]], return_index=True)[1]]:
                    best[root[y[k]]] = max(best.get(root[y[k]], (-1, 0, 0)), (int(room[k]), int(v[x]), int(v[y[k]])))
            if best:
                found = np.array([b[1:] for b in best.values()], np.int64)
                out_a.append(found.min(1))
                out_b.append(found.max(1))
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_a, out_b))
        both = np.unique(np.stack([a, b], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell; a cell is held until the next begins, and has about two blocks of rows.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            turn = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            cut = int(turn[-1]) if len(turn) else 0
            if held and (cut or any(held[-1].column(c)[-1] != batch.column(c)[0] for c in range(3))):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    rows = rows.select(names).repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _vertices(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The shingle table, and vertex, root of the vertices that have links."""
    table = store.materialize(shingle_table(docs, n), "jaccard-sets")
    shared = store.materialize(_shared(_keys(docs, n)), "jaccard-shared")
    # A set that several tasks gave is one vertex: of its rows only one joins.
    sketches = store.materialize(table.where("sketch IS NOT NULL").select("vertex", "n_shingles", "sketch", "wide").dropDuplicates(["vertex"]), "jaccard-sketches")
    stars = shared.where("vertex <> star").select(F.col("star").alias("a"), F.col("vertex").alias("b")).distinct()
    links = _verified(_allowed(stars, sketches), docs, n, table)
    # Labels so far: the smallest star that a set is linked with. Sets of one label are linked; that is all that is needed.
    roots = links.groupBy(F.col("b").alias("vertex")).agg(F.min("a").alias("root"))
    roots = store.materialize(roots.unionByName(links.select(F.col("a").alias("vertex")).distinct().join(roots, "vertex", "left_anti").withColumn("root", F.col("vertex"))), "jaccard-labels")
    rows = store.materialize(_open(shared, roots), "jaccard-open")
    store.drop(shared)
    groups = _groups(rows.where(F.col("n") > BUSY))
    cells = store.materialize(_blocked(groups.join(sketches.select("vertex", "n_shingles", "sketch"), "vertex"), BLOCK), "jaccard-cells")
    for last in (False, True):
        pairs = _cell_pairs(cells, roots, nearest=not last)
        if last:
            pairs = pairs.unionByName(_calm_pairs(rows.where(F.col("n") <= BUSY).select("key", "vertex"), roots)).distinct()
        more = _verified(_allowed(pairs, sketches), docs, n, table)
        if not last or more.limit(1).count():
            # Components that are known are stars already; only what joins them is new.
            known = roots.where("vertex <> root").select(F.col("vertex").alias("a"), F.col("root").alias("b")) if last else links
            roots = components(known.unionByName(more))
        store.drop(more)
    for t in (links, sketches, rows, cells):
        store.drop(t)
    return table, roots


def similar_components(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of similarity 4/5 lead to."""
    table, roots = _vertices(docs, n)
    known = table.where("vertex IS NOT NULL").groupBy("vertex").agg(F.min("doc_id").alias("least"))
    known = known.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("vertex", "component_id")
    return table.select("doc_id", "n_shingles", "vertex").join(named, "vertex", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_vertex(docs: DataFrame, n: int, name: str) -> DataFrame:
    """docs with the fingerprint of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, doc, h = words(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
            values, bounds = shingle_sets(h, doc, batch.num_rows, n)
            yield batch.append_column(name, pa.array(_fingerprints(values, bounds), mask=np.diff(bounds) == 0))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """The rows of docs, all columns: of each component one row, that of the smallest doc_id (null ids come last); if several
    rows have this id, the one with the smallest fingerprint. Rows without words are linked with nothing, and all stay."""
    table, roots = _vertices(docs, n)
    rows = table.where("vertex IS NOT NULL").groupBy("doc_id", "vertex").agg(F.count("*").alias("times"))
    rows = rows.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "vertex", "times")).alias("kept")
    kept = rows.groupBy("root").agg(first).select("kept.doc_id", "kept.vertex", "kept.times")
    kept = store.materialize(kept.unionByName(table.where("vertex IS NULL").select("doc_id", "vertex", F.lit(1).cast("long").alias("times"))), "jaccard-kept")
    again = table.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if not again.limit(1).count():
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    # Ids don't tell rows apart: the id and the set do, and of equal rows any one stays.
    name = "_vertex"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    marked = _with_vertex(docs, n, name)
    chosen = kept.where("vertex IS NOT NULL").select(F.col("doc_id").alias(f"{name}_id"), F.col("vertex").alias(f"{name}_of"), "times")
    same = F.col("doc_id").eqNullSafe(F.col(f"{name}_id")) & (F.col(name) == F.col(f"{name}_of"))
    once = marked.join(chosen.where("times = 1").drop("times"), same, "left_semi")
    often = marked.join(chosen.where("times > 1").drop("times"), same, "left_semi").dropDuplicates(["doc_id", name])
    return once.unionByName(often).unionByName(marked.where(F.col(name).isNull())).select(docs.columns)
