"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Every run of `n` words of a test item (all of its words, if fewer) is a gram. One pass over the corpus counts in how many
documents each gram stands. A gram's frequency is this count plus that of the items that hold it. An item's seeds are its grams
that the corpus holds at all and that are rare: by up to `ALWAYS`, or by up to `SPREAD` times the frequency at which the rarest
`seed_share` of its grams end. Rarity is relative within an item, so an item that is copied often keeps seeds (with SPREAD, also
those that only its commoner version has), and an opening that many items share gives none. A second pass looks up the seeds only:
a seed at word i of the text and word j of the item proposes the passage where the item would lie, with room for
insertions; overlapping proposals merge. Each passage is aligned with its item by words (match 2, mismatch and gap -1); the
alignment score over the item's own is the passage's score, and those of least_score or more are reported. A passage of
over four times the item's length is aligned in windows of that length which overlap by half: an alignment that reaches
least_score (0.5 or more) spans less than twice the item, so some window holds it whole, and no array is wider than that.

The benchmark is broadcast in parts of at most `part_bytes` of text each (an item longer than that is in a part of its own
or with few others), so its size has no bound: more parts, more passes. Neither pass shuffles a text; the counts of a pass are as many as the grams of a part.

Defined results: null and empty texts and items match nothing. Rows of either table repeat as often as in the input: items
that repeat an id, or have none, are items of their own. Ids may have any type. An empty benchmark or table gives an empty
result. Ties between alignments of one item go to the first passage. Words are runs of non-blank characters, A-Z lower-cased.
Extra columns are ignored by contamination() and kept by decontaminate().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortmill.llm import store
from cohortmill.llm.text import grams, slices, text_bytes, words

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bounds of rarity.
ALWAYS, SPREAD = 64, 8


@dataclass
class Part:
    """Items of one part of the benchmark: ids, word hashes and bounds; grams by size: sorted hashes with the places
    (item, word) of each."""

    ids: list
    hashes: np.ndarray
    bounds: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list, texts: list[str | None], n: int) -> Part:
        data, off = text_bytes(pa.array(texts, pa.string()))
        _, _, doc, h = words(data, off)
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        length = np.diff(bounds)
        found = {}
        for size in sorted({int(min(n, x)) for x in length if x}):
            g, at = grams(h, doc, size)
            own = (length[doc[at]] == size) if size < n else np.ones(len(at), bool)
            g, at = g[own], at[own]
            order = np.argsort(g, kind="stable")
            keys, first = np.unique(g[order], return_index=True)
            found[size] = (keys, np.append(first, len(g)), doc[at][order], (at - bounds[doc[at]])[order])
        return Part(ids, h, bounds, found)

    def hits(self, h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word places and key numbers of the grams of this size that a text has in common with the part."""
        keys = self.grams[size][0]
        g, at = grams(h, doc, size)
        if not len(g) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(keys, g)
        k[k == len(keys)] = 0
        own = np.flatnonzero(keys[k] == g)
        return at[own], k[own]


def gram_counts(docs: DataFrame, part: Part) -> dict[int, np.ndarray]:
    """In how many documents each gram of the part stands."""
    held = docs.sparkSession.sparkContext.broadcast(part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held.value
        seen = {size: np.zeros(len(g[0]), np.int64) for size, g in part.grams.items()}
        for batch in slices(batches):
            _, _, doc, h = words(*text_bytes(batch.column(0)))
            for size, total in seen.items():
                at, k = part.hits(h, doc, size)
                once = np.unique(doc[at] * len(total) + k) % max(1, len(total))
                total += np.bincount(once, minlength=len(total))
        for size, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at), pa.array(total[at])], ["size", "gram", "n"])

    out = {size: np.zeros(len(g[0]), np.int64) for size, g in part.grams.items()}
    got = docs.select("text").mapInArrow(count, "size long, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n")).toArrow()
    size, gram, n = (got[c].to_numpy() for c in ("size", "gram", "n"))
    for k, total in out.items():
        total[gram[size == k]] = n[size == k]
    return out


def seeds(part: Part, counts: dict[int, np.ndarray], share: float, always: int = ALWAYS, spread: int = SPREAD) -> Part:
    """The part with its seeds only, by the documents and items that hold its grams."""
    kept = {}
    for size, (keys, first, item, word) in part.grams.items():
        gram = np.repeat(np.arange(len(keys)), np.diff(first))
        once = np.unique(gram * len(part.ids) + item) // max(1, len(part.ids))
        often = counts[size] + np.bincount(once, minlength=len(keys))
        held = np.flatnonzero(counts[size][gram] > 0)
        order = held[np.lexsort((often[gram[held]], item[held]))]
        begin = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1]])) if len(order) else np.zeros(0, int)
        number = np.diff(np.append(begin, len(order)))
        most = often[gram[order[begin + np.maximum(0, np.ceil(share * number).astype(int) - 1)]]] if len(order) else np.zeros(0, int)
        rare = np.sort(order[often[gram[order]] <= np.repeat(np.maximum(spread * most, always), number)])
        own, at = np.unique(gram[rare], return_index=True)
        kept[size] = (keys[own], np.append(at, len(rare)), item[rare], word[rare])
    return Part(part.ids, part.hashes, part.bounds, kept)


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over many pairs at a time: best local score of each, and where in b it ends (exclusive)."""
    rows, width = max(map(len, a)), max(map(len, b))
    left, right = np.zeros((len(a), rows), np.uint64), np.zeros((len(b), width), np.uint64)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    n, m = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    inside = np.arange(width) < m[:, None]
    slope = -GAP * np.arange(width + 1)
    h, best, end = np.zeros((len(a), width + 1), np.int32), np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    for i in range(rows):
        step = np.where((left[:, i : i + 1] == right) & inside, MATCH, MISMATCH)
        g = np.zeros_like(h)
        g[:, 1:] = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        g = np.maximum.accumulate(g + slope, axis=1) - slope  # gaps along the row
        g[i >= n] = 0
        at = g.argmax(1)
        top = g[np.arange(len(a)), at]
        up = top > best
        best, end = np.where(up, top, best), np.where(up, at, end)
        h = g.astype(np.int32)
    return best, end


def _passages(part: Part, h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """text, item, first word, last word of the merged proposals as rows, words by their place in h; long ones in windows."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    found = [np.zeros((0, 4), np.int64)]
    for size in part.grams:
        at, k = part.hits(h, doc, size)
        _, place, item, word = part.grams[size]
        times = place[k + 1] - place[k]
        own = np.repeat(at, times)
        j = np.repeat(place[k], times) + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        length = np.diff(part.bounds)[item[j]]
        pad = length // 4 + 4
        d = doc[own]
        begin, end = np.maximum(own - word[j] - pad, first[d]), np.minimum(own - word[j] + length + pad, first[d + 1])
        found.append(np.stack([d, item[j], begin, end], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    if not len(rows):
        return rows
    # Proposals of one text and item that overlap are one passage.
    turn = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
    far = np.cumsum(turn) * (len(h) + 1)
    reached = np.maximum.accumulate(rows[:, 3] + far)
    new = np.flatnonzero(turn | np.concatenate([[True], rows[1:, 2] + far[1:] > reached[:-1]]))
    out = np.column_stack([rows[new, :3], np.maximum.reduceat(rows[:, 3], new)])
    length = np.diff(part.bounds)[out[:, 1]]
    windows = np.maximum(1, -(-(out[:, 3] - out[:, 2]) // (2 * length)) - 1)
    of = np.repeat(np.arange(len(out)), windows)
    begin = out[of, 2] + 2 * length[of] * (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows))
    return np.column_stack([out[of, :2], begin, np.minimum(out[of, 3], begin + 4 * length[of])])


def _matches(part: Part, texts: pa.Array, least_score: float, cells: int = 1 << 18) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first byte, end byte) of the passages that reach least_score."""
    data, off = text_bytes(texts)
    start, end, doc, h = words(data, off)
    todo = _passages(part, h, doc, len(texts))
    width = todo[:, 3] - todo[:, 2]
    todo = todo[np.lexsort((width, np.diff(part.bounds)[todo[:, 1]]))]
    out, i = [], 0
    while i < len(todo):
        # As many pairs as `cells` columns hold; the widest of the next ones counts.
        widest = np.maximum.accumulate(todo[i : i + 128, 3] - todo[i : i + 128, 2])
        some = todo[i : i + max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), cells, side="right")))].tolist()
        i += len(some)
        a, b = [part.hashes[part.bounds[k] : part.bounds[k + 1]] for _, k, _, _ in some], [h[x:y] for _, _, x, y in some]
        best, stop = align(a, b)
        score = best / (MATCH * np.array([len(x) for x in a]))
        good = np.flatnonzero(score >= least_score)
        if not len(good):
            continue
        # The same alignment backwards, from where it ends, gives where it begins.
        _, back = align([a[g][::-1] for g in good], [b[g][: stop[g]][::-1] for g in good])
        for g, r in zip(good, back):
            d, k, x, _ = some[g]
            out.append((d, k, float(score[g]), int(start[x + stop[g] - r] - off[d]), int(end[x + stop[g] - 1] - off[d])))
    return out


#: Groups of items to a part; parts are filled with whole groups.
GROUPS = 64


def _parts(benchmark: DataFrame, n: int, part_bytes: int) -> Iterator[Part]:
    """The items in parts of about part_bytes of text (one item may be longer), whatever their ids: items are dealt into small
    groups by where they were read, and parts take groups until they are full."""
    items = benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("_read")).where(F.col("text").isNotNull())
    items = store.materialize(items, "benchmark-items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group = F.pmod(F.xxhash64("_read"), F.lit(GROUPS * max(1, -(-size // part_bytes))))
    sizes = sorted((r.g, r.n) for r in items.groupBy(group.alias("g")).agg(F.sum(F.octet_length("text")).alias("n")).collect())
    begin, held, bounds = 0, 0, []
    for g, n_bytes in sizes:
        if held and held + n_bytes > part_bytes:
            bounds.append((begin, g))
            begin, held = g, 0
        held += n_bytes
    if sizes:
        bounds.append((begin, sizes[-1][0] + 1))
    for low, high in bounds:
        rows = items.where((group >= low) & (group < high)).orderBy("item_id", "_read").collect()
        yield Part.of([r.item_id for r in rows], [r.text for r in rows], n)
    store.drop(items)


def _seeded(docs: DataFrame, benchmark: DataFrame, n: int, seed_share: float, part_bytes: int) -> Iterator[Part]:
    for part in _parts(benchmark, n, part_bytes):
        yield seeds(part, gram_counts(docs, part), seed_share)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, seed_share: float = 0.6, least_score: float = 0.5, part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, score, begin, end (code points): each item's best passage in each document that holds it."""
    if least_score < 0.5:
        raise ValueError("least_score is 0.5 or more")
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type, out = benchmark.schema["item_id"].dataType, None
    for part in _seeded(docs, benchmark, n, seed_share, part_bytes):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                best: dict[tuple[int, int], tuple] = {}
                for m in _matches(held.value, batch.column(1), least_score):
                    if m[:2] not in best or (-m[2], m[3]) < (-best[m[:2]][2], best[m[:2]][3]):
                        best[m[:2]] = m
                rows = sorted(best.values())
                texts = {d: (batch.column(1)[d].as_py() or "").encode() for d in {m[0] for m in rows}}
                at = [[len(texts[m[0]][: m[k]].decode("utf-8", "ignore")) for m in rows] for k in (3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([m[0] for m in rows], pa.int64())), pa.array([held.value.ids[m[1]] for m in rows], to_arrow_type(item_type)), pa.array([m[2] for m in rows], pa.float64()), pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64())], ["doc_id", "item_id", "score", "begin", "end"])

        got = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, item_id {item}, score double, begin long, end long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item}, score double, begin long, end long")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 3, seed_share: float = 0.6, least_score: float = 0.5, part_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item."""
    out = docs
    for part in _seeded(docs, benchmark, n, seed_share, part_bytes):
        out = out.mapInArrow(_keeper(docs, part, least_score), docs.schema)
    return out


def _keeper(docs: DataFrame, part: Part, least_score: float) -> Callable:
    held = docs.sparkSession.sparkContext.broadcast(part)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column(batch.schema.get_field_index("text"))
            good = np.ones(batch.num_rows, bool)
            good[[m[0] for m in _matches(held.value, text, least_score)]] = False
            yield batch.filter(pa.array(good))

    return keep
