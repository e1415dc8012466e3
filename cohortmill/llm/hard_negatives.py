"""Hard negatives by distributed radix selection over integer scores.

A window is a range of scores for one anchor, and wanted are its k first rows by score, ties by smaller id. Rows are dealt
into blocks, anchors into chunks; a cell scores one chunk against one block. In a histogram pass every cell counts, for each
window, how many of its scores fall into each of `bins` digits of the range, from the top down to the digit in which the
cell's own k-th row lies (no later digit can hold the k-th row of all). The sums over the blocks locate the digit of the
k-th row; the next pass divides that digit by `bins` again. When the scores of a digit are equal and still too many, the
digits of the id are counted instead. As soon as at most `gather` rows are left in question the window is settled, and one
last pass gathers the rows above its cut: at most k from each cell, so ties cannot flood it.

hard_negatives selects twice: first the positives of each anchor (other rows of its label, the window being all scores),
then, for each anchor and positive, the rows of other labels whose scores are low to high percent of the positive's.

Nothing is broadcast or collected but counts. A pass sends each block to the chunks that still have open windows only.

Defined results: rows with a null id or label, and vectors that are null, empty or hold null or non-finite components take no
part. Vectors are compared with those of their own length. A row never meets rows with its anchor's id. Rows that repeat
count each as candidates; an anchor row that repeats gives its lists once. Ids must be whole numbers. Anchors without positives, and positives with an
empty window (one below 0, for low < high), give no rows. Extra columns are ignored, whatever their names. Scores from
2**53 on are computed in whole numbers of any size; one that may need more than 62 bits is an error. Empty tables give an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm import store
from cohortmill.llm.topk import quantised

_COUNTS = pa.schema([(c, pa.int64()) for c in ("anchor", "w", "lo", "hi", "id_lo", "id_hi", "n")])
_FOUND = pa.schema([("anchor", pa.int64()), ("w", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LONG = 2**63 - 1
#: Components of one side of a cell, and scores that are held at once.
CELL_COMPONENTS = 1 << 19
SCORES = 1 << 20


def _kind(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} long" for f in schema)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of whole-number matrices."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < 2.0**53:
        return (x @ y.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(x) @ whole(y).T).astype(np.int64)


def first_in(values: np.ndarray, inside: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k first values inside, by descending value, then by smaller id."""
    at = np.flatnonzero(inside)
    if len(at) > 4 * k:
        own = values[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((ids[at], -values[at]))[:k]]


def histogram(values: np.ndarray, inside: np.ndarray, ids: np.ndarray, lo: int, hi: int, id_lo: int, id_hi: int, k: int, bins: int) -> list[tuple[int, int, int, int, int]]:
    """(lo, hi, id_lo, id_hi, n) of the digits with rows of one window in one cell, first digit first, up to the digit of the k-th row.
    The digits divide the scores lo to hi or, where these are one, the ids id_lo to id_hi."""
    by_id = lo == hi
    keys = ids[inside] if by_id else values[inside]
    if not len(keys):
        return []
    # Distance from the first key, in unsigned numbers: ranges may span all 64 bits.
    far = (keys.astype(np.uint64) - np.uint64(id_lo % 2**64)) if by_id else (np.uint64(hi % 2**64) - keys.astype(np.uint64))
    width = ((id_hi - id_lo) if by_id else (hi - lo)) // bins + 1
    digit, n = np.unique(far // np.uint64(width), return_counts=True)
    upto = min(len(n), int(np.searchsorted(np.cumsum(n), k)) + 1)
    out = []
    for d, m in zip(digit[:upto].tolist(), n[:upto].tolist()):
        if by_id:
            out.append((lo, hi, id_lo + d * width, min(id_hi, id_lo + (d + 1) * width - 1), m))
        else:
            out.append((max(lo, hi - (d + 1) * width + 1), hi - d * width, id_lo, id_hi, m))
    return out


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, blocks: int, chunk_rows: int):
    """anchors (with their windows) and rows, grouped by chunk, block and length of the vectors."""
    chunks = max(1, ceil(n_anchors / chunk_rows))
    left = anchors.withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = ["chunk", "block", "d"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _scored(a: pa.Table, r: pa.Table, same: bool):
    """Of each anchor of a cell, in batches: its number, windows, scores, and the rows that may be in a window."""
    ids, labels, y = r["vec_id"].to_numpy(), r["label"].to_numpy(), _matrix(r["v"])
    own, label, x = a["vec_id"].to_numpy(), a["label"].to_numpy(), _matrix(a["v"])
    anchors, windows = a["anchor"].to_pylist(), a["windows"].to_pylist()
    step = max(1, SCORES // len(ids))
    for begin in range(0, len(own), step):
        part = slice(begin, begin + step)
        s = scores(x[part], y)
        may = ((labels == label[part][:, None]) == same) & (ids != own[part][:, None])
        yield ids, anchors[part], windows[part], s, may


def _count_cell(same: bool, k: int, bins: int):
    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        if not a.num_rows or not r.num_rows:
            return _COUNTS.empty_table()
        out = []
        for ids, anchors, windows, s, may in _scored(a, r, same):
            for i, (anchor, wins) in enumerate(zip(anchors, windows)):
                for w in wins:
                    inside = may[i] & (s[i] >= w["lo"]) & (s[i] <= w["hi"]) & (ids >= w["id_lo"]) & (ids <= w["id_hi"])
                    out += [(anchor, w["w"], *x) for x in histogram(s[i], inside, ids, w["lo"], w["hi"], w["id_lo"], w["id_hi"], w["need"], bins)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], schema=_COUNTS) if out else _COUNTS.empty_table()

    return run


def _gather_cell(same: bool, k: int):
    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        if not a.num_rows or not r.num_rows:
            return _FOUND.empty_table()
        out = [[np.zeros(0, np.int64) for _ in _FOUND]]
        for ids, anchors, windows, s, may in _scored(a, r, same):
            for i, (anchor, wins) in enumerate(zip(anchors, windows)):
                for w in wins:
                    inside = may[i] & (s[i] <= w["top"]) & ((s[i] > w["lo"]) | ((s[i] == w["lo"]) & (ids <= w["id_hi"])))
                    at = first_in(s[i], inside, ids, k)
                    out.append([np.full(len(at), anchor), np.full(len(at), w["w"]), ids[at], s[i][at]])
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=_FOUND)

    return run


def select_first(anchors: DataFrame, rows: DataFrame, windows: DataFrame, k: int, same: bool, blocks: int, chunk_rows: int = 512, bins: int = 256, gather: int = 256) -> DataFrame:
    """anchor, w, vec_id, score, rank: the k first rows of each window (anchor, w, lo, hi). anchors: anchor (a unique number),
    vec_id, label, v, d; rows: vec_id, label, v, d, block. same: rows of the anchor's label, or rows of other labels."""
    ids = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
    id_lo, id_hi = (ids[0], ids[1]) if ids[0] is not None else (0, 0)
    start = windows.where("lo <= hi").select("anchor", "w", "lo", "hi", F.lit(id_lo).cast("long").alias("id_lo"), F.lit(id_hi).cast("long").alias("id_hi"), F.col("hi").alias("top"), F.lit(0).cast("long").alias("above"))
    opened = store.materialize(start, "negatives-open")
    settled: list[DataFrame] = []
    packed = F.collect_list(F.struct("w", "lo", "hi", "id_lo", "id_hi", "top", (F.lit(k) - F.col("above")).alias("need"))).alias("windows")

    def with_windows(state: DataFrame) -> tuple[DataFrame, int]:
        of = state.groupBy("anchor").agg(packed)
        return anchors.join(of, "anchor"), of.count()

    while True:
        meeting, n = with_windows(opened)
        if not n:
            break
        counts = _cells(meeting, rows, n, blocks, chunk_rows).applyInArrow(_count_cell(same, k, bins), _kind(_COUNTS))
        counts = counts.groupBy("anchor", "w", "lo", "hi", "id_lo", "id_hi").agg(F.sum("n").alias("n"))
        old = opened.select("anchor", "w", "top", "above", F.col("lo").alias("low"), F.col("id_hi").alias("last"))
        of = Window.partitionBy("anchor", "w")
        order = of.orderBy(F.desc("hi"), "id_lo")
        told = counts.join(old, ["anchor", "w"]).withColumn("upto", F.col("above") + F.sum("n").over(order)).withColumn("place", F.row_number().over(of.orderBy("hi", F.desc("id_lo"))))
        # The digit of the k-th row; or, with fewer rows than k in the whole window, its last digit, and the window is settled.
        short = (F.col("place") == 1) & (F.col("upto") < k)
        told = told.where(((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)) | short)
        done = short | (F.col("upto") <= gather) | ((F.col("lo") == F.col("hi")) & (F.col("id_lo") == F.col("id_hi")))
        told = told.select("anchor", "w", F.when(short, F.col("low")).otherwise(F.col("lo")).alias("lo"), "hi", "id_lo", F.when(short, F.col("last")).otherwise(F.col("id_hi")).alias("id_hi"), "top", (F.col("upto") - F.col("n")).alias("above"), done.alias("done"))
        told = store.materialize(told, "negatives-open")
        store.drop(opened)
        settled.append(told.where("done").drop("done"))
        opened = told.where("NOT done").drop("done")
    if not settled:
        return rows.sparkSession.createDataFrame([], _kind(_FOUND) + ", rank int")
    state = settled[0]
    for x in settled[1:]:
        state = state.unionByName(x)
    meeting, n = with_windows(state)
    found = _cells(meeting, rows, n, blocks, chunk_rows).applyInArrow(_gather_cell(same, k), _kind(_FOUND))
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _percent(score: str, p: int, up: bool) -> Column:
    """p percent of a whole score, rounded down or up, without leaving 64 bits."""
    rest = f"pmod({score}, 100)"
    return F.expr(f"(({score} - {rest}) DIV 100) * {p} + ({rest} * {p} + {99 if up else 0}) DIV 100")


def hard_negatives(vectors: DataFrame, is_anchor: Column, k: int = 3, positives: int = 5, low: int = 50, high: int = 95, scale: int = 256, block_rows: int = 4096, chunk_rows: int = 512, bins: int = 256, gather: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. vectors: vec_id, embedding, label;
    is_anchor: a condition on vec_id. low, high: the window, in percent of the positive's score."""
    whole = quantised(vectors.where("label IS NOT NULL"), scale, keep=("label",))
    whole = whole.select("vec_id", F.col("label").cast("long").alias("label"), "v", F.size("v").alias("d"))
    whole = store.materialize(whole.withColumn("_read", F.monotonically_increasing_id()), "negatives-rows")
    n, widest, most = whole.agg(F.count("*"), F.max("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if (most or 0) >= 2.0**61:
        raise OverflowError("a score may need more than 62 bits")
    # By where a row was read, not by its id: rows that repeat are spread as well. No more components to a block than fit.
    block_rows = max(1, min(block_rows, CELL_COMPONENTS // (widest or 1)))
    chunk_rows = max(1, min(chunk_rows, CELL_COMPONENTS // (widest or 1)))
    blocks = max(1, ceil(n / block_rows))
    rows = whole.withColumn("block", F.pmod(F.xxhash64("_read"), F.lit(blocks)).cast("int")).drop("_read")
    anchors = whole.where(is_anchor).drop("_read").dropDuplicates(["vec_id", "label", "v"])
    anchors = store.materialize(anchors.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    bound = int(most or 0) + 1  # of all inner products, by their vectors' lengths
    everything = anchors.select("anchor", F.lit(0).cast("long").alias("w"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    size = {"blocks": blocks, "chunk_rows": chunk_rows, "bins": bins, "gather": gather}
    positive = store.materialize(select_first(anchors, rows, everything, positives, True, **size), "negatives-positives")
    windows = positive.select("anchor", F.col("rank").cast("long").alias("w"), _percent("score", low, True).alias("lo"), _percent("score", high, False).alias("hi"))
    negative = select_first(anchors, rows, windows, k, False, **size)
    of = positive.select("anchor", F.col("rank").cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negative.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(of, ["anchor", "w"])
    out = out.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
