"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of about `block_rows` by a hash of their id, queries into chunks; each (chunk, block)
cell is one group of bounded size. Within a block every dimension has its list of rows, sorted. For a batch of queries
the lists are read from both ends, ever deeper (a positive weight profits from the top, a negative one from the bottom);
rows seen for the first time are scored in full. The threshold of a query is the score of a row that stood, in every
list, where reading has come to: once it is below the k-th score so far, no unseen row can enter, and the query leaves
the batch. The first block goes first: the k-th score that a query has there is its floor in all other blocks, where it leaves
as soon as the threshold is below it, and rows below it aren't sent on. What the cells found is merged over the blocks.

Vectors are integers, floor(scale * component), so scores are exact. Defined results: vectors that are null or hold null
or non-finite components take no part; vectors are compared with those of their own length only; ties go to the smaller
id, and ids must be whole numbers (others are a ValueError); a query never meets rows with its own id; a query row that repeats gives its list once; fewer candidates than k give
shorter lists; empty tables give none. Vectors without components take no part. Extra columns are ignored. Where products
can reach 2**53 a cell is scored in whole numbers of any size; a score beyond 64 bits is an OverflowError.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm import store

_LOWEST = -(2**63)
_OUT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v: array of floor(scale * x), and the columns to keep; only vectors whose components are all finite."""
    if vectors.schema[vec_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{vec_id} must hold whole numbers")
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # Doubles from 2**53 on are whole; floor() would squeeze them into 64 bits.
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(F.when(F.abs(c * scale) < 2.0**53, c * scale)).cast("double")).otherwise(c * scale))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"), *keep)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then by smaller id."""
    if scores.shape[1] > 4 * k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        width = int((scores >= kth[:, None]).sum(1).max())  # ties at the k-th score stay in
        part = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
        scores, ids = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, batch: int = 256, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries x k, -inf where there are fewer) of the best rows of one block. floor: scores that a row must reach
    to matter, one for each query; rows below it may be missing."""
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    n, d = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    lists = np.take_along_axis(rows, order, 0)
    # Depth at which reading both ends of all lists meets a row first.
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    depth = np.minimum(rank, n - 1 - rank).min(1)
    by_depth = np.argsort(depth, kind="stable")
    scores, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    for begin in range(0, len(queries), batch):
        live = np.arange(begin, min(begin + batch, len(queries)))
        seen, reach = 0, 8
        while len(live) and seen < n:
            upto = int(np.searchsorted(depth[by_depth], reach, side="right"))
            new = by_depth[seen:upto]
            seen = upto
            got = queries[live] @ rows[new].T
            own = np.broadcast_to(ids[new], got.shape)
            got = np.where(own == query_ids[live][:, None], -np.inf, got)
            scores[live], found[live] = _best(np.hstack([scores[live], got]), np.hstack([found[live], own]), k)
            if seen < n:
                top, low = lists[max(n - 1 - reach, 0)], lists[min(reach, n - 1)]
                bound = np.maximum(queries[live], 0) @ top + np.minimum(queries[live], 0) @ low
                live = live[bound >= np.maximum(scores[live][:, -1], floor[live])]
            reach *= 4
    return scores, found


def exact_search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """threshold_search for components so large that doubles round their products: plain scores in whole numbers."""
    whole = [[int(x) for x in r] for r in rows.tolist()]
    scores, found = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), -1)
    for i, (q, own) in enumerate(zip(queries.tolist(), query_ids.tolist())):
        q = [int(x) for x in q]
        best = sorted((-sum(a * b for a, b in zip(q, r)), j) for r, j in zip(whole, ids.tolist()) if j != own)[:k]
        if any(abs(s) >= 2**63 for s, _ in best):
            raise OverflowError("a score needs more than 64 bits")
        scores[i, : len(best)], found[i, : len(best)] = [-s for s, _ in best], [j for _, j in best]
    return scores, found


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = 8192, chunk_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row that is_query (a condition on vec_id) selects."""
    rows = quantised(vectors, scale)
    queries = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    n, m = rows.count(), queries.count()
    blocks, chunks = max(1, ceil(n / block_rows)), max(1, ceil(m / chunk_rows))
    dims = F.size("v").alias("d")
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk")
    asked = queries.select("vec_id", "v", dims, chunk, F.xxhash64("v").alias("query"))
    dealt = rows.select("vec_id", "v", dims, F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _OUT.empty_table()
        qid, cid = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        floor = q["floor"].to_numpy()
        x, y = _matrix(q["v"]), _matrix(c["v"])
        if np.abs(x).max() * np.abs(y).max() * x.shape[1] < 2.0**53:
            scores, found = threshold_search(x, qid, y, cid, k, floor=floor.astype(np.float64))
            at = np.isfinite(scores) & (scores >= floor[:, None])
        else:
            scores, found = exact_search(x, qid, y, cid, k)
            at = (np.arange(k) < np.minimum(k, (cid != qid[:, None]).sum(1))[:, None]) & (scores >= floor[:, None])
        return pa.table([np.repeat(qid, at.sum(1)), np.repeat(q["query"].to_numpy(), at.sum(1)), found[at], scores[at].astype(np.int64)], schema=_OUT)

    def cells(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("chunk", "block", "d").cogroup(right.groupBy("chunk", "block", "d")).applyInArrow(search, "query_id long, query long, vec_id long, score long")

    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query")

    found = cells(asked.withColumns({"block": F.lit(0), "floor": F.lit(_LOWEST)}), dealt.where("block = 0"))
    if blocks > 1:
        found = store.materialize(found, "topk-first")
        floors = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "query", F.col("score").alias("floor"))
        rest = store.materialize(asked.join(floors, ["vec_id", "query"], "left").withColumn("floor", F.coalesce("floor", F.lit(_LOWEST))), "topk-floors")
        rest = rest.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))
        found = found.unionByName(cells(rest, dealt.where("block > 0")))
    return best(found).drop("query")
