"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points; A-Z is lower-cased and every run of other ASCII characters counts as one space, so that
markup and digits carry no weight. Each text gives its 1-, 2- and 3-grams, hashed into `buckets` counts. Training is one
distributed pass over all labelled rows, whose counts Spark adds up by language and bucket; the matrix of log probabilities (languages x buckets) is broadcast, and each
batch is scored by gathers and segment sums in numpy.

Defined results: a null text, or one without any letter (Unicode category L), is `und` with score 0; without training rows every text is
`und`. Ties go to the alphabetically first language. Rows repeat as often as in the input; columns other than the id
and the text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
#: At this many characters the posterior stops to sharpen: neighbouring n-grams aren't independent.
EFFECTIVE_LENGTH = 64
_BLANK = np.array([not (97 <= c <= 122 or 65 <= c <= 90) for c in range(128)])
SLICE_CHARS = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    """log_prob: languages x buckets; prior: log share of each language's rows."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row, and the bounds of the texts: each with a space before and two behind it, so that no
    n-gram reaches into the next text."""
    joined = " " + "   ".join(x or "" for x in texts) + "   "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    cp = np.where((cp < 128) & _BLANK[np.minimum(cp, 127)], np.uint32(32), cp)
    sizes = np.fromiter((len(x) if x else 0 for x in texts), np.int64, len(texts)) + 3
    return cp, np.concatenate([[0], np.cumsum(sizes)])


def gram_buckets(cp: np.ndarray, bounds: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram that begins at each kept position, and the bounds of the texts in it.
    Positions inside a run of spaces are skipped."""
    blank = cp == 32
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[bounds[:-1]] = True
    at = np.flatnonzero(keep[: bounds[-1]])
    own = np.searchsorted(at, bounds)
    padded = np.concatenate([cp, np.full(2, 32, np.uint32)])
    for n in ORDERS:
        h = np.full(len(at), 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ padded[at + k]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        yield (h % np.uint32(buckets)).astype(np.int32), own


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= SLICE_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 15, smoothing: float = 0.5, max_languages: int = 400) -> LanguageModel:
    """Count the n-grams of all rows whose text and language aren't null. Each task adds up its rows and
    hands on the buckets that aren't empty. More than max_languages languages are an error, since the matrix is broadcast."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for a, b in _chunks(texts):
                cp, bounds = code_points(texts[a:b])
                of = langs[a:b]
                codes, of = np.unique(of, return_inverse=True)
                got = np.zeros((len(codes), buckets))
                for h, own in gram_buckets(cp, bounds, buckets):
                    at = np.repeat(of, np.diff(own)) * np.int64(buckets) + h[own[0] : own[-1]]
                    got += np.bincount(at, minlength=got.size).reshape(got.shape)
                for k, code in enumerate(codes):
                    sums[code] = sums.get(code, 0) + got[k]
                    seen[code] = seen.get(code, 0) + int((of == k).sum())
        for code, total in sums.items():
            at = np.flatnonzero(total)
            # The number of rows stands in a bucket of its own, -1.
            yield pa.RecordBatch.from_arrays([pa.array([code] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], seen[code]).astype(np.int64))], ["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Bounded by max_languages times buckets.
    got = summed.limit((max_languages + 1) * (buckets + 1)).toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts, seen_rows = np.zeros((len(names), buckets)), np.zeros(len(names))
    of, bucket, n = np.searchsorted(np.array(names, object), np.array(got["lang"].to_pylist(), object)) if names else np.zeros(0, int), got["bucket"].to_numpy(), got["n"].to_numpy()
    inside = bucket >= 0
    counts[of[inside], bucket[inside]] = n[inside]
    seen_rows[of[~inside]] = n[~inside]
    share = seen_rows
    return LanguageModel(names, np.log((counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * buckets)).astype(np.float32), np.log(share / max(share.sum(), 1)))


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the posterior of the predicted language, its n-grams weighted as EFFECTIVE_LENGTH at most."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names, matrix = np.array([*model.languages, "und"], object), [np.ascontiguousarray(x) for x in model.log_prob]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best, prob = np.full(len(texts), len(matrix)), np.zeros(len(texts))
            for a, b in _chunks(texts) if matrix else ():
                cp, bounds = code_points(texts[a:b])
                total, n = np.zeros((len(matrix), b - a)), np.zeros(b - a)
                for h, own in gram_buckets(cp, bounds, model.log_prob.shape[1]):
                    n += np.diff(own)
                    for k, row in enumerate(matrix):
                        total[k] += np.add.reduceat(row[h], own[:-1], dtype=np.float64)
                total = total * (np.minimum(n, EFFECTIVE_LENGTH) / n) + model.prior[:, None]
                p = np.exp(total - total.max(0))
                best[a:b], prob[a:b] = total.argmax(0), p.max(0) / p.sum(0)
            none = np.array([not x or not any(map(str.isalpha, x)) for x in texts], bool)
            best[none], prob[none] = len(matrix), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(prob)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")
