"""Quality: attention-based multiple-instance learning over the passages of a text.

Every passage (PASSAGE_WORDS following words, all of the text) is encoded by fixed features: shares of character classes,
word lengths, repetition within the passage and towards the one before, letter entropy, and signed hashes of word shapes.
A gated attention (softmax of w . (tanh(V h) * sigmoid(U h))) weighs the passages; the weighted mean representation gives
the document's score by a logistic output. Attention and output are learned together from document labels, by Adam in
numpy, on a sample of at most `max_per_class` labelled rows of each class (the smallest hashes of their ids); this bound
is a parameter. The classes weigh as they do in the labels.

Defined results: null and empty texts are one passage without words. Without both classes the score is the share of rows
with label 1 (0.5 with no rows). Rows repeat as often as in the input; other columns are neither read nor returned. A
document with several labels counts as 1 if one of them is; null labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm import store
from cohortmill.llm.text import slices, text_bytes, words
from cohortmill.llm.toxicity import bounded_sample

PASSAGE_WORDS = 64
SHAPES = 16
HIDDEN = 12
#: Byte classes: lower, upper, digit, other bytes of letters, comma and dot, other marks, line ends, blanks.
CLASSES = 8


def _classes() -> np.ndarray:
    out = np.full(256, 5, np.int8)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    out[[44, 46]], out[10], out[[9, 11, 12, 13, 32]] = 4, 6, 7
    return out


_CLASS = _classes()
N_FEATURES = CLASSES + 8 + SHAPES


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (the third after the classes: the share of distinct words), and the len(texts) + 1 bounds of the texts' passages."""
    data, off = text_bytes(texts)
    start, end, doc, h = words(data, off)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    bags = np.maximum(1, -(-count // PASSAGE_WORDS))
    bounds = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((bounds[-1], N_FEATURES), np.float32)
    if not len(start):
        return out, bounds
    place = np.arange(len(start)) - first[doc]
    of = bounds[doc] + place // PASSAGE_WORDS
    total = np.bincount(of, minlength=len(out)).astype(np.float64)
    some = np.maximum(total, 1)
    size = (end - start).astype(np.float64)
    # Bytes of a passage: from its first word to the next passage's first word, or the text's end.
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    owner = of[head]
    stop = np.where(np.append(doc[head][1:] == doc[head][:-1], False), np.append(start[head][1:], 0), off[doc[head] + 1])
    kinds = _CLASS[data]
    sums = np.zeros((CLASSES, len(data) + 1), np.int32)
    for k in range(CLASSES):
        np.cumsum(kinds == k, out=sums[k, 1:])
        out[owner, k] = (sums[k][stop] - sums[k][start[head]]) / np.maximum(stop - start[head], 1)
    mean = np.bincount(of, size, len(out)) / some
    f = CLASSES
    out[:, f] = mean / 10
    out[:, f + 1] = np.sqrt(np.maximum(np.bincount(of, size**2, len(out)) / some - mean**2, 0)) / 10
    out[:, f + 2] = np.bincount(_distinct(of, h), minlength=len(out)) / some
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, f + 3] = np.bincount(of, again, len(out)) / some
    for j, gap in enumerate((2, 3)):
        same = np.zeros(len(h), bool)
        same[gap:] = (h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])
        out[:, f + 4 + j] = np.bincount(of, same, len(out)) / some
    out[:, f + 6] = np.log1p(total) / 5
    out[:, f + 7] = (np.bincount(of, size <= 3, len(out)) / some)
    # Shapes: classes of the first and of the last two bytes of a word.
    last = np.maximum(end - 2, start)
    shape = (kinds[start].astype(np.int64) * 64 + kinds[last] * 8 + kinds[end - 1]) * 2654435761 % 2**32
    sign = np.where(shape >> 31 & 1, -1.0, 1.0)
    slot = of * SHAPES + (shape >> 8) % SHAPES
    out[:, f + 8 :] = np.bincount(slot, sign, len(out) * SHAPES).reshape(len(out), SHAPES) / some[:, None]
    return out, bounds


def _distinct(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, of))
    a, b = of[order], h[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """p: V, U (features x hidden), w (hidden), c (features), b; mean and scale standardise the features."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """Of passages grouped by bounds: gates, attention, bag representation and score."""
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        t, g = np.tanh(x @ self.p["V"]), _sigmoid(x @ self.p["U"])
        a = (t * g) @ self.p["w"]
        own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(a - np.maximum.reduceat(a, bounds[:-1])[own])
        e /= np.add.reduceat(e, bounds[:-1])[own]
        z = np.add.reduceat(x * e[:, None], bounds[:-1])
        return {"x": x, "t": t, "g": g, "e": e, "z": z, "own": own, "score": _sigmoid(z @ self.p["c"] + self.p["b"])}


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
    rng = np.random.default_rng(11)
    d = x.shape[1]
    p = {"V": rng.normal(0, d**-0.5, (d, HIDDEN)), "U": rng.normal(0, d**-0.5, (d, HIDDEN)), "w": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(d), "b": np.zeros(1)}
    model = AttentionModel(p, x.mean(0), x.std(0) + 1e-3)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in docs])
            own = np.concatenate([[0], np.cumsum(bounds[docs + 1] - bounds[docs])])
            f = model.forward(x[rows], own)
            d_logit = (f["score"] - y[docs]) * weight[docs] / weight[docs].sum()
            d_z = d_logit[:, None] * p["c"]
            d_e = (f["x"] * d_z[f["own"]]).sum(1)
            d_a = f["e"] * (d_e - np.add.reduceat(f["e"] * d_e, own[:-1])[f["own"]])
            d_h = d_a[:, None] * p["w"]
            grad = {"c": f["z"].T @ d_logit, "b": d_logit.sum(keepdims=True), "w": (f["t"] * f["g"]).T @ d_a, "V": f["x"].T @ (d_h * f["g"] * (1 - f["t"] ** 2)), "U": f["x"].T @ (d_h * f["t"] * f["g"] * (1 - f["g"]))}
            step += 1
            for k in p:
                g = grad[k] + decay * p[k] * (k != "b")
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_per_class: int = 3000) -> AttentionModel:
    sample = store.materialize(bounded_sample(docs, labels, label, max_per_class), "quality-sample")
    # The sample is drawn by class; the labels' own shares weigh the classes again.
    share = {r.y: r.n for r in labels.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bounds = encode(batch.column(0))
            rows = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["y", "x"])

    got = sample.select("text", "y").mapInArrow(read, "y int, x binary").collect()
    store.drop(sample)
    y = np.array([r.y for r in got], float)
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]
    if len(set(y)) < 2:
        zero = np.zeros((N_FEATURES, HIDDEN))
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return AttentionModel({"V": zero, "U": zero, "w": np.zeros(HIDDEN), "c": np.zeros(N_FEATURES), "b": np.array([np.log(mean / (1 - mean))])}, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    have = np.bincount(y.astype(int), minlength=2)
    weight = np.array([share.get(k, 1) / max(1, have[k]) for k in (0, 1)])[y.astype(int)]
    return fit(np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y, weight)


def score(docs: DataFrame, model: AttentionModel, attention: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, the passages' attention weights."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bounds = encode(batch.column(1))
            f = held.value.forward(x, bounds)
            columns = {"doc_id": batch.column(0), "score": pa.array(f["score"].astype(np.float64))}
            if attention:
                columns["attention"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(f["e"].astype(np.float64)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double" + ", attention array<double>" * attention)
