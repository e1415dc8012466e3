"""Language-model scoring: marginal probability of a text over all segmentations into an existing vocabulary's pieces.

Words are runs of non-blank characters, A-Z lower-cased. A word is a path through the lattice of vocabulary pieces over
the UTF-8 bytes of its mark (U+2581) and letters; single bytes are pieces too, so every word has a path. The first piece
of a word starts with the mark; then pieces follow each other until a stop. A log-space forward recursion adds up all
paths, and nothing else scores a word: its own frequency has no part in it. The vocabulary's own order of scores gives the
prior over pieces; expectation-maximisation over the training words, each as often as it occurs, makes unigram
probabilities of it. The probability of a text is the product over its words, each with the chance that a text goes on
before it, times the chance that it ends there.

The recursion for an end needs only as many columns before it as the longest piece has bytes, so a word may have any
length: up to `WINDOW` bytes the lattice of many words is made at once; longer ones are read in a rolling window. For the
expected counts such words are cut into parts of WINDOW bytes that count as words of their own.

Work is shared by word, not by token: a chunk of documents (about `chunk_bytes` of text, one Arrow task) gives its
distinct words once, with counts, and its tokens as numbers. Words meet their corpus counts in a shuffle by word; scores
return to their chunks in a shuffle by chunk, and a segment sum gives each document's score. Nothing of the corpus goes
to the driver but four sums and one vector of the vocabulary's size for each round.

Base score: sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))) with the training counts c.

Defined results: null and empty texts have one token, the end. Rows repeat as often as in the input, with the same score
for the same text; ids may be null, repeat, and have any type. An empty table gives an empty result. Without training
rows, N = V = 0 and only the prior scores. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortmill.llm import store
from cohortmill.llm.text import Hashed, gathered, mix, slices, strings, text_bytes, words

MARK = "▁".encode()
CHUNK_BYTES = 8 << 20
WINDOW = 512


@dataclass
class Vocabulary:
    """Pieces by byte length: sorted hashes, and each one's number. first: whether it starts with the mark."""

    pieces: list[bytes]
    prior: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        end = np.cumsum([len(p) for p in self.pieces], dtype=np.int64)
        size = np.array([len(p) for p in self.pieces], np.int64)
        raw = Hashed(np.frombuffer(b"".join(self.pieces), np.uint8), fold=False).raw(end - size, end)
        h = mix(raw)
        self.by_size = {}
        #: By size and whether the piece comes first: which upper 16 bits of the unmixed hashes occur, hashes, numbers.
        self.tables = {}
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            at = at[np.argsort(h[at])]
            self.by_size[int(n)] = (h[at], at)
            for first in (True, False):
                own = at[self.first[at] == first]
                if len(own):
                    occurs = np.zeros(1 << 16, bool)
                    occurs[raw[own] >> np.uint64(48)] = True
                    self.tables[int(n), first] = (occurs, h[own], own)


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece model; byte pieces stand for their byte. A piece's prior is that of its rank, 1 / (rank + 16),
    by the model's own order of scores; pieces with the mark after the first place, or control pieces, are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mass: dict[bytes, float] = {}
    kept = [(model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    for rank, (_, i) in enumerate(sorted(kept, key=lambda x: (-x[0], x[1]))):
        name = model.id_to_piece(i)
        raw = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.lower().encode()
        if MARK not in raw[1:]:
            mass[raw] = mass.get(raw, 0.0) + 1 / (rank + 16)
    for b in range(256):
        mass.setdefault(bytes([b]), 1e-6)
    pieces = sorted(mass)
    first = np.array([p.startswith(MARK) for p in pieces])
    prior = np.array([mass[p] for p in pieces])
    # Two distributions: over first pieces, and over what follows, the stop (last place) among it.
    prior[first] /= prior[first].sum()
    prior[~first] *= 0.7 / prior[~first].sum()
    return Vocabulary(pieces, np.append(prior, 0.3), np.append(first, False))


class Lattice:
    """All words of a batch with the same number of bytes, the mark included: arcs (piece, begin, end) as matrices."""

    def __init__(self, vocabulary: Vocabulary, log_prob: np.ndarray, marked: np.ndarray):
        self.n, self.size = marked.shape
        self.marked, self.log_prob, self.vocabulary = marked, log_prob, vocabulary
        hashed = Hashed(marked.reshape(-1), fold=False)
        # Column p of the words lies at every size-th place from p on.
        column = lambda x, p: x[p :: self.size][: self.n]
        self.arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.size + 1)]
        for (n, first), (occurs, keys, number) in vocabulary.tables.items():
            for begin in [0] if first else range(len(MARK), self.size - n + 1):
                end = begin + n
                if end > self.size:
                    continue
                raw = (column(hashed.sums, end) - column(hashed.sums, begin)) * column(hashed.inverse, begin)
                own = np.flatnonzero(occurs[raw >> np.uint64(48)])
                if len(own):
                    h = mix(raw[own])
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    good = keys[at] == h
                    if good.any():
                        self.arcs[end].append((begin, own[good], number[at[good]]))

    def forward(self) -> np.ndarray:
        a = np.full((self.size + 1, self.n), -np.inf)
        a[0] = 0.0
        for end in range(1, self.size + 1):
            for begin, own, piece in self.arcs[end]:
                a[end, own] = np.logaddexp(a[end, own], a[begin, own] + self.log_prob[piece])
        return a

    def backward(self) -> np.ndarray:
        b = np.full((self.size + 1, self.n), -np.inf)
        b[self.size] = self.log_prob[-1]
        for end in range(self.size, 0, -1):
            for begin, own, piece in self.arcs[end]:
                b[begin, own] = np.logaddexp(b[begin, own], b[end, own] + self.log_prob[piece])
        return b

    def marginal(self) -> np.ndarray:
        """Natural log of each word's probability, the stop included."""
        return self.forward()[self.size] + self.log_prob[-1]

    def expected(self, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, a word counting `weight` times."""
        a, b = self.forward(), self.backward()
        total, out = a[self.size] + self.log_prob[-1], np.zeros(len(self.log_prob))
        for end in range(1, self.size + 1):
            for begin, own, piece in self.arcs[end]:
                share = np.exp(a[begin, own] + self.log_prob[piece] + b[end, own] - total[own]) * weight[own]
                out += np.bincount(piece, share, len(out))
        out[-1] += weight.sum()
        return out


def lattices(vocabulary: Vocabulary, log_prob: np.ndarray, texts: pa.Array, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, Lattice]]:
    """The indices and lattice of the words of up to WINDOW bytes, by length."""
    data, off = text_bytes(texts)
    size = np.diff(off)
    for n in np.unique(size[(size > 0) & (size <= WINDOW)]):
        at = np.flatnonzero(size == n)
        step = max(1, most * 8 // int(n))
        for i in range(0, len(at), step):
            own = at[i : i + step]
            marked = np.empty((len(own), len(MARK) + n), np.uint8)
            marked[:, : len(MARK)] = np.frombuffer(MARK, np.uint8)
            marked[:, len(MARK) :] = data[off[own][:, None] + np.arange(n)]
            yield own, Lattice(vocabulary, log_prob, marked)


def rolling(vocabulary: Vocabulary, log_prob: np.ndarray, word: bytes) -> float:
    """Natural log probability of one word of any length, the stop included: the forward recursion, with the values of the
    last places only, as many as the longest piece has bytes. Arcs are looked up for a block of places at a time."""
    text = np.frombuffer(MARK + word, np.uint8)
    reach, size = max(vocabulary.by_size), len(text)
    ahead = {0: 0.0}
    for low in range(len(MARK), size + 1, WINDOW):
        high = min(low + WINDOW, size + 1)
        start = max(0, low - reach)
        hashed = Hashed(text[start : high - 1], fold=False)
        arcs: list[list[tuple[int, float]]] = [[] for _ in range(low, high)]
        for n, (keys, number) in vocabulary.by_size.items():
            end = np.arange(max(low, n), high)
            begin = end - n
            own = (begin == 0) | (begin >= len(MARK))
            begin, end = begin[own], end[own]
            if not len(end):
                continue
            h = hashed.of(begin - start, end - start)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            good = (keys[at] == h) & (vocabulary.first[number[at]] == (begin == 0))
            for i, j, p in zip(begin[good].tolist(), end[good].tolist(), log_prob[number[at[good]]].tolist()):
                arcs[j - low].append((i, p))
        for end in range(low, high):
            paths = [ahead[i] + p for i, p in arcs[end - low] if i in ahead]
            if paths:
                top = max(paths)
                ahead[end] = top + math.log(sum(math.exp(p - top) for p in paths))
        ahead = {i: v for i, v in ahead.items() if i >= high - reach}
    return ahead[size] + float(log_prob[-1])


def marginals(vocabulary: Vocabulary, log_prob: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Natural log probability of each word."""
    out = np.zeros(len(texts))
    for own, lattice in lattices(vocabulary, log_prob, texts):
        out[own] = lattice.marginal()
    data, off = text_bytes(texts)
    for i in np.flatnonzero(np.diff(off) > WINDOW):
        out[i] = rolling(vocabulary, log_prob, data[off[i] : off[i + 1]].tobytes())
    return out


def parts(texts: pa.Array, count: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words with those beyond WINDOW bytes cut (between letters), and their counts."""
    size = np.diff(text_bytes(texts)[1])
    if not (size > WINDOW).any():
        return texts, count
    cut, times = [], []
    for i in np.flatnonzero(size > WINDOW):
        word, n = texts[int(i)].as_py().encode(), len(cut)
        at = 0
        while at < len(word):
            end = min(at + WINDOW, len(word))
            while end < len(word) and (word[end] & 0xC0) == 0x80:
                end -= 1
            cut.append(word[at:end].decode())
            at = end
        times += [count[i]] * (len(cut) - n)
    short = np.flatnonzero(size <= WINDOW)
    return pa.concat_arrays([texts.take(pa.array(short)), pa.array(cut, texts.type)]), np.concatenate([count[short], times])


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**31 in order, zstandard over their four byte planes: small numbers leave two of them empty."""
    return pa.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<i4").ravel()


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row for each chunk: its documents' ids, their tokens as numbers of the chunk's words (packed), the words, commonest
    first, and their counts (in training documents)."""
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        room = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[3] for x in held])
            ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            _, first, back, uses = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # The commonest words get the smallest numbers, which pack best.
            order = np.argsort(-uses, kind="stable")
            number_of = np.empty(len(order), np.int64)
            number_of[order] = np.arange(len(order))
            first, back = first[order], number_of[back]
            train = np.concatenate([np.repeat(~x[1], x[2]) for x in held])
            counts = np.bincount(back, train, len(first)).astype(np.int64)
            shift = np.cumsum([0, *(len(x[4]) for x in held)])
            start, end = (np.concatenate([x[k] + at for x, at in zip(held, shift)])[first] for k in (5, 6))
            texts = strings(np.concatenate([x[4] for x in held]), start, end)
            listed_texts = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(schema.field(1).type.value_type))
            return pa.RecordBatch.from_arrays([pa.array([number]), listed, *(pa.array([np.concatenate([x[k] for x in held])], schema.field(k + 1).type) for k in (1, 2)), pa.array([packed(back)], pa.binary()), listed_texts, pa.array([counts], schema.field(6).type)], schema=schema)

        for batch in slices(batches):
            data, off = text_bytes(batch.column(1))
            start, end, doc, h = words(data, off)
            out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            held.append((batch.column(0), out, np.bincount(doc, minlength=batch.num_rows).astype(np.int32), h, data, start, end))
            room += len(data)
            if room >= chunk_bytes:
                yield flush()
                held.clear()
                number, room = number + 1, 0
        if held:
            yield flush()

    return docs.mapInArrow(run, f"chunk long, ids array<{kind.simpleString()}>, held_out array<boolean>, sizes array<int>, tokens binary, words array<string>, counts array<long>")


def fit(counted: DataFrame, vocabulary: Vocabulary, rounds: int = 3, prior_words: float = 20.0) -> np.ndarray:
    """Log probabilities of the pieces by expectation-maximisation over all training words (word, count), each as often as it
    occurs. The prior weighs as prior_words words."""
    prob = vocabulary.prior
    for _ in range(rounds):
        held = counted.sparkSession.sparkContext.broadcast((vocabulary, np.log(prob)))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, log_prob = held.value  # noqa: B023
            total = np.zeros(len(log_prob))
            for batch in gathered(batches, "word"):
                texts, count = parts(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
                for own, lattice in lattices(v, log_prob, texts):
                    total += lattice.expected(count[own])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        # As many rows as pieces at most.
        uses = np.zeros(len(prob))
        for r in counted.where("count > 0").select("word", "count").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.piece] = r.uses
        prob = np.empty_like(uses)
        for part in (vocabulary.first, ~vocabulary.first):
            prob[part] = uses[part] + prior_words * vocabulary.prior[part]
            prob[part] /= prob[part].sum()
        held.unpersist()
    return np.log(prob)


def score(docs: DataFrame, held_out: Column, vocabulary_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document; those that are
    held out aren't learned from."""
    spark: SparkSession = docs.sparkSession
    vocabulary = read_vocabulary(vocabulary_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(held_out, F.lit(False))
    chunks = store.materialize(_chunks(docs.select("doc_id", "text", held_out.alias("held_out")), chunk_bytes), "lm-chunks")
    used = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    counted = store.materialize(used.groupBy("word").agg(F.sum("count").alias("count")), "lm-words")
    ends = chunks.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h))).alias("n")).first().n or 0
    c = F.col("count")
    seen = counted.where(c > 0).agg(F.count("*").alias("v"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
    total, distinct = seen.n + ends, seen.v + (ends > 0)
    held = spark.sparkContext.broadcast((vocabulary, fit(counted, vocabulary)))
    # A text goes on with another word, or ends: from the training texts' numbers of words.
    goes_on, stops = np.log((seen.n + 0.5) / (total + 1.0)), np.log10((ends + 0.5) / (total + 1.0))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, log_prob = held.value
        for batch in gathered(batches, "word"):
            spelled = (marginals(v, log_prob, batch.column(0)) + goes_on) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spelled)], ["word", "count", "log_prob"])

    rated = counted.mapInArrow(rate, "word string, count long, log_prob double")
    back = used.select("chunk", "at", "word").join(rated, "word").select("chunk", "at", "count", "log_prob")

    def put_together(t: pa.Table, w: pa.Table) -> pa.Table:
        count, log_prob = np.zeros(w.num_rows, np.int64), np.zeros(w.num_rows)
        at = w["at"].to_numpy()
        count[at], log_prob[at] = w["count"].to_numpy(), w["log_prob"].to_numpy()
        base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        ids, out, sizes = t["ids"].combine_chunks().flatten(), t["held_out"].combine_chunks().flatten(), t["sizes"].combine_chunks().flatten().to_numpy()
        token = unpacked(t["tokens"][0].as_py(), int(sizes.sum()))
        doc = np.repeat(np.arange(len(sizes)), sizes)

        def sums(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x[token], len(sizes)) if len(token) else np.zeros(len(sizes))

        end_base = np.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
        known = sums(count > 0).astype(np.int64) + (ends > 0)
        return pa.table([ids, out, sizes.astype(np.int64) + 1, known, np.full(len(sizes), total), sums(base) + end_base, sums(log_prob) + stops], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = spark.read.schema(chunks.schema).parquet(chunks._stored_at)
    got = whole.select("chunk", "ids", "held_out", "sizes", "tokens").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(put_together, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return got
