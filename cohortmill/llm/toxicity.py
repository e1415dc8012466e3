"""Toxicity: Levenshtein automata intersected with a lexicon trie, and the context of each match.

The lexicon is learned from labelled rows (terms whose share of toxic documents is significantly above the rest), joined
with a short general list. A word matches a term within 1 edit if the term has 5 letters or more, within 2 if it is a general term of
8 letters or more, after folding look-alikes (0 for o, $ for s ...). Learned terms are many and lie close to each other and to
clean words, so they stay at 1. An edit puts in, leaves out or changes a letter, or swaps two
neighbours. Words come from whole texts. A word within k edits of a term agrees with it once up to k letters are left out
of each; for k = 1 it also begins with the term's first half or ends with its second (pigeonhole, one letter between the
halves, which a swap may touch). Hashes of such parts and rests sort out nearly all words first, and lose none. The
automaton of each remaining distinct word then runs over the trie, once per task.

A word near a term may be a word of its own ("generate" beside "degenerate"): words that stand in `least_clean` clean
documents of the sample or more, and aren't much more frequent in toxic ones, match no term at two edits.

Each match has a context window: inside quotation marks, or beside a word that reports speech, it counts as quoted;
beside a word of address ("you") as aimed. A logistic regression over sums of matches (exact, misspelled, quoted, aimed,
and for the text's length) gives the score.

Learned terms have `letters` (3 to 40) letters; with max_terms only the heaviest of them stay (by default all do: the sample
bounds them). Words end at ASCII marks, general punctuation (dashes, curly quotes, ellipses) and guillemets.

The models are fitted on a sample of at most `max_per_class` labelled rows of each class, the smallest hashes of their
ids: this bound is a parameter. For the regression each half of the sample is read with the lexicon of the other half.

Defined results: null and empty texts score as a text without matches. Without both classes in the sample the score is
the share of toxic rows (0.5 with no rows). Rows repeat as often as in the input; other columns are neither read nor
returned. A document with several labels is toxic if one of them says so; null labels are left out.
Documents that repeat an id are learned from once, with the first of their texts in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm import store
from cohortmill.llm.text import Hashed, mix, slices, text_bytes, word_bounds

#: General terms of abuse; what the labels don't show is still caught. Fixed values.
GENERAL_TERMS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "bastard", "asshole", "bitch", "retard", "vermin", "filth", "dumbass", "scumbag", "degenerate"]
#: Words of address and of reported speech, and marks of quotation. Fixed values.
ADDRESS = ["you", "your", "youre", "yourself", "du", "dich", "dein", "ihr", "tu", "toi", "ton", "vous", "usted", "eres", "tú", "te"]
REPORT = ["said", "says", "called", "calls", "quote", "quoted", "quotes", "wrote", "word", "term", "sagte", "nannte", "wort", "dit", "appelé", "mot", "dijo", "llamó", "palabra"]
WINDOW = 5
GENERAL_WEIGHT = 4.0
#: Log odds from which on a word counts as one of toxic documents.
LEAST_WEIGHT = 1.5
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_APART = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
N_FEATURES = 7


def fold_word(word: str) -> str:
    return "".join(_LEET.get(c, c) for c in word.lower())


def _fold_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for a, b in _LEET.items():
        out[ord(a)] = ord(b)
    return out


_FOLD = _fold_bytes()


#: General terms of this many letters or more are reached within two edits.
LONG = 8
#: Rejected words that a task remembers.
REMEMBERED = 1 << 18


def reach(term: str) -> int:
    """Edits within which a word matches a term that isn't loose."""
    return 0 if len(term) < 5 else 1


class LevenshteinAutomaton:
    """Accepts the strings within k edits of a word. A state holds (place in the word, edits so far), the smaller edits only.
    The place ~i stands for the first half of a swap: letter i + 1 was read, and letter i must come next."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def closed(self, state: dict[int, int]) -> dict[int, int]:
        """With what skipping letters of the word reaches."""
        for i in sorted(x for x in state if x >= 0):
            e = state[i]
            for j in range(i + 1, min(len(self.word), i + self.k - e) + 1):
                if state.get(j, self.k + 1) > e + j - i:
                    state[j] = e + j - i
        return state

    def start(self) -> dict[int, int]:
        return self.closed({0: 0})

    def step(self, state: dict[int, int], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, e in state.items():
            if i < 0:
                if self.word[~i] == letter and e < out.get(~i + 2, self.k + 1):
                    out[~i + 2] = e
                continue
            if i + 1 < len(self.word) and e < self.k and self.word[i + 1] == letter:
                out[~i] = e + 1
            if i < len(self.word):
                cost = e + (self.word[i] != letter)
                if cost <= self.k and cost < out.get(i + 1, self.k + 1):
                    out[i + 1] = cost
            if e + 1 <= self.k and e + 1 < out.get(i, self.k + 1):
                out[i] = e + 1
        return self.closed(out)

    def distance(self, state: dict[int, int]) -> int | None:
        return state.get(len(self.word))


class Trie:
    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        for t, word in enumerate(terms):
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                at = self.next[at][c]
            self.term[at] = t

    def within(self, word: str, k: int) -> list[tuple[int, int]]:
        """(edits, term) of all terms within k edits of the word, the trie and the automaton walked side by side."""
        automaton = LevenshteinAutomaton(word, k)
        found, todo = [], [(0, automaton.start())]
        while todo:
            at, state = todo.pop()
            if self.term[at] >= 0 and (d := automaton.distance(state)) is not None:
                found.append((d, self.term[at]))
            for c, to in self.next[at].items():
                if after := automaton.step(state, c):
                    todo.append((to, after))
        return sorted(found)


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return np.sort(Hashed(np.frombuffer(b"".join(raw), np.uint8)).of(end - np.array([len(w) for w in raw], np.int64), end))


def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def _left_out(hashed: Hashed, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of words of one length without k (1 or 2) of their letters, a row for each word. at: where each letter
    begins and, last, where the word ends."""
    s, inverse, begin = hashed.sums, hashed.inverse, at[:, :1]
    letters = at.shape[1] - 1
    if k == 1:
        p, q = at[:, :-1], at[:, 1:]
        return mix((s[p] - s[begin]) * inverse[begin] + (s[at[:, -1:]] - s[q]) * inverse[begin + q - p])
    i, j = np.triu_indices(letters, 1)
    p, q, x, y = at[:, i], at[:, i + 1], at[:, j], at[:, j + 1]
    gone = q - p
    return mix((s[p] - s[begin]) * inverse[begin] + (s[x] - s[q]) * inverse[begin + gone] + (s[at[:, -1:]] - s[y]) * inverse[begin + gone + y - x])


def _without(term: str, k: int) -> set[str]:
    """The term without up to k of its letters."""
    out = last = {term}
    for _ in range(k):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


@dataclass
class Lexicon:
    terms: list[str]
    weights: list[float]
    #: Words that are never taken for a loose term with two slips.
    spared: frozenset[str] = frozenset()
    #: Terms that are reached within two edits.
    loose: frozenset[str] = frozenset()
    trie: Trie = field(init=False, repr=False)

    def __post_init__(self):
        self.trie = Trie(self.terms)
        self.loose = self.loose & frozenset(self.terms)
        at = [t for t, term in enumerate(self.terms) if term in self.loose]
        self.loose_trie, self.loose_at = Trie([self.terms[t] for t in at]), at
        parts: dict[tuple[str, int], set[int]] = {}

        def put(kind: str, part: bytes, size: int):
            h = int(Hashed(np.frombuffer(part, np.uint8)).of(np.array([0]), np.array([len(part)]))[0])
            # A letter has up to four bytes.
            parts.setdefault((kind, len(part)), set()).update((h + n) % 2**64 for n in range(max(1, size - 4), size + 5))

        for term in self.terms:
            if reach(term):
                b, cut = term.encode(), (len(term) + 1) // 2
                put("head", term[: cut - 1].encode(), len(b))
                put("tail", term[cut:].encode(), len(b))
        self.keys = {k: np.array(sorted(v), np.uint64) for k, v in parts.items()}
        self.exact = _word_hashes(self.terms)
        self.near = _word_hashes(sorted(set().union(*(_without(t, 1) for t in self.terms if reach(t)))))
        self.far = _word_hashes(sorted(set().union(*(_without(t, 2) for t in self.loose))))
        self.shortest, self.longest = min(map(len, self.loose), default=0), max(map(len, self.loose), default=0)
        self.rejected = np.zeros(0, np.uint64)
        self.cache: dict[int, tuple[int, int] | None] = {}

    def candidates(self, data: np.ndarray, hashed: Hashed, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Indices of the words (distinct, in order of their hashes) that are a term or may be in reach of one."""
        out = _among(h, self.exact)
        new = np.flatnonzero(~out & ~_among(h, self.rejected))
        a, b, size = start[new], end[new], end[new] - start[new]
        half = np.zeros(len(new), bool)
        for (kind, n), keys in self.keys.items():
            fits = np.flatnonzero((size >= n) & ~half)
            begin = a[fits] if kind == "head" else b[fits] - n
            half[fits[_among(hashed.of(begin, begin + n) + size[fits].astype(np.uint64), keys)]] = True
        lead = (data & 0xC0) != 0x80
        upto, place = np.concatenate([[0], np.cumsum(lead)]), np.flatnonzero(lead)
        letters = upto[b] - upto[a]
        far = (letters >= self.shortest - 2) & (letters <= self.longest + 2) if self.loose else np.zeros(len(new), bool)
        near = np.zeros(len(new), bool)
        near[half] = _among(h[new[half]], self.near)
        near[far] |= _among(h[new[far]], self.far)
        for n in np.unique(letters[half | far]):
            own = np.flatnonzero((letters == n) & (half | far) & ~near)
            step = max(1, (1 << 19) // (n * n))
            for i in range(0, len(own), step):
                w = own[i : i + step]
                at = np.concatenate([place[upto[a[w]][:, None] + np.arange(n)], b[w][:, None]], 1)
                one = _left_out(hashed, at, 1)
                near[w] = (half[w] & _among(one.ravel(), self.near).reshape(one.shape).any(1)) | (far[w] & _among(one.ravel(), self.far).reshape(one.shape).any(1))
                w, at = w[far[w] & ~near[w]], at[far[w] & ~near[w]]
                if len(w) and n >= 2:
                    two = _left_out(hashed, at, 2)
                    near[w] = _among(two.ravel(), self.far).reshape(two.shape).any(1)
        out[new[near]] = True
        rejected = h[new[~near]]
        if len(self.rejected) + len(rejected) > REMEMBERED:
            self.rejected = rejected[:REMEMBERED]
        else:
            self.rejected = np.sort(np.concatenate([self.rejected, rejected]), kind="stable")
        return np.flatnonzero(out)

    def matches(self, words: list[str]) -> list[bool]:
        """Whether each word is in reach of a term."""
        distinct = sorted(set(words) - {""})
        size = np.array([len(w.encode()) for w in distinct], np.int64)
        data, end = np.frombuffer("".join(distinct).encode(), np.uint8), np.cumsum(size)
        hashed = Hashed(data)
        h = hashed.of(end - size, end)
        order = np.argsort(h)
        near = order[self.candidates(data, hashed, (end - size)[order], end[order], h[order])]
        found = {distinct[i] for i in near if self.match(distinct[i]) is not None}
        return [w in found for w in words]

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term in reach; ties go to the heavier, then to the first."""
        most = 1 if len(word) > 3 else 0
        found = [(d, t) for d, t in self.trie.within(word, most) if d <= reach(self.terms[t])]
        if word not in self.spared and self.shortest - 2 <= len(word) <= self.longest + 2:
            found += [(d, self.loose_at[t]) for d, t in self.loose_trie.within(word, 2)]
        near = [(d, -self.weights[t], t) for d, t in found]
        return (min(near)[2], min(near)[0]) if near else None


_LATIN_MARKS = np.array([0xA0, 0xA1, 0xAB, 0xBB, 0xBF], np.uint8)


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes, and where words end: @ and $ belong to a word only between two letters."""
    apart = _APART[data]
    sign = np.flatnonzero((data == 64) | (data == 36))
    sign = sign[(sign > 0) & (sign < len(data) - 1)]
    sign = sign[~apart[sign - 1] & ~apart[sign + 1]]
    apart[sign] = False
    # Punctuation of two and three bytes: U+2000 to U+203F (E2 80), and guillemets, inverted marks and fixed blanks (C2).
    wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, int)
    apart[wide[:, None] + np.arange(3)] = True
    pair = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], _LATIN_MARKS)) if len(data) > 1 else np.zeros(0, int)
    apart[pair[:, None] + np.arange(2)] = True
    return _FOLD[data], apart


_ADDRESS, _REPORT = _word_hashes(ADDRESS), _word_hashes(REPORT)


def _places(raw: bytes, mark: str) -> np.ndarray:
    """Where the mark stands, in order."""
    mark, out, at = mark.encode(), [], 0
    while (at := raw.find(mark, at)) >= 0:
        out.append(at)
        at += 1
    return np.array(out, np.int64)


def _quoted(data: np.ndarray, off: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each place lies between quotation marks of one line: after an odd number of plain ones, or after an opening
    one that isn't closed yet, with a closing one behind. Marks are found once, so a line with many matches costs no more."""
    raw = data.tobytes()
    ends = np.concatenate([[-1], _places(raw, "\n"), [len(raw)]])
    line = np.searchsorted(ends, at, side="left")
    low, high = np.maximum(ends[line - 1] + 1, off[doc]), np.minimum(ends[line], off[doc + 1])
    plain = _places(raw, '"')
    before = np.searchsorted(plain, at) - np.searchsorted(plain, low)
    out = (before % 2 == 1) & (np.searchsorted(plain, high) > np.searchsorted(plain, at))
    for opening, closing in ("“”", "„“", "«»", "‹›"):
        x, y = _places(raw, opening), _places(raw, closing)
        if not len(x) or not len(y):
            continue
        last = lambda p: np.where((i := np.searchsorted(p, at)) > 0, p[np.maximum(i - 1, 0)], -1)
        opened, closed, behind = last(x), last(y), np.searchsorted(y, at)
        here = (behind < len(y)) & (y[np.minimum(behind, len(y) - 1)] < high)
        out |= (opened >= low) & ((closed < low) | (opened > closed)) & here
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, list[list[tuple[int, int, int, bool, bool]]]]:
    """Per text the features of the regression, and its matches: (byte, term, edits, quoted, aimed)."""
    raw, off = text_bytes(texts)
    data, apart = _folded(raw)
    # word_bounds takes a table by byte value: mark the bytes that are apart with one of their own.
    marked = np.where(apart, np.uint8(0), np.maximum(data, 1)).astype(np.uint8)
    table = np.zeros(256, bool)
    table[0] = True
    start, end, doc = word_bounds(marked, off, table)
    hashed = Hashed(data)
    h = hashed.of(start, end)
    distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
    hit = np.full(len(distinct), -1)
    edits = np.zeros(len(distinct), int)
    for i in lexicon.candidates(data, hashed, start[first], end[first], distinct):
        key = int(distinct[i])
        if key not in lexicon.cache:
            if len(lexicon.cache) > 200_000:
                lexicon.cache.clear()
            word = data[start[first[i]] : end[first[i]]].tobytes().decode("utf-8", "replace").lower()
            lexicon.cache[key] = lexicon.match(word) if len(word) < 64 else None
        if (m := lexicon.cache[key]) is not None:
            hit[i], edits[i] = m
    out = np.zeros((len(texts), N_FEATURES))
    spans: list[list[tuple[int, int, int, bool, bool]]] = [[] for _ in range(len(texts))]
    at = np.flatnonzero(hit[back] >= 0) if len(back) else np.zeros(0, int)
    if len(at):
        near = np.clip(at[:, None] + np.arange(-WINDOW, WINDOW + 1), 0, len(h) - 1)
        same = doc[near] == doc[at][:, None]
        aimed = (np.isin(h[near], _ADDRESS) & same).any(1)
        quoted = _quoted(raw, off, start[at], doc[at]) | (np.isin(h[near], _REPORT) & same).any(1)
        term, d = hit[back[at]], edits[back[at]]
        w, of = np.array(lexicon.weights)[term], doc[at]
        add = lambda sel: np.bincount(of[sel], w[sel], minlength=len(texts))
        plain = ~quoted
        out[:, 0], out[:, 1] = np.log1p(add(plain & (d == 0))), np.log1p(add(plain & (d > 0)))
        out[:, 2], out[:, 3] = np.log1p(add(quoted)), np.log1p(add(plain & aimed))
        np.maximum.at(out[:, 4], of[plain], w[plain])
        out[:, 5] = add(plain) / np.sqrt(1 + np.bincount(doc, minlength=len(texts)))
        for p, t, e, q, a, i in zip(start[at] - off[of], term, d, quoted, aimed, of):
            spans[i].append((int(p), int(t), int(e), bool(q), bool(a)))
    out[:, 6] = np.log1p(np.bincount(doc, minlength=len(texts))) / 10
    return out, spans


def learn_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, least_z: float = 3.5, least_weight: float = LEAST_WEIGHT, max_terms: int | None = None) -> Lexicon:
    """counts: term, toxic and clean documents with it. A term enters if its share of toxic documents is above the
    sample's by least_z standard errors and its log odds are least_weight or more; the weight is the log odds."""
    share = toxic / max(1, toxic + clean)
    found = {t: GENERAL_WEIGHT for t in GENERAL_TERMS}
    learned = []
    for term, a, b in counts:
        expected = (a + b) * share
        weight = _weight(a, b, toxic, clean)
        if weight >= least_weight and (a - expected) >= least_z * np.sqrt(expected * (1 - share) + 1e-9):
            learned.append((float(weight), fold_word(term)))
    for weight, term in sorted(learned, key=lambda x: (-x[0], x[1]))[:max_terms]:
        found[term] = max(weight, found.get(term, 0.0) if term not in GENERAL_TERMS else weight)
    return Lexicon(list(found), list(found.values()), loose=frozenset(t for t in GENERAL_TERMS if len(t) >= LONG))


def _weight(a: int, b: int, toxic: int, clean: int) -> float:
    """Log odds of a word in a toxic and b clean documents."""
    return float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))


def _near_words(counted: DataFrame, lexicon: Lexicon, least_clean: int) -> list[tuple[str, int, int, int, int]]:
    """Of the counted words of least_clean clean documents or more, those that may be in reach of a term."""
    held = counted.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.matches([fold_word(w) for w in batch.column(0).to_pylist()]), pa.bool_()))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema)
    return [tuple(r) for r in counted.where(F.col("n00") + F.col("n10") >= least_clean).mapInArrow(run, kind).collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept; Newton steps with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    """both: labels of both classes were there to learn from; without them a score says nothing about a text."""

    lexicon: Lexicon
    weights: np.ndarray
    both: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int) -> DataFrame:
    """doc_id, text, y, half: of each class the max_per_class labelled documents with the smallest hashes of their ids."""
    y = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    known = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(17)))
    # Two top-n selections of fixed size, so this side of the join is bounded by 2 * max_per_class ids.
    chosen = known.where("y = 1").orderBy("h", "doc_id").limit(max_per_class).unionByName(known.where("y = 0").orderBy("h", "doc_id").limit(max_per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y", "h").agg(F.min("text").alias("text")).select("doc_id", "text", "y", F.pmod(F.shiftright("h", 7), F.lit(2)).cast("int").alias("half"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = 4000, letters: tuple[int, int] = (3, 40), least_clean: int = 2) -> ToxicityModel:
    sample = store.materialize(bounded_sample(docs, labels, label, max_per_class), "toxic-sample")
    size = {(r.half, r.y): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    words = sample.select("half", "y", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("term")).where(F.length("term").between(*letters))
    counted = words.groupBy("term").agg(*(F.count(F.when((F.col("half") == h) & (F.col("y") == y), 1)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)))
    # Bounded like the sample; terms of two toxic documents at least can enter.
    counts = [tuple(r) for r in counted.where("n01 + n11 >= 2 AND n01 + n11 > (n00 + n10) / 4").collect()]
    n = {k: size.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    totals = [(n[0, 1] + n[1, 1], n[0, 0] + n[1, 0]), (n[1, 1], n[1, 0]), (n[0, 1], n[0, 0])]
    # Counts of a word over the whole sample, its second half and its first.
    split = [lambda a, b, c, d: (b + d, a + c), lambda a, b, c, d: (d, c), lambda a, b, c, d: (b, a)]
    whole, *other = (learn_lexicon([(t, *of(*r)) for t, *r in counts], *size) for of, size in zip(split, totals))
    loose = sorted(whole.loose)
    close = _near_words(counted, Lexicon(loose, [1.0] * len(loose), loose=whole.loose), least_clean)
    for lexicon, of, size in zip((whole, *other), split, totals):
        usual = [(t, *of(*r)) for t, *r in close]
        lexicon.spared = frozenset(fold_word(t) for t, a, b in usual if b >= least_clean and _weight(a, b, *size) < LEAST_WEIGHT)
    if not (n[0, 1] + n[1, 1]) or not (n[0, 0] + n[1, 0]):
        total = sum(n.values())
        share = (n[0, 1] + n[1, 1]) / total if total else 0.5
        return ToxicityModel(whole, np.append(np.zeros(N_FEATURES), np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))), both=False)
    held = docs.sparkSession.sparkContext.broadcast(other)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            halves = np.array(batch.column(1).to_pylist())
            x = np.where((halves == 0)[:, None], *(features(batch.column(0), lexicon)[0] for lexicon in held.value))
            yield pa.RecordBatch.from_pydict({"y": batch.column(2), "x": x.tolist()}, schema=pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))]))

    got = sample.select("text", "half", "y").mapInArrow(read, "y int, x array<double>").toPandas()
    store.drop(sample)
    return ToxicityModel(whole, fit_logistic(np.stack(got.x.to_numpy()), got.y.to_numpy(float)))


def score(docs: DataFrame, model: ToxicityModel, spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, matches: begin (code points), term, edits, quoted, aimed."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = pa.list_(pa.struct([("begin", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("aimed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches):
            x, found = features(batch.column(1), model.lexicon)
            columns = {"doc_id": batch.column(0), "score": pa.array(model.score(x))}
            if spans:
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                rows = [[{"begin": len(t[:p].decode("utf-8", "ignore")), "term": model.lexicon.terms[k], "edits": e, "quoted": q, "aimed": a} for p, k, e, q, a in got] for t, got in zip(texts, found)]
                columns["matches"] = pa.array(rows, made)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    more = ", matches array<struct<begin:long,term:string,edits:int,quoted:boolean,aimed:boolean>>" if spans else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double{more}")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; all of them where the model had no labels of both classes."""
    if not model.both:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, _ = features(batch.column(batch.schema.get_field_index("text")), held.value.lexicon)
            yield batch.filter(pa.array(held.value.score(x) < threshold))

    return docs.mapInArrow(keep, docs.schema)
