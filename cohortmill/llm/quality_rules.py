"""Quality rules: counts of a text, and its divergence from what the languages of the corpus look like.

References are learned from every row that has a text and a language: per language the median share of each character class
over its texts (to 1 / 4096, then scaled to add up to 1; neither long texts nor a part of poor ones can set it), and the
shares of its `common` most frequent words (A-Z lower-cased, outer punctuation left off) with one more class for all other
words. Shares and 64-bit hashes of words are counted in each task and added up in Spark; only the medians' counts and the
first words of each language are collected.

A text is compared with the reference of each language and takes the nearest one, since labels of language are missing or
wrong here and there: Jensen-Shannon distance (base 2, square root, so 0 to 1) of its character classes and of its common
words. Short texts differ by chance, so each rule has a guard of length: below min_chars letters and marks (min_words words)
its distance isn't judged, and above that the threshold is limit + slack / sqrt(length), as chance differences shrink. A
text fails if a judged distance is above its threshold. Texts are read whole.

Defined results: null texts have no words, and every count of theirs is 0. Words are maximal runs of other characters than blank, tab and line ends
(0x09-0x0D); lines end at \\n alone. Rows repeat as often as in the input. Without any reference no
distance is judged (null), and nothing fails by it. Texts that are too short for a rule have distance null in it. Ties between languages go to the first
by name; ties between words to the smaller hash. More than max_languages languages are an error, since references are
broadcast. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm import store
from cohortmill.llm.text import Hashed, grams, slices, text_bytes, word_bounds

#: Byte classes: lower, upper, digit, bytes of other letters, stops and commas, symbols, other marks, blanks and line ends.
CLASSES = 8
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:'\"-?()"
#: Steps of the shares from which medians are taken.
STEPS = 4096
SHARES = (CLASSES - 1) * (STEPS + 1)
#: Distinct words that a task holds before it hands them on.
HELD_WORDS = 1 << 20


def _class_of() -> np.ndarray:
    out = np.full(256, 6, np.int8)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    out[list(STOPS)], out[list(SYMBOLS)] = 4, 5
    out[:33] = 7
    return out


_CLASS = _class_of()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Bytes that don't begin a code point.
_INNER = (np.arange(256) & 0xC0) == 0x80


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes; hashes of the common words (sorted) and their shares, the others' last."""

    languages: list[str]
    classes: np.ndarray
    words: list[np.ndarray]
    shares: list[np.ndarray]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the distances (limit + slack / sqrt(length)), and the lengths below which they aren't judged. The
    defaults are set by labelled rows: 7 of 3243 good and 285 of 291 poor texts that pass the base rules fail them."""

    class_limit: float = 0.12
    class_slack: float = 2.0
    word_limit: float = 0.1
    word_slack: float = 3.0
    min_chars: int = 200
    min_words: int = 50
    least_words: int = 50
    most_repeated: int = 50


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def class_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """texts x CLASSES: bytes of each class, without blanks and without inner bytes of code points."""
    out = np.zeros((len(off) - 1, CLASSES - 1), np.int64)
    kinds = np.where(_INNER[data], 7, _CLASS[data]) if len(data) else np.zeros(0, np.int8)
    for k in range(CLASSES - 1):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kinds == k, out=sums[1:])
        out[:, k] = sums[off[1:]] - sums[off[:-1]]
    return out


def plain_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word, A-Z lower-cased, without the ASCII punctuation around it; words of nothing else are left out."""
    letters = np.zeros(256, bool)
    letters[np.isin(_CLASS, (0, 1, 2, 3))] = True
    start, end, doc = word_bounds(data, off)
    if not len(start):
        return np.zeros(0, np.uint64), doc
    # The first letter from a word's begin on, and the last one before its end.
    place = np.flatnonzero(letters[data])
    if not len(place):
        return np.zeros(0, np.uint64), doc[:0]
    after, before = np.searchsorted(place, start), np.searchsorted(place, end) - 1
    keep = after <= before
    start, end = place[after[keep]], place[before[keep]] + 1
    return Hashed(data).of(start, end), doc[keep]


def rule_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(off) - 1
    start, end, doc = word_bounds(data, off)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_INNER[data], out=chars[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_IS_SYMBOL[data], out=symbols[1:])
    hashed = Hashed(data, fold=False)
    out = {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": _sums(chars[end] - chars[start], doc, n),
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
    }
    # Lines: from each text's begin or a \n to the next \n or the text's end.
    ends = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], ends + 1]))
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(off, ends, side="right") - 1]))
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    line_end = np.where(last, off[line_doc + 1], np.append(line_start[1:], 0) - 1)
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    a, b, of = line_start[with_word], line_end[with_word], line_doc[with_word]
    out["n_dup_lines"] = np.bincount(of[_repeats(hashed.of(a, b), of)[1]], minlength=n).astype(np.int64)
    # Words in windows of three that stand in the text more than once.
    h, at = grams(hashed.of(start, end), doc, 3)
    again = at[_repeats(h, doc[at])[0]]
    covered = np.zeros(len(start) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, np.minimum(again + 3, len(start)), -1)
    inside = np.cumsum(covered)[: len(start)] > 0
    out["n_repeat_words"] = np.bincount(doc[inside], minlength=n).astype(np.int64)
    return out


def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: equal to another of the same text; equal to an earlier one."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    either, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order] = same
    either[order] = same | np.append(same[1:], False)
    return either, later


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p (shares) to q, base 2."""
    m = (p + q) / 2

    def toward(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0).sum(-1)

    return np.sqrt(np.clip((toward(p) + toward(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def learn_references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = 64, max_languages: int = 400) -> References:
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        room = 0
        for batch in slices(batches):
            data, off = text_bytes(batch.column(0))
            codes, of = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            classes = class_counts(data, off)
            size = classes.sum(1)
            step = (2 * STEPS * classes + size[:, None]) // np.maximum(2 * size, 1)[:, None]
            for k, code in enumerate(codes):
                # Steps of shares are negative numbers in the place of words' hashes.
                at, n = np.unique(step[(of == k) & (size > 0)] + np.arange(CLASSES - 1) * (STEPS + 1), return_counts=True)
                held.setdefault(code, []).append((at - SHARES, n))
            h, doc = plain_words(data, off)
            for k, code in enumerate(codes):
                word, n = np.unique(h[of[doc] == k] >> np.uint64(1), return_counts=True)
                held[code].append((word.astype(np.int64), n))
                room += len(word)
            if room > HELD_WORDS:
                yield from (_merged(code, parts) for code, parts in held.items())
                held, room = {}, 0
        yield from (_merged(code, parts) for code, parts in held.items())

    counts = rows.mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    # Written once: three questions are asked of the counts, and the texts are read for one.
    counts = store.materialize(counts, "rule-counts")
    # One row for each word of a language; the first of them, the classes, and the sum over all words are kept.
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = counts.where("word >= 0")
    top = words.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= common).drop("_r")
    total = words.groupBy("lang").agg(F.lit(-SHARES - 1).cast("long").alias("word"), F.sum("n").cast("decimal(38,0)").alias("n"))
    # The step that holds a class's median text: the first up to which half the texts lie.
    steps = counts.where("word < 0").withColumn("class", F.expr(f"(word + {SHARES}) DIV {STEPS + 1}"))
    by = Window.partitionBy("lang", "class")
    steps = steps.withColumn("upto", F.sum("n").over(by.orderBy("word"))).withColumn("all", F.sum("n").over(by))
    middle = steps.where("2 * upto >= all AND 2 * (upto - n) < all").select("lang", "word", "n")
    got = top.unionByName(middle).unionByName(total).limit(max_languages * (common + CLASSES) + 1).collect()
    store.drop(counts)
    names = sorted({r.lang for r in got})
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages, classes, hashes, shares = [], [], [], []
    for name in names:
        n = {r.word: int(r.n) for r in got if r.lang == name}
        c = np.zeros(CLASSES - 1)
        for at in (k + SHARES for k in n if -SHARES <= k < 0):
            c[at // (STEPS + 1)] = at % (STEPS + 1)
        if not c.sum():
            continue
        languages.append(name)
        classes.append(c / c.sum())
        own = np.array(sorted(k for k in n if k >= 0), np.int64)
        share = np.array([n[k] for k in own.tolist()], float) / max(1, n.get(-SHARES - 1, 0))
        hashes.append(own)
        shares.append(np.append(share, max(0.0, 1 - share.sum())))
    return References(languages, np.array(classes).reshape(len(languages), CLASSES - 1), hashes, shares)


def _merged(code: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    word, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(word, kind="stable")
    word, n = word[order], n[order]
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, int)
    return pa.RecordBatch.from_arrays([pa.array([code] * len(head), pa.string()), pa.array(word[head], pa.int64()), pa.array(np.add.reduceat(n, head) if len(head) else n, pa.int64())], ["lang", "word", "n"])


def distances(data: np.ndarray, off: np.ndarray, references: References, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the nearest language (-1 without references), the distances of classes and words to it (nan where a rule
    isn't judged), and whether one of them is too large."""
    n = len(off) - 1
    classes = class_counts(data, off)
    size = classes.sum(1)
    h, doc = plain_words(data, off)
    h = (h >> np.uint64(1)).astype(np.int64)
    words = np.bincount(doc, minlength=n)
    best, by_class, by_word = np.full(n, -1), np.full(n, np.nan), np.full(n, np.nan)
    nearest = np.full(n, np.inf)
    p = classes / np.maximum(size, 1)[:, None]
    for k in range(len(references.languages)):
        own, share = references.words[k], references.shares[k]
        at = np.searchsorted(own, h)
        hit = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == h) if len(own) else np.zeros(len(h), bool)
        slot = np.where(hit, at, len(own))
        q = np.bincount(doc * (len(own) + 1) + slot, minlength=n * (len(own) + 1)).reshape(n, -1) / np.maximum(words, 1)[:, None]
        c, w = js_distance(p, references.classes[k]), js_distance(q, share)
        # Words tell languages apart; characters where there are no words to judge.
        closer = np.where(words > 0, w, c) + c / 1e6
        take = closer < nearest
        nearest[take], best[take], by_class[take], by_word[take] = closer[take], k, c[take], w[take]
    by_class[size < rules.min_chars] = np.nan
    by_word[words < rules.min_words] = np.nan
    far = by_class > rules.class_limit + rules.class_slack / np.sqrt(np.maximum(size, 1))
    far |= by_word > rules.word_limit + rules.word_slack / np.sqrt(np.maximum(words, 1))
    return best, by_class, by_word, far


def judge(docs: DataFrame, references: References, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, base_failed, nearest (language), class_distance, word_distance, kept."""
    held = docs.sparkSession.sparkContext.broadcast(references)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*held.value.languages, None], object)
        for batch in slices(batches):
            data, off = text_bytes(batch.column(1))
            c = rule_counts(data, off)
            best, by_class, by_word, far = distances(data, off, held.value, rules)
            failed = (c["n_words"] < rules.least_words) | (100 * c["n_repeat_words"] > rules.most_repeated * c["n_words"])
            distance = [pa.array(x, mask=np.isnan(x)) for x in (by_class, by_word)]
            arrays = [batch.column(0), *(pa.array(c[k]) for k in counted), pa.array(failed), pa.array(names[best], pa.string()), *distance, pa.array(~failed & ~far)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *counted, "base_failed", "nearest", "class_distance", "word_distance", "kept"])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counted)}, base_failed boolean, nearest string, class_distance double, word_distance double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
