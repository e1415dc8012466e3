"""Secret scans: three base patterns, and candidates that zstandard can't shrink given what surrounds them.

A candidate is a run of 12 or more secret-like characters, with a letter and a digit or with both cases, that follows a
sensitive word within `reach` characters, or such a run that directly follows another candidate on the next line. It is
taken whole, whatever its length. Its novelty is what it adds to the compressed size when the compressor is
primed with common identifiers, the text around the candidate and nothing else: strings that recur nearby, words, names
and paths cost little, keys cost nearly all of their entropy. The identifiers are the commonest names of the corpus (learn_identifiers) after a fixed list. Candidates of at least `least_ratio` marginal bytes per
byte are reported as kind `novel`, unless a base span covers some of it.

The base patterns (assign, access, hex) are fixed. Every text is scanned whole; a scan over bytes finds the texts that
can hold any match at all, so that the patterns run on these alone.

Defined results: a null text is empty; texts without matches have no spans. Spans count code points, the end excluded,
and come by start, then kind in the order assign, access, hex, novel. Rows repeat as often as in the input; other columns
are neither read nor returned.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.text import slices, text_bytes

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns, as the contract fixes them.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs of 16+ are just the matches of [0-9a-f]+ of that length
#: Words that make what follows sensitive.
_SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authorization|bearer|AKIA", re.IGNORECASE | re.ASCII)
_HINTS = (b"passw", b"passphrase", b"secret", b"token", b"key", b"credential", b"authorization", b"bearer", b"akia")
_SHORTEST = 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]{12,}")
#: What may stand between a candidate and its next line: quotes, joining signs, blanks, a line end (also written as \\n).
_NEXT_LINE = re.compile(r"""[ \t"',;\\]*(?:\r?\n|\\n)[ \t"']*""")
#: What code and configuration say around secrets; primes the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret authorization bearer credential username user_name database connection_string "
    "https://www. http:// .com/ .org/ localhost 127.0.0.1 example.com config settings environment production development default true false null none return function class import export const string "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 your_password_here changeme placeholder xxxxxxxxxxxxxxxx ****************"
)
_HEX_BYTE = np.array([48 <= c <= 57 or 97 <= c <= 102 for c in range(256)])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order. A span of kind assign is the whole match."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def novelty(candidate: bytes, around: bytes, identifiers: bytes, level: int = 3) -> int:
    """Compressed bytes of the candidate beyond an empty frame's, primed with identifiers and surroundings."""
    primed = zstandard.ZstdCompressionDict(identifiers + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    tool = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(tool.compress(candidate)) - len(tool.compress(b""))


def candidates(text: str, at: int, reach: int, seen: set[int]) -> Iterator[re.Match]:
    """Candidates that begin within reach of a place, each with the candidate lines that directly follow it. seen: where
    those that were given before begin; what follows them was given too."""
    near = at + reach
    while m := _CANDIDATE.search(text, at, near + _SHORTEST):
        a = m.start()
        # The letter of a written line end or tab isn't part of what follows it.
        m = _CANDIDATE.match(text, a + (text[max(0, a - 1) : a + 1] in ("\\n", "\\r", "\\t"))) or m
        at = m.end()
        while m and m.start() not in seen:
            seen.add(m.start())
            yield m
            at = m.end()
            m = (gap := _NEXT_LINE.match(text, at)) and _CANDIDATE.match(text, gap.end())


def novel_spans(text: str, taken: list[tuple[int, int, int]], identifiers: bytes, reach: int, window: int, least_ratio: float) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, marginal bytes) of what the base patterns leave."""
    found: dict[int, tuple[int, int, int, int]] = {}
    # Spans that are taken, merged, as sorted starts and ends.
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in taken:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    seen: set[int] = set()
    for word in _SENSITIVE.finditer(text):
        for m in candidates(text, word.end(), reach, seen):
            a, b = m.span()
            value = m.group()
            mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value) or value.lower() != value != value.upper() and not value[1:].islower()
            # The first span that ends behind a is the only one that can begin before b and overlap first.
            at = bisect_right(ends, a)
            if not mixed or (at < len(starts) and starts[at] < b):
                continue
            around = text[max(0, a - window) : a] + text[b : b + window]
            gain = novelty(value.encode(), around.encode("utf-8", "replace"), identifiers)
            if gain >= least_ratio * len(value.encode()):
                found[a] = (a, 3, b, gain)
                starts.insert(at, a)
                ends.insert(at, b)
    return sorted(found.values())


def learn_identifiers(docs: DataFrame, most: int = 512, fallback: str = IDENTIFIERS) -> str:
    """The primer: the `most` names (letters, digits, underscores; 3 to 40) that stand most often in all texts, the most
    frequent last, where the compressor reaches them best, after the fixed list."""
    names = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9_]+")).alias("name")).where(F.length("name").between(3, 40) & ~F.col("name").rlike("[0-9].*[0-9]"))
    top = names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most).collect()
    return " ".join([fallback, *(r.name for r in reversed(top))])


def scan(docs: DataFrame, identifiers: str = IDENTIFIERS, reach: int = 32, window: int = 512, least_ratio: float = 0.7) -> DataFrame:
    """doc_id and spans: array of (start, kind, end, novelty: marginal bytes, null for base kinds)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    primer = identifiers.encode()
    made = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("novelty", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = text_bytes(batch.column(1))
            wanted = np.zeros(batch.num_rows, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], _HEX_BYTE[data].astype(np.int8), [0]])))
            at = [edge[::2][np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= 16]]
            lower = data.tobytes().lower()
            for hint in _HINTS:
                p, places = lower.find(hint), []
                while p >= 0:
                    places.append(p)
                    p = lower.find(hint, p + len(hint))
                at.append(np.array(places, np.int64))
            wanted[np.searchsorted(off, np.concatenate(at), side="right") - 1] = True
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(wanted):
                text = batch.column(1)[int(i)].as_py() or ""
                base = base_spans(text)
                rows = sorted([(*s, None) for s in base] + novel_spans(text, base, primer, reach, window, least_ratio), key=lambda s: s[:2])
                spans[i] = [{"start": a, "kind": KINDS[k], "end": b, "novelty": n} for a, k, b, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, made)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:long,kind:string,end:long,novelty:long>>")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, sha256 of the base spans, and all spans as text."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter(spans, lambda s: s["kind"] != "novel"))
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), joined(spans).alias("spans"))
