"""Secret scan: three base patterns and a sliding-window Shannon entropy per character class.

A candidate string is a run of credential characters.  A window slides over it; the counts
of its characters and the entropy are kept up incrementally, each step being O(1).  The
threshold depends on the class of characters that the window holds.  Windows without a
digit have a threshold of their own, and must change case as often as compound words do
not.  An allow-list takes out candidates that look random but are not secret (numbers,
UUIDs, versions and dates, words in one case).

Defined cases: null text counts as empty and gives no span; repeated rows each get a row;
a null doc_id is kept; an empty table gives an empty result; spans count code points, the
end is exclusive; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, texts_of

KINDS = ("assign", "access", "hex", "entropy")
_RANK = {k: i for i, k in enumerate(KINDS)}

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_LEAST = 12
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters at least; the run is taken whole, so shorter ones just fail
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Candidate strings, the window, and the least entropy (bits a character) by class.
WINDOW = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
THRESHOLDS = {"hex": 2.6, "alnum": 3.5, "base64": 3.7, "letters": 3.8}
#: Changes between upper and lower case of adjoining letters in a window without a digit; random keys have about 9.5, compound words 6 or fewer.
LEAST_CHANGES = 7
ALLOWED = (
    re.compile(r"^[0-9]+$"),  # numbers
    re.compile(r"^(?:[a-z_/=+-]+|[A-Z_/=+-]+|[A-Z][a-z]+(?:[_/=+-][A-Z]?[a-z]*)*)$"),  # words, paths and snake case without a digit; no part of it can be read in two ways
    re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),  # UUIDs
    re.compile(r"^[A-Za-z]+[-_/][0-9./_-]+$"),  # a word with a version or date
    re.compile(r"^(?:[0-9]+[-/_])+[0-9]+$"),  # dates, phone and order numbers
)


@lru_cache(maxsize=8)
def _plogp(window: int) -> list[float]:
    """n log2 n for every count that a window meets; one more than its size while a character comes before another goes."""
    return [0.0] + [n * math.log2(n) for n in range(1, window + 2)]


#: Of each candidate character: is it a digit, upper, lower, a lower or an upper hexadecimal one, or none of letters and digits.
_TRAITS = {c: (c.isdigit(), c.isupper(), c.islower(), c in "0123456789abcdef", c in "0123456789ABCDEF", not c.isalnum()) for c in map(chr, range(128))}


def _class(size: int, low: int, up: int, other: int) -> str:
    return "hex" if size in (low, up) else "base64" if other else "alnum"


def character_class(counts: dict[str, int]) -> str:
    """The narrowest class that holds all characters with a count."""
    present = [_TRAITS[c] for c, n in counts.items() if n]
    return _class(len(present), *(sum(t[k] for t in present) for k in (3, 4, 5)))


def hot_windows(s: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows whose entropy reaches their class's threshold; every count is kept up by one character in and one out."""
    counts: dict[str, int] = {}
    table = _plogp(window)
    total, runs = 0.0, []
    digits = upper = lower = low = up = other = changes = 0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += table[n + 1] - table[n]
        counts[c] = n + 1
        d, u, w, x, y, o = _TRAITS[c]
        digits, upper, lower, low, up, other = digits + d, upper + u, lower + w, low + x, up + y, other + o
        changes += i > 0 and _turns(s[i - 1], c)
        if i >= window:
            gone = s[i - window]
            n = counts[gone]
            total += table[n - 1] - table[n]
            counts[gone] = n - 1
            d, u, w, x, y, o = _TRAITS[gone]
            digits, upper, lower, low, up, other = digits - d, upper - u, lower - w, low - x, up - y, other - o
            changes -= _turns(gone, s[i - window + 1])
        mixed = not digits and changes >= LEAST_CHANGES
        if i >= window - 1 and (mixed or (digits and (upper or lower))):
            bits = math.log2(window) - total / window
            if bits >= THRESHOLDS["letters" if mixed else _class(window, low, up, other)]:
                start = i - window + 1
                if runs and start <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + 1)
                else:
                    runs.append((start, i + 1))
    return runs


def _turns(a: str, b: str) -> bool:
    """Do two adjoining letters differ in case?"""
    one, two = _TRAITS[a], _TRAITS[b]
    return (one[1] and two[2]) or (one[2] and two[1])


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of candidates with a hot window, without those on the allow-list."""
    spans = []
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if any(rule.match(s) for rule in ALLOWED):
            continue
        spans += [(m.start() + a, m.start() + b) for a, b in hot_windows(s)]
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then by kind as listed."""
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], _RANK[s[2]]))


def all_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans and the entropy spans that no base span covers; both come by start, so one pass over them tells."""
    added, furthest, at = [], 0, 0
    for a, b in entropy_spans(text):
        while at < len(base) and base[at][0] <= a:
            furthest = max(furthest, base[at][1])
            at += 1
        if b > furthest:
            added.append((a, b, "entropy"))
    return sorted(base + added, key=lambda s: (s[0], _RANK[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every found span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in all_spans(text, base_spans(text)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, the digest of the base spans, and all spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for text in texts_of(batch):
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                for column, value in zip(out, (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=pa.int64()) for c in out[:3]), *(pa.array(c, type=pa.string()) for c in out[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced; a null text stays null, n_chars follows the text."""
    columns = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "text"):
            texts = [t if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            arrays = [pa.array(texts, type=batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = docs.mapInArrow(work, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
