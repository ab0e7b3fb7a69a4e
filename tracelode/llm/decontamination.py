"""Benchmark decontamination: MinHash containment search by item size, exact verification.

Test items have a signature whose length follows from the number of their distinct word
shingles; signatures of all sizes share one table for each shingle width.  An item's
MinHash signature names the k shingles that are
least under a seeded permutation, where k is one more than an item of its size may miss: of
n shingles a document that contains a share c has all but (1 - c) n, so it has at least one
of any (1 - c) n + 1, however long it is, and no pair is lost.  Documents meet the
signatures in one pass without a shuffle; every pair with a common entry is verified over
the shingles themselves, as text.

Words are runs of letters and digits of the lower-cased text; shingles take five words,
and a shorter item is one shingle of all its words.

Defined cases: items without words match nothing; null texts count as empty; repeated
documents and items each give a row; null ids are kept; an empty table on either side
gives an empty result; columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, make_room, texts_of

WORD = re.compile(r"[^\W_]+")
WIDTH = 5
#: Items broadcast at a time; more items make more passes over the documents.
ITEMS_A_PASS = 20_000
FILTER_BITS = 22
CACHE_ENTRIES = 100_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0x27D4EB2F165667C5)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def signature_length(size: int, least: float) -> int:
    """Entries of an item of ``size`` distinct shingles, so that one is met wherever a share ``least`` of them is."""
    needed = math.ceil(least * size - 1e-9)
    return size - max(needed, 1) + 1


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = ids[:n].copy()
    for k in range(1, width):
        out *= _MULTIPLIER
        out ^= out >> np.uint64(29)
        out += ids[k : k + n]
    return out


def word_ids(words: list[str], cache: dict[str, int]) -> np.ndarray:
    missing = set(words) - cache.keys()
    make_room(cache, words, len(missing), CACHE_ENTRIES)
    digest = xxhash.xxh3_64_intdigest
    cache.update((w, digest(w)) for w in missing)
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


@dataclass
class ItemIndex:
    """Signatures of a bounded number of items, by shingle width."""

    items: list[tuple]  # (item_id, width, shingle texts, rows that are alike)
    #: width -> (bitmap, sorted entries, (entry, item) pairs sorted by entry)
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple], width: int, least: float) -> ItemIndex:
        items, entries, cache = [], {}, {}
        for item_id, text, copies in rows:
            words = words_of(text or "")
            if not words:
                continue
            own = min(width, len(words))
            number = len(items)
            items.append((item_id, own, shingles(words, own), copies))
            hashes = np.unique(rolled(word_ids(words, cache), own))
            mixed = (hashes ^ _SEED) * _MULTIPLIER
            mixed ^= mixed >> np.uint64(31)
            signature = hashes[np.argsort(mixed * _MULTIPLIER, kind="stable")[: signature_length(len(items[number][2]), least)]]
            entries.setdefault(own, []).extend((int(h), number) for h in signature)
        tables = {}
        for own, pairs in entries.items():
            pairs.sort()
            keys = np.array([h for h, _ in pairs], dtype=np.uint64)
            bitmap = np.zeros(1 << FILTER_BITS, dtype=bool)
            bitmap[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            tables[own] = (bitmap, keys, np.array([i for _, i in pairs], dtype=np.int64))
        return cls(items, tables)

    def candidates(self, lists: list[list[str]], cache: dict[str, int]) -> list[tuple[int, int]]:
        """(text number, item number) of texts and items that have a signature's entry in common."""
        flat = [w for words in lists for w in words]
        ids = word_ids(flat, cache)
        sizes = np.array([len(words) for words in lists], dtype=np.int64)
        owner = np.repeat(np.arange(len(lists)), sizes)
        met: set[tuple[int, int]] = set()
        for width, (bitmap, keys, numbers) in self.tables.items():
            hashes = rolled(ids, width)
            if not len(hashes):
                continue
            at = np.flatnonzero(bitmap[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = at[owner[at] == owner[at + width - 1]]
            left, right = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
            at, left, right = at[right > left], left[right > left], right[right > left]
            # entries that match are few, items of an entry are listed one by one
            met |= {(d, int(numbers[e])) for d, a, b in zip(owner[at].tolist(), left.tolist(), right.tolist(), strict=True) for e in range(a, b)}
        return sorted(met)


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of the pairs with at least ``least``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in _passes(items, width, least):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict[str, int] = {}
            for batch in byte_chunks(batches, "text"):
                rows = _verified(shared.value, [words_of(t) for t in texts_of(batch)], cache, least)
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, *_ in rows], type=pa.int64()), *(pa.array([r[k] for r in rows], type=t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

        part = texts.mapInArrow(work, "doc_id long, item_id long, n_shared long, n_shingles long, containment double")
        found = part if found is None else found.unionByName(part)
    return found


def _verified(index: ItemIndex, lists: list[list[str]], cache: dict[str, int], least: float) -> list[tuple]:
    """(text number, item_id, shared, shingles, containment) of the candidates that hold, over the shingles as text."""
    rows, own, own_of = [], set(), None
    for d, number in index.candidates(lists, cache):
        item_id, width, wanted, copies = index.items[number]
        if own_of != (d, width):
            own, own_of = shingles(lists[d], width), (d, width)
        both = len(wanted & own)
        if both >= least * len(wanted):
            rows += [(d, item_id, both, len(wanted), both / len(wanted))] * copies
    return rows


def _passes(items: DataFrame, width: int, least: float) -> Iterator[ItemIndex]:
    """Indexes of at most about ITEMS_A_PASS items each; at least one, which may be empty."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    parts = max(1, -(-rows.count() // ITEMS_A_PASS))
    for part in range(parts):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield ItemIndex.of(sorted(((r["item_id"], r["text"], r["copies"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), width, least)


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8, width: int = WIDTH) -> DataFrame:
    """The rows, with all columns, that contain no item to ``least`` or more."""
    for index in _passes(items, width, least):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict[str, int] = {}
            for batch in byte_chunks(batches, "text"):
                leaks = {d for d, *_ in _verified(shared.value, [words_of(t) for t in texts_of(batch)], cache, least)}
                yield batch.filter(pa.array([i not in leaks for i in range(batch.num_rows)], type=pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
