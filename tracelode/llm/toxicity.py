"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled.  Token labels for training come from them: a token of a
toxic document is a labelled toxic token if its word, or one of its prefixes, stands in
enough toxic training documents and nearly no clean one.  The field learns from word,
prefix, suffix and shape features and from the labels next to each other; a chain is a
sentence.  A document's score is a logistic function, fitted on the training documents,
of its tokens' forward-backward marginals.

Labels are learnt from a sample of at most ``sample`` labelled documents (the smallest by
a hash of doc_id), and only where crc32(doc_id as text) mod 4 is not 2.

Defined cases: null text counts as empty and has the score of a document without tokens;
repeated rows each get a row; a null doc_id is kept, scored and not held out; labels that
are null are not learnt from, repeated labels of a document count as their largest; with
no labels, or labels of one kind only, every score is 0; an empty table gives an empty
result; columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import byte_chunks, make_room, texts_of

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_BREAKS = frozenset(".!?\n")
BITS = 18
#: A marginal from which a token belongs to an offending span.
SPAN_AT = 0.5
#: Words whose feature sums a worker keeps; beyond it only those in use stay.
CACHE_ENTRIES = 100_000


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def affixes(word: str) -> list[str]:
    return [f"w={word}", *(f"p={word[:n]}" for n in range(4, min(8, len(word) - 1) + 1)), f"s={word[-3:]}"]


def feature_numbers(word: str) -> list[int]:
    shape = f"n={min(len(word), 9)}{'d' if any(c.isdigit() for c in word) else ''}"
    return [_bucket(a) for a in affixes(word)] + [_bucket(shape), _bucket("any")]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def lowered_places(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of the lowered text's tokens, as code points of the text itself (a letter may become several when lowered)."""
    lowered = text.lower()
    found = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(lowered)]
    if len(lowered) == len(text):
        return found
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1, word) for a, b, word in found]


def as_chains(lists: list[list[str]]) -> tuple[list[str], np.ndarray, crf.Chains]:
    """Words without breaks, the text number of each, and the sentences as chains."""
    flat = [w for found in lists for w in (*found, "\n")]
    breaks = np.fromiter(map(_BREAKS.__contains__, flat), dtype=bool, count=len(flat))
    owner = np.repeat(np.arange(len(lists)), [len(found) + 1 for found in lists])[~breaks]
    return [w for w in flat if w not in _BREAKS], owner, _sentences(breaks)


def _sentences(breaks: np.ndarray) -> crf.Chains:
    """Chains over the positions that are no breaks, numbered without the breaks."""
    ends = np.flatnonzero(breaks)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    lengths = ends - starts
    lengths = lengths[lengths > 0]
    return crf.Chains(np.cumsum(lengths) - lengths, lengths)


def summary(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text: 1, log(1 + expected toxic tokens), the largest marginal, their share of the tokens."""
    expected = np.bincount(owner, weights=p, minlength=n)
    # many faint marginals must not add up: only what is likelier than not is counted
    sure = np.bincount(owner, weights=np.where(p >= SPAN_AT, p, 0), minlength=n)
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    top = np.zeros(n)
    np.maximum.at(top, owner, p)
    return np.stack([np.ones(n), np.log1p(sure), top, np.sqrt(sure / size), np.log1p(np.minimum(expected, 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    field: crf.Model
    head: np.ndarray | None

    def deltas(self, words: list[str], cache: dict[str, float]) -> np.ndarray:
        """Feature sums of words; NaN for breaks."""
        missing = set(words) - cache.keys()
        make_room(cache, words, len(missing), CACHE_ENTRIES)
        weights = self.field.weights
        cache.update(dict.fromkeys(_BREAKS, np.nan))
        missing -= _BREAKS
        for w in missing:
            cache[w] = float(weights[feature_numbers(w)].sum())
        return np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))

    def apply(self, texts: list[str], cache: dict[str, float]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score and offending (start, end) code points of each text."""
        if self.head is None:
            return np.zeros(len(texts)), [[] for _ in texts]
        lists = [tokens(t) for t in texts]
        for found in lists:
            found.append("\n")
        delta = self.deltas([w for found in lists for w in found], cache)
        breaks = np.isnan(delta)
        owner = np.repeat(np.arange(len(texts)), [len(found) for found in lists])[~breaks]
        p = self.field.marginals(delta[~breaks], _sentences(breaks))
        scores = 1 / (1 + np.exp(-np.clip(summary(p, owner, len(texts)) @ self.head, -30, 30)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hits = np.flatnonzero(p >= SPAN_AT)
        first = np.searchsorted(owner, np.arange(len(texts)))
        for i in np.unique(owner[hits]) if len(hits) else ():
            places = [(a, b) for a, b, word in lowered_places(texts[i]) if word not in _BREAKS]
            spans[i] = [places[k] for k in (hits[owner[hits] == i] - first[i]).tolist()]
        return scores, spans


def train(texts: list[str], toxic: list[int], sentences: int = 20_000) -> ToxicityModel:
    """The field and the document function from labelled texts.

    The field learns from every sentence with a toxic token and from about ``sentences`` others.
    """
    y = np.array(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(crf.Model(np.zeros(1 << BITS)), None)
    clean, foul = int((y == 0).sum()), int((y == 1).sum())
    # ten times likelier in toxic documents than in clean ones, in four and one in a hundred at least
    often = Counter()
    for text, label in zip(texts, toxic, strict=True):
        if label:
            often.update({a for w in set(tokens(text)) - _BREAKS for a in affixes(w)[:-1]})
    often = Counter({a: n for a, n in often.items() if n >= max(4, 0.01 * foul)})
    rare = Counter()
    for text, label in zip(texts, toxic, strict=True):
        if not label:
            rare.update({a for w in set(tokens(text)) - _BREAKS for a in affixes(w)[:-1] if a in often})
    marks = {a for a, n in often.items() if n / foul >= 10 * (rare[a] + 0.5) / clean}
    # sentences with a toxic token, and of the others every so many, spread evenly
    every = max(1, sum(t.count(".") + 1 for t in texts) // sentences)
    chosen: list[list[str]] = []
    seen = 0
    for text, label in zip(texts, toxic, strict=True):
        words, _, chains = as_chains([tokens(text)])
        for s, n in zip(chains.starts.tolist(), chains.lengths.tolist(), strict=True):
            sentence = words[s : s + n]
            seen += 1
            if seen % every == 0 or (label and any(not marks.isdisjoint(affixes(w)) for w in sentence)):
                chosen.append([*sentence, "\1" if label else "\0"])
    known: dict[str, list[int]] = {}
    lengths = np.array([len(c) - 1 for c in chosen], dtype=np.int64)
    flat = [(w, c[-1] == "\1") for c in chosen for w in c[:-1]]
    labels = np.fromiter((foul_text and not marks.isdisjoint(affixes(w)) for w, foul_text in flat), dtype=np.int64, count=len(flat))
    features = crf.Features.of([known.get(w) or known.setdefault(w, feature_numbers(w)) for w, _ in flat])
    field = crf.fit(features, labels, crf.Chains(np.cumsum(lengths) - lengths, lengths), 1 << BITS)
    model = ToxicityModel(field, None)
    rows, cache = [], {}
    for at in range(0, len(texts), 200):
        words, owner, chains = as_chains([tokens(t) for t in texts[at : at + 200]])
        rows.append(summary(field.marginals(model.deltas(words, cache), chains), owner, len(texts[at : at + 200])))
    model.head = logistic(np.concatenate(rows), y.astype(np.float64))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, sentences: int = 20_000) -> ToxicityModel:
    """Fits on at most ``sample`` labelled documents that are not held out, and on about ``sentences`` of their sentences without a toxic token."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is bounded by its parameter, so it may be broadcast and collected
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.length("text")).alias("text"), F.max("toxic").alias("toxic"))
    table = rows.toPandas().sort_values("doc_id")
    return train([t or "" for t in table["text"]], table["toxic"].astype(int).tolist(), sentences)


def scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans ("start:end" of offending tokens, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in byte_chunks(batches, "text"):
            score, spans = shared.value.apply(texts_of(batch), cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array([",".join(f"{a}:{b}" for a, b in s) for s in spans], type=pa.string())], names=["doc_id", "score", "spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double, spans string")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows, with all columns, whose score is under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in byte_chunks(batches, "text"):
            score, _ = shared.value.apply(texts_of(batch), cache)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(work, docs.schema)
