"""Importance resampling towards a target: hashed n-gram features, log-ratio weights, Gumbel noise, top scores.

Identical texts are collapsed first, by grouping the full text, so a text's features are
made once however often it occurs and its counts are multiplied by its multiplicity.  Its
weight joins back to its documents before each draws noise of its own.

Features are hashed in whole arrays: the CRC-32 of a run of words follows from those of its
words, as that of a joined string is the first's, moved by the second's length, XOR the
second's.  Bucket counts and gains are tables of ``BUCKETS`` rows, whatever the corpus.

A text that very many documents share would make its join key one task; weights of texts
that at least one document in HOT_SHARE has, of which there are HOT_SHARE at most, are
broadcast instead.  Ranks come from ranges of scores, not from one sorted task.

Defined cases: null text has no words; texts without words have weight 0; a null doc_id
draws noise as an empty one and comes first among ties; repeated rows are documents of their own (and
draw the same noise, which is the id's); fewer than 20 documents of 20 words draw none; an
empty table gives an empty result, an empty target gains that favour none of its words;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, durable, partitions_for, ranked

BUCKETS = 10_000
#: Words of a feature, at most.
RUN = 3
LEAST_WORDS = 20
HOT_SHARE = 10_000
ROWS_PER_TASK = 500_000
_SHORT = 64
#: Bytes of words, and what each is in lower case; all bytes of characters beyond ASCII belong to words.
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256)], dtype=np.uint8)


def _steps() -> np.ndarray:
    """What one more zero byte makes of the low byte of a CRC-32 register, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _steps()


def _zero_byte(x: np.ndarray) -> np.ndarray:
    return _STEP[x & 0xFF] ^ (x >> np.uint32(8))


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """For 0.._SHORT bytes, and for powers of two, what each byte of a checksum becomes when so many bytes follow."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    short = [one]
    for _ in range(_SHORT):
        short.append(_zero_byte(short[-1]))
    power = [short[1]]
    for _ in range(31):
        power.append(_through(power[-1], power[-1]))
    return np.stack(short), np.stack(power)


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 0xFF] ^ table[1][(x >> np.uint32(8)) & 0xFF] ^ table[2][(x >> np.uint32(16)) & 0xFF] ^ table[3][x >> np.uint32(24)]


_SHORT_MOVES, _POWER_MOVES = _moves()
_FLAT = _SHORT_MOVES.reshape(-1)
_SPACE = np.uint32(zlib.crc32(b" "))


def moved(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums as parts of those of longer strings, in which ``lengths`` bytes follow."""
    base = np.minimum(lengths, _SHORT) * 1024
    out = _FLAT[base + (sums & 0xFF)] ^ _FLAT[base + 256 + ((sums >> np.uint32(8)) & 0xFF)] ^ _FLAT[base + 512 + ((sums >> np.uint32(16)) & 0xFF)] ^ _FLAT[base + 768 + (sums >> np.uint32(24))]
    for i in np.flatnonzero(lengths > _SHORT):
        x = sums[i : i + 1]
        for bit in range(int(lengths[i]).bit_length()):
            if int(lengths[i]) >> bit & 1:
                x = _through(_POWER_MOVES[bit], x)
        out[i] = x[0]
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in lower case, and of each word its text's number, start and length."""
    # a zero byte ends every text, so no word runs over it
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = _WORD[data]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return data, np.searchsorted(bounds, starts, side="right"), starts, ends - starts


def word_sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of every word: all words' bytes of one place at a time, longer words first."""
    out = np.empty(len(starts), dtype=np.uint32)
    order = np.argsort(-np.minimum(lengths, _SHORT + 1).astype(np.int16), kind="stable")
    long = int((lengths > _SHORT).sum())
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    order = order[long:]
    at, size = starts[order], lengths[order]
    upto = len(order) - np.cumsum(np.bincount(size, minlength=_SHORT + 1))
    register = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for place in range(_SHORT):
        m = upto[place]
        if not m:
            break
        now = register[:m]
        register[:m] = _STEP[(now ^ data[at[:m] + place]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out[order] = ~register
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and of all features of 1 to RUN words their text's number and their bucket."""
    data, text, starts, lengths = words_of(texts)
    sums = word_sums(data, starts, lengths)
    texts_of_features, buckets, run = [text], [sums % BUCKETS], sums
    for more in range(1, RUN):
        if len(sums) <= more:
            break
        # the run that ends at word i - 1, a space, and word i
        run = moved(moved(run[:-1], np.ones(len(run) - 1, dtype=np.int64)) ^ _SPACE, lengths[more:]) ^ sums[more:]
        whole = text[more:] == text[:-more]
        texts_of_features.append(text[more:][whole])
        buckets.append(run[whole] % BUCKETS)
    return np.bincount(text, minlength=len(texts)), np.concatenate(texts_of_features), np.concatenate(buckets)


def counted(texts: DataFrame) -> DataFrame:
    """bucket, count: features of ``texts`` (text, times), each counted as often as its text occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in byte_chunks(batches, "text"):
            times = np.array(batch.column("times").to_pylist(), dtype=np.float64)
            _, text, bucket = features(batch.column("text").to_pylist())
            total += np.bincount(bucket, weights=times[text], minlength=BUCKETS).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "count"])

    return texts.mapInArrow(work, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """What a feature of each bucket adds to a weight; both tables have a row for each bucket at most."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, table in ((s, corpus), (t, target)):
        for r in table.collect():
            counts[r["bucket"]] = r["count"]
    of_s, of_t = float(s.sum()) + BUCKETS, float(t.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(((t[b] + 1) * of_s) / ((s[b] + 1) * of_t))) for b in range(BUCKETS)], dtype=np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, times, n_words, n_features, weight of ``texts`` (key, text, times)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "text"):
            words, text, bucket = features(batch.column("text").to_pylist())
            n = np.bincount(text, minlength=batch.num_rows)
            weight = np.bincount(text, weights=gain[bucket], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("times"), *(pa.array(x, pa.int64()) for x in (words, n, weight))], names=["key", "times", "n_words", "n_features", "weight"])

    return texts.mapInArrow(work, "key binary, times long, n_words long, n_features long, weight long")


def collapsed(table: DataFrame) -> DataFrame:
    """text (binary, null as empty) and how many times it occurs."""
    return table.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).groupBy("text").agg(F.count("*").alias("times"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ranks of the ``percent`` of long enough documents that are drawn."""
    spark = docs.sparkSession
    key = F.unhex(F.sha2(F.col("text"), 256))
    texts = durable(collapsed(docs).withColumn("key", key), "texts")
    gain = gains(counted(texts), counted(collapsed(target)))
    weights = durable(weighed(texts, gain), "weights")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", key.alias("key")), "keys")
    count = keyed.count()
    # at most hot_share texts can have count / hot_share documents each
    hot = F.col("times") * hot_share >= max(count, hot_share)
    first = keyed.join(F.broadcast(weights.filter(hot).drop("times")), "key", "left")
    rest = first.filter("weight IS NULL").select("doc_id", "key").join(weights.filter(~hot).drop("times"), "key")
    found = first.filter("weight IS NOT NULL").unionByName(rest).drop("key")
    scored = durable(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    long_enough = scored.filter(F.col("n_words") >= LEAST_WORDS).withColumn("down", -F.col("score"))
    placed = ranked(long_enough, ["down", "doc_id", "weight", "n_features"], "scores-in-order", partitions_for(spark, count, ROWS_PER_TASK, 4))
    drawn = F.when(F.col("pos") < F.floor(F.col("n") * percent / 100), F.col("pos") + 1)
    out = placed.withColumn("rank", drawn).unionByName(scored.filter(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
