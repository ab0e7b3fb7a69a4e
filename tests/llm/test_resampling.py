import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import resampling
from tracelode.llm.queries import op13_importance_resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target, percent=5):
    """Rows by plain loops; ``docs`` are (doc_id, text)."""
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            counts.update(map(bucket, features_of(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for doc_id, text in docs:
        found = features_of(text)
        weight = sum(map(gain, map(bucket, found)))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for r in rows:
        r[4] = None
    for rank, r in enumerate(able[: math.floor(percent * len(able) / 100)], 1):
        r[4] = rank
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_document_by_plain_loops(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = got(op13_importance_resampling(spark, sf))
    assert found == plain(docs, target) and any(r[4] for r in found)


@pytest.mark.parametrize("hot_share", [1, 3, 10_000])
def test_copies_and_odd_rows(spark, odd, none, hot_share):
    """One text holds a third of the rows and more; hot and other texts join differently and alike."""
    more = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("Same Words " * 15)).otherwise(F.concat_ws(" ", F.lit("other words"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" É漢 ")), 12))).alias("text"))
    docs = odd.select("doc_id", "text", "score", "key", "n", "h").unionByName(more, allowMissingColumns=True)
    target = spark.createDataFrame([("same words",), (None,), ("", )], "text string")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], ["same words", None, ""], 40)
    assert got(resampling.resample(docs, target, percent=40, hot_share=hot_share)) == want
    assert resampling.resample(none, target).count() == 0
    assert got(resampling.resample(docs, none, percent=40, hot_share=hot_share)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()], [], 40)


def test_checksums_of_runs():
    texts = ["", "a", "A b", "x" * 64 + " " + "y" * 65 + " z", "é漢字 😀9 Z_z-z", "w" * 3_000_000 + " end", "\0a\0", " ".join(str(i) for i in range(50_000))]
    words, text, buckets = resampling.features([t.encode() for t in texts])
    assert list(words) == [len(words_of(t)) for t in texts]
    for k, t in enumerate(texts):
        assert Counter(buckets[text == k].tolist()) == Counter(map(bucket, features_of(t)))


def test_moved_checksums():
    rng = np.random.default_rng(7)
    for size in (1, 2, 64, 65, 1000, 70_001):
        a, b = rng.bytes(9), rng.bytes(size)
        assert int(resampling.moved(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
