import numpy as np
import pyarrow as pa

from tracelode.llm import decontamination, simhash, tokens, toxicity
from tracelode.llm.common import bounded_batches
from tests.llm.test_packing import PATH


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])


def test_batches_for_workers_are_bounded_by_bytes(spark):
    texts = spark.range(0, 2_000, 1, 1).selectExpr("repeat('abcdefghij', 200) AS text")
    with bounded_batches(spark, 1 << 18):
        found = [r["bytes"] for r in texts.mapInArrow(sizes, "bytes long").collect()]
    assert len(found) > 10 and max(found) < 1 << 19
    assert len(texts.mapInArrow(sizes, "bytes long").collect()) == 1


def test_near_dedup_bounds_what_goes_to_workers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(simhash, "similar_roots", lambda *a, known=simhash.similar_roots: seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or known(*a))
    rows = spark.createDataFrame([(n, "a b c d e f g h") for n in range(3)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.first_of_similar(rows).collect()] == [0]
    assert seen == [str(1 << 20)]


def test_full_caches_keep_what_recurs(monkeypatch):
    """New words without end fill no cache, and those in every batch stay."""
    words = [[*(f"common{i}" for i in range(20)), *(f"new{n}x{i}" for i in range(20))] for n in range(12)]
    for module in (decontamination, toxicity, tokens):
        monkeypatch.setattr(module, "CACHE_ENTRIES", 100)
    ids, weights, coder = {}, {}, tokens.ChunkedEncoder(PATH)
    model = toxicity.ToxicityModel(toxicity.crf.Model(np.ones(1 << toxicity.BITS)), None)
    for n, own in enumerate(words):
        before = ids.keys() & own, weights.keys() & own, coder.cache.keys() & {f" {w}" for w in own} | coder.cache.keys() & set(own)
        assert all(len(b) == 20 for b in before) or not n
        decontamination.word_ids(own, ids)
        model.deltas(own, weights)
        coder.encode([" ".join(["first", *own])])
        assert max(len(ids), len(coder.cache)) <= 100 and len(weights) <= 100 + len(toxicity._BREAKS)
