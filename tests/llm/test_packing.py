import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelode.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity):
    plain = Tokenizer.from_file(PATH)
    want = sorted((len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for t in docs))
    got = {}
    for r in rows:
        got.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in got.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in rows) == sum(want)
    return len(got), -(-sum(want) // capacity)


def test_packs_every_piece(spark, documents):
    rows = packing.pack(documents, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    made, least = check(rows, texts.values(), 2048)
    assert made <= least + 2
    plain = Tokenizer.from_file(PATH)
    ids = {d: [*plain.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r["ids_crc32"]
        assert len(ids[r["doc_id"]]) > 2048 or (r["piece"], r["start"]) == (0, 0)
        assert r["piece"] == 0 or r["length"] == 2048


def test_many_rounds(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 20)
    made, least = check(packing.pack(documents, PATH, capacity=512).collect(), [r["text"] for r in documents.collect()], 512)
    assert made <= 1.05 * least + 2


def test_half_full_sequences_meet(spark, documents, monkeypatch):
    """However many tasks there are, no two sequences are left that are half full."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 10)
    for capacity in (300, 512, 2048):
        fill = {}
        for r in packing.pack(documents, PATH, capacity=capacity).collect():
            fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        assert sum(f <= capacity // 2 for f in fill.values()) <= 1


def test_rows_that_never_fit_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 10)
    docs = spark.createDataFrame([(i, "word " * 59) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, capacity=100).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) == 300


def test_odd_rows(spark, odd, none):
    rows = packing.pack(odd, PATH, capacity=64).collect()
    check(rows, [r["text"] for r in odd.collect()], 64)
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 1 for r in rows) == 2
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert packing.pack(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    # no two bins could be one
    fills = sorted(sum(sizes[i] for i in b) for b in bins)
    assert len(fills) < 2 or fills[0] + fills[1] > 50


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


ODD = ["", " ", "a", " a", "a ", "a  b", "<|endoftext|> hi", "x<|endoftext|>y z", "don't we'll 12,5", "\n\n a\tb", "é ñ ß 漢字 😀", "a  b", "A B'S"]


def test_kept_chunks_give_the_same_ids(documents, monkeypatch):
    texts = ODD + [r["text"] for r in documents.limit(80).collect()]
    for path in (PATH, WORDS):
        plain = Tokenizer.from_file(path)
        for entries in (600_000, 50):
            monkeypatch.setattr(tokens, "CACHE_ENTRIES", entries)
            made = tokens.ChunkedEncoder(path).encode(texts)
            assert [np.frombuffer(b, dtype="<u4").tolist() for b in made] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z'1,.é\n\t "), max_size=40))
def test_any_text_gives_the_same_ids(text):
    for path in (PATH, WORDS):
        e = tokens.encoder(path)
        assert np.frombuffer(e.encode([text])[0], dtype="<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
