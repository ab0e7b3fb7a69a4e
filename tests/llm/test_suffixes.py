import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import suffixes
from tracelode.llm.queries import op6_suffix_dedup


def brute(texts, span=200):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + span] for b in bodies for s in range(len(b) - span + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                gone[s : s + span] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=key)


def expected(pairs, span=200):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted(((d, *w) for (d, _), w in zip(pairs, brute([t for _, t in pairs], span), strict=True)), key=key)


def test_query_against_brute_force(spark, sf, documents):
    assert rows(op6_suffix_dedup(spark, sf)) == expected([(r["doc_id"], r["text"]) for r in documents.collect()])


def passages(spark, n=60):
    rng = np.random.default_rng(3)
    word = lambda k: "".join(rng.choice(list("abcdefgh "), k))
    common, other = word(260), word(450)
    texts = [word(int(rng.integers(0, 300))) + (common if i % 2 else other[: 150 + 5 * i]) + word(int(rng.integers(0, 300))) for i in range(n)]
    texts += ["x" * 700, "y" * 199, "y" * 199, "z" * 200, "é" * 120 + word(90), "é" * 120 + word(90)] + texts[:5]
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [2_000, 7])
def test_passages_runs_of_one_byte_and_crowded_hashes(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SEGMENTS_PER_TASK", 40)
    monkeypatch.setattr(suffixes, "DOCS_PER_BUCKET", 9)
    pairs = passages(spark)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    assert rows(suffixes.deduplicate(df)) == expected(pairs)


def test_odd_rows(spark, odd, none):
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows(suffixes.deduplicate(odd)) == expected(pairs)
    assert suffixes.deduplicate(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=64, max_size=90).map(lambda b: bytes(x & 1 for x in b)), min_size=1, max_size=12), st.integers(0, 40))
def test_sorting_finds_equal_prefixes(parts, shared):
    head = b"\x01" * shared
    parts = [head + p for p in parts] + [head + parts[0]]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    lengths = [len(p) for p in parts]
    begins = np.cumsum(lengths) - lengths
    starts = np.concatenate([np.arange(b, b + n - 64 + 1) for b, n in zip(begins, lengths, strict=True)])
    classes = suffixes.repeated(data, starts, 64)
    text = data.tobytes()
    seen = collections.Counter(text[s : s + 64] for s in starts.tolist())
    assert [c >= 0 for c in classes] == [seen[text[s : s + 64]] > 1 for s in starts.tolist()]
    named = {}
    for s, c in zip(starts.tolist(), classes.tolist(), strict=True):
        if c >= 0:
            assert named.setdefault(c, text[s : s + 64]) == text[s : s + 64]
    assert len(set(named.values())) == len(named)


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 4, 230, dtype=np.uint8)
    docs = [np.concatenate([rng.integers(0, 4, k, dtype=np.uint8), shared, rng.integers(0, 4, 90, dtype=np.uint8)]) for k in (0, 13, 77)]
    data = np.concatenate(docs)
    sizes = [len(d) for d in docs]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    texts, hashes, first, counts = suffixes.anchors(data, offsets, 200)
    at = {}
    for t, h, f, n in zip(texts.tolist(), hashes.tolist(), first.tolist(), counts.tolist(), strict=True):
        for s in range(f, f + n):
            at[t, s] = h
    assert set(at) == {(t, s) for t, n in enumerate(sizes) for s in range(n - 199)}
    for s in range(31):
        assert len({at[t, k + s] for t, k in enumerate((0, 13, 77))}) == 1


def test_nothing_is_left_in_the_catalog(spark, documents):
    out = suffixes.deduplicate(documents)
    assert out.count() == documents.count()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("tracelode")] == []


def test_groups_whose_members_agree_are_not_sorted_again(monkeypatch):
    """Only the 60 starts of the groups that differ behind their first 8 bytes are."""
    rng = np.random.default_rng(8)
    block = lambda k: rng.integers(97, 123, k, dtype=np.uint8)
    same = [block(200)] * 50 + [block(200)] * 50
    head = block(100)
    other = [np.concatenate([head, block(100)]) for _ in range(20)] * 3
    data = np.concatenate([*same, *other])
    sorted_ = []
    lexsort = np.lexsort

    def counted(keys):
        sorted_.append(len(keys[0]))
        return lexsort(keys)

    monkeypatch.setattr(np, "lexsort", counted)
    got = suffixes.repeated(data, np.arange(0, len(data), 200), 200)
    assert sum(sorted_) == 60
    want = [bytes(data[s : s + 200]) for s in range(0, len(data), 200)]
    assert (got >= 0).all() and len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want)) == 22


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_classes_are_those_of_equal_strings(letters):
    rng = np.random.default_rng(letters)
    for size in (16, 40, 400):
        data = rng.integers(97, 97 + letters, size, dtype=np.uint8)
        data = np.concatenate([data, data[size // 3 :]])
        starts = np.arange(len(data) - 15)
        got = suffixes.repeated(data, starts, 16).tolist()
        want = [bytes(data[s : s + 16]) for s in starts]
        often = collections.Counter(want)
        assert [c >= 0 for c in got] == [often[w] > 1 for w in want]
        some = {(c, w) for c, w in zip(got, want, strict=True) if c >= 0}
        assert len(some) == len({c for c, _ in some}) == len({w for _, w in some})
    assert suffixes.repeated(data, np.zeros(0, dtype=np.int64), 16).tolist() == []
