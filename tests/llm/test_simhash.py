import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelode.llm import simhash
from tracelode.llm.components import connected
from tracelode.llm.queries import op3_simhash_dedup


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(pairs):
    """Component (least id) of each position of (id, fingerprint)."""
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    prints = np.array([p for _, p in pairs], dtype=np.uint64)
    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(pairs)):
        groups.setdefault(root(i), []).append(pairs[i][0])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(pairs))]


def test_against_brute_force(spark, sf, documents):
    rows = documents.collect()
    pairs = [(r["doc_id"], fingerprint(r["text"])) for r in rows]
    want = {(d, f"{p:016x}", c) for (d, p), c in zip(pairs, brute(pairs), strict=True)}
    assert {tuple(r) for r in op3_simhash_dedup(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_links_of_random_neighbourhoods(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(8):
            x = int(s)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.linked(spark.createDataFrame([(p,) for p in signed], "print long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want and len(want) > 40


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (200, 202)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, none):
    got = [(r["doc_id"], r["print"], r["component_id"]) for r in simhash.components(odd).collect()]
    rows = odd.collect()
    pairs = [(r["doc_id"], fingerprint(r["text"])) for r in rows]
    want = [(d, int(np.uint64(p).astype(np.int64)), c) for (d, p), c in zip(pairs, brute(pairs), strict=True)]
    key = lambda t: tuple((v is None, v or 0) for v in t)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.components(none).count() == 0


def test_one_of_each_stays(spark, odd, none, documents):
    kept = simhash.first_of_each(documents)
    assert kept.columns == documents.columns
    groups = {r["component_id"] for r in simhash.components(documents).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)
    rest = simhash.first_of_each(odd)
    assert rest.columns == odd.columns
    ids = [r["doc_id"] for r in rest.collect()]
    # 1 and 2 are copies; 3, 4, 5 and the null row are blank
    assert sorted((i for i in ids if i is not None)) == [1, 3, 6, 7, 8] and ids.count(None) == 1
    assert simhash.first_of_each(none).count() == 0
    clash = simhash.first_of_each(odd.withColumn("w", F.lit(1)))
    assert clash.count() == rest.count()


def similar(rows, least=0.8):
    """Kept ids by brute force: five-word shingles, exact Jaccard similarity, least id of each component; also the pairs."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)} - {""})
    root = list(range(len(rows)))
    pairs = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= least * (len(a) + len(b) - both):
                pairs += rows[i][1] != rows[j][1]
                root = [root[j] if r == root[i] else r for r in root] if root[i] != root[j] else root
    ids = {}
    for r, (doc_id, _) in zip(root, rows, strict=True):
        ids.setdefault(r, []).append(doc_id)
    return sorted(min(v) for v in ids.values()), pairs


def test_near_copies_fall_by_jaccard(spark, documents):
    """The given documents, with copies that lose, gain or change words down to a similarity of 0.8 and below."""
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for n, (_, text) in enumerate(rows[:60]):
        words = text.split()
        for place in rng.choice(len(words), max(1, len(words) * (n % 5) // 100), replace=False):
            words[place] = f"changed{place}"
        rows.append((10_000 + n, " ".join(words)))
    want, pairs = similar(rows)
    got = simhash.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want and pairs > 30


def test_odd_rows_by_jaccard(spark, odd, none):
    rest = simhash.first_of_similar(odd)
    ids = [r["doc_id"] for r in rest.collect()]
    assert rest.columns == odd.columns and sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 1
    assert simhash.first_of_similar(none).count() == 0


@pytest.mark.parametrize("stage", [simhash.first_of_each, simhash.first_of_similar])
def test_columns_of_any_name_stay(spark, odd, stage):
    names = ("_text_key", "_kept_id", "_kept_key", "_kept_n", "id", "key", "n", "row", "a.b", "w", "w0", "root", "d", "k")
    wide = odd.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    out = stage(wide)
    assert out.schema == wide.schema and out.count() == stage(odd).count()
    assert all(r[c] == i for r in out.collect() for i, c in enumerate(names))


def test_no_link_of_a_crowd_is_lost(spark):
    """Variants of a few texts, most of them unlike each other: what a text meets first says nothing about the rest it meets."""
    rng = np.random.default_rng(11)
    rows = []
    for group in range(8):
        base = [f"w{group}x{i}" for i in range(120)]
        for n in range(40):
            words = list(base)
            for place in rng.choice(24, 1 + n % 4, replace=False):
                words[5 * place] = f"n{rng.integers(3)}"
            rows.append((1_000 * group + n, " ".join(words)))
    want, _ = similar(rows)
    got = simhash.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want and 20 < len(want) < 300


def _near_copies(rng, count, words=150):
    """Copies of one text that lose, double or change some of its words; most are unlike each other."""
    base = [f"w{i}" for i in range(words)]
    rows = []
    for n in range(count):
        own = list(base)
        for place in sorted(rng.choice(words, 1 + n % 7, replace=False).tolist(), reverse=True):
            own[place : place + 1] = [[], [own[place]] * 2, [f"x{rng.integers(40)}"]][rng.integers(3)]
        rows.append((n, " ".join(own)))
    return rows


def test_a_large_group_of_near_copies_is_not_paired_in_full(spark, monkeypatch):
    """Every removal of brute force, by candidates that are few against the pairs of the group."""
    rows = _near_copies(np.random.default_rng(7), 300)
    tried = []
    known = simhash.sketched

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return known(pairs, *rest)

    monkeypatch.setattr(simhash, "sketched", counted)
    want, similar_pairs = similar(rows)
    got = simhash.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want and 10 < len(want) < 290 and similar_pairs > 1_000
    assert sum(tried) < 12 * len(rows)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_differences_from_a_centre_keep_every_similar_pair(least):
    """Unless both are like the centre, two similar sets share one of the differences by which they meet; parities drop none."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(1_500):
        n = int(rng.integers(1, 60))
        every = np.unique(rng.integers(0, 2**64, 4 * n, dtype=np.uint64))
        centre = np.sort(rng.permutation(every)[: int(rng.integers(1, 2 * n + 1))])
        a = np.setxor1d(centre, rng.permutation(every)[: int(rng.integers(0, n + 1))])
        b = np.setxor1d(a, rng.permutation(every)[: int(rng.integers(0, n // 3 + 1))])
        if simhash.jaccard(a, b) < least or not (len(a) and len(b)):
            continue
        room = (1 - least) / (1 + least) * (len(a) + len(b))
        assert sum(int(x & (2**64 - 1)).bit_count() for x in (simhash.parity(a) ^ simhash.parity(b)).tolist()) <= room + 1e-6
        (x, i, far, p), (y, j, other, q) = (simhash.difference(s, centre, least) for s in (a, b))
        if not (far or other):
            continue
        met += 1
        if far and other:
            x, y = x[:p], y[:q]
        shared = [(s, t) for s, h in enumerate(x.tolist()) for t, k in enumerate(y.tolist()) if h == k]
        assert shared and 2 * min(i - shared[0][0], j - shared[0][1]) >= i + j - room - 1e-6
    assert met > 100


def test_places_and_sketches_keep_every_similar_pair():
    """Whatever shingles count as frequent."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 40, 300):
        for cut in range(0, n // 4 + 2):
            every = np.unique(rng.integers(0, 2**64, n + cut, dtype=np.uint64))
            a, b = np.sort(rng.permutation(every)[:n]), np.sort(rng.permutation(every)[:n])
            if simhash.jaccard(a, b) < 0.8:
                continue
            often = np.sort(rng.permutation(every)[: len(every) // 2])
            first = [simhash.first_shingles(x, often, 0.8) for x in (a, b)]
            assert np.intersect1d(*first).size
            s, t = (np.frombuffer(simhash.sketch(x), dtype=np.uint8).astype(int) for x in (a, b))
            assert np.minimum(s, t).sum() >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6


def test_a_crowd_of_unlike_texts_makes_pairs_and_no_differences(spark, monkeypatch):
    """Texts of paragraphs that many share, and near copies of some: the pairs of a crowd are fewer than its texts' shingles."""
    rng = np.random.default_rng(6)
    paragraphs = [" ".join(f"p{p}w{i}" for i in range(60)) for p in range(40)]
    rows = [(n, " ".join(paragraphs[p] for p in rng.choice(40, 6, replace=False))) for n in range(120)]
    rows += [(1_000 + n, " ".join([*rows[n][1].split()[: -1 - 6 * n], "changed"])) for n in range(12)]
    members = []
    known = simhash.differences

    def counted(docs, asked, *rest):
        members.append(asked.count())
        return known(docs, asked, *rest)

    monkeypatch.setattr(simhash, "differences", counted)
    want, _ = similar(rows)
    got = simhash.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want and 120 <= len(want) < 132
    assert members == [0]
