"""SimHash fingerprints, links within a small Hamming radius by multi-index hashing, components.

Each fingerprint is cut into two halves.  A pair that differs in at most two bits differs
in at most one bit of some half: either one half is equal, or both differ by exactly one
bit.  So equal halves are looked up in both tables, and the ball of radius one around the
first half in its table; whatever meets is verified over all 64 bits.  Copies are folded
first: tables hold distinct fingerprints, so a group of copies is one entry.

Defined cases: null and blank texts have fingerprint zero, linked like any other; fewer
words than the shingle width give one shingle of all words; repeated rows each get a row;
a null doc_id gets a fingerprint and counts as larger than any other in a component;
an empty table gives an empty result; columns other than doc_id and text are not read.

``first_of_similar`` links by similarity: texts whose sets of word shingles have a Jaccard
similarity of ``least`` or more, and it finds every such link.  Two sets that similar share
one of their first shingles in any order that all sets keep, so texts meet by those alone, as
many as the text is long whatever the size of the table.  At first a few of each meeting
place are tried, nearest fingerprints first; then all that meet and are not linked by then.
Where CROWD or more meet, each is tried with one in their middle.  Where those that are not
linked by then would make many pairs for the shingles they have, they meet by what they differ
from it in: two that are similar, and not both similar to it, share such differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, byte_chunks, discard, durable, release, texts_of
from .components import connected

SEED = 42
RADIUS = 2
_LOW = (1 << 32) - 1


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of every word shingle, repeats included; ASCII letters are lower-cased and ASCII white space divides."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -width].tolist()]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: a bit is 1 if set in over half of them."""
    sizes = np.array(counts, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = sizes > 0
    if some.any():
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = (np.cumsum(sizes) - sizes)[some]
        votes = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        set_bits = np.packbits(2 * votes > sizes[some][:, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(set_bits).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, key: Column | None = None) -> DataFrame:
    """doc_id and its fingerprint as a (signed) long; with ``key``, that as a column (long) too."""
    extra = [] if key is None else [key.alias("key")]
    names = ["key"] * len(extra)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "text"):
            each = [shingle_hashes(t, width) for t in texts_of(batch)]
            flat = np.array([h for hs in each for h in hs], dtype=np.uint64)
            prints = majority(flat, [len(hs) for hs in each]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints), *(batch.column(c) for c in names)], names=["doc_id", "print", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).mapInArrow(work, "doc_id long, print long" + ", key long" * len(extra))


def linked(prints: DataFrame) -> DataFrame:
    """(a, b), a != b: every pair of distinct fingerprints that differ in at most two bits, once."""
    high = F.shiftrightunsigned("print", 32)
    low = F.col("print").bitwiseAND(F.lit(_LOW))
    table = prints.select("print", F.explode(F.array(F.struct(F.lit(0).alias("half"), high.alias("key")), F.struct(F.lit(1).alias("half"), low.alias("key")))).alias("e")).select(F.col("print").alias("b"), "e.half", "e.key")
    # one bit of the first half: only zero bits are set, so that a pair is met from one of its sides
    ball = F.array(*(F.when(high.bitwiseAND(F.lit(1 << k)) == 0, F.struct(F.lit(0).alias("half"), high.bitwiseOR(F.lit(1 << k)).alias("key"), F.lit(True).alias("flipped"))) for k in range(32)))
    equal = F.array(F.struct(F.lit(0).alias("half"), high.alias("key"), F.lit(False).alias("flipped")), F.struct(F.lit(1).alias("half"), low.alias("key"), F.lit(False).alias("flipped")))
    probes = prints.select(F.col("print").alias("a"), F.explode(F.concat(equal, F.filter(ball, lambda p: p.isNotNull()))).alias("e")).select("a", "e.*")
    met = probes.join(table, ["half", "key"]).filter((F.col("flipped") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _named(prints: DataFrame) -> DataFrame:
    """print, first (its least doc_id), root of its component."""
    distinct = durable(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected(linked(distinct.select("print")))
    return distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, print (long), component_id (the smallest doc_id reachable)."""
    prints = durable(fingerprints(docs, width), "simhash")
    named = _named(prints)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(smallest, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (id, key, n) names by id and text key, each once; the columns of ``docs`` may have any names."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = row.select("row", F.col("row.doc_id").cast("long").alias("id"), text_key(F.col("row.text")).alias("key"))
    rows = rows.alias("r").join(kept.alias("k"), (F.col("r.key") == F.col("k.key")) & F.col("r.id").eqNullSafe(F.col("k.id"))).select("row", F.col("k.id").alias("id"), F.col("k.key").alias("key"), F.col("k.n").alias("n"))
    once = rows.filter("n = 1").select("row")
    repeated = rows.filter("n > 1").dropDuplicates(["id", "key"]).select("row")
    return once.unionByName(repeated).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def text_key(text: Column) -> Column:
    """A key of a text; null and empty ones differ."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), text.isNull())


def first_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row, with all columns, of each component: that of the smallest doc_id.

    Rows that share doc_id and text are one record, of which any one stays.
    """
    key = text_key(F.col("text"))
    prints = durable(fingerprints(docs, width, key), "simhash")
    records = prints.groupBy("print", "doc_id", "key").agg(F.count("*").alias("n"))
    # a null doc_id comes after every other; a fingerprint that many rows share is one row before it meets its root
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "print")).alias("w")
    each = durable(records.groupBy("print").agg(least), "simhash-least")
    winner = each.join(_named(prints).select("print", "root"), "print").groupBy("root").agg(F.min("w").alias("w"))
    kept = winner.select("w.doc_id", "w.key", "w.print").join(records.withColumnsRenamed({"doc_id": "d", "key": "k", "print": "p"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("print") == F.col("p"))).select(F.col("d").alias("id"), F.col("k").alias("key"), "n")
    return _rows_of(docs, kept)


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as sorted arrays; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Counts of a sketch; texts from which frequent shingles are learnt (they settle an order, and no result): 1 in LEARNT_SHARE, and LEARNT_FROM at least.
SKETCH = 256
LEARNT_FROM = 4_000
LEARNT_SHARE = 16
FREQUENT = 4
MOST_FREQUENT = 1_000_000
#: Rows of a place whose texts are tried with one of them, and members of a centre in a task.
CROWD = 16
#: Shingles of a place's texts for each pair of them, if it is to make its pairs and no differences.
PAIR = 20
PER_TASK = 256
#: Text bytes whose shingles a worker holds at once.
NODE_BYTES = 512 << 10
_PLACE_BITS = 40


def frequent_shingles(docs: DataFrame, key: Column, width: int) -> np.ndarray:
    """Sorted hashes that FREQUENT or more texts hold, as told from those drawn (of which two at least hold it), MOST_FREQUENT at most."""
    share = min(LEARNT_SHARE, max(1, docs.count() // LEARNT_FROM))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "text"):
            sets = [shingle_set(t, width) for t in set(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64))], names=["h"])

    some = docs.filter(F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(share)) == 0).select(F.col("text").cast("string").alias("text"))
    often = some.mapInArrow(work, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, FREQUENT // share)).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toPandas()
    return np.sort(often["h"].to_numpy(dtype=np.int64).view(np.uint64))


def first_shingles(own: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's shingles, frequent ones last: sets of similarity ``least`` or more have one of these in common."""
    if not len(own):
        return np.zeros(1, dtype=np.uint64)  # texts without shingles meet each other
    at = np.minimum(np.searchsorted(often, own), max(0, len(often) - 1))
    last = often[at] == own if len(often) else np.zeros(len(own), dtype=bool)
    return np.concatenate([own[~last], own[last]])[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall in each of SKETCH classes, up to 255."""
    return np.minimum(np.bincount((own >> np.uint64(7)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def parity(own: np.ndarray) -> np.ndarray:
    """SKETCH bits (as longs), each set if a class holds an odd number of shingles: two sets differ in no fewer shingles than bits."""
    odd = np.bincount((own >> np.uint64(7)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _nodes(docs: DataFrame, width: int, key: Column, least: float) -> DataFrame:
    """key, n (shingles), print, sketch, places (of the first shingles, in order); copies within a task are left out."""
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, key, width))
    schema = "key long, n int, print long, sketch binary, places array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        # a text's votes for its fingerprint take many times its bytes
        for batch in byte_chunks(batches, "text", NODE_BYTES):
            out = []
            for k, text in zip(batch.column("key").to_pylist(), texts_of(batch), strict=True):
                if k not in seen:
                    seen.add(k)
                    hashes = np.array(shingle_hashes(text, width), dtype=np.uint64)
                    own = np.unique(hashes)
                    out.append((k, own, hashes))
            prints = majority(np.concatenate([np.zeros(0, dtype=np.uint64), *(h for _, _, h in out)]), [len(h) for _, _, h in out]).view(np.int64)
            places = [(first_shingles(own, often.value, least) & np.uint64((1 << _PLACE_BITS) - 1)).view(np.int64) for _, own, _ in out]
            ends = np.cumsum([0, *map(len, places)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *places])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in out], pa.int64()), pa.array([len(o) for _, o, _ in out], pa.int32()), pa.array(prints), pa.array([sketch(o) for _, o, _ in out], pa.binary()), lists], names=["key", "n", "print", "sketch", "places"])

    return docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def _may_be(x: str, y: str, least: float, first: bool = False) -> Column:
    """Can two sets be similar that have a shingle in common, each the at-th of its n?  Never false for those that are.

    With ``first``: can they, if it is the first that they have in common?
    """
    n, m, i, j = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.at", f"{y}.at"))
    most = (F.lit(0) if first else F.least(i, j)) + 1 + F.least(n - i - 1, m - j - 1)
    return (n == 0) & (m == 0) | (n > 0) & (m > 0) & (most >= least / (1 + least) * (n + m) - 1e-6)


def meetings(nodes: DataFrame) -> DataFrame:
    """place, key, n, at, print, crowd (rows of the place): one row for each text at each place where it meets another."""
    placed = nodes.select("key", "n", "print", F.posexplode("places").alias("at", "place"))
    # what a place sorts by: size, then key, so that copies of a text are next to each other
    packed = placed.select("place", (F.col("n").cast("long") * (1 << 31) + F.col("at")).alias("size"), "key", "print")
    order = Window.partitionBy("place").orderBy("size", "key")
    own = packed.select("*", F.lag("key").over(order).alias("before"), F.lag("size").over(order).alias("size_before"), F.lead("key").over(order).alias("after"), F.count("*").over(Window.partitionBy("place")).cast("int").alias("crowd"))
    once = own.filter((F.col("before").isNull() | (F.col("before") != F.col("key")) | (F.col("size_before") != F.col("size"))) & (F.col("before").isNotNull() | F.col("after").isNotNull()))
    return once.select("place", "key", F.shiftright("size", 31).cast("int").alias("n"), F.col("size").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("at"), "print", "crowd")


def centres(met: DataFrame) -> DataFrame:
    """place, centre (key, n, at, print): of each crowded place the text whose fingerprint is nearest to what most bits of all are."""
    crowded = met.filter(F.col("crowd") >= CROWD)
    bits = [F.when(2 * F.sum(F.getbit("print", F.lit(b))) > F.count("*"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    middle = crowded.groupBy("place").agg(*(b.cast("long").alias(f"b{i}") for i, b in enumerate(bits)))
    middle = middle.select("place", reduce(Column.bitwiseOR, (F.col(f"b{i}") for i in range(64))).alias("middle"))
    far = F.bit_count(F.col("print").bitwiseXOR(F.col("middle")))
    return crowded.join(middle, "place").groupBy("place").agg(F.min(F.struct(far.alias("far"), "key", "n", "at", "print")).alias("c")).select("place", F.struct("c.key", "c.n", "c.at", "c.print").alias("centre"))


def first_pairs(met: DataFrame, middles: DataFrame, least: float) -> DataFrame:
    """a < b, d: each text of a place with the one before it, the first one and its centre, if they can be similar; d is what their fingerprints differ in."""
    order = Window.partitionBy("place").orderBy("n", "at", "key")
    me = F.struct("key", "n", "at", "print")
    beside = met.select(me.alias("x"), F.lag(me).over(order).alias("y1"), F.first(me).over(order).alias("y0"))
    either = met.select("place", me.alias("x")).join(middles.withColumnRenamed("centre", "y"), "place").select("x", "y").filter("x.key <> y.key").filter(_may_be("x", "y", least))
    for y in ("y0", "y1"):
        pairs = beside.select("x", F.col(y).alias("y")).filter("y IS NOT NULL AND x.key <> y.key").filter(_may_be("x", "y", least))
        either = either.unionByName(pairs)
    return _named_pairs(either)


def other_pairs(docs: DataFrame, met: DataFrame, middles: DataFrame, roots: DataFrame, key: Column, width: int, least: float) -> DataFrame:
    """The same of all texts that share a place, can be similar and are under different ``roots`` (node, root).

    All that were to be tried with a centre must be linked to it in ``roots``, if they are similar to it.
    """
    under = met.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = under.groupBy("place").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter("low <> high")
    # pairs are made where they are far fewer than the differences would be
    open_ = open_.select("place", ((F.col("rows") >= CROWD) & (PAIR * F.col("rows") * (F.col("rows") - 1) > 2 * F.col("shingles"))).alias("crowded"))
    open_ = durable(under.join(open_, "place"), "similar-open")
    left = open_.filter("NOT crowded").select("place", "root", F.struct("key", "n", "at", "print").alias("x"))
    right = left.select("place", F.col("root").alias("other"), F.col("x").alias("y"))
    few = left.join(right, "place").filter("root < other").filter(_may_be("x", "y", least, first=True)).select("x", "y")
    members = open_.filter("crowded").join(middles, "place").select(F.col("centre.key").alias("centre"), "key", "n", "print", "root").dropDuplicates(["centre", "key"])
    parts = durable(differences(docs, durable(members, "similar-members"), key, width, least), "similar-differences")
    return _named_pairs(few.unionByName(_differing(parts, least)))


def difference(own: np.ndarray, centre: np.ndarray, least: float) -> tuple[np.ndarray, int, bool, int]:
    """First shingles in which a set differs from ``centre``, all of these, is it unlike the centre, and how many of the first an unlike partner needs.

    What the set has and the centre lacks comes first.  Let D be these differences.  Two sets
    of n and m shingles are similar if |D| + |D'| - 2 |D and D'| <= g (n + m), g = (1 - least) /
    (1 + least).  If both are like the centre, both are linked to it already.  If D' is of a set
    unlike it, |D'| > g (m + |centre|); with n <= |centre| + |D| more than (1 - g) |D| / 2 is
    common to both, so that the first (1 + g) |D| / 2 of D hold one.  A set unlike the centre
    meets those like it by the first (1 - least) / least n, as |D'| >= |D| - g (n + m).
    """
    more, fewer = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
    every = np.concatenate([more, fewer])
    far = jaccard(own, centre) < least
    g = (1 - least) / (1 + least)
    short = min(len(every), int((1 + g) * len(every) / 2 + 1e-6) + 1)
    long = min(len(every), int((1 - least) / least * len(own) + 1e-6) + 1)
    return every[: max(short, long) if far else short], len(every), far, short


def differences(docs: DataFrame, members: DataFrame, key: Column, width: int, least: float) -> DataFrame:
    """For each of ``members`` (centre, key, n, print, root) the differences by which it meets others: centre, place, at (of ``of``), far, near (may it meet those that are far by this one?), and its parity."""
    asked = members.select(F.explode(F.array("centre", "key")).alias("_key")).distinct()
    texts = durable(docs.select(key.alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(asked, "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text")), "similar-texts")
    # a centre's text goes to as many tasks as its members ask for
    tasks = members.groupBy("centre").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("tasks"))
    middle = tasks.join(texts.withColumnsRenamed({"_key": "centre", "_text": "t"}), "centre").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    dealt = members.join(tasks, "centre").withColumn("task", F.pmod(F.xxhash64("key"), F.col("tasks")).cast("int")).drop("tasks")
    both = dealt.join(texts.withColumnsRenamed({"_key": "key", "_text": "s"}), "key").join(middle, ["centre", "task"])
    names, words_ = ["centre", "key", "n", "print", "root"], [f"p{k}" for k in range(SKETCH // 64)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch in byte_chunks(batches, "s", NODE_BYTES):
            found, bits = [], []
            for c, s, t in zip(*(batch.column(x).to_pylist() for x in ("centre", "s", "t")), strict=True):
                if c != last:
                    last, centre = c, shingle_set(t, width)
                own = shingle_set(s, width)
                found.append(difference(own, centre, least))
                bits.append(parity(own))
            counts = np.array([len(f[0]) for f in found], dtype=np.int64)
            row = np.repeat(np.arange(len(found)), counts)
            at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            of, far, short = (np.array([f[k] for f in found], dtype=d)[row] for k, d in ((1, np.int32), (2, np.bool_), (3, np.int64)))
            place = np.concatenate([np.zeros(0, dtype=np.uint64), *(f[0] for f in found)]).view(np.int64)
            same = batch.select(names).take(pa.array(row)).columns
            words = np.stack(bits)[row]
            yield pa.RecordBatch.from_arrays([*same, pa.array(place), pa.array(at.astype(np.int32)), pa.array(of), pa.array(far), pa.array(at < short), *(pa.array(words[:, k].copy()) for k in range(SKETCH // 64))], names=[*names, "place", "at", "of", "far", "near", *words_])

    return both.select(*names, "s", "t").mapInArrow(work, "centre long, key long, n int, print long, root long, place long, at int, of int, far boolean, near boolean" + "".join(f", {w} long" for w in words_))


def _differing(parts: DataFrame, least: float) -> DataFrame:
    """x, y (key, print): members of a centre that are under different roots and can be similar, if what they meet by is the first difference they share."""
    x = parts.filter("far").select("centre", "place", F.struct(*parts.columns[1:]).alias("x"))
    y = parts.filter("near").select("centre", "place", F.struct(*parts.columns[1:]).alias("y"))
    most = F.least(F.col("x.of") - F.col("x.at"), F.col("y.of") - F.col("y.at"))
    room = (1 - least) / (1 + least) * (F.col("x.n") + F.col("y.n"))
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(SKETCH // 64)))
    met = x.join(y, ["centre", "place"]).filter("x.root <> y.root AND (NOT y.far OR x.near AND x.key < y.key)").filter((2 * most >= F.col("x.of") + F.col("y.of") - room - 1e-6) & (apart <= room + 1e-6))
    return met.select(*(F.struct(*(F.col(f"{c}.{f}").alias(f) for f in ("key", "n", "at", "print"))).alias(c) for c in "xy"))


def _named_pairs(pairs: DataFrame) -> DataFrame:
    d = F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print")))
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), d.alias("d")).distinct()


def sketched(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose sketches leave room for the similarity: none that have it are dropped."""
    for c in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("key").alias(c), F.col("sketch").alias(f"{c}_sketch"), F.col("n").alias(f"{c}_n")), c)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(f"{c}_sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) for c in ("a", "b"))
            n, m = (batch.column(f"{c}_n").to_numpy().astype(np.int64) for c in ("a", "b"))
            both = np.minimum(s, t).sum(axis=1, dtype=np.int64)
            full = ((s == 255) & (t == 255)).any(axis=1)  # counts that were cut say nothing
            near = full | (both >= least / (1 + least) * (n + m) - 1e-6)
            yield batch.select(["a", "b", "d"]).filter(pa.array(near))

    return pairs.select("a", "b", "d", "a_sketch", "b_sketch", "a_n", "b_n").mapInArrow(work, "a long, b long, d int")


def verified(docs: DataFrame, pairs: DataFrame, key: Column, width: int, least: float) -> DataFrame:
    """Those (a, b) of ``pairs`` of keys whose texts have a Jaccard similarity of ``least`` or more."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    texts = docs.select(key.alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(asked, "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text"))
    met = pairs.select("a", "b").join(texts.withColumnsRenamed({"_key": "a", "_text": "s"}), "a").join(texts.withColumnsRenamed({"_key": "b", "_text": "t"}), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "s", NODE_BYTES):
            alike = [jaccard(shingle_set(s, width), shingle_set(t, width)) >= least for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(alike, type=pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return met.mapInArrow(work, "a long, b long")


def similar_links(docs: DataFrame, pairs: DataFrame, links: DataFrame, roots: DataFrame, key: Column, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``links`` and, of ``pairs``, as many that are similar as join all they can join; and the ``roots`` (node, root) under them.

    At first each key verifies only its nearest pair; then all pairs that still run between
    two components are.  A pair within a component has nothing to add.
    """
    left = pairs
    for nearest in (True, False):
        left_now = left
        for c in ("a", "b"):
            left_now = left_now.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
        left = durable(left_now.filter("ra != rb").select("a", "b", "d"), "similar-left")
        if left.isEmpty():
            break
        now = left.select("a", "b")
        if nearest:
            ends = left.select("a", "b", "d", F.explode(F.array("a", "b")).alias("end"))
            now = ends.groupBy("end").agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
            now = durable(now, "similar-nearest")
        fresh = verified(docs, now, key, width, least)
        links = durable(links.unionByName(fresh), "similar-links")
        roots = connected(links)
        left = left.join(now, ["a", "b"], "left_anti") if nearest else left
    return links, roots


def similar_roots(docs: DataFrame, key: Column, width: int, least: float) -> DataFrame:
    """node, root of the components of texts, by their keys; texts that are like no other may be left out."""
    spark = docs.sparkSession
    nodes = durable(_nodes(docs, width, key, least), "similar-nodes")
    met = durable(meetings(nodes), "similar-met")
    once = durable(nodes.select("key", "n", "sketch").dropDuplicates(["key"]).join(met.select("key").distinct(), "key", "left_semi"), "similar-sketches")
    discard(nodes)
    release(spark)
    middles = durable(centres(met), "similar-centres")
    # (empty tables of createDataFrame would be read by Python workers of their own)
    none = (spark.range(0).select(F.col("id").alias(x), F.col("id").alias(y)) for x, y in (("a", "b"), ("node", "root")))
    tried = durable(sketched(first_pairs(met, middles, least), once, least), "similar-pairs")
    links, roots = similar_links(docs, tried, *none, key, width, least)
    more = sketched(other_pairs(docs, met, middles, roots, key, width, least).join(tried, ["a", "b"], "left_anti"), once, least)
    more = durable(more, "similar-pairs")
    discard(met, middles, once, tried)
    release(spark)
    return similar_links(docs, more, links, roots, key, width, least)[1]


def first_of_similar(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row, with all columns, of each component of similar texts: that of the smallest doc_id, a null being the largest.

    Rows that share doc_id and text are one record, of which any one stays.
    """
    key = text_key(F.col("text"))
    prints = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key")), "similar")
    with bounded_batches(docs.sparkSession):
        roots = similar_roots(docs, key, width, least)
    records = prints.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("w")
    each = durable(records.groupBy("key").agg(best), "similar-least")
    winner = each.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).groupBy("root").agg(F.min("w").alias("w"))
    kept = winner.select("w.doc_id", "w.key").join(records.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select(F.col("d").alias("id"), F.col("k").alias("key"), "n")
    return _rows_of(docs, kept)
