"""Nearest neighbours by inner product through multi-index hashing of learned rotated binary codes.

Vectors become 64-bit codes: the signs after a PCA and a rotation learned (iterative
quantization) on a bounded sample.  A code is split into substrings; every shard of the
index holds a table for each substring.  If two codes differ in at most r bits, some
substring differs in at most floor(r / substrings) bits, so probing those balls in every
table retrieves every code within r; whatever is met is verified over all bits and then
reranked by the exact inner product.  The radius is the smallest that covers ``coverage``
of the true neighbours among the sample, found there by brute force.

The queries are dealt in blocks of bounded size, each broadcast and run against all shards
of the index; the index itself is never shuffled again.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part; vectors of one length meet each other and no others, for there is no inner
product between lengths; rows that share a vec_id are rows of their own, as candidates and
as queries; a row with a null vec_id is a candidate (its id comes last in ties) and never a
query; a query meets every other row of its length and gets all if there are fewer than k;
an empty table gives an empty result; columns other than vec_id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions_for

BITS = 64
SUBSTRINGS = 8
WIDTH = BITS // SUBSTRINGS
#: Vectors in one shard of the index; the number of shards follows from the table.
SHARD_ROWS = 16_384
#: Queries broadcast at a time.
BLOCK_QUERIES = 4_096
#: Vectors from which rotation and radius are learned.
SAMPLE_ROWS = 8_192


def balls(radius: int) -> np.ndarray:
    """All WIDTH-bit masks of at most ``radius`` bits, the lightest first."""
    return np.array([sum(1 << b for b in c) for n in range(min(radius, WIDTH) + 1) for c in combinations(range(WIDTH), n)], dtype=np.int64)


@dataclass
class Coder:
    """Codes of vectors: signs of (v - mean) @ rotation.  ``scale``: largest norm, for the reduction of inner products to angles."""

    mean: np.ndarray
    rotation: np.ndarray
    scale: float
    radius: int

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose order by angle is that by inner product with any query."""
        norms = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.hstack([x / norms[:, None], np.zeros((len(x), 1))])
        return np.hstack([x / self.scale, np.sqrt(np.maximum(0, 1 - (norms / self.scale) ** 2))[:, None]])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        signs = (self.lifted(x, query) - self.mean) @ self.rotation > 0
        return np.ascontiguousarray(np.packbits(signs, axis=1, bitorder="little")).view("<u8").ravel()


def learn(sample: np.ndarray, scale: float, k: int, coverage: float, rounds: int = 25, queries: int = 256) -> Coder:
    """Rotation and radius from sample rows."""
    rng = np.random.default_rng(11)
    coder = Coder(np.zeros(1), np.zeros((1, 1)), scale, BITS)
    z = coder.lifted(sample, query=False)
    coder.mean = z.mean(axis=0)
    z = z - coder.mean
    values, axes = np.linalg.eigh(z.T @ z / max(1, len(z)))
    axes = axes[:, np.argsort(-values)]
    parts, bits = [], BITS
    while bits > 0:  # fewer dimensions than bits: several rotations
        n = min(bits, axes.shape[1])
        low = z @ axes[:, :n]
        turn = np.linalg.qr(rng.normal(size=(n, n)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        parts.append(axes[:, :n] @ turn)
        bits -= n
    coder.rotation = np.hstack(parts)
    asked = sample[: min(queries, len(sample))]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
    away = np.bitwise_count(coder.codes(asked, query=True)[:, None] ^ coder.codes(sample)[near])
    coder.radius = int(np.sort(away.ravel())[min(away.size - 1, int(np.ceil(coverage * away.size)))])
    return coder


class Shard:
    """The tables of one part of the index."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, coder: Coder) -> None:
        """``rows`` are the numbers of the rows in the whole table, ``ids`` what settles ties."""
        self.numbers, self.ids, self.x, self.coder = rows, ids, x, coder
        self.codes = coder.codes(x)
        parts = self.codes[:, None] >> np.arange(0, BITS, WIDTH, dtype=np.uint64) & np.uint64((1 << WIDTH) - 1)
        self.rows = [np.argsort(parts[:, j], kind="stable").astype(np.int32) for j in range(SUBSTRINGS)]
        self.bounds = [np.searchsorted(parts[self.rows[j], j], np.arange((1 << WIDTH) + 1)) for j in range(SUBSTRINGS)]
        self.masks = balls(coder.radius // SUBSTRINGS)

    def within(self, code: int) -> np.ndarray:
        """Rows whose code is within the radius, by probing every table."""
        met = np.zeros(len(self.ids), dtype=bool)
        for j in range(SUBSTRINGS):
            values = (code >> (WIDTH * j) & ((1 << WIDTH) - 1)) ^ self.masks
            rows, begin, end = self.rows[j], self.bounds[j][values], self.bounds[j][values + 1]
            for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                if e > s:
                    met[rows[s:e]] = True
        found = np.flatnonzero(met)
        return found[np.bitwise_count(self.codes[found] ^ np.uint64(code)) <= self.coder.radius]

    def nearest(self, row: int, q: np.ndarray, code: int, k: int) -> list[tuple[int, int, float]]:
        """(row number, vec_id, score) of the k nearest to the query that is row ``row``."""
        found = self.within(code)
        if len(found) <= k:  # too few: take the next nearest codes, however far
            away = np.bitwise_count(self.codes ^ np.uint64(code))
            limit = np.partition(away, min(k, len(away) - 1))[min(k, len(away) - 1)]
            found = np.flatnonzero(away <= max(limit, self.coder.radius))
        found = found[self.numbers[found] != row]
        rough = self.x[found] @ q
        if len(found) > k:
            # a product's last bits depend on how it is summed: keep whatever may tie, then sum row by row
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * max(1.0, float(np.abs(rough).max()))]
        scores = (self.x[found] * q).sum(axis=1)
        order = np.lexsort((self.numbers[found], self.ids[found], -scores))[:k]
        return list(zip(self.numbers[found][order].tolist(), self.ids[found][order].tolist(), scores[order].tolist(), strict=True))


#: Stands for a null vec_id inside tasks.
NO_ID = (1 << 63) - 1


def valid(vectors: DataFrame, column: str) -> DataFrame:
    """row (a number), vec_id and v (array of double) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def search(vectors: DataFrame, is_query: Column, k: int = 20, column: str = "embedding", coverage: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` (over vec_id) holds."""
    spark = vectors.sparkSession
    rows = durable(valid(vectors, column), "vectors")
    # one row for each length that occurs, which is one length in tables of one model
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, c: t + c * c))).alias("top")).collect()
    found = spark.createDataFrame([], "query_row long, query_id long, row long, vec_id long, score double")
    for own in sizes:
        found = found.unionByName(_of_length(rows.filter(F.size("v") == own["d"]), own["n"], own["top"], own["d"], is_query, k, coverage))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, n: int, top: float, dimension: int, is_query: Column, k: int, coverage: float) -> DataFrame:
    """query_row, query_id, row, vec_id, score: the k nearest of each query in each shard, among vectors of one length."""
    spark = rows.sparkSession
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE_ROWS).toPandas()
    coder = learn(np.array(picked["v"].tolist(), dtype=np.float64), float(top) * (1 + 1e-12), k, coverage)
    index = rows.repartition(partitions_for(spark, n, SHARD_ROWS), "row").select("row", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v")
    asked = rows.filter(is_query & F.col("vec_id").isNotNull())
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    found = None
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("row").toPandas()
        shared = spark.sparkContext.broadcast((block["row"].to_numpy(dtype=np.int64), block["vec_id"].to_numpy(dtype=np.int64), np.array(block["v"].tolist(), dtype=np.float64).reshape(-1, dimension), coder))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_rows, query_ids, queries, own = shared.value
            held = [b for b in batches if b.num_rows]
            if not held or not len(query_ids):
                return
            numbers, ids = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("row", "vec_id"))
            shard = Shard(numbers, ids, np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in held]), own)
            codes = own.codes(queries, query=True).tolist()
            for at in range(0, len(query_ids), 512):
                out = [(r, i, *hit) for r, i, q, c in zip(query_rows[at : at + 512].tolist(), query_ids[at : at + 512].tolist(), queries[at : at + 512], codes[at : at + 512], strict=True) for hit in shard.nearest(r, q, c, k)]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["query_row", "query_id", "row", "vec_id", "score"])

        part = index.mapInArrow(work, "query_row long, query_id long, row long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("vec_id", F.nullif("vec_id", F.lit(NO_ID)))
