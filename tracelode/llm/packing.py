"""Hierarchical residual best-fit packing of documents into sequences of bounded tokens.

Each task packs its items best-fit decreasing, emits its nearly full bins, and sends the
underfull ones on; those are the items of the next round, in fewer tasks.  A bin with less
room than the smallest waiting one holds is ready as well.  Two bins can only be joined if
one of them is at most half full, and best fit leaves at most one such bin in a task; so
the few half-full ones are dealt to the same tasks, where they meet each other and a share
of the rest.  Rounds end with one task, without any half-full bin, or when the half-full
ones have met and nothing was joined.

Defined cases: null text counts as empty (its end id alone makes a piece of length 1);
rows that repeat are packed as often as they occur; a null doc_id is kept; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, durable, partitions_for, texts_of
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = "sequence_id long, used long, done boolean, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
_BINS = pa.schema([("sequence_id", pa.int64()), ("used", pa.int64()), ("done", pa.bool_()), ("members", pa.list_(_MEMBER))])

#: Items that one task packs; the number of tasks follows from the number of items.
ITEMS_PER_TASK = 40_000
#: Tasks of a round whose underfull bins meet in one task of the next.
FAN_IN = 8
#: A bin with at most this share of the capacity free is nearly full.
SLACK = 1 / 128


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first is the remainder, the others are whole sequences."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document, with the checksum of its ids."""
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = encoder(tokenizer).encode, 0
        for batch in byte_chunks(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts_of(batch)), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), salt))
                    salt += 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes``: each item, the largest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        if left := room - size:
            by_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins


def _pack_round(items: DataFrame, number: int, capacity: int, last: bool) -> DataFrame:
    enough = capacity - int(capacity * SLACK)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("used").to_pylist(), b.column("members").to_pylist(), strict=True)]
        # the order of rows after a shuffle is not fixed; a task that is run again must pack alike
        rows.sort(key=lambda r: (-r[0], *(-1 if v is None else v for v in r[1][0].values())))
        first = (number << 52) | (TaskContext.get().partitionId() << 28)
        out = []
        for k, positions in enumerate(best_fit([r[0] for r in rows], capacity)):
            used = sum(rows[i][0] for i in positions)
            out.append({"sequence_id": first + k, "used": used, "done": last or used >= enough, "members": [m for i in positions for m in rows[i][1]]})
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_BINS)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=_BINS)

    return items.mapInArrow(work, BINS)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    cuts = durable(pieces(docs, tokenizer, capacity, end_id).withColumn("part", F.spark_partition_id()), "pieces")
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cuts.filter(F.col("length") == capacity).select(*fields, (F.col("part").cast("long") * (1 << 28) + F.col("salt")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cuts.filter(F.col("length") < capacity)
    waiting = items.count()
    tasks = partitions_for(spark, waiting, ITEMS_PER_TASK)
    items = items.repartition(tasks, "part", "salt").select(F.col("length").alias("used"), F.array(F.struct(*fields)).alias("members"))
    packed, number, met = [], 1, False
    while waiting:
        bins = durable(_pack_round(items, number, capacity, last=False), f"bins{number}")
        packed.append(bins.filter("done"))
        left = bins.filter("not done")
        made = left.agg(F.count("*").alias("n"), F.min("used").alias("least"), F.count_if(F.col("used") <= capacity // 2).alias("small")).first()
        joined = waiting - bins.count()
        if not made["n"] or tasks == 1 or not made["small"] or (met and not joined):
            packed.append(left)
            break
        # no waiting bin fits into these
        ready = F.col("used") > capacity - made["least"]
        packed.append(left.filter(ready))
        left = left.filter(~ready)
        waiting, number, met = left.count(), number + 1, True
        tasks = min(max(partitions_for(spark, waiting, ITEMS_PER_TASK), -(-tasks // FAN_IN) if waiting <= ITEMS_PER_TASK * tasks else tasks), tasks)
        together = partitions_for(spark, made["small"], ITEMS_PER_TASK)
        place = F.when(F.col("used") <= capacity // 2, F.pmod("sequence_id", F.lit(min(together, tasks)))).otherwise(F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)))
        items = left.select("used", "members", place.cast("int").alias("place")).repartition(tasks, "place").select("used", "members")
    result = whole
    for bins in packed:
        member = F.col("m")
        placed = F.aggregate(F.slice("members", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda total, m: total + m["length"])
        rows = bins.select("sequence_id", "members", F.posexplode("members").alias("i", "m"))
        result = result.unionByName(rows.select(*(member[f].alias(f) for f in fields), "sequence_id", placed.alias("offset")))
    return result
