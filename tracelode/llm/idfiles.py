"""Files of token ids: documents in ascending doc_id order, coded in independent, checksummed blocks.

A file is a Parquet envelope (so that any store that Spark writes will do) whose rows are
segments: whole documents, their ids and lengths under a checksum, and the coded blocks of
all their ids.  A segment whose parts do not fit each other raises ValueError when read.

Defined cases: null text counts as empty and has the end id alone; null doc_ids come first;
rows that share a doc_id come next to each other in any order; an empty table gives no
segments and an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idcoder
from .common import byte_chunks, partitions_for, texts_of
from .tokens import encoder

SEGMENT_IDS = idcoder.BLOCK * idcoder.LANES
#: Text bytes of a task, so that its ids fill about one segment.
TASK_BYTES = 24 << 20
#: Text bytes whose distinct words are looked up at once.
TEXT_BYTES = 8 << 20
SEGMENTS = "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, names_crc32 long, blocks binary"


def names_crc32(doc_ids: list, lengths: list) -> int:
    """The checksum of a segment's documents and their lengths."""
    return zlib.crc32(repr((doc_ids, lengths)).encode())


def segments(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The rows of the files: encoded segments of whole documents, parts and segments in doc_id order."""
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        vocabulary = max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            joined = np.frombuffer(b"".join(ids), dtype="<u4")
            ids.clear()
            blocks = idcoder.encode(joined, vocabulary)
            row = [[part], [number], [held], [list(doc_ids)], [lengths], [names_crc32(list(doc_ids), lengths)], [blocks]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(row, kinds, strict=True)], names=["part", "segment", "n_ids", "doc_ids", "lengths", "names_crc32", "blocks"])

        for batch in byte_chunks(batches, "text", TEXT_BYTES):
            for doc, own in zip(batch.column("doc_id").to_pylist(), coder.encode(texts_of(batch)), strict=True):
                own += end
                if held and held + len(own) // 4 > SEGMENT_IDS:
                    yield flush()
                    doc_ids.clear()
                    number, held = number + 1, 0
                ids.append(own)
                doc_ids.append(doc)
                held += len(own) // 4
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = partitions_for(docs.sparkSession, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, TASK_BYTES)
    # a doc_id that many rows share is spread over tasks by a second key
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(tasks, "doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    return rows.select("doc_id", "text").mapInArrow(work, SEGMENTS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    segments(docs, tokenizer, end_id).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded files."""
    files = spark.read.schema(SEGMENTS).parquet(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                doc_ids, lengths = row.column("doc_ids")[0].as_py(), row.column("lengths")[0].as_py()
                if names_crc32(doc_ids, lengths) != row.column("names_crc32")[0].as_py():
                    raise ValueError("checksum of a segment's documents does not match")
                data = idcoder.decode(row.column("blocks")[0].as_py()).tobytes()
                if not 4 * sum(lengths) == 4 * row.column("n_ids")[0].as_py() == len(data):
                    raise ValueError("a segment's blocks do not hold the ids of its documents")
                lengths = np.array(lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                n = len(lengths)
                crcs = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, type=pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, type=pa.int64()), pa.array([row.column("part")[0].as_py()] * n, type=pa.int32()), pa.array([row.column("segment")[0].as_py()] * n, type=pa.int32())], names=["doc_id", "within", "n_tokens", "ids_crc32", "part", "segment"])

    docs = files.mapInArrow(work, "doc_id long, within long, n_tokens long, ids_crc32 long, part int, segment int")
    # ids before a segment: those of earlier parts, and of earlier segments of its part
    sizes = files.select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("segment_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("first"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")
