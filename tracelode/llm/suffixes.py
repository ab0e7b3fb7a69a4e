"""Removal of repeated 200-byte strings by sorted suffixes (deep-shallow sorting).

Which suffixes must be compared is settled first.  Every start of a ``span``-byte string
has an anchor: the place of the least hash among the string's k-byte substrings, which
depends on the string's bytes alone.  Equal strings have anchors of equal hash, so only
starts whose anchor's hash occurs twice can repeat; their suffixes, cut to what they need,
are dealt by that hash and sorted.  Sorting is deep-shallow in its order of work: one sort
of all by 8 bytes, the shallow depth, then each group that still shares a prefix is
compared with its first member, 8 bytes at a time, and sorted and split where members
differ.  Multikey quicksort's pivots and blind tries are not built (see the README).
Suffixes that stay together to depth ``span`` repeat.

A hash that very many starts share (a passage in a large part of all documents) is dealt
over several tasks; strings that stay single there are matched across tasks by a 128-bit
digest, so no group is ever gathered in one task and nothing is dropped.

Defined cases: null text counts as empty; texts under ``span`` bytes lose nothing but can
be what others are compared with only from ``span`` bytes on; repeated rows are documents
of their own and so repeat each other; a null doc_id is kept; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, discard, durable, partitions_for, release, scratch

GRAM = 32
#: Bytes that are sorted before groups are compared with their first members.
SHALLOW = 8
#: Bytes for each start that may be compared at once, run by run.
WIDEST = 12
DOCS_PER_BUCKET = 4_000
SEGMENTS_PER_TASK = 16_000
#: Segments of one hash in one task; more are dealt over several tasks.
CROWD = 2_000


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, nulls empty, and the offsets of its values."""
    values = [v or b"" for v in column.to_pylist()]
    offsets = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return np.frombuffer(b"".join(values), dtype=np.uint8), offsets


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; places beyond the end count as zero bytes."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    words = words_at(data)
    out = words[:n].copy()
    for k in range(8, GRAM, 8):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out += words[k : k + n]
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x165667B19E3779F9)
    out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, first start, number of starts) for each anchor; starts are places in their text."""
    none = np.zeros(0, dtype=np.int64)
    hashes = gram_hashes(data)
    window = span - GRAM + 1
    if len(hashes) < window:
        return none, none, none, none
    # the hash decides, then the leftmost place
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= window:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < window:
        least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
    places = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(places)]
    starts = np.flatnonzero(np.arange(len(places)) + span <= offsets[1:][owner])
    if not len(starts):
        return none, none, none, none
    at = places[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    texts = owner[starts[first]]
    counts = np.diff(np.concatenate([first, [len(starts)]]))
    return texts, hashes[at[first]].view(np.int64), starts[first] - offsets[texts], counts


def _groups(fresh: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """For groups that begin where ``fresh``, without members that are alone (they are told apart from all others): the place of each member's first one, and ``columns``."""
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.concatenate([first, [len(fresh)]]))
    if (sizes == 1).any():
        keep = np.repeat(sizes > 1, sizes)
        columns, sizes = tuple(c[keep] for c in columns), sizes[sizes > 1]
    return np.repeat(np.cumsum(sizes) - sizes, sizes), *columns


def _agree(data: np.ndarray, at: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Does each start of ``at`` have the ``span`` bytes of its ``first``?  False may stand for true where neighbours have no common offset, which would be slow.

    Starts next to each other whose firsts are, too, share all bytes but one, so each run of them is compared once.
    """
    firsts = np.full(len(data), -1, dtype=np.int64)
    firsts[at] = first
    here = np.flatnonzero(firsts >= 0)
    there = firsts[here]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(here) != 1) | (np.diff(there) != 1)]))
    sizes = np.diff(np.concatenate([begins, [len(here)]])) + span - 1
    if sizes.sum() > WIDEST * len(at):
        return np.zeros(len(at), dtype=bool)
    base = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum()))
    differ = data[np.repeat(here[begins] - base, sizes) + step] != data[np.repeat(there[begins] - base, sizes) + step]
    before = np.zeros(len(differ) + 1, dtype=np.int32)
    np.cumsum(differ, dtype=np.int32, out=before[1:])
    place = np.repeat(base - begins, sizes - span + 1) + np.arange(len(here))
    same = np.zeros(len(data), dtype=bool)
    same[here] = before[place + span] == before[place]
    return same[at]


def repeated(data: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """A class number for each start: starts of one class (0 or more) have equal ``span`` bytes; single ones have -1."""
    if span % 8:
        raise ValueError("span must be a multiple of 8")
    classes = np.full(len(starts), -1, dtype=np.int64)
    words = words_at(data)
    # shallow: all in the order of their first bytes
    key = words[starts]
    members = np.argsort(key, kind="stable")
    key = key[members]
    lead, members = _groups(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)], members)
    at = starts[members]
    if len(members):
        # groups all of whose members have the bytes of their first one are classes
        open_ = np.zeros(len(members), dtype=bool)
        open_[lead[~_agree(data, at, at[lead], span)]] = True
        open_ = open_[lead]
        done, heads = members[~open_], lead[~open_]
        classes[done] = np.cumsum(np.concatenate([[True], heads[1:] != heads[:-1]])[: len(heads)]) - 1
        many = int(classes.max()) + 1
        lead, members = _groups((lead == np.arange(len(lead)))[open_], members[open_])
        at = starts[members]
    for depth in range(SHALLOW, span, 8):
        if not len(members):
            break
        # deep: groups whose members all agree with their first one stay as they are
        key = words[at + depth]
        other = lead[key != key[lead]]
        if not len(other):
            continue
        branch = np.zeros(len(key), dtype=bool)
        branch[other] = True
        some = np.flatnonzero(branch[lead])
        some_lead, some_key = lead[some], key[some]
        order = np.lexsort((some_key, some_lead))
        members[some], some_key = members[some][order], some_key[order]
        fresh = lead == np.arange(len(lead))
        fresh[some[1:]] |= some_key[1:] != some_key[:-1]
        lead, members = _groups(fresh, members)
        at = starts[members]
    if len(members):
        classes[members] = many + np.cumsum(lead == np.arange(len(lead))) - 1
    return classes


def _anchor_rows(docs: DataFrame, span: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "body"):
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            texts, hashes, first, counts = anchors(*flat_bytes(batch.column("body")), span)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(rid[texts] if len(texts) else texts), pa.array(first.astype(np.int32)), pa.array(counts.astype(np.int32))], names=["h", "rid", "first", "n"])

    return docs.select("rid", "body").mapInArrow(work, "h long, rid long, first int, n int")


def _segment_rows(joined: DataFrame, span: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "body"):
            out: list[list] = [[], [], [], [], [], []]
            for rid, body, found in zip(batch.column("rid").to_pylist(), batch.column("body").to_pylist(), batch.column("found").to_pylist(), strict=True):
                for a in found:
                    for column, value in zip(out, (a["h"], rid, a["first"], a["n"], a["tasks"], body[a["first"] : a["first"] + a["n"] - 1 + span]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=["h", "rid", "first", "n", "tasks", "segment"])

    return joined.mapInArrow(work, "h long, rid long, first int, n int, tasks int, segment binary")


def _sorted_rows(segments: DataFrame, span: int) -> DataFrame:
    """rid, first, last: runs of starts that repeat; digest set: a single start of a crowded hash, or (rid null) a class seen there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = flat_bytes(table.column("segment").combine_chunks())
        n = table.column("n").to_numpy().astype(np.int64)
        rid, place, tasks = table.column("rid").to_numpy(), table.column("first").to_numpy().astype(np.int64), table.column("tasks").to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[owner] + step
        classes = repeated(data, starts, span)
        hit = np.flatnonzero(classes >= 0)
        columns: list[list] = [[], [], [], []]
        if len(hit):
            fresh = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
            ends = np.concatenate([fresh[1:], [len(hit)]]) - 1
            a, b = hit[fresh], hit[ends]
            columns = [rid[owner[a]].tolist(), (place[owner[a]] + step[a]).tolist(), (place[owner[b]] + step[b]).tolist(), [None] * len(a)]
        crowded = np.flatnonzero(tasks[owner] > 1)
        if len(crowded):
            _, one = np.unique(classes[crowded], return_index=True)
            told = set(crowded[one].tolist())
            view = memoryview(data.tobytes())
            for i in crowded.tolist():
                if classes[i] < 0 or i in told:
                    single = classes[i] < 0
                    s = int(starts[i])
                    for column, value in zip(columns, (int(rid[owner[i]]) if single else None, int(place[owner[i]] + step[i]), int(place[owner[i]] + step[i]), hashlib.blake2b(view[s : s + span], digest_size=16).digest()), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["rid", "first", "last", "digest"])

    return segments.select("rid", "first", "n", "tasks", "segment").mapInArrow(work, "rid long, first long, last long, digest binary")


def _cleaned(joined: DataFrame, span: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "body"):
            removed, spans, digests, kept = [], [], [], []
            for body, runs in zip(batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for r in sorted(((r["first"], r["last"] + span) for r in runs or ())):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                parts, at = [], 0
                for a, b in merged:
                    parts.append(body[at:a])
                    at = b
                left = b"".join([*parts, body[at:]])
                removed.append(len(body) - len(left))
                spans.append(len(merged))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(spans, type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("doc_id", "body", "runs").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicate(docs: DataFrame, span: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left)."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    buckets = partitions_for(spark, docs.count(), DOCS_PER_BUCKET)
    if buckets > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", buckets)
    # one shuffle of the texts: the table is bucketed by row, so later joins move only the small side
    name = f"tracelode_texts_{uuid.uuid4().hex}"
    rows.repartition(buckets, "rid").write.format("parquet").option("compression", "zstd").option("path", scratch(spark, "texts")).bucketBy(buckets, "rid").saveAsTable(name)
    texts = spark.table(name)
    # the plan holds the files and their buckets by now; the name in the catalog is needed no more, and the files stay
    spark.sql(f"DROP TABLE {name}")
    release(spark)
    marks = durable(_anchor_rows(texts, span), "anchors")
    # written first, so that the join below has plain shuffles on both sides and a crowded hash can be split
    crowds = durable(marks.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h", F.ceil(F.col("c") / CROWD).cast("int").alias("tasks")), "crowds")
    found = marks.join(crowds, "h").groupBy("rid").agg(F.collect_list(F.struct("h", "first", "n", "tasks")).alias("found"))
    segments = durable(_segment_rows(texts.join(found.hint("shuffle_hash"), "rid").select("rid", "body", "found"), span), "segments")
    discard(marks, crowds)
    release(spark)
    tasks = partitions_for(spark, segments.count(), SEGMENTS_PER_TASK)
    dealt = segments.repartition(tasks, "h", F.pmod(F.xxhash64("rid"), F.col("tasks")))
    runs = durable(_sorted_rows(dealt, span), "runs")
    discard(segments)
    release(spark)
    singles = runs.filter("digest IS NOT NULL")
    across = singles.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1").select("digest")
    late = singles.filter("rid IS NOT NULL").join(across, "digest", "left_semi").select("rid", "first", "last")
    each = runs.filter("digest IS NULL").select("rid", "first", "last").unionByName(late).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return _cleaned(texts.join(each.hint("shuffle_hash"), "rid", "left"), span)
