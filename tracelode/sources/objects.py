"""JSON objects of trace files: arrays, single documents or one object a line, with their order kept."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import held

#: Characters of objects that a worker hands on at once.
BATCH_BYTES = 4 << 20

# Keys that mark a whole-file object as a trace and not as one event.
CONTAINER_KEYS = ("steps", "messages", "run_type", "trace_id", "type", "resourceSpans", "scopeSpans", "instrumentationLibrarySpans", "tasks_output", "final_output", "chat_history", "tasks")


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, value: whole files, directories being walked; files that cannot be read are left out."""
    return _reader(spark).text(list(paths) if not isinstance(paths, str) else paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _reader(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.json*")


def trace_objects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, ord, obj of all trace files under ``paths``, to be given to a loader in place of whole files.

    Files of one object a line are read in splits, so a long log is many tasks; a line's
    number is the start of its split and its place in there, which keeps the order of lines
    and names each once.  An array of more than a split is cut into its elements in splits
    too (``array_objects``).  Only other files that are one document are read whole.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    arrays = long_arrays(spark, paths)
    found = array_objects(spark, arrays) if arrays else None
    if arrays:
        # the same file may be file:/x in one listing and file:///x in another
        place = lambda p: tuple(urlsplit(p))[1:3]
        known = set(map(place, arrays))
        paths = [p for p in map(unquote, _reader(spark).text(paths).inputFiles()) if place(p) not in known]
    if not paths:
        return found
    lines = _reader(spark).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    begins = lines.filter("block = 0").groupBy("path").agg(F.min_by(F.trim("value"), F.when(F.trim("value") != "", F.col("id"))).alias("first"))
    by_line = begins.filter(F.col("first").startswith("{") & is_json(F.col("first"))).select("path")
    splits = lines.groupBy("path", "block").agg(F.min("id").alias("from"))
    each = lines.join(by_line, "path", "left_semi").join(splits, ["path", "block"]).select("path", (F.col("block") + F.col("id") - F.col("from")).alias("ord"), F.trim("value").alias("obj"))
    kept = each.filter(F.col("obj").startswith("{") & is_json(F.col("obj")))
    whole = text_files(spark, paths).join(by_line, "path", "left_anti")
    out = kept.unionByName(objects(whole).withColumn("ord", F.col("ord").cast("long")))
    return out if found is None else out.unionByName(found)


# ---------------------------------------------------------------- arrays in splits
# Pieces of a file end at its closing braces, wherever they stand, so that any file is read
# in splits.  A piece in the middle of a file cannot tell whether it begins inside a string,
# nor how deep; what it does from either beginning can be told, and put together.
_TOKENS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_STATE = "path string, block long, inside boolean, depth long, since long"


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, block, value: what stands between closing braces, in order within a block."""
    return _reader(spark).option("lineSep", "}").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def long_arrays(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files that begin with a bracket and are longer than a split; the driver lists files anyway."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    heads = _reader(spark).option("lineSep", "}").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_extract("value", r"^\s*(.)", 1).alias("head"))
    first = heads.filter((F.col("size") > most) & (F.col("block") == 0)).groupBy("path").agg(F.min_by("head", "id").alias("head"))
    return sorted(unquote(r["path"]) for r in first.filter("head = '['").select("path").collect())


class _Walk:
    """Where a text is, in strings and depth, as its pieces go by."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.lowest = inside, depth, depth

    def over(self, piece: str) -> Iterator[tuple[int, str, int]]:
        """Place, token and depth after it, of each bracket outside strings."""
        for m in _TOKENS.finditer(piece):
            token = m.group()
            if token == '"':
                self.inside = not self.inside
            elif not self.inside and len(token) == 1:
                self.depth += 1 if token in "{[" else -1
                self.lowest = min(self.lowest, self.depth)
                yield m.start(), token, self.depth

    def brace(self) -> bool:
        """The brace that ends a piece; is it one of the document, and not of a string?"""
        if not self.inside:
            self.depth -= 1
            self.lowest = min(self.lowest, self.depth)
        return not self.inside


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str]]:
    for batch in batches:
        yield from ((r, r["value"]) for r in batch.to_pylist())


def block_effects(pieces: DataFrame) -> DataFrame:
    """path, block, and for a beginning outside (0) and inside (1) a string: whether it ends inside, how much deeper it ends, and how deep it gets at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walks, done = None, (), []
        for row, piece in _blocks(batches):
            if (row["path"], row["block"]) != now:
                if now:
                    done.append((*now, *(x for w in walks for x in (w.inside, w.depth, w.lowest))))
                now, walks = (row["path"], row["block"]), (_Walk(False, 0), _Walk(True, 0))
            for w in walks:
                for _ in w.over(piece):
                    pass
                w.brace()
        if now:
            done.append((*now, *(x for w in walks for x in (w.inside, w.depth, w.lowest))))
        columns = list(zip(*done, strict=True)) or [()] * 8
        kinds = [pa.string(), pa.int64(), *[pa.bool_(), pa.int64(), pa.int64()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "block", "in0", "by0", "low0", "in1", "by1", "low1"])

    return pieces.mapInArrow(work, "path string, block long, in0 boolean, by0 long, low0 long, in1 boolean, by1 long, low1 long")


def block_states(effects: DataFrame) -> DataFrame:
    """path, block, inside, depth, since: where each block begins, and the block in which the element it begins in began.

    One row for each split of a file is gone through in order.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        inside, depth, since, out = False, 0, 0, []
        for r in frame.sort_values("block").itertuples():
            out.append((r.path, r.block, inside, depth, since))
            by, low, ends = (r.by1, r.low1, r.in1) if inside else (r.by0, r.low0, r.in0)
            # an element that was open stays the same only if the block never leaves it
            since = since if depth > 1 and depth + low > 1 else r.block
            inside, depth = ends, depth + by
        return pd.DataFrame(out, columns=["path", "block", "inside", "depth", "since"])

    return effects.groupBy("path").applyInPandas(work, _STATE)


def array_objects(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, ord, obj of the objects in arrays, one array a file, read in splits.

    Elements that are no objects, or not well formed by themselves, are skipped.  An element
    across splits is put together from its parts; all others stay where they are read.
    """
    pieces = _pieces(spark, paths)
    # one row for each split
    states = F.broadcast(block_states(block_effects(pieces)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "since", "block", "ord", "obj", "whole"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        out: list[tuple] = []
        size = 0
        now, walk, open_, since, count, place = None, _Walk(False, 0), None, 0, 0, None

        def told(whole: bool) -> None:
            nonlocal size, open_
            out.append((*(now[0], since, now[1]), place, "".join(open_), whole))
            size, open_ = size + len(out[-1][4]), None

        for row, piece in _blocks(batches):
            if (row["path"], row["block"]) != now:
                if now and open_ is not None:
                    told(False)
                now, walk = (row["path"], row["block"]), _Walk(row["inside"], row["depth"])
                # what is open began in an earlier block, which knows its number
                open_, since, count, place = ([] if row["depth"] > 1 else None), row["since"], 0, None
            begin = 0
            for at, token, depth in walk.over(piece):
                if depth == 2 and token in "{[" and open_ is None:
                    open_, begin, since, place = [], at, now[1], now[1] + count
                    count += 1
                elif depth == 1 and token == "]" and open_ is not None:
                    # an array, which is no object: its parts are told, and fail as one
                    open_.append(piece[begin : at + 1])
                    told(since == now[1])
            if open_ is None:
                walk.brace()
                continue
            open_.append(piece[begin:] + "}")
            if walk.brace() and walk.depth == 1:
                told(since == now[1] and place is not None)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, size = [], 0
        if now and open_ is not None:
            told(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    cut = held(pieces.join(states, ["path", "block"]).mapInArrow(work, "path string, since long, block long, ord long, obj string, whole boolean"), "elements")
    parts = cut.filter(~F.col("whole")).groupBy("path", "since").agg(F.max("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("block", "obj"))).alias("p"))
    joined = parts.select("path", "ord", F.array_join(F.transform("p", lambda x: x["obj"]), "").alias("obj"))
    each = cut.filter("whole").select("path", "ord", "obj").unionByName(joined)
    return each.filter(F.col("obj").startswith("{") & is_json(F.col("obj")))


def objects(files: DataFrame) -> DataFrame:
    """path, ord, obj (JSON text) of whole files (path, value), or of what ``trace_objects`` has read: blank, malformed and non-object pieces are skipped."""
    if "obj" in files.columns:
        return files.select("path", "ord", "obj")
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    lines = F.split(text, r"\r?\n")
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    # the parser reads one value and ignores what follows, so a file whose first line is a value by itself is one of lines
    whole = is_json(text) & ((F.size(lines) == 1) | ~is_json(lines[0]))
    pieces = (
        F.when(text.startswith("[") & is_json(text), F.from_json(text, "array<string>"))
        .when(text.startswith("{") & whole & ((F.size(lines) == 1) | F.arrays_overlap(keys, F.array(*map(F.lit, CONTAINER_KEYS)))), F.array(text))
        .otherwise(lines)
    )
    each = files.select("path", F.posexplode(pieces).alias("ord", "obj")).withColumn("obj", F.trim("obj"))
    return each.filter(F.col("obj").startswith("{") & is_json(F.col("obj")))


def malformed(files: DataFrame) -> DataFrame:
    """path, ord, line: lines that are no JSON, for a corrupt-record table."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    return lines.filter((F.trim("line") != "") & ~is_json(F.col("line")))


def rename_parts(spark: SparkSession, folder: str, suffix: str) -> None:
    """Gives the part files that Spark wrote to ``folder`` the suffix by which readers find them."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = jvm.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), jvm.Path(base, name.split(".")[0] + suffix))
