"""Which format a file has: magic bytes of SQLite stores, else additive scores of its first objects."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RUN
from ..tables import scratch
from . import loaders, stores
from .objects import objects, trace_objects

# Formats in the order that settles ties.
FORMATS = ("canonical", "pi", "openai", "langsmith", "otel", "autogen", "crewai", "claude", "codex", "opencode", "antigravity")
OBJECTS_SNIFFED = 50
_TYPED = ("ToolCallRequestEvent", "ToolCallExecutionEvent")


def scores(obj: Column) -> dict[str, Column]:
    """Points that one object gives to each format."""
    keys = F.json_object_keys(obj)
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    kind, role = F.get_json_object(obj, "$.type"), F.get_json_object(obj, "$.role")
    inner = F.slice(F.coalesce(F.from_json(F.get_json_object(obj, "$.messages"), "array<string>"), F.array().cast("array<string>")), 1, 20)
    calls = F.exists(inner, lambda m: F.coalesce(F.array_contains(F.json_object_keys(m), F.lit("function_call")), F.lit(False)) | F.coalesce(F.get_json_object(m, "$.type").isin(*_TYPED), F.lit(False)))
    points = lambda *rules: sum((F.when(F.coalesce(c, F.lit(False)), F.lit(n)).otherwise(F.lit(0)) for c, n in rules), F.lit(0))
    pi_like = (F.array_contains(keys, F.lit("type")) & F.array_contains(keys, F.lit("message"))) | F.coalesce(kind.isin("session", "message", "model_change"), F.lit(False))
    return {
        "canonical": points((has("steps"), 3)),
        "pi": points((pi_like & ~has("parentUuid"), 3)),
        "openai": points((has("tool_call_id"), 3), (has("messages") | F.coalesce(role.isin("user", "assistant", "tool"), F.lit(False)), 2)),
        "langsmith": points((has("run_type", "trace_id"), 3)),
        "otel": points((has("resourceSpans", "scopeSpans", "instrumentationLibrarySpans"), 5)),
        "autogen": points((kind.isin(*_TYPED), 4), (has("chat_history", "function_call", "stop_reason"), 3), (calls, 3)),
        "crewai": points((has("tasks_output", "final_output"), 4)),
        "claude": points((has("parentUuid", "isSidechain"), 5)),
        "codex": points((kind.isin("session_meta", "response_item", "event_msg", "turn_context"), 5)),
    }


def detect(files: DataFrame) -> DataFrame:
    """path, format of text files (path, value); all-zero scores read as canonical."""
    each = objects(files)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    points = each.withColumn("_r", rank).filter(F.col("_r") <= OBJECTS_SNIFFED)
    total = points.groupBy("path").agg(*(F.sum(c).alias(f) for f, c in scores(F.col("obj")).items()))
    best = F.array_max(F.array(*(F.struct(F.col(f).alias("score"), F.lit(-FORMATS.index(f)).alias("o"), F.lit(f).alias("format")) for f in FORMATS[:9])))
    found = total.select("path", F.when(best["score"] > 0, best["format"]).otherwise("canonical").alias("format"))
    return files.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("format", F.lit("canonical")).alias("format"))


@F.pandas_udf(T.StringType())
def store_kind(contents: pd.Series) -> pd.Series:
    """opencode or antigravity by a store's tables; null for what is no such store."""

    def one(data):
        if not data or not bytes(data).startswith(b"SQLite format 3"):
            return None
        try:
            with sqlite3.connect(":memory:") as con:
                con.deserialize(bytes(data))
                tables = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
        except sqlite3.Error:
            return None
        return "opencode" if {"part", "session"} <= tables else "antigravity" if "steps" in tables else None

    return contents.map(one)


LOADERS = {
    "canonical": loaders.load_canonical,
    "pi": loaders.load_pi,
    "openai": loaders.load_openai,
    "langsmith": loaders.load_langsmith,
    "otel": loaders.load_otel,
    "autogen": loaders.load_autogen,
    "crewai": loaders.load_crewai,
    "claude": loaders.load_claude,
    "codex": loaders.load_codex,
    "opencode": stores.load_opencode,
    "antigravity": stores.load_antigravity,
}
STORES = ("opencode", "antigravity")


def formats_of(spark: SparkSession, paths) -> DataFrame:
    """path, format of all trace files under ``paths``."""
    found = detect(trace_objects(spark, paths))
    kinds = stores.store_files(spark, paths).select("path", store_kind("content").alias("format")).filter("format IS NOT NULL")
    return found.unionByName(kinds)


def load_found(found: DataFrame) -> DataFrame:
    """Runs of files with their format (path, format, and value or ord and obj), each file read by its own loader.

    What was read is written once by format, so that each loader reads its own files and no others.
    """
    spark = found.sparkSession
    folder = scratch(spark, "formats")
    columns = [c for c in ("path", "ord", "obj", "value") if c in found.columns]
    found.select(*columns, "format").write.partitionBy("format").parquet(folder)
    kept = spark.read.schema(found.select(*columns, "format").schema).parquet(folder)
    out = spark.createDataFrame([], RUN)
    # the formats that occur are at most as many as there are loaders
    for name in sorted(r["format"] for r in kept.select("format").distinct().collect()):
        out = out.unionByName(LOADERS[name](kept.filter(F.col("format") == name).select(*columns)))
    return out


def load(spark: SparkSession, paths, fmt: str | None = None) -> DataFrame:
    """Runs of all files under ``paths``: of one format, or each file by what it is found to be."""
    texts, binaries = trace_objects(spark, paths), stores.store_files(spark, paths)
    if fmt:
        return LOADERS[fmt](binaries if fmt in STORES else texts)
    out = load_found(texts.join(detect(texts), "path"))
    kinds = binaries.withColumn("format", store_kind("content"))
    for name in STORES:
        out = out.unionByName(LOADERS[name](kinds.filter(F.col("format") == name).drop("format")))
    return out
