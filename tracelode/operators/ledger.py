"""The two ledgers of a tower: classes explored (n) and classes that hold a success (l), by group and level.

A class is 16 bytes made of the class above it and its own part, so no part is shuffled.
Classes are made distinct at the finest level once; every coarser level is an aggregation of
the classes of the level below, and what was counted there goes along.  Trees of prefixes
are nodes with parents, of a fixed size each, so a long run costs its length and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tower import Tower

#: Nodes in a batch that a worker hands on.
NODES_PER_BATCH = 50_000
#: The node above those of level 1.
ROOT = b""


def classes(runs: DataFrame, tower: Tower, ok: Column, group: str) -> DataFrame:
    """group, level, k1..kK (null beyond the level), seen, live: explicit rule, live iff some run through the class succeeded.

    For classes whose parts themselves are wanted; counts need only ``class_ids``.
    """
    keys = tower.columns
    distinct = tower.signature(runs.withColumn("_ok", ok), group, "_ok").groupBy(group, *keys).agg(F.count("*").alias("seen"), F.max("_ok").alias("live"))
    sets = [[group, *keys[:j]] for j in range(1, len(keys) + 1)]
    grouped = distinct.groupingSets(sets, group, *keys)
    # one bit for each grouping column, set where it is rolled up: the level is what is left
    return grouped.agg(F.sum("seen").alias("seen"), F.max("live").alias("live"), F.grouping_id().alias("_g")).withColumn("level", (F.lit(len(keys)) - F.bit_count("_g")).cast("int")).drop("_g")


def _finest(runs: DataFrame, tower: Tower, ok: Column, group: str) -> tuple[DataFrame, list[str]]:
    ids = [f"c{j}" for j in range(1, tower.depth + 1)]
    return tower.identified(runs.withColumn("_ok", ok), group, "_ok").groupBy(group, *ids).agg(F.count("*").alias("seen"), F.max("_ok").alias("live")), ids


def class_ids(runs: DataFrame, tower: Tower, ok: Column, group: str = "agent") -> DataFrame:
    """group, level, id, seen, live of the classes of every level."""
    finest, ids = _finest(runs, tower, ok, group)
    levels = F.array(*(F.struct(F.lit(j).alias("level"), F.col(c).alias("id")) for j, c in enumerate(ids, 1)))
    return finest.select(group, "seen", "live", F.explode(levels).alias("x")).groupBy(group, "x.level", "x.id").agg(F.sum("seen").alias("seen"), F.max("live").alias("live"))


def counts(found: DataFrame, group: str = "agent") -> DataFrame:
    """group, level, n, l of classes."""
    return found.groupBy(group, "level").agg(F.count("*").alias("n"), F.count_if("live").alias("l"))


def ledger(runs: DataFrame, tower: Tower, ok: Column, group: str = "agent") -> DataFrame:
    """group, level, n, l: a chain of aggregations from the finest classes up, each over the classes of the one before."""
    now, ids = _finest(runs, tower, ok, group)
    done: list[str] = []
    for j in range(len(ids), 0, -1):
        told = [F.sum(c).alias(c) for c in done] + [F.count("*").alias(f"n{j}"), F.count_if("live").alias(f"l{j}")]
        # above the first level is the group itself, of which nothing more is counted
        now = now.groupBy(group, *ids[: j - 1]).agg(F.max("live").alias("live"), *told)
        done += [f"n{j}", f"l{j}"]
    rows = F.array(*(F.struct(F.lit(j).alias("level"), F.col(f"n{j}").alias("n"), F.col(f"l{j}").alias("l")) for j in range(1, len(ids) + 1)))
    return now.select(group, F.explode(rows).alias("x")).select(group, "x.*")


def with_yield(book: DataFrame) -> DataFrame:
    """Adds the transient mass n - l and the yield l / n (0 if n is 0)."""
    return book.withColumn("transient", F.col("n") - F.col("l")).withColumn("yield", F.when(F.col("n") > 0, F.col("l") / F.col("n")).otherwise(F.lit(0.0)))


def _below(node: bytes, label: str | None) -> bytes:
    return hashlib.md5(node + (b"-" if label is None else b"+" + label.encode())).digest()


def chained(rows: DataFrame, labels: str, max_depth: int | None = None) -> DataFrame:
    """For every label of ``labels``, an array, the other columns of ``rows`` and level (from 1), id, parent, label.

    An id is 16 bytes made of the id before it and the label, so equal prefixes have equal
    ids and ids differ by level.  A sequence becomes as many rows as it has labels, which
    leave in batches of bounded size.  Labels that are not text go by their JSON.
    """
    kind = rows.schema[labels].dataType.elementType
    if not isinstance(kind, T.StringType):
        rows = rows.withColumn(labels, F.transform(labels, lambda x: F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})))
    keep = [c for c in rows.columns if c != labels]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(batch, at, level, ids, parents, names):
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
            return pa.RecordBatch.from_arrays([*kept, pa.array(level, pa.int32()), pa.array(ids, pa.binary()), pa.array(parents, pa.binary()), pa.array(names, pa.string())], names=[*keep, "level", "id", "parent", "label"])

        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, sequence in enumerate(batch.column(labels)):
                node = ROOT
                for level, label in enumerate((sequence.values or [])[:max_depth], 1):
                    parent, name = node, label.as_py()
                    node = _below(parent, name)
                    for column, value in zip(out, (row, level, node, parent, name), strict=True):
                        column.append(value)
                    if len(out[0]) == NODES_PER_BATCH:
                        yield told(batch, *out)
                        out = ([], [], [], [], [])
            if out[0]:
                yield told(batch, *out)

    schema = T.StructType([*(f for f in rows.schema if f.name != labels), T.StructField("level", T.IntegerType()), T.StructField("id", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("label", T.StringType())])
    return rows.mapInArrow(work, schema)


def prefixes(runs: DataFrame, labels: Column, ok: Column, group: str = "agent", max_depth: int | None = None) -> DataFrame:
    """group, level, id, parent, label, seen, live, longest: the tree of label prefixes.

    Whole sequences are made distinct before their nodes are told.
    """
    whole = runs.select(F.col(group), labels.alias("_labels"), ok.alias("_ok")).groupBy(group, "_labels").agg(F.count("*").alias("_n"), F.max("_ok").alias("_ok"))
    each = chained(whole.withColumn("_size", F.size("_labels")), "_labels", max_depth)
    return each.groupBy(group, "level", "id", "parent", "label").agg(F.sum("_n").alias("seen"), F.max("_ok").alias("live"), F.max("_size").alias("longest"))


def paths(found: DataFrame, level: int, group: str = "agent") -> DataFrame:
    """The nodes of ``level`` with ``prefix``, their labels from the root: one join up for each level."""
    out = found.filter(F.col("level") == level).withColumn("prefix", F.array("label")).withColumn("_up", F.col("parent"))
    for above in range(level - 1, 0, -1):
        nodes = found.filter(F.col("level") == above).select(F.col(group).alias("_g"), F.col("id").alias("_id"), F.col("parent").alias("_next"), F.col("label").alias("_label"))
        out = out.join(nodes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_up") == F.col("_id"))).withColumn("prefix", F.concat(F.array("_label"), "prefix")).withColumn("_up", F.col("_next")).drop("_g", "_id", "_next", "_label")
    return out.drop("_up")


def prefix_ledger(runs: DataFrame, labels: Column, ok: Column, group: str = "agent", rule: str = "explicit", horizon: int | None = None) -> DataFrame:
    """group, level, n, l under the ``explicit`` rule (a success below) or the ``horizon`` rule (a descendant at the horizon).

    The rule is always an argument: the two may disagree.  A horizon given cuts traces to it.
    """
    found = prefixes(runs, labels, ok, group, horizon)
    if rule == "explicit":
        return counts(found, group)
    if rule != "horizon":
        raise ValueError("rule is explicit or horizon")
    if horizon:
        return counts(found.withColumn("live", F.col("longest") >= horizon), group)
    top = found.groupBy(group).agg(F.max("level").alias("_h"))
    return counts(found.join(top, group).withColumn("live", F.col("longest") >= F.col("_h")), group)


def statuses(found: DataFrame, finalised: Column) -> DataFrame:
    """Adds status: LIVE, TRANSIENT, or UNKNOWN while ``finalised`` does not hold and no success was seen."""
    return found.withColumn("status", F.when(F.col("live"), F.lit("LIVE")).when(finalised, F.lit("TRANSIENT")).otherwise(F.lit("UNKNOWN")))


def live_never_falls(book: DataFrame, group: str = "agent") -> DataFrame:
    """group, holds: l_j <= l_{j+1} at all levels."""
    after = F.lead("l").over(Window.partitionBy(group).orderBy("level"))
    return book.withColumn("_next", after).groupBy(group).agg(F.every(F.coalesce(F.col("_next") >= F.col("l"), F.lit(True))).alias("holds"))


def degrees(found: DataFrame, group: str = "agent") -> DataFrame:
    """group, level, degree, nodes: how many nodes of a level have that many children (level 0 is the root)."""
    kids = found.groupBy(group, (F.col("level") - 1).alias("level"), "parent").agg(F.count("*").alias("degree"))
    return kids.groupBy(group, "level", "degree").agg(F.count("*").alias("nodes"))


def leaves(found: DataFrame, group: str = "agent") -> DataFrame:
    """Nodes without children, by anti join of the parents."""
    parents = found.select(F.col(group).alias("_g"), F.col("parent").alias("_p")).distinct()
    return found.join(parents, F.col(group).eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_p")), "left_anti")


def canonical_trees(found: DataFrame, depth: int, group: str = "agent") -> DataFrame:
    """group, shape: the tree of prefixes as nested parentheses with children in order; equal iff isomorphic.

    Two aggregations for each level, from the deepest up: equal children are counted before
    a node lists its shapes.  A shape is as long as its tree; ``ranked_trees`` tells trees
    apart without writing them out.
    """
    shapes = None
    for level in range(depth, -1, -1):
        here = found.filter(F.col("level") == level).select(group, "id", "parent") if level else found.select(group, F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent")).distinct()
        if shapes is None:
            shapes = here.withColumn("shape", F.lit("()"))
            continue
        equal = shapes.groupBy(group, F.col("parent").alias("id"), "shape").agg(F.count("*").cast("int").alias("n"))
        kids = F.transform(F.sort_array(F.collect_list(F.struct("shape", "n"))), lambda k: F.repeat(k["shape"], k["n"]))
        up = equal.groupBy(group, "id").agg(F.concat(F.lit("("), F.array_join(kids, ""), F.lit(")")).alias("shape"))
        shapes = here.join(up, [group, "id"], "left").withColumn("shape", F.coalesce("shape", F.lit("()")))
    return shapes.select(group, "shape")


def ranked_trees(found: DataFrame, depth: int, group: str = "agent") -> DataFrame:
    """group, nodes, digest: a tree's size (its root counts) and 16 bytes that are equal iff the trees are isomorphic.

    A node's digest is made of how many children it has of each digest.  Whole trees are never
    written out, and a node's children are counted by kind before they meet.
    """
    trees = None
    for level in range(depth, -1, -1):
        here = found.filter(F.col("level") == level).select(group, "id", "parent") if level else found.select(group, F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent")).distinct()
        if trees is None:
            up = None
        else:
            kinds = trees.groupBy(group, F.col("parent").alias("id"), "digest").agg(F.count("*").alias("n"), F.sum("nodes").alias("nodes"))
            kinds = kinds.withColumn("_kind", F.unhex(F.md5(F.concat(F.hex("digest"), F.lit("x"), F.col("n").cast("string")))))
            listed = F.array_join(F.transform(F.sort_array(F.collect_list("_kind")), lambda k: F.hex(k)), "")
            up = kinds.groupBy(group, "id").agg(F.unhex(F.md5(listed)).alias("digest"), F.sum("nodes").alias("nodes"))
        leaf = F.unhex(F.md5(F.lit("")))
        if up is None:
            trees = here.withColumn("digest", leaf).withColumn("nodes", F.lit(1).cast("long"))
        else:
            met = here.join(up, [group, "id"], "left")
            trees = met.withColumn("digest", F.coalesce("digest", leaf)).withColumn("nodes", F.coalesce(F.col("nodes"), F.lit(0)) + 1)
    return trees.select(group, "nodes", "digest")


def lookup(payloads: DataFrame, queries: DataFrame, equivalent: Column, max_level: int | None = None) -> DataFrame:
    """query_id, level, payload: the coarsest stored class on a query's path whose payload serves it, else the deepest level reached.

    ``payloads``: id (of ``chained``), payload, profile.  ``queries``: query_id, labels.  ``equivalent`` is over both.
    """
    steps = chained(queries, "labels", max_level)
    met = steps.join(payloads, "id", "left").withColumn("_hit", F.coalesce(equivalent & F.col("payload").isNotNull(), F.lit(False)))
    return met.groupBy("query_id").agg(F.min(F.when(F.col("_hit"), F.col("level"))).alias("level"), F.min_by("payload", F.when(F.col("_hit"), F.col("level"))).alias("payload"), F.max(F.when(F.col("payload").isNotNull(), F.col("level"))).alias("reached"))


def groups_of(runs: DataFrame, key: str) -> DataFrame:
    """``runs`` with an agent column by model, project, file or none."""
    column = {"model": F.col("model"), "project": F.col("project"), "file": F.col("session"), "none": F.lit("all")}[key]
    return runs.withColumn("agent", column)


def summary(runs: DataFrame, group: str) -> DataFrame:
    """group (null: all), runs, calls, errors, successes, mean_steps: groups and their total in one pass."""
    steps = F.size("steps")
    errors = F.size(F.filter("steps", lambda s: F.coalesce(s["error"], F.lit("")) != ""))
    narrow = runs.select(group, F.greatest(steps, F.lit(0)).alias("calls"), F.greatest(errors, F.lit(0)).alias("errors"), (F.col("outcome") == "stop").alias("ok"))
    return narrow.groupingSets([[group], []], group).agg(F.count("*").alias("runs"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.count_if("ok").alias("successes"), F.avg("calls").alias("mean_steps"))


def top_tools(runs: DataFrame, k: int = 6) -> DataFrame:
    """tool, uses: the k most used, ties by first appearance (least run ordinal and place)."""
    long = runs.select("ordinal", F.posexplode("steps").alias("pos", "s"))
    used = long.groupBy(F.col("s.tool").alias("tool")).agg(F.count("*").alias("uses"), F.min(F.struct("ordinal", "pos")).alias("_first"))
    return used.orderBy(F.desc("uses"), "_first").limit(k).select("tool", "uses")


def matched(runs: DataFrame, agents: int = 2) -> DataFrame:
    """Runs of non-empty tasks that at least ``agents`` agents ran."""
    tasks = runs.filter(F.coalesce("task", F.lit("")) != "").groupBy("task").agg(F.count_distinct("agent").alias("_a")).filter(F.col("_a") >= agents)
    return runs.join(tasks, "task", "left_semi")


def large_groups(runs: DataFrame, least: int, group: str = "agent") -> DataFrame:
    return runs.join(runs.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least), group, "left_semi")


def largest_group(runs: DataFrame, group: str = "project") -> DataFrame:
    """Runs of the most frequent group; ties by first appearance."""
    top = runs.groupBy(group).agg(F.count("*").alias("_n"), F.min("ordinal").alias("_first")).orderBy(F.desc("_n"), "_first").limit(1)
    return runs.join(top, group, "left_semi")


def stats(found: DataFrame) -> DataFrame:
    """level, inserts, nodes_created, revisits of classes (level, seen): how often a run met a class that was there."""
    return found.groupBy("level").agg(F.sum("seen").alias("inserts"), F.count("*").alias("nodes_created"), (F.sum("seen") - F.count("*")).alias("revisits"))
