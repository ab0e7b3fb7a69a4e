"""A Merkle manifest of a table: every row's leaf, subroot, root and proof, and what a changed row folds to.

A row's leaf is the SHA-256 of its fields, each with its length.  The leaves of a language,
by doc_id, are the ground of a tree whose nodes are the hashes of FANOUT consecutive nodes
below; the subroots of the languages, in order, are the ground of one more tree to the root.

Large blocks of a language's leaves are reduced where they lie, one row for each block,
and blocks of blocks likewise while more than ``top`` rows are left; those few the driver
joins to the root.  It broadcasts what it built (at most 8/7 of ``top`` digests of 64
bytes), of which the path above a block is a slice.  A task then folds every row of a block along the
block's own levels and that path, and tells the row's proof and its verdict.

Defined cases: a null field is ``-``; a null doc_id comes first in its language and is
never changed; rows of the same doc_id go by leaf, and equal rows share all but their
proofs; null is a language, and the first; a language of one row has its leaf as subroot,
and a table of one language its subroot as root; a row without siblings has the hash of no
bytes as proof; an empty table gives an empty result; columns other than FIELDS are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, partitions_for, ranked

FANOUT = 8
#: Levels that a block climbs: 4,096 nodes make one.
HEIGHT = 4
#: Nodes that the driver may hold and broadcast.
TOP = 32_768
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_TASK = 250_000
WIDTH = 64
SEALED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """The binary SHA-256 of ``fields``, each ``-`` if null and else its UTF-8 bytes' count, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def in_lower_case(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, _CAPITALS, _CAPITALS.lower())


def runs_of(digests: list[str], height: int) -> tuple[list[list[str]], list[str]]:
    """The runs of each of ``height`` levels, a run being its nodes' digests joined, and the nodes above the last."""
    levels = []
    for _ in range(height):
        runs = ["".join(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
        levels.append(runs)
        digests = [digest(r) for r in runs]
    return levels, digests


def height_of(n: int, most: int | None = None) -> int:
    """Levels from ``n`` nodes to a single one, ``most`` at most."""
    h = 0
    while n > 1 and h != most:
        n, h = -(-n // FANOUT), h + 1
    return h


def path_of(place: int, levels: list[list[str]]) -> Path:
    """What stands before and after a node in its run, level by level."""
    path = []
    for runs in levels:
        run, at = runs[place // FANOUT], place % FANOUT * WIDTH
        path.append((run[:at], run[at + WIDTH :]))
        place //= FANOUT
    return path


def fold(node: str, path: Path) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


class Top:
    """The tree above the last distributed blocks, and the path from each of them to the root."""

    def __init__(self, nodes: list[tuple[str, int, str]], of_roots: bool):
        """``nodes``: tree, place, digest.  ``of_roots``: they are subroots already, in one tree."""
        self.trees: dict[str, tuple[list[list[str]], str, int]] = {}
        by_tree: dict[str, list[str]] = {}
        for tree, _, node in sorted(nodes):
            by_tree.setdefault(tree, []).append(node)
        for k, (tree, digests) in enumerate(by_tree.items()):
            levels, last = runs_of(digests, height_of(len(digests)))
            self.trees[tree] = (levels, last[0], k)
        subroots = [] if of_roots else [t[1] for t in self.trees.values()]
        self.levels, last = runs_of(subroots, height_of(len(subroots)))
        self.root = (last or [t[1] for t in self.trees.values()] or [digest("")])[0]

    def above(self, tree: str, place: int) -> tuple[Path, str]:
        """The path from a node to the root, and the root of its own tree."""
        levels, subroot, k = self.trees[tree]
        return path_of(place, levels) + path_of(k, self.levels), subroot


def _climb(blocks: DataFrame, height: int) -> DataFrame:
    """tree, pos, n, digest: one node for each block."""

    def work(key, table):
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        _, last = runs_of([d.hex() for d in table["digest"].to_pylist()], height_of(n, height))
        return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // FANOUT**height)], pa.int64()), "digest": pa.array([bytes.fromhex(last[0])], pa.binary())})

    return blocks.select("tree", "pos", "n", "digest", "block").groupBy("tree", "block").applyInArrow(work, "tree string, pos long, n long, digest binary")


def _with_paths(nodes: DataFrame, above: DataFrame | object, each: Callable[[pa.Table, list[Path], str | None], pa.Table], schema: str, height: int) -> DataFrame:
    """``each`` over the nodes of every block with their whole paths; ``above`` is a broadcast Top, or a table of paths by tree and place."""

    def folded(table: pa.Table, path: Path, subroot: str | None) -> pa.Table:
        table = table.sort_by("pos")
        levels, _ = runs_of([d.hex() for d in table["digest"].to_pylist()], height_of(table["n"][0].as_py(), height))
        return each(table, [path_of(i, levels) + path for i in range(table.num_rows)], subroot)

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**height))
    if not isinstance(above, DataFrame):
        return blocks.groupBy("tree", "block").applyInArrow(lambda key, table: folded(table, *above.value.above(key[0].as_py(), key[1].as_py())), schema)

    def met(table, path):
        row = path.to_pylist()[0]
        return folded(table, list(zip(row["before"], row["after"], strict=True)), row["subroot"])

    return blocks.groupBy("tree", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(met, schema)


def _paths(table: pa.Table, paths: list[Path], subroot: str | None) -> pa.Table:
    """The paths of nodes as rows."""
    return pa.table({"tree": table["tree"], "pos": table["pos"], "before": pa.array([[b for b, _ in p] for p in paths], pa.list_(pa.string())), "after": pa.array([[a for _, a in p] for p in paths], pa.list_(pa.string())), "subroot": pa.array([subroot] * table.num_rows, pa.string())})


_PATHS = "tree string, pos long, before array<string>, after array<string>, subroot string"


def _sealed(root: str) -> Callable[[pa.Table, list[Path], str | None], pa.Table]:
    def each(table: pa.Table, paths: list[Path], subroot: str | None) -> pa.Table:
        leaves = [d.hex() for d in table["digest"].to_pylist()]
        now = [d.hex() if d is not None else own for d, own in zip(table["tampered"].to_pylist(), leaves, strict=True)]
        ends = [fold(node, path) for node, path in zip(now, paths, strict=True)]
        proofs = [digest("".join(b + a for b, a in path)) for path in paths]
        return pa.table({"doc_id": table["doc_id"], "leaf": leaves, "subroot": pa.array([subroot] * len(leaves), pa.string()), "root": [root] * len(leaves), "proof_sha256": proofs, "folded_root": ends, "verified": [e == root for e in ends]})

    return each


def manifest(docs: DataFrame, changed: Column, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; rows where ``changed`` holds are folded with their text in lower case."""
    spark = docs.sparkSession
    fields = [F.col(c) for c in FIELDS]
    other = leaf(in_lower_case(F.col("text").cast("string")) if c == "text" else F.col(c) for c in FIELDS)
    # a prefix keeps the null language, and its place before all others, in a key that is never null
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    leaves = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(fields).alias("digest"), F.when(F.coalesce(changed, F.lit(False)), other).alias("tampered")), "leaves")
    count = leaves.count()
    ground = ranked(leaves, ["doc_id", "digest", "tampered"], "leaves-in-order", partitions_for(spark, count, ROWS_PER_TASK, 4), by="tree")
    rounds, nodes, of_roots = [], ground, False
    while True:
        up = durable(_climb(nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**height)), height), "blocks")
        rounds.append((nodes, "blocks"))
        nodes, found = up, up.agg(F.count("*").alias("rows"), F.max("n").alias("widest")).first()
        if found["rows"] > top and found["widest"] == 1 and not of_roots:
            # very many languages: their subroots are one more long row of nodes
            roots = ranked(up.drop("n", "pos").withColumnRenamed("tree", "under"), ["under"], "subroots", partitions_for(spark, found["rows"], ROWS_PER_TASK, 4))
            rounds.append((up, "roots"))
            nodes, of_roots = roots.withColumn("tree", F.lit("")), True
        elif found["rows"] <= top:
            break
    up = Top([(r["tree"], r["pos"], r["digest"].hex()) for r in nodes.select("tree", "pos", "digest").collect()], of_roots)
    above: DataFrame | object = spark.sparkContext.broadcast(up)
    for below, kind in reversed(rounds[1:]):
        if kind == "blocks":
            above = durable(_with_paths(below, above, _paths, _PATHS, height), "paths")
        else:
            above = _of_trees(roots, above)
    return _with_paths(ground, above, _sealed(up.root), SEALED, height)


def _of_trees(roots: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of subroots, by their place in the row of all, as paths of their trees' only nodes."""
    named = roots.select("pos", "under", F.lower(F.hex("digest")).alias("own"))
    return above.drop("tree", "subroot").join(named, "pos").select(F.col("under").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after", F.col("own").alias("subroot"))
