"""Towers of nested class functions.

A tower is an ordered list of parts; a run's class at level j is the tuple of its first j
parts.  Nesting then holds by construction, and the classes of all levels come out of one
rollup over the parts.  A tower given by class functions of its own (``nested=False``) is
checked by ``violations``: a class must have exactly one coarser prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import steps as S

LN2 = 0.6931471805599453


class TowerViolation(ValueError):
    """A class with more than one coarser class."""


@dataclass(frozen=True)
class Tower:
    """``names`` and ``parts`` (columns of a run) from coarse to fine.  ``outcome_free``: no part reads outcome, label or cost."""

    names: Sequence[str]
    parts: Sequence[Column]
    nested: bool = True
    outcome_free: bool = False

    def __post_init__(self) -> None:
        if not self.parts or len(self.names) != len(self.parts):
            raise ValueError("a tower needs at least one level, and a name for each")

    @property
    def depth(self) -> int:
        return len(self.parts)

    @property
    def columns(self) -> list[str]:
        return [f"k{j}" for j in range(1, self.depth + 1)]

    def signature(self, runs: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and k1..kK."""
        return runs.select(*keep, *(p.alias(c) for p, c in zip(self.parts, self.columns, strict=True)))

    def identified(self, runs: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and c1..cK: the class of each level as 128 bits, made of the class before it and the level's part.

        Parts are told apart by their JSON, so a class costs the same however large its parts are.
        """
        out = self.signature(runs, *keep)
        for j, k in enumerate(self.columns, 1):
            part = [F.to_json(F.struct(F.col(k).alias("k")), {"ignoreNullFields": "false"})]
            above = [] if j == 1 else [F.col(f"c{j - 1}")]
            # two 64-bit hashes that start apart
            out = out.withColumn(f"c{j}", F.struct(F.xxhash64(*above, *part).alias("a"), F.xxhash64(F.lit(j), *above, *part).alias("b"))).drop(k)
        return out


# The names of the tool tower's levels.
TOOL_LEVELS = ("outcome", "family multiset", "family sequence", "errors", "argument classes", "arguments")


def tool_tower(canonical: Callable[[Column, Column], Column] = S.canonical_args) -> Tower:
    """Six levels over a run's steps: outcome, families, their order, errors, argument classes, full arguments."""
    steps = F.col("steps")
    parts = [
        F.col("outcome"),
        F.array_sort(S.family_sequence(steps)),
        S.family_sequence(steps),
        S.error_flags(steps),
        F.transform(steps, lambda s: S.arg_class(s["tool"], s["args"])),
        F.transform(steps, lambda s: F.struct(s["tool"].alias("tool"), canonical(s["tool"], s["args"]).alias("args"))),
    ]
    return Tower(TOOL_LEVELS, parts)


def behaviour_tower() -> Tower:
    """The tool tower without its outcome: what variance and cost decompositions may use."""
    full = tool_tower(lambda tool, args: F.coalesce(args, F.lit("")))
    return Tower(full.names[1:], full.parts[1:], outcome_free=True)


def violations(keys: DataFrame, tower: Tower) -> DataFrame:
    """level, n_prefixes, n_classes: how many classes of a level have that many (more than one) coarser prefixes."""
    columns = tower.columns
    checks = None
    for j in range(2, tower.depth + 1):
        bad = keys.groupBy(F.col(columns[j - 1]).alias("key")).agg(F.count_distinct(F.struct(*columns[: j - 1])).alias("n_prefixes")).filter("n_prefixes > 1")
        rows = bad.groupBy("n_prefixes").agg(F.count("*").alias("n_classes")).select(F.lit(j).alias("level"), "n_prefixes", "n_classes")
        checks = rows if checks is None else checks.unionByName(rows)
    return checks if checks is not None else keys.sparkSession.createDataFrame([], "level int, n_prefixes long, n_classes long")


def validate(runs: DataFrame, tower: Tower) -> int:
    """The number of runs; TowerViolation if the tower's class functions do not nest."""
    keys = tower.signature(runs)
    if not tower.nested and (bad := violations(keys, tower).first()):
        raise TowerViolation(f"level {bad['level']}: {bad['n_classes']} classes have {bad['n_prefixes']} coarser prefixes")
    return keys.count()


def violating_pairs(runs: DataFrame, tower: Tower, key: str) -> DataFrame:
    """level, a, b: pairs of runs that agree at a level and differ above it (the quadratic check, for small tests)."""
    keys = tower.signature(runs, key)
    out = None
    for j in range(2, tower.depth + 1):
        level = keys.select(key, F.col(tower.columns[j - 1]).alias("k"), F.struct(*tower.columns[: j - 1]).alias("prefix"))
        a, b = level.alias("a"), level.alias("b")
        pairs = a.join(b, (F.col("a.k").eqNullSafe(F.col("b.k"))) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col("a.prefix") != F.col("b.prefix")))
        rows = pairs.select(F.lit(j).alias("level"), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out


def eps(level: Column) -> Column:
    return F.pow(F.lit(2.0), -level)


def path_tower() -> Tower:
    """Five levels over paths on a grid (column ``path``: array of (r, c), and ``goal``): goal reached, steps, moves in any order, moves, the path."""
    path = F.col("path")
    moves = F.zip_with(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), lambda b, a: F.struct((b["r"] - a["r"]).alias("r"), (b["c"] - a["c"]).alias("c")))
    return Tower(("goal reached", "steps", "moves in any order", "moves", "path"), [F.element_at(path, -1) == F.col("goal"), F.size(path) - 1, F.array_sort(moves), moves, path])


def prefix_tower(labels: Column, depth: int) -> Tower:
    """Level j is the label at place j, so a class is the first j labels; null beyond a history's end."""
    return Tower(tuple(f"prefix {j}" for j in range(1, depth + 1)), [F.get(labels, F.lit(j)) for j in range(depth)])


#: Registry of towers by name; users may add their own.
TOWERS: dict[str, Callable[..., Tower]] = {"tool": tool_tower, "prefix": prefix_tower, "behaviour": behaviour_tower, "path": path_tower}


def build_tower(name: str, *args) -> Tower:
    if name not in TOWERS:
        raise ValueError(f"there is no tower {name!r}; known are {', '.join(TOWERS)}")
    return TOWERS[name](*args)
