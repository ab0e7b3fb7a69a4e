"""Weighted multiresolution over nested partitions of items.

Items are rows with block columns l0..lJ (l0 trivial unless allowed otherwise), a weight mu
(items without one weigh alike) and a value v.  Everything but what is said of single items
follows from a book of moments, for which the items are read once; amounts are shares of
the mass, so weights need not sum to 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import Book


class NestingError(ValueError):
    """A block with more than one parent, or a first level of more than one block."""


def check_nesting(items: DataFrame, levels: Sequence[str], trivial_root: bool = True) -> None:
    if trivial_root and items.select(levels[0]).distinct().limit(2).count() > 1:
        raise NestingError("the first level must be one block")
    for coarse, fine in zip(levels, levels[1:], strict=False):
        if items.groupBy(fine).agg(F.count_distinct(F.struct(coarse)).alias("c")).filter("c > 1").limit(1).count():
            raise NestingError(f"{fine} does not refine {coarse}")


def restrict(items: DataFrame, subset: DataFrame, key: str = "item") -> DataFrame:
    """The items of ``subset`` (column ``key``), with their blocks: a tower on part of the items still nests."""
    return items.join(subset.select(key).distinct(), key, "left_semi")


def dimensions(items: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, blocks, dim: block counts and how many more the next level has."""
    one = items.agg(*(F.count_distinct(F.struct(c)).alias(c) for c in levels))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(j).alias("level"), F.col(c).alias("blocks"), (F.col(levels[j + 1]) - F.col(c) if j + 1 < len(levels) else F.lit(None)).cast("long").alias("dim")) for j, c in enumerate(levels)))).alias("x"))
    return long.select("x.*")


def normalized(items: DataFrame, weight: Column | None = None) -> DataFrame:
    """mu as shares of the whole; the total is one number, joined as a row."""
    w = items.withColumn("_w", (weight if weight is not None else F.lit(1.0)).cast("double"))
    total = w.agg(F.sum("_w").alias("_t"))
    return w.crossJoin(total).withColumn("mu", F.col("_w") / F.when(F.col("_t") == 0, F.raise_error(F.lit("weights sum to 0")).cast("double")).otherwise(F.col("_t"))).drop("_w", "_t")


def _mu(items: DataFrame) -> Column | None:
    return F.col("mu") if "mu" in items.columns else None


def book(items: DataFrame, levels: Sequence[str], *values: str) -> Book:
    return Book.of(items, levels, values, _mu(items))


def conditional_expectation(items: DataFrame, block: str, value: str = "v", name: str = "p") -> DataFrame:
    """The block's weighted mean at each item.  Blocks are aggregated and joined back, so a large block is never one window."""
    mu = _mu(items)
    mean = F.avg(value) if mu is None else F.sum(mu * F.col(value)) / F.sum(mu)
    means = items.groupBy(block).agg(mean.alias(name))
    return items.join(means, items[block].eqNullSafe(means[block])).drop(means[block])


def energies(items: DataFrame, levels: Sequence[str], u: str = "v", w: str | None = None) -> DataFrame:
    """level, energy: sum of mu D_j u D_j w, the detail between level j and j + 1 (w: u itself)."""
    return book(items, levels, u, w or u).energies(u, w)


def parent_energies(items: DataFrame, levels: Sequence[str], j: int, value: str = "v") -> DataFrame:
    """parent, energy: each parent block's share of level j's energy."""
    found = book(items, levels[: j + 2], value)
    whole = found.blocks.agg(F.sum("mass").alias("_whole"))
    shares = found.rolled(j).crossJoin(whole).select(F.col(levels[j]).alias("parent"), (F.col(f"e{j + 1}_{value}_{value}") / F.col("_whole")).alias("energy"))
    return shares.groupBy("parent").agg(F.sum("energy").alias("energy"))


def band_energy(items: DataFrame, levels: Sequence[str], a: int, b: int, value: str = "v") -> DataFrame:
    """energy between levels a and b: details of different levels are orthogonal, so theirs add up."""
    found = book(items, levels, value)
    return found.rolled().select(sum((found.of_level(j, value) for j in range(a, b)), F.lit(0.0)).alias("energy"))


def moments(items: DataFrame, levels: Sequence[str], value: str = "v") -> DataFrame:
    """mean, variance, root_energy, residual of the value."""
    found = book(items, levels, value)
    return found.rolled().select(found.mean(value).alias("mean"), found.variance(value).alias("variance"), (found.mean(value) * found.mean(value)).alias("root_energy"), found.residual(value).alias("residual"))


def kept_levels(items: DataFrame, levels: Sequence[str], kept: Sequence[int], value: str = "v") -> DataFrame:
    """pruning_error: variance that the details not in ``kept``, and the residual, hold."""
    found = book(items, levels, value)
    return found.rolled().select(sum((found.of_level(j, value) for j in range(len(levels) - 1) if j not in kept), found.residual(value)).alias("pruning_error"))


def reconstruct(items: DataFrame, levels: Sequence[str], kept: Sequence[int], value: str = "v") -> DataFrame:
    """Items with ``rebuilt``: the root mean and the details in ``kept``.  Finest blocks are rebuilt, and each item takes its block's."""
    found = book(items, levels, value)
    blocks = found.blocks.select(*levels)
    for j in range(len(levels)):
        if j in kept or j - 1 in kept or j == 0:
            here = [*levels[: j + 1]]
            means = found.means(j, value, f"_p{j}").withColumnsRenamed({c: f"_{c}" for c in here})
            blocks = blocks.join(means, _alike(blocks, means, here)).drop(*(f"_{c}" for c in here))
    rebuilt = F.col("_p0") + sum((F.col(f"_p{j + 1}") - F.col(f"_p{j}") for j in kept), F.lit(0.0))
    whole = blocks.select(*(F.col(c).alias(f"_{c}") for c in levels), rebuilt.alias("rebuilt"))
    return items.join(whole, _alike(items, whole, levels)).drop(*(f"_{c}" for c in levels))


def _alike(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    """Rows of the same blocks, null being one; ``b`` has an underscore before its names."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[f"_{c}"])
    return out


def permutation_null(p: Column, dim: Column, n: Column) -> Column:
    """Expected energy of a level under random labels of mean p."""
    return F.when(n > 1, p * (1 - p) / (n - 1) * dim)


def coverage(labels: DataFrame, label: str = "label") -> DataFrame:
    """n, labelled, positive."""
    return labels.agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count_if(F.col(label) == 1).alias("positive"))


def decomposition(items: DataFrame, levels: Sequence[str], value: str = "v") -> DataFrame:
    """part, amount: root, each level's energy, residual and variance (energies and residual sum to it)."""
    found = book(items, levels, value)
    parts = {"root": found.mean(value) * found.mean(value), "residual": found.residual(value), "variance": found.variance(value)}
    parts |= {f"level {j}": found.of_level(j, value) for j in range(len(levels) - 1)}
    return found.rolled().select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), a.alias("amount")) for p, a in parts.items()))).alias("x")).select("x.*")


def null_energies(items: DataFrame, levels: Sequence[str], value: str = "v") -> DataFrame:
    """level, blocks, dim, expected: the energy of each level if the labels in ``value`` were dealt at random."""
    found = book(items, levels, value)
    last = len(levels) - 1
    dim = [(F.col(f"b{j + 1}") - F.col(f"b{j}")).cast("long") if j < last else F.lit(None).cast("long") for j in range(last + 1)]
    rows = F.array(*(F.struct(F.lit(j).alias("level"), F.col(f"b{j}").alias("blocks"), dim[j].alias("dim"), permutation_null(found.mean(value), dim[j], F.col("n")).alias("expected")) for j in range(last + 1)))
    return found.rolled().select(F.explode(rows).alias("x")).select("x.*")


def block_number(items: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: blocks numbered by their least item; ranks over blocks, not over items."""
    blocks = items.groupBy(column).agg(F.min("item").alias("_m"))
    numbered = blocks.withColumn(name, F.dense_rank().over(Window.orderBy("_m")) - 1).drop("_m")
    return items.join(numbered, column)
