"""A book of moments: what nested levels are analysed from, kept at their finest blocks.

A book has a row for each finest block (and each value of its ``by`` columns): how many
items, their mass, for each value the weighted sum, and for each pair of values the sum of
products about the block's means.  Books merge, so coarser blocks, energies, covariations,
residuals, support and the error of every set of kept levels follow from it by arithmetic:
the items are read once.

A book is written before it is used, and its sums are then taken about the whole's mean,
so that a large common offset costs no digits.  Rolling up is a chain of aggregations from the finest level to the root, each over the rows
of the one before.  What children of a block differ by is taken at that block, so a block
with one child adds exactly nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import held


def _per_mass(product: Column, mass: Column) -> Column:
    return F.when(mass != 0, product / mass).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Book:
    """``blocks``: by and level columns, n, mass, s_<value>, and c_<value>_<value> about the block's own means."""

    blocks: DataFrame
    levels: tuple[str, ...]
    values: tuple[str, ...]
    by: tuple[str, ...] = ()
    #: For each value the number that its sums are taken about.
    pivot: tuple[float, ...] = ()

    @classmethod
    def of(cls, items: DataFrame, levels: Sequence[str], values: Sequence[str] = ("v",), weight: Column | None = None, by: Sequence[str] = ()) -> Book:
        """One aggregation of ``items``, written: what is asked of the book later reads no item.  Without a weight each counts as one."""
        values = tuple(sorted(set(values)))
        pairs = [(u, w) for i, u in enumerate(values) for w in values[i:]]
        if weight is None:
            n = F.count("*").cast("double")
            found = [n.alias("mass"), *((F.avg(v) * n).alias(f"s_{v}") for v in values), *((F.covar_pop(u, w) * n).alias(f"c_{u}_{w}") for u, w in pairs)]
        else:
            mass = F.sum(weight)
            s = {v: F.sum(weight * F.col(v)) for v in values}
            found = [mass.alias("mass"), *(s[v].alias(f"s_{v}") for v in values), *((F.sum(weight * F.col(u) * F.col(w)) - _per_mass(s[u] * s[w], mass)).alias(f"c_{u}_{w}") for u, w in pairs)]
        blocks = held(items.groupBy(*by, *levels).agg(F.count("*").alias("n"), *found), "book")
        means = blocks.agg(*((F.sum(f"s_{v}") / F.nullif(F.sum("mass"), F.lit(0.0))).alias(v) for v in values)).first()
        pivot = tuple(means[v] or 0.0 for v in values)
        return cls(blocks.withColumns({f"s_{v}": F.col(f"s_{v}") - F.col("mass") * p for v, p in zip(values, pivot, strict=True)}), tuple(levels), values, tuple(by), pivot)

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [(u, w) for i, u in enumerate(self.values) for w in self.values[i:]]

    def where(self, condition: Column) -> Book:
        return replace(self, blocks=self.blocks.filter(condition))

    def rolled(self, upto: int = -1, by: Sequence[str] = ()) -> DataFrame:
        """Blocks of level ``upto`` (-1: the whole), for each value of ``by``.

        by and level columns, n, mass, s_<value>; for each pair r_ (within the finest
        blocks) and e<j>_ (between the blocks of level j within those of level j - 1, the whole
        being level -1); b<j> (how many blocks level j has).
        """
        names = [f"{u}_{w}" for u, w in self.pairs]
        now = self.blocks.withColumnsRenamed({f"c_{k}": f"r_{k}" for k in names})
        if tuple(by) != self.by:
            # the finest blocks themselves, once what kept them apart is dropped
            now = self._merged(now, [*by, *self.levels], [f"r_{k}" for k in names], "r")
        summed = [f"r_{k}" for k in names]
        for j in range(len(self.levels) - 2, upto - 1, -1):
            now = self._merged(now, [*by, *self.levels[: j + 1]], summed, f"e{j + 1}", f"b{j + 1}")
            summed += [f"e{j + 1}_{k}" for k in names] + [f"b{j + 1}"]
        return now

    def _merged(self, rows: DataFrame, keys: list[str], summed: list[str], between: str, blocks: str | None = None) -> DataFrame:
        """Rows of equal keys as one; ``between`` is what they differ by, added to the column of that name if there is one."""
        mass = F.sum("mass")
        apart = {f"{u}_{w}": F.sum(_per_mass(F.col(f"s_{u}") * F.col(f"s_{w}"), F.col("mass"))) - _per_mass(F.sum(f"s_{u}") * F.sum(f"s_{w}"), mass) for u, w in self.pairs}
        out = [F.sum(c).alias(c) for c in ("n", *(f"s_{v}" for v in self.values))] + [mass.alias("mass")]
        fresh = {f"{between}_{k}": e for k, e in apart.items()}
        out += [(F.sum(c) + fresh.pop(c) if c in fresh else F.sum(c)).alias(c) for c in summed]
        out += [e.alias(c) for c, e in fresh.items()]
        if blocks:
            out.append(F.count("*").alias(blocks))
        return rows.groupBy(*keys).agg(*out)

    def _pair(self, u: str, w: str) -> str:
        return "_".join(sorted((u, w)))

    def of_level(self, j: int, u: str, w: str | None = None) -> Column:
        """Energy of level ``j`` in a row of ``rolled()``: what level j + 1 adds, as a share of the mass."""
        return _per_mass(F.col(f"e{j + 1}_{self._pair(u, w or u)}"), F.col("mass"))

    def residual(self, u: str) -> Column:
        return _per_mass(F.col(f"r_{self._pair(u, u)}"), F.col("mass"))

    def variance(self, u: str) -> Column:
        return self.residual(u) + sum((self.of_level(j, u) for j in range(-1, len(self.levels) - 1)), F.lit(0.0))

    def mean(self, u: str) -> Column:
        return _per_mass(F.col(f"s_{u}"), F.col("mass")) + self.about(u)

    def about(self, u: str) -> float:
        return self.pivot[self.values.index(u)]

    def energies(self, u: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """by, level, energy: the detail between level j and j + 1 of ``u`` (and ``w``)."""
        each = F.array(*(F.struct(F.lit(j).alias("level"), self.of_level(j, u, w).alias("energy")) for j in range(len(self.levels) - 1)))
        return self.rolled(by=by).select(*by, F.explode(each).alias("x")).select(*by, "x.*")

    def pruning_sets(self, u: str) -> DataFrame:
        """mask, kept (levels whose detail is kept), error: variance that no kept detail holds, for every set of levels; from one row."""
        details = len(self.levels) - 1
        kept = [F.shiftright("mask", j).bitwiseAND(F.lit(1)) == 1 for j in range(details)]
        lost = sum((F.when(kept[j], F.lit(0.0)).otherwise(self.of_level(j, u)) for j in range(details)), self.residual(u))
        sets = self.rolled().select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << details) - 1))).alias("mask"))
        return sets.select("mask", F.array_compact(F.array(*(F.when(k, F.lit(j)) for j, k in enumerate(kept)))).alias("kept"), lost.alias("error"))

    def means(self, j: int, u: str, name: str) -> DataFrame:
        """The blocks of level ``j``: their columns up to it, and the mean as ``name``."""
        return self.rolled(j).select(*self.levels[: j + 1], self.mean(u).alias(name))
