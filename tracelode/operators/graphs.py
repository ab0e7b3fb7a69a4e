"""Graph invariants: components, degrees, canonical forests, prime cycles, exact determinants, polynomial products."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dynamics import _held


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """degree, vertices."""
    return undirected(edges).groupBy("u").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("vertices"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """x, component (its least vertex), by label propagation with shortcuts until nothing changes."""
    arcs = undirected(edges)
    now = _held(vertices.select("x", F.col("x").alias("component")))
    while True:
        near = arcs.join(now.select(F.col("x").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("x")).agg(F.min("c").alias("c"))
        low = now.join(near, "x", "left").select("x", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = low.select(F.col("x").alias("component"), F.col("component").alias("up"))
        nxt = _held(low.join(jump, "component").select("x", F.col("up").alias("component")))
        if not nxt.join(now.withColumnRenamed("component", "old"), "x").filter("component <> old").limit(1).count():
            return nxt
        now = nxt


def prime_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """length, cycles: primitive closed walks without backtracking or tail, up to rotation, of length 3 to ``longest``.

    Walks are extended arc by arc; each class of rotations is counted by its least arc sequence.
    """
    arcs = undirected(edges).select(F.col("u").alias("a"), F.col("v").alias("b"))
    walks = arcs.select(F.array("a", "b").alias("w"))
    out = None
    for n in range(2, longest + 1):
        last, before = F.element_at("w", -1), F.element_at("w", -2)
        walks = _held(walks.join(arcs, (F.col("a") == last) & (F.col("b") != before)).select(F.concat("w", F.array("b")).alias("w")))
        closed = walks.filter((F.element_at("w", 1) == F.element_at("w", -1)) & (F.element_at("w", 2) != F.element_at("w", -2))).select(F.slice("w", 1, n).alias("c"))
        turns = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.slice("c", k + 1, n), F.slice("c", F.lit(1), k)))
        rotations = closed.select("c", turns.alias("r"))
        least = rotations.filter((F.col("c") == F.array_min("r")) & (F.size(F.array_distinct("r")) == n))
        row = least.agg(F.count("*").alias("cycles")).select(F.lit(n).alias("length"), "cycles")
        out = row if out is None else out.unionByName(row)
    return out.filter("cycles > 0")


def _multiply(p: list[Fraction], q: list[Fraction]) -> list[Fraction]:
    out = [Fraction(0)] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] += a * b
    return out


def _determinant(m: list[list[Fraction]]) -> Fraction:
    m, n, sign, out = [row[:] for row in m], len(m), 1, Fraction(1)
    for k in range(n):
        pivot = next((i for i in range(k, n) if m[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            m[k], m[pivot], sign = m[pivot], m[k], -sign
        out *= m[k][k]
        for i in range(k + 1, n):
            if m[i][k]:
                f = m[i][k] / m[k][k]
                m[i] = [a - f * b for a, b in zip(m[i], m[k], strict=True)]
    return sign * out


def _interpolated(values: list[Fraction]) -> list[Fraction]:
    """Coefficients of the polynomial with the given values at 0, 1, 2, ... (Newton's form)."""
    table, coefficients = values[:], []
    for k in range(len(values)):
        coefficients.append(table[0])
        table = [(b - a) / (k + 1) for a, b in zip(table, table[1:], strict=False)]
    out, basis = [Fraction(0)], [Fraction(1)]
    for k, c in enumerate(coefficients):
        out = [a + c * b for a, b in zip(out + [Fraction(0)] * (len(basis) - len(out)), basis, strict=True)]
        basis = _multiply(basis, [Fraction(-k), Fraction(1)])
    return out


def _adjacency(frame: pd.DataFrame) -> tuple[list[int], dict[int, set[int]]]:
    near: dict[int, set[int]] = {}
    for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return sorted(near), near


def _coefficients(frame: pd.DataFrame, entry) -> list[str]:
    vertices, near = _adjacency(frame)
    n = len(vertices)
    values = [_determinant([[entry(x, i == j, Fraction(int(b in near[a])), len(near[a])) for j, b in enumerate(vertices)] for i, a in enumerate(vertices)]) for x in map(Fraction, range(2 * n + 1))]
    out = _interpolated(values)
    while len(out) > 1 and not out[-1]:
        out.pop()
    return [str(c) for c in out]


def bass_determinants(edges: DataFrame) -> DataFrame:
    """graph, coefficients (text, ascending) of det(I - uA + u^2 (D - I)), exactly; ``edges``: graph, u, v."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        c = _coefficients(frame, lambda x, same, a, d: (1 + x * x * (d - 1) if same else 0) - x * a)
        return pd.DataFrame({"graph": [frame["graph"].iloc[0]], "coefficients": [c]})

    return edges.groupBy("graph").applyInPandas(one, "graph string, coefficients array<string>")


def characteristic_polynomials(edges: DataFrame) -> DataFrame:
    """graph, coefficients (text, ascending) of det(xI - A), exactly."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        c = _coefficients(frame, lambda x, same, a, d: (x if same else 0) - a)
        return pd.DataFrame({"graph": [frame["graph"].iloc[0]], "coefficients": [c]})

    return edges.groupBy("graph").applyInPandas(one, "graph string, coefficients array<string>")


def product(p: Column, q: Column, longest: int | None = None) -> Column:
    """Product of two polynomials (arrays of integers, ascending), cut after ``longest`` if given."""
    n = F.size(p) + F.size(q) - 1
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(0))
    full = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0).cast("long"), lambda t, i: t + at(p, i) * at(q, k - i)))
    return F.slice(full, 1, longest + 1) if longest is not None else full


def ihara_from_cycles(counts: DataFrame, longest: int) -> DataFrame:
    """coefficients of the product of (1 - u^length) over prime cycles up to ``longest`` (length, cycles: few rows)."""
    out = [1] + [0] * longest
    for row in counts.filter(F.col("length") <= longest).orderBy("length").collect():
        for _ in range(row["cycles"]):
            n = row["length"]
            out = [c - (out[i - n] if i >= n else 0) for i, c in enumerate(out)]
    return counts.sparkSession.createDataFrame([(out,)], "coefficients array<long>")


def weighted_cycles(cycles: DataFrame, gains: DataFrame) -> DataFrame:
    """cycle, gain, length: products of arc gains and sums of arc lengths over cycles (cycle, u, v); gains: u, v, gain, length."""
    return cycles.join(gains, ["u", "v"]).groupBy("cycle").agg(F.product("gain").alias("gain"), F.sum("length").alias("length"))


def canonical_forests(parents: DataFrame, depth: int) -> DataFrame:
    """tree, shape: nested parentheses of rooted trees (tree, x, parent, level), children in order; equal iff isomorphic."""
    shapes = None
    for level in range(depth, -1, -1):
        here = parents.filter(F.col("level") == level).select("tree", "x", "parent")
        if shapes is not None:
            up = shapes.groupBy("tree", F.col("parent").alias("x")).agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("shape")), ""), F.lit(")")).alias("shape"))
            here = here.join(up, ["tree", "x"], "left")
            shapes = here.withColumn("shape", F.coalesce("shape", F.lit("()")))
        else:
            shapes = here.withColumn("shape", F.lit("()"))
    return shapes.select("tree", "shape")
