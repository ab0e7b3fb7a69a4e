"""Finite dynamics: Max-Cut searches over bit states, maps, refinement, cores, cycles.

A map is a DataFrame (x, t); a partition is (x, block); states are integers whose bit i is
vertex i.  Loops run on the driver over whole-table steps; each round is checkpointed so
that lineage stays short.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Edges = Sequence[tuple[int, int]]


def _held(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(given or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def bit(x: Column, i: int) -> Column:
    return F.shiftright(x, i).bitwiseAND(F.lit(1))


def packed(bits: Column) -> Column:
    """The state of an array of bits, vertex 0 first."""
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda t, b: t * 2 + b)


def unpacked(x: Column, n: int) -> Column:
    """The bits of a state, vertex 0 first."""
    return F.array(*(bit(x, i).cast("int") for i in range(n)))


def flip(x: Column, v: Column) -> Column:
    return x.bitwiseXOR(F.pow(F.lit(2), v).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def energy(x: Column, edges: Edges) -> Column:
    """Edges that the state does not cut."""
    return total([(bit(x, u) == bit(x, v)).cast("int") for u, v in edges])


def states(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1 << n).withColumnRenamed("id", "x")


def optima(spark: SparkSession, n: int, edges: Edges) -> DataFrame:
    """x, energy of all states of least energy."""
    scored = states(spark, n).withColumn("energy", energy(F.col("x"), edges))
    return scored.join(scored.agg(F.min("energy").alias("energy")), "energy", "left_semi").select("x", "energy")


def least_states(n: int, edges: Edges) -> list[int]:
    """The states of least energy of one small instance, on the driver."""
    x = np.arange(1 << n)
    cost = sum(((x >> u & 1) == (x >> v & 1)).astype(np.int64) for u, v in edges)
    return np.flatnonzero(cost == cost.min()).tolist()


def ring(n: int, far: int = 4) -> Edges:
    """A ring of n vertices with chords to the ``far``-th next one; its length is what instances are drawn to."""
    return [(i, (i + 1) % n) for i in range(n)] + [(i, (i + far) % n) for i in range(n)]


def find_instance(n: int, edges: Edges, want: int = 2, tries: int = 4000) -> Edges:
    """As many random edges as ``edges`` has, drawn until exactly ``want`` states are optimal; on the driver, so that streams repeat."""
    rng = random.Random(0)
    for _ in range(tries):
        drawn = {tuple(sorted(rng.sample(range(n), 2))) for _ in edges}
        if len(drawn) == len(edges) and len(least_states(n, found := sorted(drawn))) == want:
            return found
    raise ValueError("no instance found")


def _gain(x: Column, v: int, edges: Edges) -> Column:
    """Change of energy by flipping v: edges of v that are cut less those that are not."""
    own = [(a, b) for a, b in edges if v in (a, b)]
    return total([F.when(bit(x, a) == bit(x, b), F.lit(-1)).otherwise(F.lit(1)) for a, b in own])


def _key(x: Column, v: int, n: int, edges: Edges, bias: Column) -> Column:
    return F.struct(_gain(x, v, edges).alias("d"), F.abs(F.lit(float(v)) - bias * F.lit(float(n - 1))).alias("far"), F.lit(v).alias("v"))


def walked(x: Column, tabu: Column, flips: Column, n: int, edges: Edges, tabu_len: Column) -> Column:
    """(t, tabu) after the best flips one after another, in one expression and so without a shuffle or a round of jobs.

    ``flips``: array of (bias, fresh); where fresh holds, the list of what is tabu starts anew.
    A state whose flips are all tabu stays.
    """

    def step(now: Column, flip: Column) -> Column:
        held = F.when(flip["fresh"], F.array().cast("array<int>")).otherwise(now["tabu"])
        free = F.filter(F.array(*(_key(now["t"], v, n, edges, flip["bias"]) for v in range(n))), lambda o: ~F.array_contains(held, o["v"]))
        # the choice is bound once by a one-element array
        chosen = F.transform(F.array(F.struct(F.array_min(free)["v"].alias("v"), held.alias("held"))), lambda c: F.struct(F.when(c["v"].isNull(), now["t"]).otherwise(now["t"].bitwiseXOR(_power(c["v"], n))).alias("t"), F.when(c["v"].isNull() | (tabu_len == 0), c["held"]).otherwise(_last(F.concat(c["held"], F.array(c["v"])), tabu_len)).alias("tabu")))
        return F.get(chosen, F.lit(0))

    return F.aggregate(flips, F.struct(x.cast("long").alias("t"), tabu.cast("array<int>").alias("tabu")), step)


def _power(v: Column, n: int) -> Column:
    return F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(n))), v + 1)


def _last(values: Column, k: Column) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - k + 1), F.greatest(k, F.lit(1)))


def flips_of(biases: Sequence[float], steps: int, fresh: bool = True) -> Column:
    """The flips of legs with these biases, ``steps`` each; with ``fresh`` nothing is tabu when a leg starts."""
    each = [F.struct(F.lit(float(b)).alias("bias"), F.lit(fresh and k == 0).alias("fresh")) for b in biases for k in range(steps)]
    return F.array(*each) if each else F.array().cast("array<struct<bias:double,fresh:boolean>>")


def search(found: DataFrame, n: int, edges: Edges, bias: float, steps: int, tabu_len: int) -> DataFrame:
    """x, t: each state after ``steps`` best flips with a tabu list that starts empty; blocked states stay."""
    return searched(found, n, edges, bias, steps, tabu_len, F.array().cast("array<int>")).select("x", "t")


def searched(found: DataFrame, n: int, edges: Edges, bias: float, steps: int, tabu_len: int, tabu: Column) -> DataFrame:
    """x, t, tabu: state and memory carried together from ``tabu`` on."""
    out = walked(F.col("x"), tabu, flips_of([bias], steps, fresh=False), n, edges, F.lit(tabu_len))
    return found.select("x", out.alias("w")).select("x", F.col("w.t").alias("t"), F.col("w.tabu").alias("tabu"))


def transport(spark: SparkSession, n: int, edges: Edges, schedule: Sequence[float], steps: int, tabu_len: int) -> DataFrame:
    """x, t over all states: the legs of ``schedule`` one after another, each with an empty tabu list."""
    out = walked(F.col("x"), F.array(), flips_of(schedule, steps), n, edges, F.lit(tabu_len))
    return states(spark, n).select("x", out["t"].alias("t"))


def loops(spark: SparkSession, n: int, edges: Edges, grid: DataFrame) -> DataFrame:
    """m, x, t over all states for each row of ``grid`` (m, biases, steps, tabu): a family of maps in one pass.

    ``biases`` are those of a loop's legs, without its base point.
    """
    each = F.flatten(F.transform("biases", lambda b: F.transform(F.sequence(F.lit(1), F.col("steps")), lambda k: F.struct(b.cast("double").alias("bias"), (k == 1).alias("fresh")))))
    rows = grid.select("m", "tabu", each.alias("flips")).crossJoin(states(spark, n))
    return rows.select("m", "x", walked(F.col("x"), F.array(), F.col("flips"), n, edges, F.col("tabu"))["t"].alias("t"))


def augmented(spark: SparkSession, n: int, edges: Edges, schedule: Sequence[float], steps: int, tabu_len: int) -> DataFrame:
    """x, t over all pairs of a state and a tabu list of at most ``tabu_len`` vertices, which is never forgotten.

    A pair is one number: the state times the number of lists, and the list's place (the
    empty one first, then by length and as digits to the base n).
    """
    starts = [sum(n**k for k in range(length)) for length in range(tabu_len + 2)]
    lists = starts[-1]
    place = F.col("x") % lists
    length = total([(place >= s).cast("int") for s in starts[1:-1]])
    digit = lambda k, size: F.floor((place - F.element_at(F.array(*map(F.lit, starts)), size + 1)) / F.pow(F.lit(float(n)), size - k)).cast("long") % n
    tabu = F.when(length == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), length), lambda k: digit(k, length).cast("int")))
    out = walked(F.floor(F.col("x") / lists).cast("long"), tabu, flips_of(schedule, steps, fresh=False), n, edges, F.lit(tabu_len))
    back = F.aggregate(F.col("w.tabu"), F.lit(0).cast("long"), lambda t, v: t * n + v) + F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.size("w.tabu") + 1)
    return spark.range(lists << n).withColumnRenamed("id", "x").select("x", out.alias("w")).select("x", (F.col("w.t") * lists + back).alias("t"))


def memory_blind(labels: DataFrame, lists: int) -> DataFrame:
    """x, block of pairs of state and list from labels (x, branch) of states."""
    return labels.select("branch", F.explode(F.sequence(F.col("x") * lists, F.col("x") * lists + lists - 1)).alias("x")).select("x", F.col("branch").alias("block"))


def settle(found: DataFrame, n: int, edges: Edges, cap: int = 500) -> DataFrame:
    """x, t: greedy descent until no flip lowers the energy."""
    out = found.select("x", F.col("x").alias("t"), F.lit(True).alias("going"))
    for step in range(cap):
        best = F.array_min(F.array(*(F.struct(_gain(F.col("t"), v, edges).alias("d"), F.lit(v).alias("v")) for v in range(n))))
        moved = out.withColumn("b", best).withColumn("going", F.col("going") & (F.col("b.d") < 0))
        mask = F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(n))), F.col("b.v") + 1)
        out = _held(moved.select("x", F.when(F.col("going"), F.col("t").bitwiseXOR(mask)).otherwise(F.col("t")).alias("t"), "going"))
        if not out.filter("going").limit(1).count():
            break
    return out.select("x", "t")


def branches(found: DataFrame, tops: DataFrame) -> DataFrame:
    """x, branch: the number (by order of states) of the nearest optimum, ties to the lower.

    Optima of a small instance are few; they are numbered and crossed with the states.
    """
    numbered = tops.select(F.col("x").alias("o"), (F.row_number().over(Window.orderBy("x")) - 1).alias("i"))
    return found.crossJoin(numbered).groupBy("x").agg(F.min_by("i", F.struct(hamming(F.col("x"), F.col("o")), F.col("i"))).cast("int").alias("branch"))


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """x, t of ``then`` after ``first``."""
    return first.alias("f").join(then.alias("g"), F.col("f.t") == F.col("g.x")).select(F.col("f.x").alias("x"), F.col("g.t").alias("t"))


def inverse(f: DataFrame) -> DataFrame:
    """x, t of the inverse; fails on a map that is not injective."""
    if f.groupBy("t").count().filter("count > 1").limit(1).count():
        raise ValueError("the map is not injective")
    return f.select(F.col("t").alias("x"), F.col("x").alias("t"))


def power(f: DataFrame, k: int) -> DataFrame:
    """The k-th iterate, by repeated squaring."""
    out, square = f.select("x", F.col("x").alias("t")), f
    while k:
        if k & 1:
            out = _held(compose(out, square))
        k >>= 1
        if k:
            square = _held(compose(square, square))
    return out


def order_of(f: DataFrame, cap: int = 12) -> int | None:
    """The least k up to ``cap`` whose iterate is the identity."""
    now = f
    for k in range(1, cap + 1):
        if not now.filter("x <> t").limit(1).count():
            return k
        now = _held(compose(now, f))
    return None


def refine(part: DataFrame, maps: Sequence[DataFrame]) -> DataFrame:
    """x, block: split by the blocks of the images under all maps; blocks are numbered by their least state."""
    keyed = part.select("x", F.col("block").alias("b0"))
    for i, f in enumerate(maps, 1):
        images = f.select("x", F.col("t").alias(f"t{i}")).join(part.select(F.col("x").alias(f"t{i}"), F.col("block").alias(f"b{i}")), f"t{i}").select("x", f"b{i}")
        keyed = keyed.join(images, "x")
    key = [f"b{i}" for i in range(len(maps) + 1)]
    blocks = keyed.groupBy(*key).agg(F.min("x").alias("m"))
    # ranks are over blocks, of which there are fewer than states
    numbered = blocks.withColumn("block", F.dense_rank().over(Window.orderBy("m")) - 1)
    return keyed.join(numbered, key).select("x", "block")


def coarsest_stable(part: DataFrame, maps: Sequence[DataFrame], cap: int = 64) -> tuple[DataFrame, list[int]]:
    """The coarsest refinement of ``part`` stable under all maps, and the block counts on the way."""
    profile = [part.select("block").distinct().count()]
    for _ in range(cap):
        part = _held(refine(part, maps))
        profile.append(part.select("block").distinct().count())
        if profile[-1] == profile[-2]:
            break
    return part, profile


def block_map(part: DataFrame, f: DataFrame) -> DataFrame:
    """x, t over blocks; fails if the partition is not stable under the map."""
    image = part.join(f, "x").select(F.col("block").alias("b"), F.col("t").alias("y")).join(part.select(F.col("x").alias("y"), F.col("block").alias("c")), "y")
    out = image.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    said = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("the partition is not stable")).cast("int")).otherwise(F.col("lo"))
    return out.select(F.col("b").alias("x"), said.alias("t"))


def recurrent_core(f: DataFrame) -> DataFrame:
    """x: states on cycles, the image of a power at least as large as the state set, by doubling."""
    size, reach, now = f.count(), 1, f
    while reach < size:
        now, reach = _held(compose(now, now)), 2 * reach
    return now.select(F.col("t").alias("x")).distinct()


def core_within(f: DataFrame, inside: DataFrame) -> DataFrame:
    """x: periodic states whose whole forward orbit stays in ``inside`` (x).

    Leaving is made a state of its own, -1, that maps to itself.
    """
    kept = f.join(inside, "x", "left_semi").join(inside.select(F.col("x").alias("t"), F.lit(1).alias("_in")), "t", "left").select("x", F.when(F.col("_in") == 1, F.col("t")).otherwise(F.lit(-1)).alias("t"))
    closed = kept.unionByName(kept.sparkSession.createDataFrame([(-1, -1)], kept.schema))
    return recurrent_core(_held(closed)).filter("x <> -1")


def cycles(f: DataFrame) -> DataFrame:
    """x, cycle: states on cycles with the least state of their cycle, by doubling."""
    on = recurrent_core(f)
    size = max(1, on.count())
    jump = _held(f.join(on, "x", "left_semi").select("x", "t", F.least("x", "t").alias("low")))
    reach = 1
    while reach < size:
        nxt = jump.select(F.col("x").alias("t"), F.col("t").alias("u"), F.col("low").alias("low2"))
        jump, reach = _held(jump.join(nxt, "t").select("x", F.col("u").alias("t"), F.least("low", "low2").alias("low"))), 2 * reach
    return jump.select("x", F.col("low").alias("cycle"))


def cycle_lengths(f: DataFrame) -> DataFrame:
    """length, cycles."""
    return cycles(f).groupBy("cycle").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("cycles"))


def idempotent(f: DataFrame) -> bool:
    return not compose(f, f).alias("g").join(f.alias("f"), "x").filter(F.col("g.t") != F.col("f.t")).limit(1).count()


def transient_profile(f: DataFrame) -> DataFrame:
    """depth, states: distance to the core, outward along inverse arrows."""
    front = recurrent_core(f).select("x", F.lit(0).alias("depth"))
    done = _held(front)
    depth = 0
    front = done
    while True:
        depth += 1
        nxt = f.join(front.select(F.col("x").alias("t")), "t", "left_semi").join(done, "x", "left_anti").select("x", F.lit(depth).alias("depth"))
        front = _held(nxt)
        if not front.limit(1).count():
            break
        done = _held(done.unionByName(front))
    return done.groupBy("depth").agg(F.count("*").alias("states"))


def collisions(f: DataFrame) -> DataFrame:
    """blocks, images, surplus, shared (images with more than one source)."""
    each = f.groupBy("t").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("blocks"), F.count("*").alias("images"), (F.sum("n") - F.count("*")).alias("surplus"), F.count_if(F.col("n") > 1).alias("shared"))


def collision_pairs(f: DataFrame) -> DataFrame:
    """x, y, image: pairs of states (x < y) with one image; for state sets of small instances."""
    a, b = f.alias("a"), f.alias("b")
    return a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.x") < F.col("b.x"))).select(F.col("a.x").alias("x"), F.col("b.x").alias("y"), F.col("a.t").alias("image"))


def one_step_vertex(f: DataFrame) -> DataFrame:
    """x, v: the vertex that one step flips; null where the state is blocked."""
    return f.select("x", F.when(F.col("x") != F.col("t"), F.log2(F.col("x").bitwiseXOR(F.col("t")).cast("double")).cast("int")).alias("v"))


def fibres(f: DataFrame, labels: DataFrame) -> DataFrame:
    """branch, images: the image branches of each branch; one image means the map is determined by branches."""
    out = f.join(labels, "x").join(labels.select(F.col("x").alias("t"), F.col("branch").alias("to")), "t")
    return out.groupBy("branch").agg(F.array_sort(F.collect_set("to")).alias("images"))


def image_sizes(spark: SparkSession, n: int, edges: Edges, biases: Sequence[float], tabu: Sequence[int], steps: Sequence[int]) -> DataFrame:
    """bias, tabu, steps, images: how many states each leg reaches from all."""
    return leg_census(spark, n, edges, biases, tabu, steps).drop("lost")


def leg_census(spark: SparkSession, n: int, edges: Edges, biases: Sequence[float], tabu: Sequence[int], steps: Sequence[int]) -> DataFrame:
    """bias, tabu, steps, images, lost: for every single leg how many states it reaches from all, and how many it loses; one pass over all legs."""
    rows = [(i, [b], s, k) for i, (k, s, b) in enumerate((k, s, b) for k in tabu for s in steps for b in biases)]
    grid = spark.createDataFrame(rows, "m int, biases array<double>, steps int, tabu int")
    sizes = loops(spark, n, edges, grid).groupBy("m").agg(F.count_distinct("t").alias("images"))
    return grid.join(sizes, "m").select(F.get("biases", F.lit(0)).alias("bias"), "tabu", "steps", "images", (F.lit(1 << n) - F.col("images")).alias("lost"))


def characterised(f: DataFrame) -> DataFrame:
    """x, y, image, vx, vy, exact: colliding pairs of a one-step map, the vertices they flip, and whether they differ in just those two."""
    v = one_step_vertex(f)
    pairs = collision_pairs(f).join(v.select("x", F.col("v").alias("vx")), "x").join(v.select(F.col("x").alias("y"), F.col("v").alias("vy")), "y")
    two = F.expr("shiftleft(1L, vx) | shiftleft(1L, vy)")
    exact = F.coalesce((F.col("vx") != F.col("vy")) & (F.col("x").bitwiseXOR(F.col("y")) == two), F.lit(False))
    return pairs.select("x", "y", "image", "vx", "vy", exact.alias("exact"))


def preimages_of_optima(spark: SparkSession, n: int, edges: Edges, bias: float) -> DataFrame:
    """z, preimages, bound, at_two: for each optimum how many neighbours step onto it, against n - 2 times the optima at distance two."""
    tops = least_states(n, edges)
    near = spark.createDataFrame([(z, z ^ 1 << v) for z in tops for v in range(n)], "z long, x long")
    step = walked(F.col("x"), F.array(), flips_of([bias], 1), n, edges, F.lit(3))["t"]
    hit = near.select("z", (step == F.col("z")).cast("long").alias("hit")).groupBy("z").agg(F.sum("hit").alias("preimages"))
    two = at_distance_two(F.col("z"), tops)
    return hit.select("z", "preimages", (F.lit(n) - 2 * two).alias("bound"), two.alias("at_two"))


def basin_images(settled: DataFrame, f: DataFrame, labels: DataFrame) -> DataFrame:
    """basin, images: the image branches of each basin (states that settle in one state); one image means that basins determine the loop."""
    to = f.join(labels.select(F.col("x").alias("t"), F.col("branch").alias("to")), "t").select("x", "to")
    return settled.select("x", F.col("t").alias("basin")).join(to, "x").groupBy("basin").agg(F.array_sort(F.collect_set("to")).alias("images"))


def determined(images: DataFrame) -> DataFrame:
    """fibres, determined, ambiguous, largest: how many fibres have one image only."""
    size = F.size("images")
    return images.agg(F.count("*").alias("fibres"), F.count_if(size == 1).alias("determined"), F.count_if(size > 1).alias("ambiguous"), F.coalesce(F.max(size), F.lit(0)).alias("largest"))


def at_distance_two(z: Column, tops: Sequence[int]) -> Column:
    return total([(F.bit_count(z.bitwiseXOR(F.lit(o))) == 2).cast("int") for o in tops])


def loop(base: float, *interior: float) -> tuple[float, ...]:
    """A schedule from a base point and back."""
    return (base, *interior, base)


def joined_schedules(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    if a[-1] != b[0]:
        raise ValueError("the schedules do not meet")
    return (*a, *b[1:])


def all_maps(spark: SparkSession, n: int) -> DataFrame:
    """m, x, t: every map on n states, for exhaustive checks of small n."""
    return spark.range(n**n).withColumnRenamed("id", "m").crossJoin(spark.range(n).withColumnRenamed("id", "x")).withColumn("t", F.floor(F.col("m") / F.pow(F.lit(n), F.col("x"))).cast("long") % n)


# ---------------------------------------------------------------- families of maps (m, x, t)
def family_cores(maps: DataFrame) -> DataFrame:
    """m, x: the states on cycles of each map, by doubling all maps at once."""
    size = maps.groupBy("m").count().agg(F.max("count")).first()[0] or 0
    now, reach = maps.select("m", "x", "t"), 1
    while reach < size:
        after = now.select("m", F.col("x").alias("t"), F.col("t").alias("u"))
        now, reach = _held(now.join(after, ["m", "t"]).select("m", "x", F.col("u").alias("t"))), 2 * reach
    return now.select("m", F.col("t").alias("x")).distinct()


def family_stable(part: DataFrame, maps: DataFrame, cap: int = 64) -> DataFrame:
    """m, x, block: for each map the coarsest refinement of ``part`` (x, block) stable under it; blocks by their least state."""
    now = _held(maps.select("m", "x").join(part, "x"))
    counts = now.groupBy("m").agg(F.count_distinct("block").alias("n")).agg(F.sum("n")).first()[0]
    for _ in range(cap):
        image = maps.join(now.select("m", F.col("x").alias("t"), F.col("block").alias("b1")), ["m", "t"]).select("m", "x", "b1")
        keyed = now.withColumnRenamed("block", "b0").join(image, ["m", "x"])
        blocks = keyed.groupBy("m", "b0", "b1").agg(F.min("x").alias("least"))
        numbered = blocks.withColumn("block", F.row_number().over(Window.partitionBy("m").orderBy("least")) - 1)
        now = _held(keyed.join(numbered, ["m", "b0", "b1"]).select("m", "x", "block"))
        before, counts = counts, now.agg(F.count_distinct("m", "block")).first()[0]
        if counts == before:
            break
    return now


def family_quotients(stable: DataFrame, maps: DataFrame) -> DataFrame:
    """m, x, t: the map that each map induces on the blocks of its stable partition."""
    image = stable.withColumnRenamed("block", "b").join(maps, ["m", "x"]).join(stable.select("m", F.col("x").alias("t"), F.col("block").alias("c")), ["m", "t"])
    return image.groupBy("m", "b").agg(F.min("c").alias("t")).select("m", F.col("b").alias("x"), "t")


def loop_grid(spark: SparkSession) -> DataFrame:
    """m, biases, steps, tabu: loops through 0 over two interior points in both orders, by memory and length."""
    interiors = [order for a in (0.05, 0.10, 0.25) for b in (0.50, 0.75, 0.90) for order in ((a, b), (b, a))]
    rows = [([*interior, 0.0], steps, tabu) for interior in interiors for tabu in (1, 2, 3) for steps in (2, 4, 8, 16)]
    return spark.createDataFrame([(m, *row) for m, row in enumerate(rows)], "m int, biases array<double>, steps int, tabu int")


def attack(spark: SparkSession, n: int, edges: Edges, grid: DataFrame) -> DataFrame:
    """m, blocks, images, surplus, bijective: of the map that each loop of ``grid`` induces on its stable quotient of branches."""
    maps = _held(loops(spark, n, edges, grid))
    labels = branches(states(spark, n), optima(spark, n, edges)).withColumnRenamed("branch", "block")
    induced = family_quotients(family_stable(labels, maps), maps)
    out = induced.groupBy("m").agg(F.count("*").alias("blocks"), F.count_distinct("t").alias("images"))
    return out.select("m", "blocks", "images", (F.col("blocks") - F.col("images")).alias("surplus"), (F.col("blocks") == F.col("images")).alias("bijective"))


def attack_augmented(spark: SparkSession, n: int, edges: Edges, schedule: Sequence[float], tabu_len: int, steps: int) -> DataFrame:
    """states, collisions, blocks, bijective: with the memory kept as part of the state."""
    lists = sum(n**k for k in range(tabu_len + 1))
    f = _held(augmented(spark, n, edges, schedule[1:], steps, tabu_len))
    labels = branches(states(spark, n), optima(spark, n, edges))
    part, _ = coarsest_stable(memory_blind(labels, lists), [f])
    induced = block_map(part, f)
    whole = f.agg(F.count("*").alias("states"), (F.count("*") - F.count_distinct("t")).alias("collisions"))
    return whole.crossJoin(induced.agg(F.count("*").alias("blocks"), (F.count("*") == F.count_distinct("t")).alias("bijective")))


# The six loops through 0.1.
LOOPS = {"g1": (0.1, 0.5, 0.9, 0.1), "g1^-1": (0.1, 0.9, 0.5, 0.1), "g3": (0.1, 0.25, 0.75, 0.1), "g3^-1": (0.1, 0.75, 0.25, 0.1), "g1.g1": (0.1, 0.5, 0.9, 0.1, 0.5, 0.9, 0.1), "g1.g1^-1": (0.1, 0.5, 0.9, 0.1, 0.9, 0.5, 0.1)}


def monodromy(spark: SparkSession, n: int, edges: Edges, tabu: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """(m, x, t) of the six loops, and (m, x) of their cores."""
    grid = spark.createDataFrame([(name, list(schedule[1:]), steps, tabu) for name, schedule in LOOPS.items()], "m string, biases array<double>, steps int, tabu int")
    maps = _held(loops(spark, n, edges, grid))
    return maps, _held(family_cores(maps))


def monodromy_report(maps: DataFrame, cores: DataFrame) -> DataFrame:
    """distinct_cores, intersection, composition_holds, inverse_fails, reverse_preserves_core of the six loops."""
    of = lambda name: maps.filter(F.col("m") == name).select("x", "t")
    core = cores.filter(F.col("m") == "g1").select("x")
    differs = lambda f, g: f.alias("f").join(g.alias("g"), "x").filter(F.col("f.t") != F.col("g.t")).select("x")
    bad = differs(compose(of("g1"), of("g1")), of("g1.g1")).unionByName(differs(compose(of("g1"), of("g1^-1")), of("g1.g1^-1")))
    returned = compose(of("g1"), of("g1^-1")).join(core, "x", "left_semi").filter("x <> t")
    left = of("g1^-1").join(core, "x", "left_semi").join(core.withColumnRenamed("x", "t"), "t", "left_anti")
    sets = cores.groupBy("m").agg(F.array_sort(F.collect_list("x")).alias("s")).agg(F.count_distinct("s").alias("distinct_cores"))
    shared = cores.groupBy("x").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == len(LOOPS)).alias("intersection"))
    none = lambda df, name, yes: df.agg((F.count("*") == 0 if yes else F.count("*") > 0).alias(name))
    return sets.crossJoin(shared).crossJoin(none(bad, "composition_holds", True)).crossJoin(none(returned, "inverse_fails", False)).crossJoin(none(left, "reverse_preserves_core", True))


def bridge(spark: SparkSession, lengths: DataFrame, primes: Sequence[int] = (3, 5, 7, 11, 13, 17, 19, 23)) -> DataFrame:
    """length, primes: the first three primes p over a cycle length with the length dividing p - 1, so that the cycle embeds in the units mod p."""
    fits = F.filter(F.array(*(F.lit(p) for p in primes)), lambda p: (p > F.col("length")) & ((p - 1) % F.col("length") == 0))
    return lengths.select("length").distinct().select("length", F.slice(fits, 1, 3).alias("primes"))


def verify_field(spark: SparkSession, p: int) -> DataFrame:
    """p, bijective, compose_ok: multiplications mod p permute the units and compose; every (a, b, x) is looked at."""
    units = lambda name: spark.range(1, p).withColumnRenamed("id", name)
    rows = units("a").crossJoin(units("b")).crossJoin(units("x"))
    per = rows.groupBy("a").agg(F.count_distinct(F.col("a") * F.col("x") % p).alias("images"), F.every(F.col("a") * F.col("b") % p * F.col("x") % p == F.col("a") * (F.col("b") * F.col("x") % p) % p).alias("ok"))
    return per.agg(F.lit(p).alias("p"), F.every(F.col("images") == p - 1).alias("bijective"), F.every("ok").alias("compose_ok"))


def quotient_map(part: DataFrame, f: DataFrame) -> DataFrame:
    """x, t over blocks, by each block's least state; for partitions that ``f`` respects."""
    least = part.groupBy("block").agg(F.min("x").alias("x"))
    return least.join(f, "x").join(part.select(F.col("x").alias("t"), F.col("block").alias("c")), "t").select(F.col("block").alias("x"), F.col("c").alias("t"))


def projection(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """x, t: the coarse block of each fine block."""
    return fine.groupBy("block").agg(F.min("x").alias("x")).join(coarse.withColumnRenamed("block", "c"), "x").select(F.col("block").alias("x"), F.col("c").alias("t"))


def smallest_witness(spark: SparkSession, largest: int = 4) -> DataFrame | None:
    """n, m, f, x, within, after: the first map and proper subset (bits f) where the core within the subset is not the core cut to it.

    All maps and subsets of one size are looked at together; the first is that of the least
    images in order, then of the least f.
    """
    for n in range(2, largest + 1):
        maps = all_maps(spark, n)
        order = maps.groupBy("m").agg(F.sum(F.col("t") * F.pow(F.lit(n), n - 1 - F.col("x"))).cast("long").alias("place"))
        cores = family_cores(maps)
        subsets = spark.range(1, (1 << n) - 1).withColumnRenamed("id", "f")
        cut = cores.crossJoin(subsets).filter(F.expr("(f >> cast(x as int)) & 1 = 1")).select("m", "f", "x")
        pairs = maps.crossJoin(subsets).filter(F.expr("(f >> cast(x as int)) & 1 = 1")).select("m", "f", "x", F.expr("CASE WHEN (f >> cast(t as int)) & 1 = 1 THEN t ELSE -1 END").alias("t"))
        away = maps.select("m").distinct().crossJoin(subsets).select("m", "f", F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("t"))
        keyed = pairs.unionByName(away).withColumn("m", F.struct("m", "f"))
        within = family_cores(keyed).filter("x >= 0").select("m.m", "m.f", "x")
        both = within.withColumn("within", F.lit(True)).join(cut.withColumn("after", F.lit(True)), ["m", "f", "x"], "full").fillna(False)
        differ = both.filter("within <> after").select("m", "f").distinct().join(order, "m").agg(F.min(F.struct("place", "f", "m")).alias("w"))
        if (w := differ.first()["w"]) is not None:
            return both.filter((F.col("m") == w["m"]) & (F.col("f") == w["f"])).select(F.lit(n).alias("n"), F.lit(w["place"]).cast("long").alias("place"), "f", "x", "within", "after")
    return None


def multiplicative_orders(spark: SparkSession, p: int) -> DataFrame:
    """a, order: of every unit modulo the prime p, from the table of powers."""
    powers = spark.range(1, p).withColumnRenamed("id", "a").select("a", F.posexplode(F.expr(f"aggregate(sequence(1, {p - 1}), array(cast(1 as bigint)), (acc, k) -> array_append(acc, (element_at(acc, -1) * a) % {p}))")).alias("k", "power"))
    return powers.filter("k > 0 AND power = 1").groupBy("a").agg(F.min("k").cast("long").alias("order"))


def generator(spark: SparkSession, p: int) -> int:
    return multiplicative_orders(spark, p).filter(F.col("order") == p - 1).agg(F.min("a")).first()[0]


def character(spark: SparkSession, p: int, h: int) -> tuple[float, float]:
    """(re, im) of exp(2 pi i log_g(h) / (p - 1)) for the least generator g."""
    if h % p == 0:
        raise ValueError("0 has no character")
    g = generator(spark, p)
    k = next(k for k in range(p - 1) if pow(g, k, p) == h % p)
    row = spark.range(1).select(F.cos(F.lit(2.0) * F.pi() * k / (p - 1)).alias("re"), F.sin(F.lit(2.0) * F.pi() * k / (p - 1)).alias("im")).first()
    return row["re"], row["im"]


def invariant_partitions(maps: DataFrame, partitions: DataFrame) -> DataFrame:
    """m, q of maps (m, x, t) and partitions (q, x, block) with block(x) = block(y) implying block(Tx) = block(Ty)."""
    image = maps.join(partitions, "x").select("m", "q", "block", "t").join(partitions.select("q", F.col("x").alias("t"), F.col("block").alias("to")), ["q", "t"])
    broken = image.groupBy("m", "q", "block").agg(F.count_distinct("to").alias("c")).filter("c > 1").select("m", "q").distinct()
    return maps.select("m").distinct().crossJoin(partitions.select("q").distinct()).join(broken, ["m", "q"], "left_anti")


def refinements(partitions: DataFrame) -> DataFrame:
    """fine, coarse: pairs of partitions (q, x, block) where every fine block lies in one coarse block."""
    both = partitions.alias("f").join(partitions.alias("c"), "x").select(F.col("f.q").alias("fine"), F.col("c.q").alias("coarse"), F.col("f.block").alias("fb"), F.col("c.block").alias("cb"))
    per = both.groupBy("fine", "coarse", "fb").agg(F.count_distinct("cb").alias("c"))
    return per.groupBy("fine", "coarse").agg(F.max("c").alias("c")).filter("c = 1").select("fine", "coarse")
