"""Generated corpora: binary boundaries and distractors, grid walks, solver logs, mixed agents, graph instances."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Puzzles (rows of cells, 0 is empty) and search strategies.
PUZZLES = {
    "easy": "530070000600195000098000060800060003400803001700020006060000280000419005000080079",
    "medium": "000000907000420180000705026100904000050000040000507009920108000034059000507000000",
    "hard": "000000000000003085001020000000507000004000100090000000500000073002010000000040009",
    "empty": "0" * 81,
}
STRATEGIES = {"first/asc": ("first", "asc"), "mrv/asc": ("mrv", "asc"), "first/random": ("first", "random")}


def boundary_runs(spark: SparkSession, horizon: int, distracted: bool) -> DataFrame:
    """agent, labels: every binary trace of length ``horizon``; with 2^k dead ends below each node of level k if ``distracted``."""
    bit = lambda m, i: F.shiftright(m, i).bitwiseAND(F.lit(1)).cast("string")
    live = spark.range(1 << horizon).select(F.lit("B" if distracted else "A").alias("agent"), F.array(*(bit(F.col("id"), i) for i in range(horizon))).alias("labels"))
    for k in range(1, horizon - 1) if distracted else ():
        ends = spark.range(1 << k).alias("m").crossJoin(spark.range(1 << k).alias("d"))
        live = live.unionByName(ends.select(F.lit("B").alias("agent"), F.concat(F.array(*(bit(F.col("m.id"), i) for i in range(k))), F.array(F.concat(F.lit(f"d{k}."), F.col("d.id").cast("string")))).alias("labels")))
    return live


def grid_walks(spark: SparkSession, n: int = 6, monotone: bool = False, slack: int | None = None) -> DataFrame:
    """labels, ok: self-avoiding walks from one corner with at most 2(n - 1) moves; ok: at the other corner with all of them.

    Each level unfolds the one before by an expression and no shuffle, so walks are never on the driver.
    """
    most = 2 * (n - 1)
    moves = [(1, 0), (0, 1)] if monotone else [(1, 0), (-1, 0), (0, 1), (0, -1)]
    front = spark.createDataFrame([([0],)], "path array<int>")
    out = front
    for step in range(1, most + 1):
        last = F.element_at("path", -1)
        row, column = F.floor(last / n).cast("int"), last % n
        places = []
        for dr, dc in moves:
            inside = (row + dr).between(0, n - 1) & (column + dc).between(0, n - 1) & ~F.array_contains("path", last + dr * n + dc)
            if slack is not None:
                inside = inside & (2 * (n - 1) - (row + dr) - (column + dc) <= most - step + slack)
            places.append(F.when(inside, last + dr * n + dc))
        front = front.select("path", F.explode(F.array_compact(F.array(*places))).alias("here")).select(F.array_append("path", F.col("here")).alias("path"))
        out = out.unionByName(front)
    return out.select(F.transform("path", lambda p: p.cast("string")).alias("labels"), ((F.element_at("path", -1) == n * n - 1) & (F.size("path") == most + 1)).alias("ok"))


class _Board:
    """Cells and what rows, columns and boxes still allow."""

    def __init__(self, puzzle: str) -> None:
        self.cells = [int(c) for c in puzzle]
        self.free = [511] * 27
        for cell, value in enumerate(self.cells):
            if value:
                self.put(cell, value)

    @staticmethod
    def units(cell: int) -> tuple[int, int, int]:
        row, column = divmod(cell, 9)
        return row, 9 + column, 18 + row // 3 * 3 + column // 3

    def put(self, cell: int, value: int) -> None:
        self.cells[cell] = value
        for u in self.units(cell):
            self.free[u] ^= 1 << value - 1

    def lift(self, cell: int) -> None:
        value, self.cells[cell] = self.cells[cell], 0
        for u in self.units(cell):
            self.free[u] ^= 1 << value - 1

    def options(self, cell: int) -> list[int]:
        a, b, c = self.units(cell)
        allowed = self.free[a] & self.free[b] & self.free[c]
        return [v for v in range(1, 10) if allowed >> v - 1 & 1]


def solver_nodes(puzzle: str, order: str, values: str, seed: int = 0, cap: int = 400_000) -> Iterator[tuple[int, int]]:
    """(depth, backtracks so far) of every node that a backtracking search visits, until it is solved or capped."""
    board, rng = _Board(puzzle), random.Random(seed)
    empty = [i for i, v in enumerate(board.cells) if not v]

    def branches() -> list[tuple[int, int]]:
        open_cells = [i for i in empty if not board.cells[i]]
        if not open_cells:
            return []
        if order == "mrv":
            cell = min(open_cells, key=lambda i: (len(board.options(i)), i))
        else:
            cell = rng.choice(open_cells) if order == "random" else open_cells[0]
        found = board.options(cell)
        if values == "random":
            rng.shuffle(found)
        return [(cell, v) for v in reversed(found)]

    visited, backtracks = 1, 0
    yield 0, 0
    stack = [branches()]
    trail: list[int] = []
    while stack and len(trail) < len(empty) and visited < cap:
        if stack[-1]:
            cell, value = stack[-1].pop()
            board.put(cell, value)
            trail.append(cell)
            visited += 1
            yield len(trail), backtracks
            if len(trail) < len(empty) and visited < cap:
                stack.append(branches())
            continue
        stack.pop()
        if trail:
            board.lift(trail.pop())
            backtracks += 1


def solver_ledger(spark: SparkSession, puzzles: list[str], strategies: list[str], seed: int = 0) -> DataFrame:
    """agent (strategy), puzzle, level, n, backtracks: nodes visited by depth; a search is sequential, searches are parallel."""
    jobs = spark.createDataFrame([(s, p, PUZZLES[p], *STRATEGIES[s]) for s in strategies for p in puzzles], "agent string, puzzle string, cells string, cell_order string, value_order string").repartition(len(strategies) * len(puzzles), "agent", "puzzle")

    def work(frames):
        for frame in frames:
            for job in frame.itertuples():
                counts: dict[int, int] = {}
                back = 0
                for depth, back in solver_nodes(job.cells, job.cell_order, job.value_order, seed):
                    counts[depth] = counts.get(depth, 0) + 1
                yield pd.DataFrame([(job.agent, job.puzzle, d, c, back) for d, c in counts.items()], columns=["agent", "puzzle", "level", "n", "backtracks"])

    return jobs.mapInPandas(work, "agent string, puzzle string, level int, n long, backtracks long")


def mixed_agents(spark: SparkSession, runs: int = 300, tasks: int = 5) -> DataFrame:
    """agent, task, ordinal, outcome, steps of three ways to work: straight to the goal, wandering, and looping on one call.

    Drawn from hashes of the run, so any number of rows comes out the same on any number of tasks.
    """
    base = spark.range(runs * tasks * 3).select(F.col("id").alias("ordinal"), (F.col("id") % 3).alias("kind"), F.concat(F.lit("task-"), (F.col("id") / 3 % tasks).cast("int").cast("string")).alias("task"))
    draw = lambda salt, n: F.pmod(F.xxhash64("ordinal", F.lit(salt)), F.lit(n)).cast("int")
    step = lambda tool, args, error: F.struct(F.lit(tool).alias("tool"), args.alias("args"), F.when(error, "failed").alias("error"))
    file = lambda k: F.to_json(F.struct(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py")).alias("path")))
    straight = F.array(*(step(t, file(F.lit(0)), F.lit(False)) for t in ("read", "edit", "bash")))
    wander = F.transform(F.sequence(F.lit(0), draw("w", 12) + 5), lambda i: step("read", file(F.pmod(F.xxhash64("ordinal", i), F.lit(20))), F.pmod(F.xxhash64("ordinal", i), F.lit(9)) == 0))
    looping = F.transform(F.sequence(F.lit(0), draw("l", 15) + 3), lambda i: step("bash", file(F.lit(1)), F.lit(True)))
    steps = F.when(F.col("kind") == 0, straight).when(F.col("kind") == 1, wander).otherwise(looping)
    good = F.when(F.col("kind") == 0, draw("ok", 100) < 97).when(F.col("kind") == 1, draw("ok", 100) < 89).otherwise(draw("ok", 100) < 30)
    name = F.element_at(F.array(F.lit("disciplined"), F.lit("wanderer"), F.lit("looping")), (F.col("kind") + 1).cast("int"))
    return base.select("ordinal", name.alias("agent"), "task", F.when(good, "stop").otherwise("error").alias("outcome"), steps.alias("steps"))


def graph_instances(spark: SparkSession, seed: int = 0, count: int = 6) -> DataFrame:
    """instance, n, u, v: seeded random graphs on 8 to 11 vertices; drawn on the driver so that streams repeat."""
    rng, rows = random.Random(seed), []
    for k in range(count):
        n = 8 + k % 4
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        rows += [(k, n, a, b) for a, b in edges]
    return spark.createDataFrame(rows, "instance int, n int, u int, v int")
