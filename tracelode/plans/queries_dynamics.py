"""Registered queries of searches, families of maps, quotients and finite fields, each with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dynamics, graphs
from . import views
from .registry import query

N = 6
EDGES = dynamics.find_instance(N, dynamics.ring(N))
RING = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 3))
LONG = ((0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (4, 6), (5, 7), (6, 7), (1, 6))


# ---------------------------------------------------------------- SQL that several queries share
def _bit(x: str, v: int) -> str:
    return f"(({x} >> {v}) & 1)"


def _gains(x: str, n: int, edges) -> list[str]:
    return [" + ".join(f"(CASE WHEN {_bit(x, a)} = {_bit(x, b)} THEN -1 ELSE 1 END)" for a, b in edges if v in (a, b)) or "0" for v in range(n)]


def states_sql(n: int) -> str:
    return f"s AS (SELECT range::BIGINT AS x FROM range({1 << n}))"


def optima_sql(n: int, edges) -> str:
    """o: optima with their number; br: the branch of each state."""
    cost = " + ".join(f"({_bit('x', u)} = {_bit('x', v)})::INT" for u, v in edges)
    return f"e AS (SELECT x, {cost} AS energy FROM s), o AS (SELECT x AS o, row_number() OVER (ORDER BY x) - 1 AS i FROM e WHERE energy = (SELECT min(energy) FROM e)), br AS (SELECT s.x, arg_min(i, (bit_count(xor(s.x, o.o)), i))::BIGINT AS branch FROM s, o GROUP BY s.x)"


def walk_sql(n: int, edges, configs: dict, start: str = "SELECT m, x, 0, x, []::INT[] FROM cfg, s") -> str:
    """w: m, x, t of every state under every configuration (biases of legs, steps, tabu length); ``start`` may give a memory, which is then kept."""
    q = lambda m: f"'{m}'" if isinstance(m, str) else str(m)
    carried = "FROM cfg, s" not in start
    rows = ", ".join(f"({q(m)}, {[float(b) for b in biases for _ in range(steps)]}::DOUBLE[], {[not carried and k == 0 for _ in biases for k in range(steps)]}::BOOLEAN[], {tabu})" for m, (biases, steps, tabu) in configs.items())
    options = ", ".join(f"{{'d': {g}, 'far': abs({v}.0::DOUBLE - bias * {float(n - 1)}::DOUBLE), 'v': {v}}}" for v, g in enumerate(_gains("t", n, edges)))
    return f"""cfg(m, bias, fresh, tl) AS (VALUES {rows}),
steps AS (WITH RECURSIVE w(m, x, k, t, tabu) AS ({start} UNION ALL
  SELECT m, x, k + 1, CASE WHEN v IS NULL THEN t ELSE xor(t, 1::BIGINT << v) END, CASE WHEN v IS NULL OR tl = 0 THEN held ELSE list_append(held, v)[-tl:] END
  FROM (SELECT *, list_sort(list_filter([{options}], lambda c: NOT list_contains(held, c.v)))[1].v::INT AS v FROM (SELECT m, x, k, t, tl, cfg.bias[k + 1] AS bias, CASE WHEN fresh[k + 1] THEN []::INT[] ELSE tabu END AS held FROM w JOIN cfg USING (m) WHERE k < len(cfg.bias)) h) c)
  SELECT * FROM w),
w AS (SELECT steps.m, x, t, tabu FROM steps JOIN cfg USING (m) WHERE k = len(cfg.bias))"""


def stable_sql(maps: str, part: str, rounds: int = 12) -> str:
    """q: m, x, block after so many refinements of ``part`` (x, b) under each of ``maps`` (m, x, t); more than are needed."""
    return f"q AS (WITH RECURSIVE r(k, m, x, b) AS (SELECT 0, m, x, b FROM (SELECT DISTINCT m FROM {maps}) f, ({part}) p UNION ALL SELECT a.k + 1, a.m, a.x, dense_rank() OVER (PARTITION BY a.m ORDER BY a.b, c.b) FROM r a JOIN {maps} f ON f.m = a.m AND f.x = a.x JOIN r c ON c.m = a.m AND c.x = f.t WHERE a.k < {rounds}) SELECT m, x, b FROM r WHERE k = {rounds})"


# ---------------------------------------------------------------- searches
@query(f"WITH {states_sql(8)}, {walk_sql(8, LONG, {0: ([0.5], 4, 2)})} SELECT x, t FROM w")
def leg_map(spark, sf_dir):
    return dynamics.search(dynamics.states(spark, 8), 8, LONG, 0.5, 4, 2)


_CENSUS = {(k * 10 + int(b)): ([b], 2, k) for k in (1, 2) for b in (0.0, 1.0)}


@query(f"WITH {states_sql(6)}, {walk_sql(6, RING, _CENSUS)} SELECT cfg.bias[1] AS bias, tl AS tabu, len(cfg.bias)::INT AS steps, count(DISTINCT t) AS images FROM w JOIN cfg USING (m) GROUP BY ALL")
def leg_image_sizes(spark, sf_dir):
    return dynamics.image_sizes(spark, 6, RING, (0.0, 1.0), (1, 2), (2,))


_LEGS = {(k, steps, b): ([b], steps, k) for k in (2, 3, 4, 5) for steps in (1, 2, 4, 8, 16) for b in (0.0, 0.3, 0.5, 0.7, 1.0)}


@query(f"WITH {states_sql(N)}, {walk_sql(N, EDGES, dict(enumerate(_LEGS.values())))} SELECT cfg.bias[1] AS bias, tl AS tabu, len(cfg.bias)::INT AS steps, count(DISTINCT t) AS images, {1 << N} - count(DISTINCT t) AS lost FROM w JOIN cfg USING (m) GROUP BY ALL")
def leg_census(spark, sf_dir):
    return dynamics.leg_census(spark, N, EDGES, (0.0, 0.3, 0.5, 0.7, 1.0), (2, 3, 4, 5), (1, 2, 4, 8, 16))


def settle_sql(n: int, edges) -> str:
    options = ", ".join(f"{{'d': {g}, 'v': {v}}}" for v, g in enumerate(_gains("t", n, edges)))
    return f"g AS (WITH RECURSIVE g(x, k, t, going) AS (SELECT x, 0, x, true FROM s UNION ALL SELECT x, k + 1, CASE WHEN c.d < 0 THEN xor(t, 1::BIGINT << c.v) ELSE t END, c.d < 0 FROM (SELECT x, k, t, list_sort([{options}])[1] AS c FROM g WHERE going) h) SELECT x, arg_max(t, k)::BIGINT AS t FROM g GROUP BY x)"


@query(f"WITH {states_sql(6)}, {settle_sql(6, RING)} SELECT x, t FROM g")
def settled_states(spark, sf_dir):
    return dynamics.settle(dynamics.states(spark, 6), 6, RING)


_LOOP = (0.1, 0.5, 0.9, 0.1)


@query(f"WITH {states_sql(N)}, {walk_sql(N, EDGES, {0: (_LOOP[1:], 4, 2)})} SELECT x, t FROM w")
def transport_map(spark, sf_dir):
    """A loop's map over all states: three legs, each forgetting what the one before had tried."""
    return dynamics.transport(spark, N, EDGES, _LOOP[1:], 4, 2)


_KEPT = "SELECT m, x, 0, x, [(x % {0})::INT]::INT[] FROM cfg, (SELECT x FROM s) z".format(N)


@query(f"WITH {states_sql(N)}, {walk_sql(N, EDGES, {0: ([0.5], 5, 2)}, _KEPT)} SELECT x, t, array_to_string(tabu, ',') AS tabu FROM w")
def carried_memory(spark, sf_dir):
    """State and tabu list carried together from a list that is not empty."""
    start = F.array((F.col("x") % N).cast("int"))
    out = dynamics.searched(dynamics.states(spark, N), N, EDGES, 0.5, 5, 2, start)
    return out.select("x", "t", F.array_join("tabu", ",").alias("tabu"))


@query(f"WITH {states_sql(N)}, {optima_sql(N, EDGES)}, {walk_sql(N, EDGES, {0: (_LOOP[1:], 4, 2)})} SELECT a.branch, array_to_string(list_sort(list(DISTINCT b.branch)), ',') AS images FROM w JOIN br a USING (x) JOIN br b ON b.x = w.t GROUP BY a.branch")
def branch_determined(spark, sf_dir):
    """Over every state and not a sample: is the loop a map of branches?"""
    labels = dynamics.branches(dynamics.states(spark, N), dynamics.optima(spark, N, EDGES))
    out = dynamics.fibres(dynamics.transport(spark, N, EDGES, _LOOP[1:], 4, 2), labels)
    return out.select(F.col("branch").cast("long").alias("branch"), F.array_join("images", ",").alias("images"))


@query(f"WITH {states_sql(N)}, {optima_sql(N, EDGES)}, {settle_sql(N, EDGES)}, {walk_sql(N, EDGES, {0: (_LOOP[1:], 4, 2)})}, b AS (SELECT g.t, count(DISTINCT br.branch) AS c FROM w JOIN g USING (x) JOIN br ON br.x = w.t GROUP BY g.t) SELECT count(*) AS fibres, count(*) FILTER (c = 1) AS determined, count(*) FILTER (c > 1) AS ambiguous, max(c)::INT AS largest FROM b")
def fibre_determined(spark, sf_dir):
    """The same by basins of greedy descent."""
    every = dynamics.states(spark, N)
    labels = dynamics.branches(every, dynamics.optima(spark, N, EDGES))
    return dynamics.determined(dynamics.basin_images(dynamics.settle(every, N, EDGES), dynamics.transport(spark, N, EDGES, _LOOP[1:], 4, 2), labels))


_GRID = {}
for _a in (0.05, 0.10, 0.25):
    for _b in (0.50, 0.75, 0.90):
        for _order in ((_a, _b), (_b, _a)):
            for _tabu in (1, 2, 3):
                for _steps in (2, 4, 8, 16):
                    _GRID[len(_GRID)] = ([*_order, 0.0], _steps, _tabu)


@query(f"WITH {states_sql(N)}, {optima_sql(N, EDGES)}, {walk_sql(N, EDGES, _GRID)}, {stable_sql('w', 'SELECT x, branch AS b FROM br')}, i AS (SELECT q.m, q.b, min(c.b) AS t FROM q JOIN w USING (m, x) JOIN q c ON c.m = q.m AND c.x = w.t GROUP BY q.m, q.b) SELECT m, count(*) AS blocks, count(DISTINCT t) AS images, count(*) - count(DISTINCT t) AS surplus, count(*) = count(DISTINCT t) AS bijective FROM i GROUP BY m")
def loop_attack_grid(spark, sf_dir):
    """216 loops: is any induced map on a stable quotient injective?"""
    return dynamics.attack(spark, N, EDGES, dynamics.loop_grid(spark))


_LISTS = f"tb AS (SELECT []::INT[] AS l UNION ALL SELECT [a] FROM range({N}) r(a) UNION ALL SELECT [a, b] FROM range({N}) r(a), range({N}) q(b)), ix AS (SELECT l, row_number() OVER (ORDER BY len(l), l) - 1 AS i FROM tb)"


@query(
    f"WITH {states_sql(N)}, {_LISTS}, {walk_sql(N, EDGES, {0: (_LOOP[1:], 4, 2)}, f'SELECT 0, s.x * {1 + N + N * N} + ix.i, 0, s.x, ix.l FROM s, ix')} SELECT w.x, w.t * {1 + N + N * N} + ix.i AS t FROM w JOIN ix ON ix.l = w.tabu"
)
def augmented_map(spark, sf_dir):
    """The loop's map where the tabu list is part of the state."""
    return dynamics.augmented(spark, N, EDGES, _LOOP[1:], 4, 2)


_SIX = {name: (schedule[1:], 4, 2) for name, schedule in dynamics.LOOPS.items()}
_CORES = f"{states_sql(N)}, {walk_sql(N, EDGES, _SIX)}, it AS (WITH RECURSIVE p(m, x, k, y) AS (SELECT m, x, 0, x FROM w UNION ALL SELECT p.m, p.x, k + 1, w.t FROM p JOIN w ON w.m = p.m AND w.x = p.y WHERE k < {1 << N}) SELECT * FROM p), core AS (SELECT DISTINCT m, y AS x FROM it WHERE k = {1 << N})"


@query(f"WITH {_CORES} SELECT m, x FROM core")
def loop_cores(spark, sf_dir):
    return dynamics.monodromy(spark, N, EDGES, 2, 4)[1]


@query(
    f"""WITH {_CORES}, st AS (SELECT m, list(x ORDER BY x) AS s FROM core GROUP BY m), f AS (SELECT x, t FROM w WHERE m = 'g1'), b AS (SELECT x, t FROM w WHERE m = 'g1^-1'), ff AS (SELECT x, t FROM w WHERE m = 'g1.g1'), fb AS (SELECT x, t FROM w WHERE m = 'g1.g1^-1'), c AS (SELECT x FROM core WHERE m = 'g1')
SELECT (SELECT count(DISTINCT s) FROM st) AS distinct_cores, (SELECT count(*) FROM (SELECT x FROM core GROUP BY x HAVING count(*) = 6)) AS intersection,
 (SELECT bool_and(ff.t = g.t) FROM ff JOIN f USING (x) JOIN f g ON g.x = f.t) AND (SELECT bool_and(fb.t = b.t) FROM fb JOIN f USING (x) JOIN b ON b.x = f.t) AS composition_holds,
 (SELECT bool_or(b.t <> c.x) FROM c JOIN f USING (x) JOIN b ON b.x = f.t) AS inverse_fails, (SELECT bool_and(b.t IN (SELECT x FROM c)) FROM c JOIN b USING (x)) AS reverse_preserves_core"""
)
def loop_experiment(spark, sf_dir):
    return dynamics.monodromy_report(*dynamics.monodromy(spark, N, EDGES, 2, 4))


# ---------------------------------------------------------------- collisions
_ONE = f"{states_sql(N)}, {walk_sql(N, EDGES, {0: ([0.5], 1, 3)})}, v AS (SELECT x, t, CASE WHEN x <> t THEN log2(xor(x, t))::INT END AS v FROM w)"


@query(f"WITH {_ONE} SELECT a.x, b.x AS y, a.t AS image, a.v AS vx, b.v AS vy, coalesce(a.v <> b.v AND xor(a.x, b.x) = ((1::BIGINT << a.v) | (1::BIGINT << b.v)), false) AS exact FROM v a JOIN v b ON a.t = b.t AND a.x < b.x")
def collision_mechanism(spark, sf_dir):
    """Every colliding pair of one step, and whether it differs in just the two vertices that are flipped."""
    return dynamics.characterised(dynamics.search(dynamics.states(spark, N), N, EDGES, 0.5, 1, 3))


@query(f"WITH {_ONE}, {optima_sql(N, EDGES)}, h AS (SELECT o.o AS z, count(*) FILTER (v.t = o.o) AS preimages FROM o, range({N}) r(k), v WHERE v.x = xor(o.o, 1::BIGINT << k) GROUP BY o.o), d AS (SELECT a.o AS z, count(b.o) AS at_two FROM o a LEFT JOIN o b ON bit_count(xor(a.o, b.o)) = 2 GROUP BY a.o) SELECT z, preimages::BIGINT AS preimages, ({N} - 2 * at_two)::INT AS bound, at_two::INT AS at_two FROM h JOIN d USING (z)")
def preimages_of_optima(spark, sf_dir):
    return dynamics.preimages_of_optima(spark, N, EDGES, 0.5)


@query(f"WITH {_ONE} SELECT x, v FROM v")
def one_step_vertices(spark, sf_dir):
    return dynamics.one_step_vertex(dynamics.search(dynamics.states(spark, N), N, EDGES, 0.5, 1, 3))


@query(f"WITH {states_sql(10)} SELECT x, array_to_string([(x >> i) & 1 FOR i IN range(10)], '') AS bits, list_sum([((x >> i) & 1) << i FOR i IN range(10)])::BIGINT AS again FROM s")
def packed_bits(spark, sf_dir):
    s = dynamics.states(spark, 10).select("x", dynamics.unpacked(F.col("x"), 10).alias("bits"))
    return s.select("x", F.array_join("bits", "").alias("bits"), dynamics.packed(F.col("bits")).alias("again"))


# ---------------------------------------------------------------- maps, partitions
_MAP64 = "f AS (SELECT 0 AS m, range::BIGINT AS x, ((range * range + 3 * range + 7) % 64)::BIGINT AS t FROM range(64))"


def _map64(spark):
    return spark.range(64).select(F.col("id").alias("x"), ((F.col("id") * F.col("id") + 3 * F.col("id") + 7) % 64).alias("t"))


_START64 = "SELECT range::BIGINT AS x, (range >= 40)::BIGINT AS b FROM range(64)"


def _start64(spark):
    return spark.range(64).select(F.col("id").alias("x"), (F.col("id") >= 40).cast("int").alias("block"))


@query(f"WITH {_MAP64}, {stable_sql('f', _START64, 40)} SELECT x, (dense_rank() OVER (ORDER BY l) - 1)::INT AS block FROM (SELECT x, min(x) OVER (PARTITION BY b) AS l FROM q)")
def coarsest_stable(spark, sf_dir):
    """From a partition that is not stable."""
    return dynamics.coarsest_stable(_start64(spark), [_map64(spark)])[0]


@query(f"WITH {_MAP64}, {stable_sql('f', _START64, 40)}, n AS (SELECT x, (dense_rank() OVER (ORDER BY l) - 1)::INT AS b FROM (SELECT x, min(x) OVER (PARTITION BY b) AS l FROM q)) SELECT n.b AS x, min(c.b) AS t FROM n JOIN f USING (x) JOIN n c ON c.x = f.t GROUP BY n.b")
def block_map(spark, sf_dir):
    part, _ = dynamics.coarsest_stable(_start64(spark), [_map64(spark)])
    return dynamics.block_map(part, _map64(spark))


_BLOCKS = f"{_MAP64}, {stable_sql('f', _START64, 40)}, n AS (SELECT x, (dense_rank() OVER (ORDER BY l) - 1)::INT AS b FROM (SELECT x, min(x) OVER (PARTITION BY b) AS l FROM q))"


@query(f"WITH {_BLOCKS}, r AS (SELECT b, min(x) AS x FROM n GROUP BY b) SELECT r.b AS x, c.b AS t FROM r JOIN f USING (x) JOIN n c ON c.x = f.t")
def quotient_map(spark, sf_dir):
    part, _ = dynamics.coarsest_stable(_start64(spark), [_map64(spark)])
    return dynamics.quotient_map(part, _map64(spark))


@query(f"WITH {_BLOCKS}, p AS ({_START64}) SELECT DISTINCT n.b AS x, p.b::INT AS t FROM n JOIN p USING (x)")
def block_projection(spark, sf_dir):
    fine, _ = dynamics.coarsest_stable(_start64(spark), [_map64(spark)])
    return dynamics.projection(fine, _start64(spark))


@query("WITH RECURSIVE p(k, x, y) AS (SELECT 1, range::BIGINT, (range * 2 % 5)::BIGINT FROM range(5) UNION ALL SELECT k + 1, x, y * 2 % 5 FROM p WHERE k < 12), k AS (SELECT k FROM p GROUP BY k HAVING bool_and(x = y)) SELECT min(k)::BIGINT AS map_order FROM k")
def map_order(spark, sf_dir):
    f = spark.range(5).select(F.col("id").alias("x"), ((F.col("id") * 2) % 5).alias("t"))
    return spark.createDataFrame([(dynamics.order_of(f),)], "map_order long")


@query("SELECT (x * 27) % 64 AS x, x AS t FROM (SELECT range::BIGINT AS x FROM range(64))")
def map_inverse(spark, sf_dir):
    f = spark.range(64).select(F.col("id").alias("x"), ((F.col("id") * 27) % 64).alias("t"))
    return dynamics.inverse(f)


@query("WITH f AS (SELECT range::BIGINT AS x, ((range * range + 1) % 97)::BIGINT AS t FROM range(97)), p AS (WITH RECURSIVE p(x, k, y, inside) AS (SELECT x, 0, x, x % 2 = 0 OR x > 50 FROM f UNION ALL SELECT p.x, k + 1, f.t, inside AND (f.t % 2 = 0 OR f.t > 50) FROM p JOIN f ON f.x = p.y WHERE k < 97) SELECT * FROM p) SELECT DISTINCT x FROM p WHERE k > 0 AND x = y AND inside")
def core_within_subset(spark, sf_dir):
    f = views.square_map(spark, 97)
    return dynamics.core_within(f, f.filter("x % 2 = 0 OR x > 50").select("x"))


_WIT = """mp AS (SELECT m, x, (m // pow({n}, {n} - 1 - x)::BIGINT) % {n} AS t FROM range(({n} ** {n})::BIGINT) a(m), range({n}) b(x)), fs AS (SELECT f FROM range(1, (1 << {n}) - 1) r(f)),
it AS (WITH RECURSIVE p(m, x, k, y) AS (SELECT m, x, 0, x FROM mp UNION ALL SELECT p.m, p.x, k + 1, mp.t FROM p JOIN mp ON mp.m = p.m AND mp.x = p.y WHERE k < {n}) SELECT * FROM p),
pc AS (SELECT DISTINCT m, x FROM it WHERE k > 0 AND x = y),
b AS (SELECT pc.m, fs.f, pc.x, (SELECT bool_and((fs.f >> it.y::INT) & 1 = 1) FROM it WHERE it.m = pc.m AND it.x = pc.x) AS within, (fs.f >> pc.x::INT) & 1 = 1 AS after FROM pc, fs),
d AS (SELECT m, f FROM b WHERE within <> after ORDER BY m, f LIMIT 1)
SELECT {n} AS n, m::BIGINT AS place, f, x, within, after FROM b JOIN d USING (m, f) WHERE within OR after"""


@query("WITH " + _WIT.format(n=2))
def smallest_witness(spark, sf_dir):
    """The smallest map and subset where surviving within the subset is not surviving and being in it."""
    return dynamics.smallest_witness(spark)


@query("WITH f AS (SELECT range::BIGINT AS x, ((range * range + 1) % 97)::BIGINT AS t FROM range(97)) SELECT DISTINCT a.x, b.x AS y FROM f a JOIN f b ON a.t = b.t AND a.x < b.x")
def fibre_pairs(spark, sf_dir):
    return dynamics.collision_pairs(views.square_map(spark, 97)).select("x", "y")


# ---------------------------------------------------------------- fields, cycles, graphs
@query("SELECT 7 AS p, (SELECT bool_and(c = 6) FROM (SELECT a, count(DISTINCT a * x % 7) AS c FROM range(1, 7) r(a), range(1, 7) q(x) GROUP BY a)) AS bijective, (SELECT bool_and(a * b % 7 * x % 7 = a * (b * x % 7) % 7) FROM range(1, 7) r(a), range(1, 7) s(b), range(1, 7) q(x)) AS compose_ok")
def verify_field(spark, sf_dir):
    return dynamics.verify_field(spark, 7)


@query("WITH l(length) AS (VALUES (1), (2), (3), (5), (6), (11)), p AS (SELECT length, list_filter([3, 5, 7, 11, 13, 17, 19, 23], lambda p: p > length AND (p - 1) % length = 0)[1:3] AS primes FROM l) SELECT length, array_to_string(primes, ',') AS primes FROM p")
def cycle_bridge(spark, sf_dir):
    lengths = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 11)], "length int")
    return dynamics.bridge(spark, lengths).select("length", F.array_join("primes", ",").alias("primes"))


@query("WITH RECURSIVE p(k, v) AS (SELECT 0, 1 UNION ALL SELECT k + 1, v * 3 % 7 FROM p WHERE k < 5), h AS (SELECT v AS h, k FROM p) SELECT h, round(cos(2 * pi() * k / 6), 9) AS re, round(sin(2 * pi() * k / 6), 9) AS im FROM h")
def field_characters(spark, sf_dir):
    """Characters of the units mod 7, whose least generator is 3."""
    rows = [(h, *dynamics.character(spark, 7, h)) for h in range(1, 7)]
    return spark.createDataFrame(rows, "h int, re double, im double").select("h", F.round("re", 9).alias("re"), F.round("im", 9).alias("im"))


_ARCS = """arcs AS (SELECT DISTINCT a, b FROM (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e)),
walks AS (WITH RECURSIVE w(n, p) AS (SELECT 1, [a, b] FROM arcs UNION ALL SELECT n + 1, list_append(p, b) FROM w JOIN arcs ON a = p[-1] AND b <> p[-2] WHERE n < 5) SELECT * FROM w),
cl AS (SELECT n, p[1:n] AS c FROM walks WHERE p[1] = p[-1] AND p[2] <> p[-2]), ro AS (SELECT n, c, [c[k + 1:n] || c[1:k] FOR k IN range(n)] AS r FROM cl)
SELECT n::INT AS length, count(*) AS cycles FROM ro WHERE c = list_sort(r)[1] AND len(list_distinct(r)) = n GROUP BY n"""


@query(f"WITH e AS (SELECT a AS u, b AS v FROM range(4) r(a), range(4) q(b) WHERE a < b), {_ARCS}")
def prime_cycles_k4(spark, sf_dir):
    return graphs.prime_cycles(spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "u long, v long"), 5)


def _family(spark):
    rows = [("C3", 0, 1), ("C3", 1, 2), ("C3", 0, 2), *(("C6", i, (i + 1) % 6) for i in range(6)), *(("K4", a, b) for a in range(4) for b in range(a + 1, 4))]
    return spark.createDataFrame(rows, "graph string, u long, v long")


def _determinants_sql(entry: str) -> str:
    """c: the values at 0, 1, 2, .. of a determinant of each graph, by fraction-free elimination (divisions are exact)."""
    return f"""e(graph, u, v) AS (VALUES ('C3', 0, 1), ('C3', 1, 2), ('C3', 0, 2), ('C6', 0, 1), ('C6', 1, 2), ('C6', 2, 3), ('C6', 3, 4), ('C6', 4, 5), ('C6', 5, 0), ('K4', 0, 1), ('K4', 0, 2), ('K4', 0, 3), ('K4', 1, 2), ('K4', 1, 3), ('K4', 2, 3)),
arcs AS (SELECT graph, u AS a, v AS b FROM e UNION ALL SELECT graph, v, u FROM e), dg AS (SELECT graph, a, count(*) AS d FROM arcs GROUP BY ALL), sz AS (SELECT graph, count(*) AS n FROM dg GROUP BY graph),
cell AS (SELECT dg.graph, z.z, dg.a AS i, o.a AS j, ({entry})::HUGEINT AS v FROM dg JOIN dg o USING (graph) JOIN sz USING (graph) CROSS JOIN range(-7, 8) z(z) LEFT JOIN arcs x ON x.graph = dg.graph AND x.a = dg.a AND x.b = o.a)"""


@query(
    f"""WITH {_determinants_sql("CASE WHEN dg.a = o.a THEN 1 + z.z * z.z * (dg.d - 1) ELSE 0 END - z.z * (x.a IS NOT NULL)::INT")},
pm AS (WITH RECURSIVE p(graph, k, used, sign, v, z) AS (SELECT graph, 0, []::BIGINT[], 1, 1::HUGEINT, z.z FROM sz, range(1, 4) z(z) UNION ALL SELECT p.graph, k + 1, list_append(used, j), sign * CASE WHEN len(list_filter(used, lambda q: q > j)) % 2 = 1 THEN -1 ELSE 1 END, p.v * cell.v, p.z FROM p JOIN cell ON cell.graph = p.graph AND cell.z = p.z AND cell.i = k AND NOT list_contains(used, j) AND cell.v <> 0) SELECT * FROM p)
SELECT pm.graph, z AS u, sum(sign * v)::BIGINT AS value FROM pm JOIN sz ON sz.graph = pm.graph AND k = n GROUP BY ALL"""
)
def bass_determinant(spark, sf_dir):
    """The exact polynomial of every graph of the family, at 1, 2 and 3."""
    return _evaluated(graphs.bass_determinants(_family(spark)))


@query(
    f"""WITH {_determinants_sql("CASE WHEN dg.a = o.a THEN z.z ELSE 0 END - (x.a IS NOT NULL)::INT")},
pm AS (WITH RECURSIVE p(graph, k, used, sign, v, z) AS (SELECT graph, 0, []::BIGINT[], 1, 1::HUGEINT, z.z FROM sz, range(1, 4) z(z) UNION ALL SELECT p.graph, k + 1, list_append(used, j), sign * CASE WHEN len(list_filter(used, lambda q: q > j)) % 2 = 1 THEN -1 ELSE 1 END, p.v * cell.v, p.z FROM p JOIN cell ON cell.graph = p.graph AND cell.z = p.z AND cell.i = k AND NOT list_contains(used, j) AND cell.v <> 0) SELECT * FROM p)
SELECT pm.graph, z AS u, sum(sign * v)::BIGINT AS value FROM pm JOIN sz ON sz.graph = pm.graph AND k = n GROUP BY ALL"""
)
def charpoly(spark, sf_dir):
    return _evaluated(graphs.characteristic_polynomials(_family(spark)))


def _evaluated(found):
    value = F.aggregate(F.reverse("coefficients"), F.lit(0).cast("long"), lambda t, c: t * F.col("u") + c.cast("long"))
    return found.select("graph", "coefficients", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("u")).select("graph", F.col("u").cast("long").alias("u"), value.alias("value"))


@query("WITH RECURSIVE k(length, cycles) AS (VALUES (3, 8), (4, 6)), f AS (SELECT row_number() OVER () AS i, length FROM k, range(cycles)), m(i, c) AS (SELECT 0, [CASE WHEN j = 0 THEN 1 ELSE 0 END FOR j IN range(5)] UNION ALL SELECT m.i + 1, [c[j + 1] - CASE WHEN j >= length THEN c[j - length + 1] ELSE 0 END FOR j IN range(5)] FROM m JOIN f ON f.i = m.i + 1) SELECT array_to_string(arg_max(c, i), ',') AS coefficients FROM m")
def ihara_from_cycles(spark, sf_dir):
    counts = graphs.prime_cycles(spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "u long, v long"), 4)
    return graphs.ihara_from_cycles(counts, 4).select(F.array_join("coefficients", ",").alias("coefficients"))


@query("SELECT n_regionkey AS cycle, round(product(1.0 + n_nationkey % 3), 6) AS gain, sum(n_nationkey)::BIGINT AS length FROM nation GROUP BY 1")
def gain_and_length_twists(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    cycles = n.select(F.col("n_regionkey").alias("cycle"), F.col("n_nationkey").alias("u"), (F.col("n_nationkey") + 1).alias("v"))
    gains = n.select(F.col("n_nationkey").alias("u"), (F.col("n_nationkey") + 1).alias("v"), (1.0 + F.col("n_nationkey") % 3).alias("gain"), F.col("n_nationkey").cast("long").alias("length"))
    return graphs.weighted_cycles(cycles, gains).withColumn("gain", F.round("gain", 6))


@query("WITH c AS (SELECT n_regionkey AS tree, n_nationkey, count(s_suppkey) AS kids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL), s AS (SELECT tree, '(' || repeat('()', kids::BIGINT) || ')' AS shape FROM c) SELECT tree, '(' || string_agg(shape, '' ORDER BY shape) || ')' AS shape FROM s GROUP BY tree")
def forest_shapes(spark, sf_dir):
    n, s = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "supplier")
    root = n.select(F.col("n_regionkey").alias("tree"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("x")).distinct().select("tree", "x", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"))
    mid = n.select(F.col("n_regionkey").alias("tree"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("x"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit(1).alias("level"))
    leaf = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("tree"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("x"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent"), F.lit(2).alias("level"))
    return graphs.canonical_forests(root.unionByName(mid).unionByName(leaf), 2)
