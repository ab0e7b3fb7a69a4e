"""The registered queries over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import steps as S
from ..operators import analytics, costvar, dynamics, graphs, ledger, multires, protocol, tower, warrants
from . import views
from .registry import query

def plain_tower() -> tower.Tower:
    """The tool tower with arguments as given (the driver tables' arguments are already flat text)."""
    return tower.tool_tower(lambda tool, args: F.coalesce(args, F.lit("")))


def ok():
    return S.succeeded(F.col("outcome"))


# ---------------------------------------------------------------- SQL that several queries share
EV = """ev_steps AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type AS tool, event_type = 'error' AS err, props AS args, value FROM events),
ev AS (SELECT user_id, day, 'agent-' || (user_id % 5) AS agent, dayofmonth(day)::VARCHAR AS task, min(event_id) AS ordinal, list(tool ORDER BY ts, event_id) AS tools, list(err ORDER BY ts, event_id) AS errs, list(args ORDER BY ts, event_id) AS args,
  CASE arg_max(tool, (ts, event_id)) WHEN 'purchase' THEN 'stop' WHEN 'error' THEN 'error' ELSE 'toolUse' END AS outcome, sum(value) AS cost FROM ev_steps GROUP BY user_id, day)"""
ORD = """ol AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS tools, list(l_linestatus = 'O' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS errs,
  list(concat_ws('|', l_partkey, l_suppkey, l_quantity::BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS args FROM lineitem GROUP BY l_orderkey),
ord AS (SELECT o_orderkey AS ordinal, r_name AS agent, o_orderpriority AS task, CASE o_orderstatus WHEN 'F' THEN 'stop' WHEN 'O' THEN 'toolUse' ELSE 'length' END AS outcome, round(o_totalprice * 100)::BIGINT AS cents, tools, errs, args
  FROM orders JOIN ol ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _six(source: str) -> str:
    return f"""keyed AS (SELECT agent, ordinal, outcome = 'stop' AS ok, tools, [outcome, list_sort(tools)::VARCHAR, tools::VARCHAR, errs::VARCHAR, tools::VARCHAR, args::VARCHAR] AS parts FROM {source}),
cls AS (SELECT agent, level::INT AS level, array_to_string(parts[1:level], '#') AS k, count(*) AS seen, bool_or(ok) AS live FROM keyed, range(1, 7) r(level) GROUP BY ALL),
book AS (SELECT agent, level, count(*) AS n, count(*) FILTER (live) AS l FROM cls GROUP BY ALL)"""


def _book_sql(source: str, views_sql: str, rest: str) -> str:
    return f"WITH {views_sql}, {_six(source)} {rest}"


_YIELD = "SELECT agent, level, n, l, n - l AS transient, round(l / n, 6) AS yield FROM book"


def _events_book(spark, sf_dir):
    return ledger.ledger(views.event_runs(spark, sf_dir), plain_tower(), ok())


def _orders_book(spark, sf_dir):
    return ledger.ledger(views.order_runs(spark, sf_dir), plain_tower(), ok())


def _shown(book: DataFrame) -> DataFrame:
    return ledger.with_yield(book).select("agent", "level", "n", "l", "transient", F.round("yield", 6).alias("yield"))


@query(_book_sql("ev", EV, _YIELD))
def ledger_events_tool_tower(spark, sf_dir):
    return _shown(_events_book(spark, sf_dir))


@query(_book_sql("ord", ORD, _YIELD))
def ledger_orders_tool_tower(spark, sf_dir):
    return _shown(_orders_book(spark, sf_dir))


_PREFIX = """pre AS (SELECT agent, level::INT AS level, tools[1:level] AS p, bool_or(ok) AS live, max(len(tools)) AS longest FROM (SELECT agent, tools, outcome = 'stop' AS ok FROM {0}) t, range(1, 200) r(level) WHERE level <= len(tools) GROUP BY ALL)"""


@query(f"WITH {EV}, {_PREFIX.format('ev')} SELECT agent, level, count(*) AS n, count(*) FILTER (live) AS l FROM pre GROUP BY ALL")
def ledger_events_prefix(spark, sf_dir):
    return ledger.prefix_ledger(views.event_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok())


_CONV = "conv AS (SELECT 'agent-' || (conv_id % 3) AS agent, list(role ORDER BY turn, text) AS tools, CASE arg_max(role, (turn, text)) WHEN 'assistant' THEN 'stop' ELSE 'open' END AS outcome FROM conversations GROUP BY conv_id)"


@query(f"WITH {_CONV}, {_PREFIX.format('conv')} SELECT agent, level, count(*) AS n, count(*) FILTER (live) AS l FROM pre GROUP BY ALL")
def ledger_conv_prefix(spark, sf_dir):
    return ledger.prefix_ledger(views.conversation_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok())


@query(f"WITH {ORD}, {_PREFIX.format('ord')}, h AS (SELECT agent, max(level) AS h FROM pre GROUP BY agent) SELECT agent, level, count(*) AS n, count(*) FILTER (longest >= h) AS l FROM pre JOIN h USING (agent) GROUP BY ALL")
def ledger_orders_horizon(spark, sf_dir):
    return ledger.prefix_ledger(views.order_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok(), rule="horizon")


def _crossed() -> tower.Tower:
    """A tower that does not nest: the task is no function of the length."""
    return tower.Tower(("task", "calls"), [F.col("task"), F.size("steps")], nested=False)


@query(f"WITH {ORD} SELECT 2 AS level, n_prefixes, count(*) AS n_classes FROM (SELECT len(tools), count(DISTINCT task) AS n_prefixes FROM ord GROUP BY 1) WHERE n_prefixes > 1 GROUP BY n_prefixes")
def tower_violation_rows(spark, sf_dir):
    t = _crossed()
    return tower.violations(t.signature(views.order_runs(spark, sf_dir)), t)


@query(f"WITH {ORD} SELECT count(*) AS runs FROM ord")
def tower_validate_ok(spark, sf_dir):
    runs = views.order_runs(spark, sf_dir)
    return spark.createDataFrame([(tower.validate(runs, plain_tower()),)], "runs long")


@query(_book_sql("ev", EV, "SELECT agent, level, seen, count(*) AS classes FROM cls GROUP BY ALL"))
def class_seen_counts(spark, sf_dir):
    found = ledger.class_ids(views.event_runs(spark, sf_dir), plain_tower(), ok())
    return found.groupBy("agent", "level", "seen").agg(F.count("*").alias("classes"))


@query(_book_sql("ev", EV, "SELECT level, CASE WHEN live THEN 'LIVE' WHEN level < 6 THEN 'TRANSIENT' ELSE 'UNKNOWN' END AS status, count(*) AS classes FROM cls GROUP BY ALL"))
def class_status(spark, sf_dir):
    found = ledger.class_ids(views.event_runs(spark, sf_dir), plain_tower(), ok())
    return ledger.statuses(found, F.col("level") < 6).groupBy("level", "status").agg(F.count("*").alias("classes"))


@query(f"WITH {EV} SELECT DISTINCT agent, array_to_string(tools, '>') AS path FROM (SELECT agent, tools[1:3] AS tools FROM ev WHERE outcome = 'stop' AND len(tools) >= 3)")
def live_profiles_level3(spark, sf_dir):
    found = ledger.prefixes(views.event_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok())
    return ledger.paths(found, 3).filter("live").select("agent", F.array_join("prefix", ">").alias("path"))


@query(f"WITH {EV}, {_PREFIX.format('ev')}, d AS (SELECT agent, level - 1 AS level, p[1:level - 1] AS parent, count(*) AS degree FROM pre GROUP BY ALL) SELECT agent, level, degree, count(*) AS nodes FROM d GROUP BY ALL")
def degrees_by_level(spark, sf_dir):
    return ledger.degrees(ledger.prefixes(views.event_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok()))


@query(f"WITH {EV}, {_PREFIX.format('ev')} SELECT agent, level, count(*) AS leaves FROM pre a WHERE NOT EXISTS (SELECT 1 FROM pre b WHERE b.agent = a.agent AND b.level = a.level + 1 AND b.p[1:a.level] = a.p) GROUP BY ALL")
def leaf_counts(spark, sf_dir):
    found = ledger.prefixes(views.event_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok())
    return ledger.leaves(found).groupBy("agent", "level").agg(F.count("*").alias("leaves"))


def _region_tree(spark, sf_dir, customers: DataFrame) -> DataFrame:
    nation = views.table(spark, sf_dir, "nation").join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kids = customers.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").cast("string").alias("leaf"))
    paths = nation.join(kids, "n_nationkey", "left").select(F.col("r_name").alias("agent"), F.when(F.col("leaf").isNull(), F.array(F.col("n_name"))).otherwise(F.array("n_name", "leaf")).alias("labels"))
    found = ledger.prefixes(paths, F.col("labels"), F.lit(True))
    return ledger.canonical_trees(found, 2)


_TREES = """WITH c AS (SELECT r_name AS agent, n_nationkey, count(c_custkey) AS kids FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT agent, '(' || repeat('()', kids::BIGINT) || ')' AS shape FROM c), t AS (SELECT agent, '(' || string_agg(shape, '' ORDER BY shape) || ')' AS shape FROM s GROUP BY agent)"""


@query(f"{_TREES} SELECT agent, len(shape) // 2 AS nodes, sha256(shape) AS digest FROM t")
def ahu_region_tree(spark, sf_dir):
    """Size and digest of the canonical form of each region's tree of nations and all customers."""
    trees = _region_tree(spark, sf_dir, views.table(spark, sf_dir, "customer"))
    return trees.select("agent", F.expr("length(shape) div 2").alias("nodes"), F.sha2("shape", 256).alias("digest"))


@query(f"{_TREES} SELECT agent, shape FROM t")
def ahu_tree_all_customers(spark, sf_dir):
    """The canonical forms themselves."""
    return _region_tree(spark, sf_dir, views.table(spark, sf_dir, "customer"))


_KINDS = """WITH c AS (SELECT r_name AS agent, n_nationkey, count(c_custkey) AS kids FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
n AS (SELECT agent, kids, CASE WHEN kids = 0 THEN upper(md5('')) ELSE upper(md5(upper(md5(upper(md5('')) || 'x' || kids)))) END AS digest FROM c), k AS (SELECT agent, upper(md5(digest || 'x' || count(*))) AS kind, count(*) + sum(kids) AS nodes FROM n GROUP BY agent, digest)"""


@query(f"{_KINDS} SELECT agent, (1 + sum(nodes))::BIGINT AS nodes, upper(md5(string_agg(kind, '' ORDER BY kind))) AS digest FROM k GROUP BY agent")
def tree_digests(spark, sf_dir):
    """Size and digest of each region's tree of nations and customers; no tree is written out."""
    labels = F.when(F.col("leaf").isNull(), F.array(F.col("n_name"))).otherwise(F.array("n_name", "leaf"))
    nation = views.table(spark, sf_dir, "nation").join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kids = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").cast("string").alias("leaf"))
    found = ledger.prefixes(nation.join(kids, "n_nationkey", "left").select(F.col("r_name").alias("agent"), labels.alias("labels")), F.col("labels"), F.lit(True))
    return ledger.ranked_trees(found, 2).select("agent", "nodes", F.hex("digest").alias("digest"))


_R = "r AS (SELECT agent, level, ln(n) / (level * 0.6931471805599453) AS s, CASE WHEN l > 0 THEN ln(l) / (level * 0.6931471805599453) END AS d FROM book)"
_E = """e AS (SELECT agent, coalesce(max(s) FILTER (s > 0), 0) AS s, coalesce(max(d) FILTER (d > 0), 0) AS d, max(level) AS horizon FROM r GROUP BY agent),
x AS (SELECT e.agent, e.s, coalesce(min(r.level) FILTER (r.s = e.s AND e.s > 0), 0)::INT AS s_at, e.d, coalesce(min(r.level) FILTER (r.d = e.d AND e.d > 0), 0)::INT AS d_at, e.s - e.d AS delta, e.horizon FROM e JOIN r USING (agent) GROUP BY e.agent, e.s, e.d, e.horizon)"""


_BOOK_FROM = f"{_R}, {_E}"


@query(_book_sql("ev", EV, f", {_R}, {_E} SELECT agent, round(s, 6) AS s, s_at, round(d, 6) AS d, d_at, round(delta, 6) AS delta, horizon, s_at > 0 AND s_at < horizon AS s_shallow, d_at > 0 AND d_at < horizon AS d_shallow FROM x"))
def exponents_by_agent(spark, sf_dir):
    e = analytics.exponents(_events_book(spark, sf_dir))
    return e.withColumns({c: F.round(c, 6) for c in ("s", "d", "delta")})


@query(_book_sql("ev", EV, f", {_R} SELECT agent, level, round(s, 6) AS s, round(d, 6) AS d FROM r"))
def level_exponent_sequences(spark, sf_dir):
    return analytics.ratios(_events_book(spark, sf_dir)).select("agent", "level", F.round("s", 6).alias("s"), F.round("d", 6).alias("d"))


@query(_book_sql("ev", EV, f", {_R}, y AS (SELECT * FROM r WHERE level IN (2, 4, 6)) SELECT agent, round(coalesce(max(s) FILTER (s > 0), 0), 6) AS s, round(coalesce(max(d) FILTER (d > 0), 0), 6) AS d FROM y GROUP BY agent"))
def reindexed_exponents(spark, sf_dir):
    return analytics.on_levels(_events_book(spark, sf_dir), [2, 4, 6]).select("agent", F.round("s", 6).alias("s"), F.round("d", 6).alias("d"))


@query(_book_sql("ev", EV, "SELECT agent, min(level) FILTER (10 * l < 2 * n) AS stop_level FROM book GROUP BY agent"))
def stop_level(spark, sf_dir):
    return analytics.stop_levels(_events_book(spark, sf_dir), tenths=2)


_TAIL = """, r2 AS (SELECT agent, level, 's' AS kind, s AS v FROM r UNION ALL SELECT agent, level, 'd', d FROM r), q AS (SELECT agent, kind, level, v, row_number() OVER (PARTITION BY agent, kind ORDER BY level DESC) AS back FROM r2 WHERE v IS NOT NULL),
t AS (SELECT agent, kind, list(v ORDER BY level) AS tail, min(level) AS tail_from FROM q WHERE back <= 4 GROUP BY ALL), w AS (SELECT agent, kind, max(v) AS window_sup FROM q GROUP BY ALL),
z AS (SELECT agent, kind, list_max(tail) AS value, window_sup, tail_from, [tail[i + 1] - tail[i] FOR i IN range(1, len(tail))] AS steps, 1e-9 * greatest(1, list_max([abs(u) FOR u IN tail])) AS tol, len(tail) AS k FROM t JOIN w USING (agent, kind))
SELECT agent, kind, round(value, 6) AS value, round(window_sup, 6) AS window_sup, tail_from::INT AS tail_from, CASE WHEN k = 1 THEN 'UNRESOLVED' WHEN len([u FOR u IN steps IF abs(u) > tol]) = 0 THEN 'STABLE' WHEN len([u FOR u IN steps IF u < -tol]) = 0 THEN 'TRENDING_UP' WHEN len([u FOR u IN steps IF u > tol]) = 0 THEN 'TRENDING_DOWN' ELSE 'UNRESOLVED' END AS status FROM z"""


@query(_book_sql("ev", EV, f", {_R}{_TAIL}"))
def tail_trend(spark, sf_dir):
    return analytics.tails(_events_book(spark, sf_dir)).select("agent", "kind", F.round("value", 6).alias("value"), F.round("window_sup", 6).alias("window_sup"), "tail_from", "status")


@query(_book_sql("ev", EV, f", {_R} SELECT agent, level, round(max(s) OVER w, 6) AS s_envelope, round(max(d) OVER w, 6) AS d_envelope FROM r WINDOW w AS (PARTITION BY agent ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
def tail_envelope(spark, sf_dir):
    return analytics.envelopes(_events_book(spark, sf_dir)).select("agent", "level", F.round("s_envelope", 6).alias("s_envelope"), F.round("d_envelope", 6).alias("d_envelope"))


@query(_book_sql("ev", EV, "SELECT a.agent, a.level, a.n, b.n AS base, round(a.n / b.n, 6) AS inflation FROM book a LEFT JOIN (SELECT * FROM book WHERE agent = 'agent-0') b USING (level)"))
def inflation_vs_reference(spark, sf_dir):
    return analytics.inflation(_events_book(spark, sf_dir), "agent-0").withColumn("inflation", F.round("inflation", 6))


@query(f"WITH {ORD}, {_PREFIX.format('ord')}, book AS (SELECT agent, level, count(*) AS n FROM pre GROUP BY ALL), hit AS (SELECT a.agent, a.level FROM book a JOIN book b ON b.level = a.level AND b.agent = 'ASIA' WHERE a.agent <> 'ASIA' AND 100 * a.n >= 101 * b.n) SELECT min(level)::INT AS onset_level, arg_min(agent, (level, agent)) AS onset_agent FROM hit")
def onset(spark, sf_dir):
    book = ledger.prefix_ledger(views.order_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok())
    order = book.select("agent").distinct().withColumn("ordinal", F.col("agent"))
    return analytics.onset(book, "ASIA", order, factor=1.01).select("onset_level", "onset_agent")


@query(_book_sql("ev", EV, f", {_R}, {_E}, st AS (SELECT agent, min(level) FILTER (10 * l < n) AS stop_level FROM book GROUP BY agent) SELECT agent, round(s, 6) AS s, round(d, 6) AS d, round(delta, 6) AS delta, round(CASE WHEN s > 0 THEN delta / s ELSE 0 END, 6) AS waste, stop_level, (SELECT max(d) - min(d) FROM x) <= 1e-9 AS same_d FROM x JOIN st USING (agent)"))
def compare_agents(spark, sf_dir):
    c = analytics.compare(_events_book(spark, sf_dir))
    return c.withColumns({k: F.round(k, 6) for k in ("s", "d", "delta", "waste")})


@query(f"WITH {ORD}, {_PREFIX.format('ord')}, v AS (SELECT agent, level, count(*) AS n FROM pre GROUP BY ALL), b AS (SELECT agent, CASE WHEN level <= 3 THEN '1-3' WHEN level <= 6 THEN '4-6' ELSE 'other' END AS band, sum(n) AS n FROM v GROUP BY ALL) SELECT agent, band, round(n / sum(n) OVER (PARTITION BY agent), 6) AS share FROM b")
def depth_band_share(spark, sf_dir):
    book = ledger.prefix_ledger(views.order_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok())
    return analytics.band_shares(book, ((1, 3), (4, 6))).withColumn("share", F.round("share", 6))


@query(f"WITH {EV}, {_PREFIX.format('ev')}, b AS (SELECT agent, level, count(*) AS n FROM pre GROUP BY ALL), p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY agent ORDER BY level), 0) AS before FROM b) SELECT agent, min(level) FILTER (n > 4 * greatest(1, before) AND n > 50) AS blowup_level, arg_max(level, (n, -level)) AS peak_level FROM p GROUP BY agent")
def first_blowup(spark, sf_dir):
    return analytics.first_blowup(ledger.prefix_ledger(views.event_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok()))


@query(_book_sql("ev", EV, f", {_R}, m AS (SELECT agent, max(s) OVER (PARTITION BY agent ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM r) SELECT agent, round(min(m), 6) AS limsup FROM m GROUP BY agent"))
def limsup_of_ratios(spark, sf_dir):
    return analytics.limsup(analytics.ratios(_events_book(spark, sf_dir)), "agent", "level", "s").select("agent", F.round("limsup", 6).alias("limsup"))


@query(f"WITH {EV}, sh AS (SELECT agent, outcome, list_prepend('p', tools) AS tools FROM ev), {_PREFIX.format('sh')} SELECT agent, level, count(*) AS n, count(*) FILTER (live) AS l FROM pre GROUP BY ALL")
def shifted_prefix_ledger(spark, sf_dir):
    return ledger.prefix_ledger(views.event_runs(spark, sf_dir), analytics.shifted(S.tool_sequence(F.col("steps"))), ok())


@query(f"WITH {EV}, {_PREFIX.format('ev')}, b AS (SELECT agent, level, count(*) FILTER (live) AS l FROM pre GROUP BY ALL), n AS (SELECT *, lead(l) OVER (PARTITION BY agent ORDER BY level) AS nx FROM b) SELECT agent, bool_and(coalesce(nx >= l, true)) AS holds FROM n GROUP BY agent")
def live_non_decreasing(spark, sf_dir):
    return ledger.live_never_falls(ledger.prefix_ledger(views.event_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), ok()))


@query(f"WITH {EV} SELECT agent, count(*) AS runs, sum(len(tools))::BIGINT AS calls, sum(len([e FOR e IN errs IF e]))::BIGINT AS errors, count(*) FILTER (outcome = 'stop') AS successes, round(avg(len(tools)), 6) AS mean_steps FROM ev GROUP BY GROUPING SETS ((agent), ())")
def corpus_summary(spark, sf_dir):
    return ledger.summary(views.event_runs(spark, sf_dir), "agent").withColumn("mean_steps", F.round("mean_steps", 6))


@query("SELECT event_type AS tool, count(*) AS uses FROM events GROUP BY 1 ORDER BY uses DESC, tool LIMIT 6")
def top_tools(spark, sf_dir):
    return ledger.top_tools(views.event_runs(spark, sf_dir), 6)


@query(f"WITH {EV} SELECT task, count(DISTINCT agent) AS agents FROM ev GROUP BY task HAVING count(DISTINCT agent) >= 2")
def matched_tasks(spark, sf_dir):
    return protocol.matched_tasks(views.event_runs(spark, sf_dir), 2)


@query(f"WITH {EV} SELECT user_id::VARCHAR AS grp, count(*) AS runs FROM ev GROUP BY 1 HAVING count(*) >= 20")
def min_group_filter(spark, sf_dir):
    runs = views.event_runs(spark, sf_dir).withColumn("grp", F.col("user_id").cast("string"))
    return ledger.large_groups(runs, 20, "grp").groupBy("grp").agg(F.count("*").alias("runs"))


@query(f"WITH {ORD} SELECT task, count(*) AS runs FROM ord GROUP BY task ORDER BY runs DESC, min(ordinal) LIMIT 1")
def largest_group(spark, sf_dir):
    return ledger.largest_group(views.order_runs(spark, sf_dir), "task").groupBy("task").agg(F.count("*").alias("runs"))


@query(f"WITH {EV} SELECT list_sort(tools)::VARCHAR IS NOT NULL AS has, array_to_string([f || '=' || len([x FOR x IN tools IF x = f]) FOR f IN list_sort(list_distinct(tools))], ',') AS families, count(*) AS runs FROM ev GROUP BY ALL")
def family_multiset(spark, sf_dir):
    pairs = S.family_multiset(F.col("steps"))
    return views.event_runs(spark, sf_dir).groupBy(F.lit(True).alias("has"), F.array_join(F.transform(pairs, lambda p: F.concat(p["family"], F.lit("="), p["count"].cast("string"))), ",").alias("families")).agg(F.count("*").alias("runs"))


@query(f"WITH {EV} SELECT array_to_string([CASE WHEN e THEN '1' ELSE '0' END FOR e IN errs], '') AS flags, count(*) AS runs FROM ev GROUP BY ALL")
def error_flags(spark, sf_dir):
    flags = F.transform(S.error_flags(F.col("steps")), lambda e: F.when(e, "1").otherwise("0"))
    return views.event_runs(spark, sf_dir).groupBy(F.array_join(flags, "").alias("flags")).agg(F.count("*").alias("runs"))


@query(r"""WITH p AS (SELECT 'https://x/' || p_name || '.' || split_part(p_type, ' ', 1) AS path FROM part), e AS (SELECT regexp_extract(regexp_replace(regexp_replace(path, '^.*/', ''), '^\.+', ''), '(\.[^.]*)$', 1) AS ext FROM p) SELECT 'read|' || ext AS class, count(*) AS n FROM e GROUP BY ALL""")
def arg_class(spark, sf_dir):
    path = F.concat(F.lit("https://x/"), "p_name", F.lit("."), F.split("p_type", " ")[0])
    args = F.to_json(F.struct(path.alias("path")))
    return views.table(spark, sf_dir, "part").groupBy(S.arg_class(F.lit("read"), args).alias("class")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, left(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 500) AS prompt FROM documents")
def normalize_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", S.collapsed(F.col("text"), 500).alias("prompt"))


_CALLS = "c AS (SELECT user_id, event_id, ts, props FROM events WHERE event_type = 'click'), r AS (SELECT user_id, event_id, ts, props, event_type FROM events WHERE event_type IN ('error', 'purchase'))"


@query(f"WITH {_CALLS}, f AS (SELECT user_id, props, arg_min(event_type, event_id) AS first FROM r GROUP BY ALL) SELECT coalesce(f.first, 'none') AS result, count(*) AS calls FROM c LEFT JOIN f USING (user_id, props) GROUP BY ALL")
def step_result_join_first(spark, sf_dir):
    from ..operators.pairing import first_result

    e = views.table(spark, sf_dir, "events")
    calls, results = e.filter("event_type = 'click'"), e.filter("event_type IN ('error', 'purchase')")
    met = first_result(calls, results, ["user_id", "props"], "event_id", "event_type")
    return met.groupBy(F.coalesce("event_type_first", F.lit("none")).alias("result")).agg(F.count("*").alias("calls"))


@query(f"WITH {_CALLS}, f AS (SELECT user_id, props, max(event_id) AS last FROM r WHERE event_type = 'error' GROUP BY ALL) SELECT f.last IS NOT NULL AS failed, count(*) AS calls, sum(coalesce(f.last, 0) % 97)::BIGINT AS digest FROM c LEFT JOIN f USING (user_id, props) GROUP BY ALL")
def step_result_join_last(spark, sf_dir):
    from ..operators.pairing import last_error

    e = views.table(spark, sf_dir, "events")
    calls, errors = e.filter("event_type = 'click'"), e.filter("event_type = 'error'")
    met = last_error(calls, errors, ["user_id", "props"], "event_id", "event_id")
    return met.groupBy(F.col("event_id_last").isNotNull().alias("failed")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("event_id_last", F.lit(0)) % 97).alias("digest"))


@query("WITH b AS (SELECT user_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT user_id, run::BIGINT AS run, count(*) AS steps FROM b GROUP BY ALL")
def run_boundaries(spark, sf_dir):
    from ..operators.pairing import run_numbers

    e = views.table(spark, sf_dir, "events")
    return run_numbers(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").groupBy("user_id", "run").agg(F.count("*").alias("steps"))


@query("WITH c AS (SELECT conv_id, turn, text, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS nxt FROM conversations) SELECT role, nxt, count(*) AS n FROM c WHERE nxt IS NOT NULL GROUP BY ALL")
def consecutive_moves(spark, sf_dir):
    roles = S.tool_sequence(F.col("steps"))
    moves = F.arrays_zip(F.slice(roles, F.lit(1), F.size(roles) - 1).alias("role"), F.slice(roles, F.lit(2), F.size(roles)).alias("nxt"))
    return views.conversation_runs(spark, sf_dir).select(F.explode(moves).alias("m")).filter("m.nxt IS NOT NULL").groupBy(F.col("m.role").alias("role"), F.col("m.nxt").alias("nxt")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- warrants
def _capability_values() -> str:
    return ", ".join(f"('{f}', '{s}', {warrants.STATES[state]})" for f, row in warrants.CAPABILITIES.items() for s, state in zip(warrants.SEMANTICS, row, strict=True))


_STATES = "CASE min(rank) WHEN 3 THEN 'supported' WHEN 2 THEN 'inferred' WHEN 1 THEN 'unknown' ELSE 'unavailable' END"


@query(f"SELECT semantic, {_STATES} AS state FROM (VALUES {_capability_values()}) t(format, semantic, rank) WHERE format IN ('pi', 'claude', 'codex') GROUP BY semantic")
def capability_meet(spark, sf_dir):
    return warrants.reconciled(spark.createDataFrame([("pi",), ("claude",), ("codex",)], "format string"))


def _requirement_values() -> str:
    return ", ".join(f"('{a}', '{s}', {warrants.STATES[need]})" for a, r in warrants.REQUIREMENTS.items() for s, need in r.items())


@query(f"SELECT c.format, r.analysis, bool_and(c.rank >= r.need) AS warranted FROM (VALUES {_capability_values()}) c(format, semantic, rank) JOIN (VALUES {_requirement_values()}) r(analysis, semantic, need) USING (semantic) GROUP BY ALL")
def capability_gate(spark, sf_dir):
    needs = spark.createDataFrame([(a, s, warrants.STATES[n]) for a, r in warrants.REQUIREMENTS.items() for s, n in r.items()], "analysis string, semantic string, need int")
    return warrants.capability_table(spark).join(needs, "semantic").groupBy("format", "analysis").agg(F.every(F.col("rank") >= F.col("need")).alias("warranted"))


# ---------------------------------------------------------------- multiresolution: orders in nested blocks
_ITEMS = """i AS (SELECT o_orderkey AS item, 'all' AS l0, r_name AS l1, n_name AS l2, n_name || '|' || o_orderpriority AS l3, (o_orderstatus = 'F')::INT::DOUBLE AS v, (o_orderkey % 7)::DOUBLE AS u, 1.0 / (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS mu
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT *, avg(v) OVER (PARTITION BY l0) AS v0, avg(v) OVER (PARTITION BY l1) AS v1, avg(v) OVER (PARTITION BY l2) AS v2, avg(v) OVER (PARTITION BY l3) AS v3, avg(u) OVER (PARTITION BY l0) AS u0, avg(u) OVER (PARTITION BY l1) AS u1, avg(u) OVER (PARTITION BY l2) AS u2, avg(u) OVER (PARTITION BY l3) AS u3 FROM i)"""
LEVELS = ["l0", "l1", "l2", "l3"]


def _items(spark, sf_dir) -> DataFrame:
    t = lambda n: views.table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("o_orderkey").alias("item"), "o_custkey", F.lit("all").alias("l0"), F.col("r_name").alias("l1"), F.col("n_name").alias("l2"), F.concat_ws("|", "n_name", "o_orderpriority").alias("l3"), (F.col("o_orderstatus") == "F").cast("double").alias("v"), (F.col("o_orderkey") % 7).cast("double").alias("u"))
    return rows


@query(f"WITH {_ITEMS} SELECT l2, round(any_value(v2), 6) AS p, count(*) AS items FROM p GROUP BY l2")
def cond_expectation(spark, sf_dir):
    out = multires.conditional_expectation(_items(spark, sf_dir), "l2")
    return out.groupBy("l2").agg(F.round(F.any_value("p"), 6).alias("p"), F.count("*").alias("items"))


@query(f"WITH {_ITEMS} SELECT 0 AS level, round(sum(mu * (v1 - v0) ** 2), 9) AS energy FROM p UNION ALL SELECT 1, round(sum(mu * (v2 - v1) ** 2), 9) FROM p UNION ALL SELECT 2, round(sum(mu * (v3 - v2) ** 2), 9) FROM p")
def detail_energies(spark, sf_dir):
    return multires.energies(_items(spark, sf_dir), LEVELS).withColumn("energy", F.round("energy", 9))


@query(f"WITH {_ITEMS} SELECT l1 AS parent, round(sum(mu * (v2 - v1) ** 2), 9) AS energy FROM p GROUP BY l1")
def parent_energies(spark, sf_dir):
    return multires.parent_energies(_items(spark, sf_dir), LEVELS, 1).withColumn("energy", F.round("energy", 9))


@query(f"WITH {_ITEMS} SELECT 'root' AS part, round(sum(mu * v0 ** 2), 9) AS amount FROM p UNION ALL SELECT 'residual', round(sum(mu * (v - v3) ** 2), 9) FROM p UNION ALL SELECT 'variance', round(sum(mu * (v - v0) ** 2), 9) FROM p UNION ALL SELECT 'level 0', round(sum(mu * (v1 - v0) ** 2), 9) FROM p UNION ALL SELECT 'level 1', round(sum(mu * (v2 - v1) ** 2), 9) FROM p UNION ALL SELECT 'level 2', round(sum(mu * (v3 - v2) ** 2), 9) FROM p")
def variance_decomposition(spark, sf_dir):
    return multires.decomposition(_items(spark, sf_dir), LEVELS).withColumn("amount", F.round("amount", 9))


@query(f"WITH {_ITEMS} SELECT round(sum(mu * (v3 - v1) ** 2), 9) AS energy FROM p")
def band_energy(spark, sf_dir):
    return multires.band_energy(_items(spark, sf_dir), LEVELS, 1, 3).select(F.round("energy", 9).alias("energy"))


@query(f"WITH {_ITEMS} SELECT round(sum(mu * (v2 - v1) ** 2) + sum(mu * (v - v3) ** 2), 9) AS pruning_error FROM p")
def pruning_error(spark, sf_dir):
    return multires.kept_levels(_items(spark, sf_dir), LEVELS, [0, 2]).select(F.round("pruning_error", 9).alias("pruning_error"))


@query(f"WITH {_ITEMS} SELECT l3, round(any_value(v0 + v2 - v1), 6) AS rebuilt FROM p GROUP BY l3")
def reconstruct_levels(spark, sf_dir):
    out = multires.reconstruct(_items(spark, sf_dir), LEVELS, [1])
    return out.groupBy("l3").agg(F.round(F.any_value("rebuilt"), 6).alias("rebuilt"))


@query(f"WITH {_ITEMS} SELECT 0 AS level, round(sum(mu * (v1 - v0) * (u1 - u0)), 9) AS energy FROM p UNION ALL SELECT 1, round(sum(mu * (v2 - v1) * (u2 - u1)), 9) FROM p UNION ALL SELECT 2, round(sum(mu * (v3 - v2) * (u3 - u2)), 9) FROM p")
def covariation(spark, sf_dir):
    return multires.energies(_items(spark, sf_dir), LEVELS, "v", "u").withColumn("energy", F.round("energy", 9))


@query(f"WITH {_ITEMS}, b AS (SELECT count(DISTINCT l0) AS b0, count(DISTINCT l1) AS b1, count(DISTINCT l2) AS b2, count(DISTINCT l3) AS b3, avg(v) AS p, count(*) AS n FROM i) SELECT level, blocks, dim, round(p * (1 - p) / (n - 1) * dim, 12) AS expected FROM b, LATERAL (VALUES (0, b0, b1 - b0), (1, b1, b2 - b1), (2, b2, b3 - b2), (3, b3, NULL)) t(level, blocks, dim)")
def permutation_null(spark, sf_dir):
    return multires.null_energies(_items(spark, sf_dir), LEVELS).withColumn("expected", F.round("expected", 12))


@query("SELECT count(*) AS n, count(quality) AS labelled, count(*) FILTER (quality = 1) AS positive FROM documents LEFT JOIN labels USING (doc_id)")
def label_coverage(spark, sf_dir):
    return multires.coverage(views.document_runs(spark, sf_dir), "quality")


# ---------------------------------------------------------------- cost variation
_COST = f"""WITH {EV}, k AS (SELECT task, cost, 'all' AS l0, outcome AS l1, outcome || '|' || tools[1] AS l2 FROM ev), m AS (SELECT task, count(*) AS m, avg(cost) AS c FROM k GROUP BY task HAVING count(*) >= 2),
i AS (SELECT k.task, l0, l1, l2, 1.0 / ((SELECT count(*) FROM m) * m.m) AS mu, cost - c AS v FROM k JOIN m USING (task)),
p AS (SELECT *, sum(mu * v) OVER (PARTITION BY l0) / sum(mu) OVER (PARTITION BY l0) AS v0, sum(mu * v) OVER (PARTITION BY l1) / sum(mu) OVER (PARTITION BY l1) AS v1, sum(mu * v) OVER (PARTITION BY l2) / sum(mu) OVER (PARTITION BY l2) AS v2 FROM i),
t AS (SELECT sum(mu * v * v) - sum(mu * v) ** 2 / sum(mu) AS total, sum(mu * (v1 - v0) ** 2) AS e0, sum(mu * (v2 - v1) ** 2) AS e1 FROM p),
bl AS (SELECT 0 AS level, l0 AS b, count(*) AS n, sum(mu) AS mu, count(DISTINCT task) AS tasks FROM i GROUP BY l0 UNION ALL SELECT 1, l1, count(*), sum(mu), count(DISTINCT task) FROM i GROUP BY l1 UNION ALL SELECT 2, l2, count(*), sum(mu), count(DISTINCT task) FROM i GROUP BY l2),
su AS (SELECT level, count(*) AS blocks, avg(n) AS mean_size, coalesce(sum(mu) FILTER (tasks >= 2), 0) AS supported FROM bl GROUP BY level)"""
COST_LEVELS = ["l0", "l1", "l2"]


def _cost_runs(spark, sf_dir) -> DataFrame:
    first = F.get(F.col("steps"), F.lit(0))["tool"]
    return views.event_runs(spark, sf_dir).select("task", "cost", F.lit("all").alias("l0"), F.col("outcome").alias("l1"), F.concat_ws("|", "outcome", first).alias("l2"))


@query(f"{_COST} SELECT 0 AS level, round(e0, 4) AS energy, round(e0 / total, 6) AS share, (SELECT blocks >= 2 AND supported >= 0.5 FROM su WHERE level = 1) AS admissible FROM t UNION ALL SELECT 1, round(e1, 4), round(e1 / total, 6), (SELECT blocks >= 2 AND supported >= 0.5 FROM su WHERE level = 2) FROM t")
def cost_shares(spark, sf_dir):
    return costvar.shares(_cost_runs(spark, sf_dir), COST_LEVELS).select("level", F.round("energy", 4).alias("energy"), F.round("share", 6).alias("share"), "admissible")


@query(f"{_COST} SELECT level, blocks, round(mean_size, 6) AS mean_size, round(supported, 6) AS supported, blocks >= 2 AND supported >= 0.5 AS admissible FROM su")
def cost_support(spark, sf_dir):
    found = costvar.support(costvar.weighed(costvar.cost_book(_cost_runs(spark, sf_dir), COST_LEVELS)))
    return found.withColumns({"mean_size": F.round("mean_size", 6), "supported": F.round("supported", 6)})


@query(f"{_COST} SELECT CASE WHEN e0 >= e1 THEN 0 ELSE 1 END AS level, round(greatest(e0, e1) / total, 6) AS share FROM t")
def cost_best_level(spark, sf_dir):
    return costvar.best_level(costvar.shares(_cost_runs(spark, sf_dir), COST_LEVELS), 0.0).withColumn("share", F.round("share", 6))


@query(f"WITH {EV}, {_six('(SELECT *, task AS g FROM ev)').replace('SELECT agent, ordinal', 'SELECT g AS agent, ordinal')}, tau AS (SELECT level, (n - l) / n AS tau FROM book WHERE level BETWEEN 2 AND 5), f AS (SELECT level, median(tau) AS m, count(*) FILTER (tau > 0) AS c FROM tau GROUP BY level) SELECT level, round(m, 6) AS median FROM f WHERE m >= 0.2 AND c >= 5 ORDER BY m DESC, level LIMIT 1")
def localised_level(spark, sf_dir):
    runs = views.event_runs(spark, sf_dir)
    book = ledger.ledger(runs, plain_tower(), ok(), "task")
    return costvar.localised(book, runs.select("task").distinct()).withColumn("median", F.round("median", 6))


# ---------------------------------------------------------------- protocol
_DOC = "d AS (SELECT source AS agent, lang AS task, n_chars::DOUBLE AS cost, CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failure' END AS label FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_DOC} SELECT count(*) AS n, count(*) FILTER (label = 'success') AS success, count(*) FILTER (label = 'failure') AS failure, 0::BIGINT AS unknown, count(*) FILTER (label IS NULL) AS unevaluated, count(label) AS labelled, round(count(label) / count(*), 6) AS coverage FROM d")
def coverage_report(spark, sf_dir):
    return protocol.coverage_report(views.document_runs(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {_DOC} SELECT agent, task, round(CASE WHEN count(label) > 0 THEN count(*) FILTER (label = 'success') / count(label) END, 6) AS score FROM d GROUP BY ALL")
def task_success_score(spark, sf_dir):
    return protocol.task_success(views.document_runs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_DOC} SELECT agent, task, round(CASE WHEN count(cost) = count(*) THEN avg(cost) END, 6) AS mean_cost FROM d GROUP BY ALL")
def task_cost_mean(spark, sf_dir):
    return protocol.task_cost(views.document_runs(spark, sf_dir)).withColumn("mean_cost", F.round("mean_cost", 6))


@query(f"WITH {_DOC}, m AS (SELECT agent, task, avg(cost) AS c FROM d GROUP BY ALL) SELECT a.task, round(a.c - b.c, 6) AS difference FROM m a JOIN m b USING (task) WHERE a.agent = 'src1' AND b.agent = 'src0'")
def paired_differences(spark, sf_dir):
    return protocol.paired_differences(protocol.task_cost(views.document_runs(spark, sf_dir)), "src1", "src0", "mean_cost").withColumn("difference", F.round("difference", 6))


@query("SELECT n, h, r, CASE WHEN n < 6 THEN 'D' WHEN NOT h THEN 'B' WHEN r THEN 'A' ELSE 'D' END AS verdict FROM (VALUES (5), (6), (9)) a(n), (VALUES (true), (false)) b(h), (VALUES (true), (false)) c(r)")
def classify(spark, sf_dir):
    grid = spark.createDataFrame([(n, h, r) for n in (5, 6, 9) for h in (True, False) for r in (True, False)], "n int, h boolean, r boolean")
    return grid.select("n", "h", "r", protocol.classify(F.col("n"), F.col("h"), F.col("r")).alias("verdict"))


@query()
def bootstrap_percentile(spark, sf_dir):
    scores = protocol.task_cost(views.event_runs(spark, sf_dir))
    pairs = protocol.paired_differences(scores, "agent-1", "agent-0", "mean_cost")
    return protocol.bootstrap_table(pairs.withColumn("kind", F.lit("cost")), 0.95)


@query()
def task_split(spark, sf_dir):
    train, held = protocol.task_split(views.event_runs(spark, sf_dir), 0.5, seed=0)
    return train.select("task").distinct().withColumn("held", F.lit(False)).unionByName(held.select("task").distinct().withColumn("held", F.lit(True)))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'unknown' WHEN trim(lang) = 'en' THEN 'success' ELSE 'failure' END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def exact_match_labels(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", protocol.exact_match(F.when(F.col("quality").isNotNull(), F.col("lang")), F.lit(" en ")).alias("label"))


# ---------------------------------------------------------------- dynamics
EDGES = ((0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (4, 6), (5, 7), (6, 7), (1, 6))
N = 8
_BIT = lambda x, v: f"(({x} >> {v}) & 1)"
_ENERGY = " + ".join(f"({_BIT('x', u)} = {_BIT('x', v)})::INT" for u, v in EDGES)
_XS = f"s AS (SELECT range::BIGINT AS x FROM range({1 << N}))"


def _gain_sql(v: int, x: str) -> str:
    return " + ".join(f"(CASE WHEN {_BIT(x, a)} = {_BIT(x, b)} THEN -1 ELSE 1 END)" for a, b in EDGES if v in (a, b))


_STEP = f"{_XS}, o AS (SELECT x, v, d FROM s, LATERAL (VALUES {', '.join(f'({v}, {_gain_sql(v, chr(120))})' for v in range(N))}) t(v, d)), st AS (SELECT x, xor(x, (1::BIGINT << arg_min(v, (d, abs(v - 0.5 * {N - 1}), v))))::BIGINT AS t FROM o GROUP BY x)"


def _one_step(spark):
    return dynamics.search(dynamics.states(spark, N), N, EDGES, 0.5, 1, 2)


@query(f"WITH {_XS}, e AS (SELECT x, ({_ENERGY})::INT AS energy FROM s) SELECT x, energy FROM e WHERE energy = (SELECT min(energy) FROM e)")
def maxcut_optima(spark, sf_dir):
    return dynamics.optima(spark, N, EDGES)


@query(f"WITH {_STEP} SELECT x, t FROM st")
def one_step_map(spark, sf_dir):
    return _one_step(spark)


@query(f"WITH {_STEP} SELECT sum(c)::BIGINT AS blocks, count(*) AS images, (sum(c) - count(*))::BIGINT AS surplus, count(*) FILTER (c > 1) AS shared FROM (SELECT t, count(*) AS c FROM st GROUP BY t)")
def collisions(spark, sf_dir):
    return dynamics.collisions(_one_step(spark))


@query(f"WITH {_STEP} SELECT a.x, b.x AS y, a.t AS image FROM st a JOIN st b ON a.t = b.t AND a.x < b.x")
def collision_pairs(spark, sf_dir):
    return dynamics.collision_pairs(_one_step(spark))


@query(f"WITH {_XS}, e AS (SELECT x, ({_ENERGY})::INT AS energy FROM s), o AS (SELECT x AS o, row_number() OVER (ORDER BY x) - 1 AS i FROM e WHERE energy = (SELECT min(energy) FROM e)) SELECT s.x, arg_min(i, (bit_count(xor(s.x, o.o)), i))::INT AS branch FROM s, o GROUP BY s.x")
def branch_labels(spark, sf_dir):
    return dynamics.branches(dynamics.states(spark, N), dynamics.optima(spark, N, EDGES))


_MAP = "f AS (SELECT range::BIGINT AS x, ((range * range + 1) % 97)::BIGINT AS t FROM range(97))"


@query(f"WITH {_MAP}, p AS (SELECT x, (x % 3)::BIGINT AS b FROM f), k AS (SELECT f.x, p.b AS b0, q.b AS b1 FROM f JOIN p USING (x) JOIN p q ON q.x = f.t), m AS (SELECT b0, b1, dense_rank() OVER (ORDER BY min(x)) - 1 AS block FROM k GROUP BY b0, b1) SELECT x, block::INT AS block FROM k JOIN m USING (b0, b1)")
def refine_once(spark, sf_dir):
    f = views.square_map(spark, 97)
    return dynamics.refine(f.select("x", (F.col("x") % 3).alias("block")), [f])


@query(f"WITH {_MAP}, f64 AS (WITH RECURSIVE w(k, x, y) AS (SELECT 0, x, x FROM f UNION ALL SELECT k + 1, w.x, f.t FROM w JOIN f ON f.x = w.y WHERE k < 97) SELECT x, y FROM w WHERE k = 97) SELECT DISTINCT y AS x FROM f64")
def recurrent_core(spark, sf_dir):
    return dynamics.recurrent_core(views.square_map(spark, 97))


_CYC = f"WITH {_MAP}, w97 AS (WITH RECURSIVE w(k, x, y) AS (SELECT 0, x, x FROM f UNION ALL SELECT k + 1, w.x, f.t FROM w JOIN f ON f.x = w.y WHERE k < 97) SELECT DISTINCT y AS x FROM w WHERE k = 97), o AS (WITH RECURSIVE w(k, x, y) AS (SELECT 0, x, x FROM w97 UNION ALL SELECT k + 1, w.x, f.t FROM w JOIN f ON f.x = w.y WHERE k < 97) SELECT x, min(y) AS cycle FROM w GROUP BY x)"


@query(f"{_CYC}, c AS (SELECT cycle, count(*) AS length FROM o GROUP BY cycle) SELECT length, count(*) AS cycles FROM c GROUP BY length")
def cycle_lengths(spark, sf_dir):
    return dynamics.cycle_lengths(views.square_map(spark, 97))


@query(f"WITH {_MAP}, w97 AS (WITH RECURSIVE w(k, x, y) AS (SELECT 0, x, x FROM f UNION ALL SELECT k + 1, w.x, f.t FROM w JOIN f ON f.x = w.y WHERE k < 97) SELECT k, x, y FROM w), core AS (SELECT DISTINCT y AS x FROM w97 WHERE k = 97), d AS (SELECT w97.x, min(k) AS depth FROM w97 JOIN core ON core.x = w97.y GROUP BY w97.x) SELECT depth::INT AS depth, count(*) AS states FROM d GROUP BY depth")
def transient_profile(spark, sf_dir):
    return dynamics.transient_profile(views.square_map(spark, 97))


@query(f"WITH {_MAP} SELECT a.x, c.t FROM f a JOIN f b ON b.x = a.t JOIN f c ON c.x = b.t")
def map_power(spark, sf_dir):
    return dynamics.power(views.square_map(spark, 97), 3)


@query("WITH RECURSIVE p(a, k, v) AS (SELECT range::BIGINT, 1, range::BIGINT FROM range(1, 31) UNION ALL SELECT a, k + 1, v * a % 31 FROM p WHERE k < 30) SELECT a, min(k)::BIGINT AS \"order\" FROM p WHERE v = 1 GROUP BY a")
def mult_orders(spark, sf_dir):
    return dynamics.multiplicative_orders(spark, 31)


@query("WITH n AS (SELECT n_nationkey::BIGINT AS x, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS component FROM nation) SELECT x, component FROM n")
def forest_components(spark, sf_dir):
    nation = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("x"), "n_regionkey")
    chain = F.lead("x").over(Window.partitionBy("n_regionkey").orderBy("x"))
    edges = nation.withColumn("v", chain).filter("v IS NOT NULL").select(F.col("x").alias("u"), "v")
    return graphs.components(nation.select("x"), edges)


@query("WITH n AS (SELECT n_nationkey AS x, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS v FROM nation), e AS (SELECT x AS u, v FROM n WHERE v IS NOT NULL UNION ALL SELECT v, x FROM n WHERE v IS NOT NULL), d AS (SELECT u, count(*) AS degree FROM e GROUP BY u) SELECT degree, count(*) AS vertices FROM d GROUP BY degree")
def graph_degrees(spark, sf_dir):
    nation = views.table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("u"), F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("v")).filter("v IS NOT NULL")
    return graphs.degrees(edges)


@query("SELECT doc_id, array_to_string(list_transform(range(0, 5), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: coalesce(([1, doc_id % 5, 2])[i + 1], 0) * coalesce(([doc_id % 3, 1, 4])[k - i + 1], 0)))::BIGINT), ',') AS product FROM documents")
def polynomial_products(spark, sf_dir):
    p = F.array(F.lit(1).cast("long"), F.col("doc_id") % 5, F.lit(2).cast("long"))
    q = F.array(F.col("doc_id") % 3, F.lit(1).cast("long"), F.lit(4).cast("long"))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(graphs.product(p, q), ",").alias("product"))


# ---------------------------------------------------------------- cache lookup, windows
def _payload_lookup(spark, sf_dir) -> DataFrame:
    runs = views.event_runs(spark, sf_dir)
    labels = S.tool_sequence(F.col("steps"))
    stored = ledger.chained(runs.filter(ok()).select("cost", labels.alias("labels")), "labels").groupBy("id").agg(F.min("cost").alias("payload"))
    asked = runs.select(F.col("ordinal").alias("query_id"), labels.alias("labels"), "cost")
    return ledger.lookup(stored, asked, F.col("payload") <= F.col("cost")).withColumn("payload", F.round("payload", 6))


_LOOKED = f"""WITH {EV}, pay AS (SELECT level::INT AS level, tools[1:level] AS p, min(cost) AS payload FROM (SELECT tools, cost FROM ev WHERE outcome = 'stop') t, unnest(range(1, len(tools) + 1)) r(level) GROUP BY ALL),
q AS (SELECT ordinal AS query_id, tools, cost, level::INT AS level FROM ev, unnest(range(1, len(tools) + 1)) r(level)), m AS (SELECT q.query_id, q.level, pay.payload, pay.payload IS NOT NULL AND pay.payload <= q.cost AS hit FROM q LEFT JOIN pay ON pay.level = q.level AND pay.p = q.tools[1:q.level]),
found AS (SELECT query_id, min(level) FILTER (hit) AS level, round(arg_min(payload, level) FILTER (hit), 6) AS payload, max(level) FILTER (payload IS NOT NULL) AS reached FROM m GROUP BY query_id)"""


@query(f"{_LOOKED} SELECT level, reached, count(*) AS queries FROM found GROUP BY ALL")
def payload_prefix_lookup(spark, sf_dir):
    """At which level stored payloads serve, along whole paths of any length."""
    return _payload_lookup(spark, sf_dir).groupBy("level", "reached").agg(F.count("*").alias("queries"))


@query(f"{_LOOKED} SELECT * FROM found")
def payload_lookup_whole_path(spark, sf_dir):
    """The served payload of each query."""
    return _payload_lookup(spark, sf_dir)


@query("""WITH g AS (SELECT user_id, ts, event_type, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, (epoch_us(min(ts)) // 1000000)::BIGINT AS started, count(*) AS events FROM s GROUP BY user_id, sid""")
def events_session_window(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("started"), "events")


@query("SELECT x, y FROM (SELECT c_nationkey::INT AS x, 'c' AS y FROM customer INTERSECT SELECT s_nationkey, 'c' FROM supplier)")
def set_intersection(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("x"), F.lit("c").alias("y"))
    return c.intersect(views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("x"), F.lit("c").alias("y")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey").join(views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# ---------------------------------------------------------------- sources and streams
@query(f"WITH {EV} SELECT outcome, 'agent-' || (user_id % 5) AS model, count(*) AS runs, sum(len(tools))::BIGINT AS steps, sum(len([e FOR e IN errs IF e]))::BIGINT AS errors FROM ev GROUP BY ALL")
def load_canonical_events(spark, sf_dir):
    """Event runs written in the canonical form and read back by its loader."""
    from ..sources import loaders, sinks

    runs = views.event_runs(spark, sf_dir).select(F.col("agent").alias("model"), F.lit("p").alias("project"), F.col("task").alias("prompt"), "outcome", F.transform("steps", lambda s: F.struct(s["tool"].alias("tool"), s["args"].alias("args"), s["error"].alias("error"))).alias("steps"))
    files = sinks.canonical_json(runs).select(F.sha2("value", 256).alias("path"), "value")
    back = loaders.load_canonical(files)
    return back.groupBy("outcome", "model").agg(F.count("*").alias("runs"), F.sum(F.size("steps")).alias("steps"), F.sum(F.size(F.filter("steps", lambda s: s["error"].isNotNull()))).alias("errors"))


@query("SELECT * FROM (VALUES ('a', 'canonical'), ('b', 'otel'), ('c', 'openai'), ('d', 'langsmith'), ('e', 'autogen'), ('f', 'crewai'), ('g', 'claude'), ('h', 'codex'), ('i', 'pi'), ('j', 'canonical')) t(path, format)")
def format_detect_scores(spark, sf_dir):
    from ..sources import detect

    samples = {
        "a": '{"steps": []}',
        "b": '{"resourceSpans": []}',
        "c": '{"messages": [{"role": "user", "content": "x"}]}',
        "d": '{"run_type": "tool", "trace_id": "1"}',
        "e": '{"messages": [{"function_call": {"name": "f"}}]}',
        "f": '{"tasks_output": []}',
        "g": '{"type": "user", "message": {}, "parentUuid": null}',
        "h": '{"type": "response_item", "payload": {}}',
        "i": '{"type": "session", "cwd": "/"}\n{"type": "message", "message": {}}',
        "j": '{"unknown": 1}',
    }
    return detect.detect(spark.createDataFrame(list(samples.items()), "path string, value string"))


@query(_book_sql("ev", EV, "SELECT agent, level, n, l FROM book"))
def streamed_ledger_merge(spark, sf_dir):
    """The ledger from class sights merged batch by batch, as a stream would leave them."""
    from ..streaming import ledgers

    marks = ledgers.class_marks(views.event_runs(spark, sf_dir), plain_tower(), ok(), "agent")
    sights = ledgers.first_sights(marks, "agent")
    return ledgers.counts(sights, "agent")


@query(f"WITH {EV}, {_PREFIX.format('ev')}, h AS (SELECT agent, max(level) AS h FROM pre GROUP BY agent) SELECT agent, level, CASE WHEN longest >= h THEN 'LIVE' ELSE 'TRANSIENT' END AS status, count(*) AS classes FROM pre JOIN h USING (agent) GROUP BY ALL")
def horizon_statuses(spark, sf_dir):
    from ..streaming import ledgers

    reach = ledgers.prefix_reach(views.event_runs(spark, sf_dir), S.tool_sequence(F.col("steps")), "agent")
    return ledgers.horizon_statuses(reach, "agent").groupBy("agent", "level", "status").agg(F.count("*").alias("classes"))
