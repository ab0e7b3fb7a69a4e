"""Registered queries of argument keys, loaders, streams, diagnostic levels, selectors, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import mesh
from ..functions import steps as S
from ..operators import analytics, costvar, dynamics, ledger, moments, multires, pairing, protocol, tower, warrants
from ..tables import held, scratch
from . import views
from .queries import _BOOK_FROM, _COST, _PREFIX, COST_LEVELS, EV, LEVELS, ORD, _book_sql, _cost_runs, _events_book, _items, _six, ok
from .registry import query

# ---------------------------------------------------------------- steps with JSON arguments
_US = "chr(31)"
_K = "(json_extract(props, '$.k'))::INT"
#: Event kinds as tools, their arguments, and what their key, class and display are.
TOOLS = {
    "view": ("read", '{"filePath": "src/.f%1$d.py", "offset": %1$d, "limit": null, "lines": [1, 2]}'),
    "click": ("bash", '{"command": " grep  -n   x%1$d | wc "}'),
    "signup": ("mcp_a", '{"name": "inner%1$d", "arguments": {"b": %1$d, "a": 1.0}}'),
    "error": ("edit", '{"path": "p%1$d.txt", "new_str": "v%1$d", "old_str": ""}'),
    "purchase": ("other", '{"z": %1$d, "a": [1, {"y": 2.50, "x": "\\u00e9"}]}'),
}
_TOOL_SQL = "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'bash' WHEN 'signup' THEN 'mcp_a' WHEN 'error' THEN 'edit' ELSE 'other' END"
_KEY_SQL = f"""CASE event_type WHEN 'view' THEN 'src/.f' || k || '.py' || {_US} || 'offset=' || k || {_US} || 'lines=[1,2]' WHEN 'click' THEN 'grep -n x' || k || ' | wc' WHEN 'signup' THEN 'inner' || k || {_US} || '{{"a":1,"b":' || k || '}}'
  WHEN 'error' THEN 'p' || k || '.txt' || {_US} || 'new_str#' || len('v' || k) || ':v' || k || {_US} || 'old_str#0:' ELSE '{{"a":[1,{{"x":"é","y":2.5}}],"z":' || k || '}}' END"""
_CLASS_SQL = "CASE event_type WHEN 'view' THEN 'read|.py' WHEN 'click' THEN 'bash|grep|true|false' WHEN 'signup' THEN 'mcp|inner' || k WHEN 'error' THEN 'edit|.txt' ELSE 'other' END"
_SHOWN_SQL = "CASE event_type WHEN 'view' THEN 'src/.f' || k || '.py' WHEN 'click' THEN 'grep -n x' || k || ' | wc' WHEN 'signup' THEN 'inner' || k || ':{\"b\":' || k || ',\"a\":1.0}' WHEN 'error' THEN 'p' || k || '.txt' ELSE '{\"a\":[1,{\"x\":\"é\",\"y\":2.5}],\"z\":' || k || '}' END"
_CALLED = f"called AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type, {_TOOL_SQL} AS tool, {_KEY_SQL} AS key, {_CLASS_SQL} AS class, {_SHOWN_SQL} AS shown, event_type = 'error' AS err, value, k FROM (SELECT *, {_K} AS k FROM events))"


def called(spark, sf_dir) -> DataFrame:
    """Events as tool calls with JSON arguments."""
    e = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    tool = F.coalesce(*(F.when(F.col("event_type") == kind, F.lit(name)) for kind, (name, _) in TOOLS.items()))
    args = F.coalesce(*(F.when(F.col("event_type") == kind, F.format_string(text, "k")) for kind, (_, text) in TOOLS.items()))
    return e.withColumn("tool", tool).withColumn("args", args)


def called_runs(spark, sf_dir) -> DataFrame:
    e = called(spark, sf_dir).withColumn("step", F.struct("tool", "args", F.when(F.col("event_type") == "error", F.lit("error")).alias("error"))).withColumn("day", F.to_date("ts"))
    runs = e.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "step"))), lambda x: x["step"]).alias("steps"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.min("event_id").alias("ordinal"), F.sum("value").alias("cost"))
    outcome = F.when(F.col("last") == "purchase", "stop").when(F.col("last") == "error", "error").otherwise("toolUse")
    return runs.select("ordinal", F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string")).alias("agent"), F.dayofmonth("day").cast("string").alias("task"), outcome.alias("outcome"), "cost", "steps")


@query(f"WITH {_CALLED} SELECT DISTINCT tool, class, key, shown FROM called")
def canonical_keys(spark, sf_dir):
    t, a = F.col("tool"), F.col("args")
    return called(spark, sf_dir).select("tool", S.arg_class(t, a).alias("class"), S.canonical_args(t, a).alias("key"), S.shown_args(t, a).alias("shown")).distinct()


_CALLED_RUNS = f"""{_CALLED}, cr AS (SELECT user_id, day, 'agent-' || (user_id % 5) AS agent, dayofmonth(day)::VARCHAR AS task, min(event_id) AS ordinal, list(CASE WHEN tool LIKE 'mcp%' THEN 'mcp' ELSE tool END ORDER BY ts, event_id) AS tools, list(err ORDER BY ts, event_id) AS errs, list(class ORDER BY ts, event_id) AS classes, list(tool || chr(30) || key ORDER BY ts, event_id) AS keys,
  list(tool ORDER BY ts, event_id) AS names, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'stop' WHEN 'error' THEN 'error' ELSE 'toolUse' END AS outcome, sum(value) AS cost FROM called GROUP BY user_id, day)"""


@query(
    f"""WITH {_CALLED_RUNS}, keyed AS (SELECT agent, outcome = 'stop' AS ok, [outcome, list_sort(tools)::VARCHAR, tools::VARCHAR, errs::VARCHAR, array_to_string(classes, chr(29)), array_to_string(keys, chr(29))] AS parts FROM cr),
cls AS (SELECT agent, level::INT AS level, array_to_string(parts[1:level], '#') AS k, bool_or(ok) AS live FROM keyed, range(1, 7) r(level) GROUP BY ALL)
SELECT agent, level, count(*) AS n, count(*) FILTER (live) AS l FROM cls GROUP BY ALL"""
)
def ledger_tool_tower_canonical(spark, sf_dir):
    """The default tower: argument classes and canonical arguments of JSON."""
    return ledger.ledger(called_runs(spark, sf_dir), tower.build_tower("tool"), ok())


@query("SELECT DISTINCT event_id, list_reduce([(position(c IN '0123456789abcdef') - 1)::BIGINT FOR c IN string_split(sha256('7:' || event_type || ':' || event_id), '')], lambda a, b: (a * 16 + b) % (event_id % 90 + 1))::BIGINT % (event_id % 90 + 1) AS place FROM events")
def seeded_places(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", S.seeded_index(F.concat(F.lit("7:"), "event_type", F.lit(":"), F.col("event_id").cast("string")), F.col("event_id") % 90 + 1).alias("place"))


# ---------------------------------------------------------------- loaders
_TURNS = "m AS (SELECT conv_id, turn, role, row_number() OVER w AS rn, sum((role = 'user')::INT) OVER w AS run, role = 'assistant' AND (turn // 2) % 2 = 0 AS call, role = 'assistant' AND (turn // 2) % 2 = 1 AS said FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))"


def openai_files(spark, sf_dir) -> DataFrame:
    """Conversations as files of messages: assistants call tools or answer, and some calls fail."""
    c = views.table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("c"), F.col("turn").cast("string")))
    call = (F.col("role") == "assistant") & (F.floor(F.col("turn") / 2) % 2 == 0)
    asked = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(F.struct("id", F.struct(F.lit("look").alias("name"), F.to_json(F.struct("turn")).alias("arguments")).alias("function"))).alias("tool_calls")))
    got = F.to_json(F.struct(F.lit("tool").alias("role"), F.col("id").alias("tool_call_id"), F.when(F.col("turn") % 3 == 1, "Error: no").otherwise("fine").alias("content")))
    plain = F.to_json(F.struct("role", F.lit("some words").alias("content"), F.lit("m").alias("model")))
    lines = F.when(call, F.concat(asked, F.lit("\n"), got)).otherwise(plain)
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", lines.alias("line")))).alias("l"))
    return rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value"))


@query(f"WITH {_TURNS}, r AS (SELECT conv_id, run, count(*) FILTER (call) AS steps, count(*) FILTER (call AND turn % 3 = 1) AS errors, CASE WHEN bool_or(said) THEN 'stop' ELSE 'noToolUse' END AS outcome FROM m GROUP BY ALL HAVING count(*) FILTER (call) > 0) SELECT outcome, steps, errors, count(*) AS runs FROM r GROUP BY ALL")
def load_openai_conversations(spark, sf_dir):
    from ..sources import loaders

    runs = loaders.load_openai(openai_files(spark, sf_dir))
    return runs.select("outcome", F.size("steps").cast("long").alias("steps"), F.size(F.filter("steps", lambda s: s["error"].isNotNull())).cast("long").alias("errors")).groupBy("outcome", "steps", "errors").agg(F.count("*").alias("runs"))


@query(f"WITH {_TURNS}, r AS (SELECT conv_id, run FROM m GROUP BY ALL HAVING count(*) FILTER (call) > 0), {EV} SELECT 'openai' AS project, (SELECT count(*) FROM r) AS runs UNION ALL SELECT 'p', count(*) FROM ev")
def load_mixed_folder(spark, sf_dir):
    """Files of two formats, told apart by their contents, each read by its own loader."""
    from ..sources import detect, sinks

    runs = views.event_runs(spark, sf_dir).select(F.col("agent").alias("model"), F.lit("p").alias("project"), F.col("task").alias("prompt"), "outcome", "steps", "ordinal")
    # a run's file bears the run's own number, and what was made once is read by all that follows
    canonical = sinks.canonical_json(runs, F.concat(F.lit("r"), F.col("ordinal").cast("string"), F.lit(".json")).alias("path"))
    files = held(openai_files(spark, sf_dir).unionByName(canonical), "mixed")
    files = files.join(detect.detect(files), "path")
    return detect.load_found(files).groupBy("project").agg(F.count("*").alias("runs"))


@query("SELECT doc_id, 'lint@2 [' || lang || ']' AS provenance, CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failure' END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def label_provenance(spark, sf_dir):
    """Labels with who gave them, checked row by row; the terminal outcome is another column."""
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failure")
    who = F.struct(F.lit("lint").alias("id"), F.lit("2").alias("version"), F.col("lang").alias("method"))
    return model.checked(d.select("doc_id", label.alias("verified_outcome"), who.alias("evaluator"))).select("doc_id", model.evaluator_text(F.col("evaluator")).alias("provenance"), F.col("verified_outcome").alias("label"))


@query("SELECT doc_id, CASE WHEN contains(coalesce(text, ''), 'the') THEN 'success' ELSE 'failure' END AS label FROM documents UNION ALL SELECT -1, 'failure'")
def artifact_labels(spark, sf_dir):
    """Files that must hold a marker; one of them is missing."""
    d = views.table(spark, sf_dir, "documents")
    wanted = d.select("doc_id").unionByName(spark.createDataFrame([(-1,)], "doc_id long")).select(F.col("doc_id").cast("string").alias("path"), F.lit("the").alias("marker"))
    out = protocol.file_contains(d.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content")), wanted)
    return out.select(F.col("path").cast("long").alias("doc_id"), "label")


@query(f"WITH {EV} SELECT ordinal, outcome, CASE WHEN ordinal % 3 = 0 THEN 'success' WHEN ordinal % 3 = 1 THEN 'failure' END AS verified_outcome FROM ev")
def attached_labels(spark, sf_dir):
    runs = views.event_runs(spark, sf_dir).withColumn("verified_outcome", F.lit(None).cast("string")).withColumn("evaluator", F.lit(None).cast("string"))
    labels = runs.filter("ordinal % 3 < 2").select("ordinal", F.when(F.col("ordinal") % 3 == 0, "success").otherwise("failure").alias("label"), F.lit("rule").alias("evaluator"))
    return protocol.attach(runs, labels, "ordinal").select("ordinal", "outcome", "verified_outcome")


# ---------------------------------------------------------------- streams
@query(_book_sql("ev", EV, "SELECT agent, level, n, l FROM book"))
def streamed_ledger(spark, sf_dir):
    """The ledger of a stream of runs that comes in several batches, each merged into the table of first sights."""
    from ..streaming import ledgers
    from .queries import plain_tower

    base = scratch(spark, "stream")
    runs = views.event_runs(spark, sf_dir)
    runs.repartition(4, "ordinal").write.parquet(f"{base}/runs")
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/runs")
    ledgers.run_stream(stream, plain_tower(), ok(), "agent", f"{base}/sights", f"{base}/progress").awaitTermination()
    return ledgers.stream_book(spark, f"{base}/sights", "agent")


@query(f"WITH {EV}, {_PREFIX.format('ev')}, h AS (SELECT agent, max(level) AS h FROM pre GROUP BY agent) SELECT agent, level, CASE WHEN longest >= h THEN 'LIVE' ELSE 'TRANSIENT' END AS status, count(*) AS classes FROM pre JOIN h USING (agent) GROUP BY ALL")
def streamed_horizon(spark, sf_dir):
    """The horizon rule on a stream of several batches: classes enter, and are demoted when a longer run comes."""
    from ..streaming import ledgers

    base = scratch(spark, "stream")
    runs = views.event_runs(spark, sf_dir).select("agent", "ordinal", S.tool_sequence(F.col("steps")).alias("labels"))
    # three batches of as many files as the session has partitions, each a task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs.repartition(3 * parts, "ordinal").write.parquet(f"{base}/runs")
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", parts).parquet(f"{base}/runs")
    ledgers.run_horizon(stream, F.col("labels"), "agent", f"{base}/changes", f"{base}/progress").awaitTermination()
    return ledgers.latest_statuses(spark, f"{base}/changes", "agent").groupBy("agent", "level", "status").agg(F.count("*").alias("classes"))


# ---------------------------------------------------------------- order-dependent joins, sets
@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS n FROM events WHERE event_type = 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS n FROM events WHERE event_type = 'view') SELECT c.event_id, r.event_id AS paired FROM c LEFT JOIN r USING (user_id, props, n)")
def paired_in_order(spark, sf_dir):
    """Without ids the n-th result of a name belongs to the n-th call of it."""
    e = views.table(spark, sf_dir, "events")
    calls, results = e.filter("event_type = 'click'").select("user_id", "props", "event_id"), e.filter("event_type = 'view'").select("user_id", "props", "event_id")
    return pairing.by_name_in_order(calls, results, ["user_id"], "props", "event_id", "event_id").select("event_id", F.col("event_id_paired").alias("paired"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events")
def last_known_signup(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return pairing.last_known(e, ["user_id"], ["ts", "event_id"], "s", "since").select("event_id", "since")


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) = 0 AND (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) = 0 AS equal, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_left, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS only_right")
def set_equality(spark, sf_dir):
    return pairing.same_rows(views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("WITH p AS (SELECT q, x, (q // pow(3, x)::BIGINT) % 3 AS b FROM range(27) a(q), range(3) r(x)), c AS (SELECT f.q AS fine, c.q AS coarse, f.b, count(DISTINCT c.b) AS k FROM p f JOIN p c USING (x) GROUP BY ALL) SELECT fine, coarse FROM c GROUP BY ALL HAVING max(k) = 1")
def partition_refinements(spark, sf_dir):
    """All pairs of labellings of three elements of which one refines the other."""
    p = spark.range(27).withColumnRenamed("id", "q").crossJoin(spark.range(3).withColumnRenamed("id", "x")).withColumn("block", F.floor(F.col("q") / F.pow(F.lit(3), F.col("x"))).cast("long") % 3)
    return dynamics.refinements(p)


@query("WITH p AS (SELECT q, x, (q // pow(2, x)::BIGINT) % 2 AS b FROM range(8) a(q), range(3) r(x)), f AS (SELECT m, x, (m // pow(3, x)::BIGINT) % 3 AS t FROM range(27) a(m), range(3) r(x)), i AS (SELECT m, q, p.b, count(DISTINCT c.b) AS k FROM f JOIN p USING (x) JOIN p c USING (q) WHERE c.x = f.t GROUP BY ALL) SELECT m, q FROM i GROUP BY ALL HAVING max(k) = 1")
def invariant_partitions(spark, sf_dir):
    p = spark.range(8).withColumnRenamed("id", "q").crossJoin(spark.range(3).withColumnRenamed("id", "x")).withColumn("block", F.floor(F.col("q") / F.pow(F.lit(2), F.col("x"))).cast("long") % 2)
    return dynamics.invariant_partitions(dynamics.all_maps(spark, 3), p)


@query("SELECT 2 AS level, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON len(a.n_name) = len(b.n_name) AND a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def violating_pairs(spark, sf_dir):
    """The quadratic check of a tower that does not nest, over a table of 25 rows."""
    t = tower.Tower(("region", "length"), [F.col("n_regionkey"), F.length("n_name")], nested=False)
    return tower.violating_pairs(views.table(spark, sf_dir, "nation"), t, "n_nationkey")


# ---------------------------------------------------------------- groups, statistics, audits
@query(f"WITH {EV}, t AS (SELECT task FROM ev WHERE task <> '' GROUP BY task HAVING count(DISTINCT agent) >= 5) SELECT agent, task, count(*) AS runs FROM ev JOIN t USING (task) GROUP BY ALL")
def matched_runs(spark, sf_dir):
    return ledger.matched(views.event_runs(spark, sf_dir), 5).groupBy("agent", "task").agg(F.count("*").alias("runs"))


@query(f"WITH {EV} SELECT 'none' AS grouping, 'all' AS agent, count(*) AS runs FROM ev UNION ALL SELECT 'model', agent, count(*) FROM ev GROUP BY agent UNION ALL SELECT 'project', outcome, count(*) FROM ev GROUP BY outcome UNION ALL SELECT 'file', task, count(*) FROM ev GROUP BY task")
def groupings(spark, sf_dir):
    runs = views.event_runs(spark, sf_dir).select(F.col("agent").alias("model"), F.col("outcome").alias("project"), S.task_of(F.col("task")).alias("session"))
    out = None
    for key in ("none", "model", "project", "file"):
        part = ledger.groups_of(runs, key).groupBy("agent").agg(F.count("*").alias("runs")).select(F.lit(key).alias("grouping"), "agent", "runs")
        out = part if out is None else out.unionByName(part)
    return out


@query(_book_sql("ev", EV, "SELECT level, sum(seen)::BIGINT AS inserts, count(*) AS nodes_created, (sum(seen) - count(*))::BIGINT AS revisits FROM cls GROUP BY level"))
def insert_stats(spark, sf_dir):
    from .queries import plain_tower

    return ledger.stats(ledger.class_ids(views.event_runs(spark, sf_dir), plain_tower(), ok()))


@query(_book_sql("ev", EV, f", {_BOOK_FROM} SELECT arg_min(agent, (s, agent)) AS agent FROM x"))
def reference_agent(spark, sf_dir):
    book = _events_book(spark, sf_dir)
    return analytics.reference_of(book, book.select("agent").distinct().withColumn("ordinal", F.col("agent")))


@query(_book_sql("ev", EV, "SELECT agent, level, CASE WHEN n = 0 OR l = 0 THEN 2.0 * 0.5 >= 0.3 ELSE 2.0 * 0.5 * l / n >= 0.3 END AS worth, round(pow(2.0, -level), 9) AS eps, round(log2(1 + n), 6) AS bar FROM book"))
def worth_refining(spark, sf_dir):
    from ..sources import sinks

    worth = analytics.worth_refining(F.col("n"), F.col("l"), gain=2.0, cost=0.3, ambiguity=0.5)
    return _events_book(spark, sf_dir).select("agent", "level", worth.alias("worth"), F.round(tower.eps(F.col("level")), 9).alias("eps"), F.round(sinks.bar_heights(F.col("n")), 6).alias("bar"))


@query(_book_sql("ev", EV, "SELECT a.agent, min(a.level) FILTER (a.n >= 1.05 * b.n) AS onset, round(max(a.n / b.n) FILTER (a.level = 2), 6) AS inflation, coalesce(min(a.level) FILTER (a.n >= 1.05 * b.n) < 3, false) OR coalesce(max(a.n / b.n) FILTER (a.level = 2) > 1.1, false) AS blocked FROM book a LEFT JOIN (SELECT * FROM book WHERE agent = 'agent-0') b USING (level) WHERE a.agent <> 'agent-0' GROUP BY a.agent"))
def regression_gate(spark, sf_dir):
    book = _events_book(spark, sf_dir)
    order = book.select("agent").distinct().withColumn("ordinal", F.col("agent"))
    return analytics.gate(book, "agent-0", order, earliest=3, tolerance=1.1, factor=1.05).withColumn("inflation", F.round("inflation", 6))


_TAILS = "t(c, status, obs, later) AS (VALUES ('down', 'TRENDING_DOWN', [0.4, 0.3, 0.2, 0.1], 9.0), ('flat', 'STABLE', [0.5, 0.5, 0.5, 0.5], 9.0), ('up', 'TRENDING_UP', [0.1, 0.2, 0.3, 0.4], 0.01))"


@query(f"WITH {_TAILS} SELECT c AS \"case\", status, list_max(obs)::DOUBLE AS value, later::DOUBLE AS limsup, abs(later - list_max(obs)) > 1e-9 AS violated FROM t")
def falsified_tails(spark, sf_dir):
    """What each kind of tail reports, and a continuation that breaks it."""
    seen = spark.createDataFrame([(c, i, v) for c, own in (("up", (0.1, 0.2, 0.3, 0.4)), ("down", (0.4, 0.3, 0.2, 0.1)), ("flat", (0.5,) * 4)) for i, v in enumerate(own, 1)], "case string, level int, v double")
    later = spark.createDataFrame([(c, 4 + i, v) for c, v in (("up", 0.01), ("down", 9.0), ("flat", 9.0)) for i in range(1, 200)], "case string, level int, v double")
    return analytics.falsified(seen, later)


@query(_book_sql("ev", EV, ", r AS (SELECT agent, level, ln(n) / (level * 0.6931471805599453) AS s FROM book), q AS (SELECT agent, level, s, s - lag(s) OVER (PARTITION BY agent ORDER BY level) AS d, row_number() OVER (PARTITION BY agent ORDER BY level DESC) AS back FROM r), z AS (SELECT agent, list(d) FILTER (back < 4) AS d, 1e-9 * greatest(1, max(abs(s)) FILTER (back <= 4)) AS tol FROM q GROUP BY agent) SELECT agent, CASE WHEN len([u FOR u IN d IF abs(u) > tol]) = 0 THEN 'window-exact (tail flat so far)' WHEN len([u FOR u IN d IF u < -tol]) = 0 THEN 'lower bound IF the tail stays monotone' WHEN len([u FOR u IN d IF u > tol]) = 0 THEN 'upper bound IF the tail stays monotone' ELSE 'no bound claimed' END AS label FROM z"))
def bound_labels(spark, sf_dir):
    return analytics.tails(_events_book(spark, sf_dir)).filter("kind = 's'").select("agent", "label")


@query(_book_sql("ev", EV, "SELECT agent, level, round(n / lag(n) OVER (PARTITION BY agent ORDER BY level), 6) AS ratio FROM book QUALIFY lag(n) OVER (PARTITION BY agent ORDER BY level) IS NOT NULL"))
def mesh_ratios(spark, sf_dir):
    return analytics.mesh_ratios(_events_book(spark, sf_dir), "agent", "level", "n").withColumn("ratio", F.round("ratio", 6))


_MESH = "j AS (SELECT range::BIGINT AS j FROM range(1, 60)), k AS (SELECT j, CASE WHEN j >= 16 THEN 16 WHEN j >= 4 THEN 4 ELSE 2 END AS k FROM j)"


@query(f"WITH {_MESH} SELECT j, round(CASE WHEN j = 1 THEN log2(3) ELSE log2(pow(2.0, j) + pow(2.0, 2 * k)) / j END, 9) AS explored, round(1.0, 9)::DOUBLE AS live, round(2 + log2(1 + pow(2.0, -k)) / k, 9) AS peak FROM k")
def burst_tower_ratios(spark, sf_dir):
    """Ratios of a tower of bursts at depths 2, 4 and 16, in closed form."""
    depths = mesh.burst_depths(3)
    k = mesh.band_depth(F.col("j"), depths)
    return spark.range(1, 60).select(F.col("id").alias("j")).select("j", F.round(mesh.ratio_explored(F.col("j"), depths), 9).alias("explored"), F.round(mesh.ratio_live(F.col("j")), 9).alias("live"), F.round(mesh.burst_peak(k), 9).alias("peak"))


@query("SELECT m, round(log2(1 + pow(2.0, -abs((k - 1) - 2 * before)::DOUBLE)) / (k - 1), 12) AS sparse, round((after - 1) / (k - 1)::DOUBLE, 9) AS mesh FROM (VALUES (1, 2, 4, 16), (2, 4, 16, 256), (3, 16, 256, 65536)) t(m, before, k, after)")
def sparse_burst_ratios(spark, sf_dir):
    rows = spark.createDataFrame([(1, 2, 4, 16), (2, 4, 16, 256), (3, 16, 256, 65536)], "m int, before long, k long, after long")
    return rows.select("m", F.round(mesh.sparse_ratio(F.col("before"), F.col("k")), 12).alias("sparse"), F.round(mesh.mesh_ratio(F.col("k"), F.col("after")), 9).alias("mesh"))


@query("WITH d AS (SELECT lang, CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failure' END AS label FROM documents LEFT JOIN labels USING (doc_id)) SELECT count(*) AS n, count(label) AS labelled, CASE WHEN count(DISTINCT CASE WHEN label IS NOT NULL THEN lang END) = 1 THEN NULL WHEN count(label) = 0 THEN 'no run is labelled' ELSE 'labels must come from one evaluator' END AS error FROM d")
def protocol_report(spark, sf_dir):
    """Labels of several evaluators: the report names what stands against a comparison."""
    runs = views.document_runs(spark, sf_dir).withColumn("evaluator", F.col("task"))
    out = protocol.report(runs)
    return spark.createDataFrame([(out["coverage"]["n"], out["coverage"]["labelled"], out["error"])], "n long, labelled long, error string")


@query(f"WITH {EV}, l AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN 'success' WHEN ordinal % 3 = 1 THEN 'failure' END AS label FROM ev), t AS (SELECT task, count(DISTINCT agent) AS agents FROM l WHERE task <> '' GROUP BY task) SELECT count(*) AS n, count(label) AS labelled, NULL::VARCHAR AS error, (SELECT count(*) FROM t WHERE agents >= 2) AS matched, greatest(1, round_even((SELECT count(DISTINCT task) FROM l) * 0.5, 0))::BIGINT AS held_tasks, (SELECT count(DISTINCT task) FROM l) - greatest(1, round_even((SELECT count(DISTINCT task) FROM l) * 0.5, 0))::BIGINT AS training_tasks, 0::BIGINT AS shared FROM l")
def protocol_passed(spark, sf_dir):
    """Labels of one evaluator over tasks that agents share: every step of the protocol, to the split and its check."""
    label = F.when(F.col("ordinal") % 3 == 0, "success").when(F.col("ordinal") % 3 == 1, "failure")
    runs = views.event_runs(spark, sf_dir).select("agent", "task", label.alias("verified_outcome"), F.lit("rule").alias("evaluator"))
    out = protocol.report(runs)
    train, held = (part.select("task").distinct() for part in protocol.task_split(runs))
    shared = train.intersect(held).count()
    matched = protocol.matched_tasks(protocol.labelled_runs(runs).unionByName(runs.filter("verified_outcome IS NULL")), 2).count()
    return spark.createDataFrame([(out["coverage"]["n"], out["coverage"]["labelled"], out["error"], matched, held.count(), train.count(), shared)], "n long, labelled long, error string, matched long, held_tasks long, training_tasks long, shared long")


@query("SELECT c.format, r.analysis FROM (VALUES " + ", ".join(f"('{f}', '{s}', {warrants.STATES[state]})" for f, row in warrants.CAPABILITIES.items() for s, state in zip(warrants.SEMANTICS, row, strict=True)) + ") c(format, semantic, rank) JOIN (VALUES " + ", ".join(f"('{a}', '{s}', {warrants.STATES[need]})" for a, r in warrants.REQUIREMENTS.items() for s, need in r.items()) + ") r(analysis, semantic, need) USING (semantic) GROUP BY ALL HAVING NOT bool_and(c.rank >= r.need)")
def refused_analyses(spark, sf_dir):
    """For which format each analysis is refused, asked one by one."""
    refused = []
    for name in warrants.CAPABILITIES:
        for analysis in warrants.REQUIREMENTS:
            try:
                warrants.require(name, analysis)
            except warrants.CapabilityError:
                refused.append((name, analysis))
    return spark.createDataFrame(refused, "format string, analysis string")


# ---------------------------------------------------------------- diagnostic levels and selectors
_MODES = f"""{_CALLED_RUNS}, md AS (SELECT *, len([x FOR x IN names IF x = 'bash']) AS ns, len([x FOR x IN names IF x = 'read']) AS nr, list_position(errs, true) AS bad FROM cr),
dl AS (SELECT ordinal, task, cost, 'all' AS l0, CASE WHEN ns = 0 THEN 'none' WHEN ns >= 2 THEN 'broad' ELSE 'targeted' END AS s, CASE WHEN nr = 0 THEN 'none' ELSE 'bounded' END AS r, CASE WHEN bad IS NULL OR bad = 0 THEN 'none' WHEN bad = len(errs) THEN 'unresolved' WHEN keys[bad] = keys[bad + 1] THEN 'retry' ELSE 'changed-action' END AS e FROM md),
dv AS (SELECT ordinal, task, cost, l0, s AS l1, s || '|' || r AS l2, s || '|' || r || '|' || e AS l3 FROM dl)"""


@query(f"WITH {_MODES} SELECT l1, l2, l3, count(*) AS runs FROM dv GROUP BY ALL")
def diagnostic_levels(spark, sf_dir):
    """Search mode, read scope and what follows the first error."""
    return costvar.diagnostic_levels(called_runs(spark, sf_dir)).groupBy("l1", "l2", "l3").agg(F.count("*").alias("runs"))


_PER_TASK = f"""{_MODES}, m AS (SELECT task, count(*) AS m, avg(cost) AS c FROM dv GROUP BY task HAVING count(*) >= 2), i AS (SELECT dv.*, 1.0 / ((SELECT count(*) FROM m) * m.m) AS mu, cost - c AS v FROM dv JOIN m USING (task)),
p AS (SELECT *, avg(v) OVER (PARTITION BY task) AS v0, avg(v) OVER (PARTITION BY task, l1) AS v1, avg(v) OVER (PARTITION BY task, l2) AS v2, avg(v) OVER (PARTITION BY task, l3) AS v3 FROM i),
e AS (SELECT task, sum(mu * (v1 - v0) ** 2) AS e0, sum(mu * (v2 - v1) ** 2) AS e1, sum(mu * (v3 - v2) ** 2) AS e2, sum(mu * v * v) - sum(mu * v) ** 2 / sum(mu) AS total FROM p GROUP BY task),
sh AS (SELECT task, 0 AS level, CASE WHEN total > 1e-12 THEN e0 / total END AS share FROM e UNION ALL SELECT task, 1, CASE WHEN total > 1e-12 THEN e1 / total END FROM e UNION ALL SELECT task, 2, CASE WHEN total > 1e-12 THEN e2 / total END FROM e)"""


@query(f"WITH {_PER_TASK} SELECT task, level, round(share, 6) AS share FROM sh")
def shares_by_task(spark, sf_dir):
    runs = costvar.diagnostic_levels(called_runs(spark, sf_dir))
    return costvar.by_task_shares(runs, ["l0", "l1", "l2", "l3"]).withColumn("share", F.round("share", 6))


@query(f"WITH {_PER_TASK}, bl AS (SELECT 1 AS level, l1 AS b, sum(mu) AS mu, count(DISTINCT task) AS t FROM i GROUP BY l1 UNION ALL SELECT 2, l2, sum(mu), count(DISTINCT task) FROM i GROUP BY l2 UNION ALL SELECT 3, l3, sum(mu), count(DISTINCT task) FROM i GROUP BY l3), fit AS (SELECT level - 1 AS level FROM bl GROUP BY level HAVING count(*) >= 2 AND coalesce(sum(mu) FILTER (t >= 2), 0) >= 0.5) SELECT level, round(median(share), 6) AS median FROM sh JOIN fit USING (level) GROUP BY level HAVING median(share) >= 0.01 AND count(*) FILTER (share > 0) >= 3 ORDER BY median(share) DESC, level LIMIT 1")
def selector_by_share(spark, sf_dir):
    runs = costvar.diagnostic_levels(called_runs(spark, sf_dir))
    return costvar.select_by_share(runs, ["l0", "l1", "l2", "l3"], s_min=0.01).withColumn("median", F.round("median", 6))


_ATTR = "c AS (SELECT user_id AS run, event_id AS pos, user_id * 1000 + event_id % 7 AS message_id, event_type, k, value FROM called), g AS (SELECT *, value / count(*) OVER (PARTITION BY message_id) AS share, lag(event_type = 'error') OVER (PARTITION BY run ORDER BY pos) AS after FROM c), w AS (SELECT run, 1.0 / count(*) OVER () AS mu FROM (SELECT DISTINCT run FROM c)), ev2 AS (SELECT run, 0 AS level, share FROM g WHERE event_type = 'click' UNION ALL SELECT run, 1, share FROM g WHERE event_type = 'view' UNION ALL SELECT run, 2, share FROM g WHERE event_type = 'error' OR coalesce(after, false)), r AS (SELECT level, sum(mu * share) / sum(mu) AS mean FROM ev2 JOIN w USING (run) GROUP BY level)"


@query(f"WITH {_CALLED}, {_ATTR} SELECT arg_max(level, (mean, -level)) AS level, round(max(mean), 6) AS mean FROM r")
def selector_by_cost(spark, sf_dir):
    calls = called(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("message_id"), "tool", "args", F.when(F.col("event_type") == "error", F.lit("error")).alias("error"), F.col("value").alias("cost"))
    ids = calls.select("run").distinct()
    runs = ids.crossJoin(ids.agg(F.count("*").alias("n"))).select("run", (1.0 / F.col("n")).alias("mu"))
    return costvar.select_by_cost(calls, runs, margin=0.0).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_CALLED}, c AS (SELECT event_id, value / count(*) OVER (PARTITION BY user_id, event_id % 7) AS call_cost, count(*) OVER (PARTITION BY user_id, tool, key) > 1 AS repeated FROM called) SELECT event_id, round(call_cost, 6) AS call_cost, repeated FROM c")
def attributed_costs(spark, sf_dir):
    calls = called(spark, sf_dir).select("event_id", F.col("user_id").alias("run"), F.struct("user_id", F.col("event_id") % 7).alias("message_id"), "tool", "args", F.col("value").alias("cost"))
    return costvar.attributed(calls).select("event_id", F.round("call_cost", 6).alias("call_cost"), "repeated")


@query(f"{_COST.replace('l2 FROM ev)', 'l2 FROM (SELECT * REPLACE (CASE WHEN outcome = chr(101) || chr(114) || chr(114) || chr(111) || chr(114) THEN chr(117) || chr(110) || chr(107) || chr(110) || chr(111) || chr(119) || chr(110) ELSE outcome END AS outcome) FROM ev))')} SELECT l1 <> 'unknown' AS known, round(sum(mu), 6) AS mass, round(sum(mu * v * v), 4) AS energy FROM i GROUP BY 1")
def described_level(spark, sf_dir):
    """The full cohort's mass and energy by whether a level is known."""
    runs = _cost_runs(spark, sf_dir).withColumn("l1", F.when(F.col("l1") == "error", "unknown").otherwise(F.col("l1")))
    return costvar.described(runs, "l1").select("known", F.round("mass", 6).alias("mass"), F.round("energy", 4).alias("energy"))


_HALVES = """it AS (SELECT o_orderkey AS item, 'all' AS l0, r_name AS l1, n_name AS l2, n_name || '|' || o_orderpriority AS l3, (o_orderstatus = 'F')::INT::DOUBLE AS v, o_custkey % 2 AS h FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tr AS (SELECT *, avg(v) OVER (PARTITION BY l0) AS v0, avg(v) OVER (PARTITION BY l1) AS v1, avg(v) OVER (PARTITION BY l2) AS v2, avg(v) OVER (PARTITION BY l3) AS v3 FROM it WHERE h = 0),
en AS (SELECT avg((v1 - v0) ** 2) AS e0, avg((v2 - v1) ** 2) AS e1, avg((v3 - v2) ** 2) AS e2, avg((v - v3) ** 2) AS res, avg((v - v0) ** 2) AS va FROM tr),
ms AS (SELECT mask, [j FOR j IN [0, 1, 2] IF (mask >> j::INT) & 1 = 1] AS kept FROM range(8) r(mask)), pr AS (SELECT mask, kept, res + CASE WHEN list_contains(kept, 0) THEN 0 ELSE e0 END + CASE WHEN list_contains(kept, 1) THEN 0 ELSE e1 END + CASE WHEN list_contains(kept, 2) THEN 0 ELSE e2 END AS err, res + (va - res) / 2 AS budget FROM ms, en),
bs AS (SELECT kept, err FROM pr WHERE err <= budget ORDER BY len(kept), err, mask LIMIT 1),
a0 AS (SELECT avg(v) AS p0 FROM tr), a1 AS (SELECT l1, avg(v) AS p1 FROM tr GROUP BY l1), a2 AS (SELECT l2, avg(v) AS p2 FROM tr GROUP BY l2), a3 AS (SELECT l3, avg(v) AS p3 FROM tr GROUP BY l3),
gs AS (SELECT v, p0 + CASE WHEN list_contains(kept, 0) THEN coalesce(p1 - p0, 0) ELSE 0 END + CASE WHEN list_contains(kept, 1) THEN coalesce(p2 - p1, 0) ELSE 0 END + CASE WHEN list_contains(kept, 2) THEN coalesce(p3 - p2, 0) ELSE 0 END AS g, kept, err FROM it CROSS JOIN a0 CROSS JOIN bs LEFT JOIN a1 USING (l1) LEFT JOIN a2 USING (l2) LEFT JOIN a3 USING (l3) WHERE h = 1)"""


@query(f"WITH {_HALVES} SELECT array_to_string(any_value(kept), ',') AS kept, round(any_value(err), 9) AS train_error, round(avg((v - g) ** 2), 9) AS held_error FROM gs")
def pruned_within_budget(spark, sf_dir):
    """The fewest levels within half of what they explain, chosen on one half of the customers and measured on the other."""
    book = moments.Book.of(_items(spark, sf_dir).withColumn("half", F.col("o_custkey") % 2), LEVELS, by=["half"])
    budget = F.col("residual") + (F.col("variance") - F.col("residual")) / 2
    out = costvar.cheapest_description(book.where(F.col("half") == 0), book.where(F.col("half") == 1), budget)
    return out.select(F.array_join("kept", ",").alias("kept"), F.round("train_error", 9).alias("train_error"), F.round("held_error", 9).alias("held_error"))


@query("WITH c AS (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1) SELECT (SELECT count(*) FROM c) = 5 AS nests, (SELECT count(DISTINCT n_regionkey) FROM nation) AS regions")
def nesting_checked(spark, sf_dir):
    """A tower of nations in regions passes; nations by length of name do not."""
    n = views.table(spark, sf_dir, "nation").withColumn("root", F.lit(0)).withColumn("len", F.length("n_name"))
    multires.check_nesting(n, ["root", "n_regionkey", "n_nationkey"])
    try:
        multires.check_nesting(n, ["root", "n_regionkey", "len"])
        nests = False
    except multires.NestingError:
        nests = True
    return n.agg(F.lit(nests).alias("nests"), F.count_distinct("n_regionkey").alias("regions"))


@query(f"WITH {ORD}, pth AS (SELECT ordinal, agent, outcome = 'stop' AS ok, [(ordinal % 3, 0), (ordinal % 3 + len(tools) % 2, 1), (2, 2)] AS p FROM ord), k AS (SELECT agent, ok, [true::VARCHAR, '2', ((ordinal % 3)::VARCHAR || '/' || (len(tools) % 2)), ((ordinal % 3)::VARCHAR || '/' || (len(tools) % 2)), ((ordinal % 3)::VARCHAR || '/' || (len(tools) % 2))] AS parts, ordinal % 3 AS r, len(tools) % 2 AS t FROM ord JOIN pth USING (agent, ordinal)), c AS (SELECT agent, level, CASE WHEN level <= 2 THEN '' WHEN level = 3 THEN list_sort([(t, 1), (2 - r - t, 1)])::VARCHAR WHEN level = 4 THEN [(t, 1), (2 - r - t, 1)]::VARCHAR ELSE [(r, 0), (r + t, 1), (2, 2)]::VARCHAR END AS key, bool_or(ok) AS live FROM k, range(1, 6) l(level) GROUP BY ALL) SELECT agent, level::INT AS level, count(*) AS n, count(*) FILTER (live) AS l FROM c GROUP BY ALL")
def ledger_path_tower(spark, sf_dir):
    """Paths on a grid, made from orders, by goal, steps, moves in any order, moves, and path."""
    runs = views.order_runs(spark, sf_dir)
    cell = lambda r, c: F.struct(r.cast("long").alias("r"), F.lit(c).cast("long").alias("c"))
    r, t = F.col("ordinal") % 3, F.size("steps") % 2
    paths = runs.withColumn("path", F.array(cell(r, 0), cell(r + t, 1), cell(F.lit(2), 2))).withColumn("goal", cell(F.lit(2), 2))
    return ledger.ledger(paths, tower.build_tower("path"), ok())


@query(f"WITH {EV}, pr AS (SELECT agent, outcome = 'stop' AS ok, tools FROM ev), c AS (SELECT agent, level::INT AS level, [tools[i] FOR i IN range(1, level + 1)]::VARCHAR AS key, bool_or(ok) AS live FROM pr, range(1, 4) l(level) GROUP BY ALL) SELECT agent, level, count(*) AS n, count(*) FILTER (live) AS l FROM c GROUP BY ALL")
def ledger_prefix_tower(spark, sf_dir):
    """The registry's tower of prefixes, three labels deep; histories that end before count as their own class."""
    return ledger.ledger(views.event_runs(spark, sf_dir), tower.build_tower("prefix", S.tool_sequence(F.col("steps")), 3), ok())
