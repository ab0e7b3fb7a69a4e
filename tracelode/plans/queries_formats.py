"""Registered queries of the trace formats: conversations written in each format and read back by its loader.

An assistant's turn calls a tool or speaks, by its number; some calls fail.  What a format's
loader must make of that is said in SQL over the conversations themselves.
"""

from __future__ import annotations

import json
import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import loaders, objects, sinks, stores
from ..tables import held, scratch
from . import views
from .queries import EV
from .registry import query

_WORDS = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
#: Turns with their place, their run (turns before the first question are run 0), and what they are.
_TURNS = f"""m AS (SELECT conv_id, turn, role, {_WORDS} AS words, row_number() OVER w AS rn, sum((role = 'user')::INT) OVER w AS run, role = 'assistant' AND (turn // 2) % 2 = 0 AS call, role = 'assistant' AND (turn // 2) % 2 = 1 AS said, turn % 3 = 1 AS bad FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))"""


def _by_run(outcome: str, keep: str, cap: int) -> str:
    return f"""WITH {_TURNS}, r AS (SELECT conv_id, run, count(*) FILTER (call) AS steps, count(*) FILTER (call AND bad) AS errors, {outcome} AS outcome, coalesce(max(left(words, {cap})) FILTER (role = 'user'), '') AS prompt FROM m GROUP BY conv_id, run HAVING {keep})
SELECT outcome, steps, errors, count(*) AS runs, sum(len(prompt))::BIGINT AS prompt_chars FROM r GROUP BY ALL"""


def _by_conversation(outcome: str) -> str:
    return f"""WITH {_TURNS}, r AS (SELECT conv_id, count(*) FILTER (call) AS steps, count(*) FILTER (call AND bad) AS errors, {outcome} AS outcome FROM m GROUP BY conv_id HAVING count(*) FILTER (call) > 0)
SELECT outcome, steps, errors, count(*) AS runs FROM r GROUP BY ALL"""


def _shown(runs: DataFrame, *more: str) -> DataFrame:
    each = runs.select("outcome", F.size("steps").cast("long").alias("steps"), F.size(F.filter("steps", lambda s: s["error"].isNotNull())).cast("long").alias("errors"), F.length("prompt").cast("long").alias("prompt_chars"))
    return each.groupBy("outcome", "steps", "errors").agg(F.count("*").alias("runs"), *(F.sum(c).alias(c) for c in more))


def _turns(spark, sf_dir) -> DataFrame:
    """conv_id, turns: in order, each with its text and what it is."""
    half = F.floor(F.col("turn") / 2) % 2
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role", ((F.col("role") == "assistant") & (half == 0)).alias("call"), ((F.col("role") == "assistant") & (half == 1)).alias("said"), (F.col("turn") % 3 == 1).alias("bad"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role", "call", "said", "bad"))).alias("turns"))


def _j(**fields) -> Column:
    """One JSON object; absent fields are left out."""
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str | bool | int) else v).alias(k) for k, v in fields.items())))


def _o(**fields) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, str | bool | int) else v).alias(k) for k, v in fields.items()))


def _id(t: Column) -> Column:
    return F.concat(F.lit("c"), t["turn"].cast("string"))


def _files(turns: DataFrame, line, first: Column | None = None, suffix: str = "jsonl") -> DataFrame:
    """A file for each conversation: ``line`` of every turn (an array of lines, null for none), after ``first``."""
    lines = F.flatten(F.transform("turns", lambda t: F.coalesce(line(t), F.array().cast("array<string>"))))
    lines = lines if first is None else F.concat(F.array(first), lines)
    return turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(f".{suffix}")).alias("path"), F.array_join(lines, "\n").alias("value"))


_LAST = "coalesce(arg_max(CASE WHEN call THEN 'toolUse' ELSE 'stop' END, rn) FILTER (call OR said), '{0}')"


def pi_files(turns: DataFrame) -> DataFrame:
    def line(t):
        message = lambda **f: _j(type="message", message=_o(**f))
        text = F.array(_o(type="text", text=t["text"]))
        asked = message(role="assistant", stopReason="toolUse", content=F.array(_o(type="toolCall", id=_id(t), name="look", arguments=_o(turn=t["turn"]))))
        got = message(role="toolResult", toolCallId=_id(t), isError=t["bad"], content=F.array(_o(type="text", text="as it is")))
        return F.when(t["role"] == "user", F.array(message(role="user", content=text))).when(t["call"], F.array(asked, got)).when(t["said"], F.array(message(role="assistant", stopReason="stop", content=text)))
    return _files(turns, line, _j(type="session", cwd="/work/talks"))


def claude_files(turns: DataFrame) -> DataFrame:
    def line(t):
        record = lambda kind, content: _j(type=kind, parentUuid="p", sessionId="s", cwd="/work", message=_o(content=content))
        asked = record("assistant", F.array(_o(type="tool_use", id=_id(t), name="Look", input=_o(turn=t["turn"]))))
        got = record("user", F.array(_o(type="tool_result", tool_use_id=_id(t), is_error=t["bad"], content="as it is")))
        aside = _j(type="assistant", parentUuid="p", isSidechain=True, message=_o(content=F.array(_o(type="tool_use", id="x", name="Aside", input=_o(turn=0)))))
        return F.when(t["role"] == "user", F.array(record("user", F.array(_o(type="text", text=t["text"]))))).when(t["call"], F.array(aside, asked, got)).when(t["said"], F.array(record("assistant", F.array(_o(type="text", text=t["text"])))))
    return _files(turns, line)


def codex_files(turns: DataFrame) -> DataFrame:
    """Errors are read off the outputs; arguments sit in a snippet."""

    def line(t):
        item = lambda **f: _j(type="response_item", payload=_o(**f))
        said = lambda role: item(type="message", role=role, content=F.array(_o(type="input_text", text=t["text"])))
        asked = item(type="custom_tool_call", name="exec", call_id=_id(t), input=F.concat(F.lit("run("), _j(turn=t["turn"]), F.lit(")")))
        got = item(type="custom_tool_call_output", call_id=_id(t), output=F.when(t["bad"], "it failed badly").otherwise("completed, no error"))
        return F.when(t["role"] == "user", F.array(said("user"))).when(t["call"], F.array(asked, got)).when(t["said"], F.array(said("assistant")))
    return _files(turns, line, _j(type="session_meta", payload=_o(id="s", cwd="/work")))


def langsmith_files(turns: DataFrame) -> DataFrame:
    """Exports of single runs, latest first; what is spoken is no kept kind."""

    def line(t):
        kind = F.when(t["call"], "tool").when(t["said"], "llm")
        return F.when(kind.isNotNull(), F.array(_j(id=_id(t), trace_id="t", name="look", run_type=kind, inputs=_o(turn=t["turn"]), error=F.when(t["call"] & t["bad"], "refused"), start_time=F.lpad(t["turn"].cast("string"), 9, "0"))))

    turns = turns.withColumn("turns", F.reverse("turns"))
    return _files(turns, line)


def otel_files(turns: DataFrame) -> DataFrame:
    """One document for each conversation; a span for each call, and one with its reason to finish for what is spoken."""

    def span(t):
        text = lambda key, value: _o(key=key, value=_o(stringValue=value))
        facts = F.when(t["call"], F.array(text("gen_ai.operation.name", F.lit("execute_tool")), text("gen_ai.tool.name", F.lit("look")), text("gen_ai.tool.call.arguments", _j(turn=t["turn"])))).otherwise(F.array(text("gen_ai.response.finish_reason", F.lit("stop"))))
        return _o(traceId="t", startTimeUnixNano=(t["turn"] * 1000).cast("string"), attributes=facts, status=_o(code=F.when(t["call"] & t["bad"], 2).otherwise(0)))

    def document(turns):
        spans = F.transform(F.filter(turns, lambda t: t["call"] | t["said"]), span)
        return _j(resourceSpans=F.array(_o(resource=_o(attributes=F.array(_o(key="service.name", value=_o(stringValue="talks")))), scopeSpans=F.array(_o(spans=spans)))))

    return turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), document(F.reverse("turns")).alias("value"))


def autogen_files(turns: DataFrame) -> DataFrame:
    """Turns that 4 divides call functions without ids, answered by name; the others have tool calls or typed requests with ids."""

    def line(t):
        args, bad = _j(turn=t["turn"]), t["bad"]
        text = F.when(bad, "Error: refused").otherwise("fine")
        old = F.array(_j(role="assistant", function_call=_o(name="look", arguments=args)), _j(role="function", name="look", content=text))
        new = F.array(_j(role="assistant", tool_calls=F.array(_o(id=_id(t), function=_o(name="look", arguments=args)))), _j(role="tool", tool_call_id=_id(t), content=text))
        typed = F.array(_j(type="ToolCallRequestEvent", content=F.array(_o(id=_id(t), name="look", arguments=args))), _j(type="ToolCallExecutionEvent", content=F.array(_o(call_id=_id(t), content=text, is_error=bad))))
        spoken = F.array(_j(role="assistant", content=t["text"], stop_reason="completed"))
        return F.when(t["call"], F.when(t["turn"] % 3 == 0, old).when(t["turn"] % 3 == 1, new).otherwise(typed)).when(t["said"], spoken).otherwise(F.array(_j(role="user", content=t["text"])))

    lists = _files(turns, line).withColumn("value", F.concat(F.lit('{"model": "loam", "stop_reason": null, "messages": ['), F.replace("value", F.lit("\n"), F.lit(", ")), F.lit("]}")))
    return lists


def crewai_files(turns: DataFrame) -> DataFrame:
    """A task for each call, under the names that crews use for it; a task that failed makes the outcome, a call's error alone does not."""

    def task(t):
        args = _o(turn=t["turn"])
        error = F.when(t["bad"], "refused")
        return F.when(t["turn"] % 3 == 0, _j(tools_used=F.array(_o(tool="look", tool_input=args, error=error)))).otherwise(_j(actions=F.array(_o(action="look", args=args, error=error)), status=F.when(t["bad"] & (t["turn"] % 2 == 1), "failed").otherwise("done")))

    calls = lambda turns: F.array_join(F.transform(F.filter(turns, lambda t: t["call"]), task), ", ")
    value = F.concat(F.lit('{"crew": "threshers", "outcome": "partial", "tasks_output": ['), calls("turns"), F.lit("]}"))
    return turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), value.alias("value"))


def _stores(turns: DataFrame, make) -> DataFrame:
    """path, content: a SQLite store for each conversation, made in its task by ``make`` (a connection, and the turns)."""

    def work(batches):
        for batch in batches:
            contents = []
            for rows in batch.column("turns").to_pylist():
                con = sqlite3.connect(":memory:")
                make(con, rows)
                con.commit()
                contents.append(con.serialize())
                con.close()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary())], names=["path", "content"])

    return turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".db")).alias("path"), "turns").mapInArrow(work, "path string, content binary")


def _opencode(con: sqlite3.Connection, turns: list[dict]) -> None:
    con.executescript("create table session(id text primary key, model text); create table message(id text primary key, data text); create table part(id text primary key, message_id text, session_id text, time_created integer, data text)")
    con.execute("insert into session values ('talk', 'loam')")
    for place, t in enumerate(turns):
        if t["role"] == "system":
            continue
        con.execute("insert into message values (?, ?)", (f"m{place}", json.dumps({"role": t["role"]})))
        part = {"type": "text", "text": t["text"]}
        if t["call"]:
            part = {"type": "tool", "tool": "look", "state": {"input": {"turn": t["turn"]}, "output": "refused", "status": "error" if t["bad"] else "completed"}}
        con.execute("insert into part values (?, ?, 'talk', ?, ?)", (f"p{place:06d}", f"m{place}", place, json.dumps(part)))


@query(_by_run("'unknown'", "run > 0 OR count(*) FILTER (call) > 0", 500))
def load_opencode_conversations(spark, sf_dir):
    return _shown(stores.load_opencode(_stores(_turns(spark, sf_dir), _opencode)), "prompt_chars")


def _antigravity(con: sqlite3.Connection, turns: list[dict]) -> None:
    def field(number: int, data: bytes) -> bytes:
        size, length = b"", len(data)
        while length > 127:
            size, length = size + bytes([length & 127 | 128]), length >> 7
        return bytes([number << 3 | 2]) + size + bytes([length]) + data

    con.execute("create table steps(idx integer, step_type integer, step_payload blob)")
    for place, t in enumerate(turns):
        if t["call"]:
            call = field(1, b"call_%d" % t["turn"]) + field(2, b"look") + field(3, json.dumps({"turn": t["turn"], "pad": "x" * 150}).encode())
            con.execute("insert into steps values (?, 1, ?)", (place, field(4, field(1, call))))


@query(_by_conversation("'unknown'").replace("count(*) FILTER (call AND bad) AS errors", "0::BIGINT AS errors"))
def load_antigravity_conversations(spark, sf_dir):
    """Payloads say no errors."""
    return _shown(stores.load_antigravity(_stores(_turns(spark, sf_dir), _antigravity)))


@query(f"WITH {EV} SELECT outcome, len(tools) AS steps, len([e FOR e IN errs IF e]) AS errors, count(*) AS runs FROM ev GROUP BY ALL")
def load_arrays_in_splits(spark, sf_dir):
    """Event runs in files that are one array each, cut into their elements by the splitter."""
    runs = views.event_runs(spark, sf_dir).select(F.col("agent").alias("model"), F.lit("p").alias("project"), F.col("task").alias("prompt"), "outcome", "steps")
    folder = scratch(spark, "arrays")

    def arrays(batches):
        first = True
        for batch in batches:
            for value in batch.column("value").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + value])], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    sinks.canonical_json(runs).select("value").mapInArrow(arrays, "value string").write.text(folder)
    objects.rename_parts(spark, folder, ".json")
    found = objects.array_objects(spark, [folder])
    return _shown(loaders.load_canonical(found))


@query(_by_run(_LAST.format("noToolUse"), "run > 0", 120))
def load_pi_conversations(spark, sf_dir):
    return _shown(loaders.load_pi(pi_files(_turns(spark, sf_dir))), "prompt_chars")


@query(_by_run(_LAST.format("toolUse"), "run > 0 OR count(*) FILTER (call OR said) > 0", 500))
def load_claude_conversations(spark, sf_dir):
    return _shown(loaders.load_claude(claude_files(_turns(spark, sf_dir))), "prompt_chars")


@query(_by_run("'unknown'", "run > 0 OR count(*) FILTER (call OR said) > 0", 500))
def load_codex_conversations(spark, sf_dir):
    return _shown(loaders.load_codex(codex_files(_turns(spark, sf_dir))), "prompt_chars")


@query(_by_conversation("CASE WHEN bool_or(call AND bad) THEN 'error' ELSE 'stop' END"))
def load_langsmith_conversations(spark, sf_dir):
    return _shown(loaders.load_langsmith(langsmith_files(_turns(spark, sf_dir))))


@query(_by_conversation("CASE WHEN bool_or(call AND bad) THEN 'error' WHEN bool_or(said) THEN 'stop' ELSE 'noToolUse' END"))
def load_otel_conversations(spark, sf_dir):
    return _shown(loaders.load_otel(otel_files(_turns(spark, sf_dir))))


@query(_by_conversation("CASE WHEN bool_or(call AND bad) THEN 'error' WHEN bool_or(said) THEN 'stop' ELSE 'noToolUse' END"))
def load_autogen_conversations(spark, sf_dir):
    return _shown(loaders.load_autogen(autogen_files(_turns(spark, sf_dir))))


@query(_by_conversation("CASE WHEN bool_or(call AND bad AND turn % 2 = 1) THEN 'error' ELSE 'partial' END"))
def load_crewai_conversations(spark, sf_dir):
    return _shown(loaders.load_crewai(crewai_files(_turns(spark, sf_dir))))


_EVERY = ("pi", "claude", "codex", "langsmith", "otel", "autogen", "crewai")


@query(
    f"""WITH {_TURNS}, r AS (SELECT conv_id, run, count(*) FILTER (call) AS calls, count(*) FILTER (call OR said) AS told FROM m GROUP BY conv_id, run), c AS (SELECT conv_id FROM r GROUP BY conv_id HAVING sum(calls) > 0), n AS (SELECT (SELECT count(*) FROM c) AS talks, (SELECT sum(calls) FROM r)::BIGINT AS calls, (SELECT sum(calls) FROM r WHERE run > 0)::BIGINT AS asked_calls, (SELECT count(*) FROM r WHERE run > 0) AS asked, (SELECT count(*) FROM r WHERE run > 0 OR told > 0) AS told)
SELECT project, runs, steps FROM n, LATERAL (VALUES ('autogen', talks, calls), ('langsmith', talks, calls), ('threshers', talks, calls), ('talks', asked + talks, asked_calls + calls), ('/work', 2 * told, 2 * calls)) t(project, runs, steps)"""
)
def load_every_format(spark, sf_dir):
    """Files of seven formats in one folder: each is told by its contents and read by its own loader."""
    from ..sources import detect

    # read and gathered once for all formats
    turns = held(_turns(spark, sf_dir), "turns")
    files = None
    for name in _EVERY:
        own = globals()[f"{name}_files"](turns).withColumn("path", F.concat(F.lit(f"{name}/"), "path"))
        files = own if files is None else files.unionByName(own)
    files = held(files, "formats")
    runs = detect.load_found(files.join(detect.detect(files), "path"))
    return runs.groupBy("project").agg(F.count("*").alias("runs"), F.sum(F.size("steps")).cast("long").alias("steps"))
