"""Sinks: canonical JSON lines, Parquet, and a self-contained HTML report of a small profile."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(runs: DataFrame, *more: Column) -> DataFrame:
    """value: the canonical form of each run, absent optional fields left out; after ``more`` columns of the runs."""
    steps = F.concat(F.lit("["), F.array_join(F.transform("steps", lambda s: F.concat(F.lit('{"tool":'), F.to_json(F.array(s["tool"])).substr(F.lit(2), F.length(F.to_json(F.array(s["tool"]))) - 2), F.lit(',"args":'), F.coalesce(s["args"], F.lit("{}")), F.lit(',"error":'), F.when(s["error"].isNull(), "null").otherwise(F.to_json(F.array(s["error"])).substr(F.lit(2), F.length(F.to_json(F.array(s["error"]))) - 2)), F.lit("}"))), ","), F.lit("]"))
    fields = [c for c in ("model", "project", "prompt", "outcome", "verified_outcome", "evaluator", "cost", "tokens_input", "tokens_output") if c in runs.columns]
    head = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    return runs.select(*more, F.concat(head.substr(F.lit(1), F.length(head) - 1), F.when(F.length(head) > 2, ",").otherwise(""), F.lit('"steps":'), steps, F.lit("}")).alias("value"))


def write_canonical(runs: DataFrame, path: str) -> None:
    canonical_json(runs).write.text(path)


def write_parquet(runs: DataFrame, path: str, *by: str) -> None:
    runs.write.partitionBy(*by).parquet(path)


def bar_scale(n: int) -> float:
    return math.log2(1 + n)


def _bars(rows: list[dict], width: int = 640, height: int = 160) -> str:
    top = max((bar_scale(r["n"]) for r in rows), default=1) or 1
    step = width / max(1, len(rows))
    out = []
    for i, r in enumerate(rows):
        for name, x, color in (("n", 0.1, "#b8c4d6"), ("l", 0.5, "#3a6ea5")):
            h = bar_scale(r[name]) / top * (height - 20)
            out.append(f'<rect x="{(i + x) * step:.1f}" y="{height - h:.1f}" width="{0.4 * step:.1f}" height="{h:.1f}" fill="{color}"><title>{name}={r[name]}</title></rect>')
    return f'<svg width="{width}" height="{height}">{"".join(out)}</svg>'


def _line(values: list[float | None], width: int = 640, height: int = 90, mark: float | None = None) -> str:
    top = max([v for v in values if v is not None] + [mark or 0, 1e-9])
    step = width / max(1, len(values))
    points = " ".join(f"{(i + 0.5) * step:.1f},{height - v / top * (height - 10):.1f}" for i, v in enumerate(values) if v is not None)
    rule = "" if mark is None else f'<line x1="0" x2="{width}" y1="{height - mark / top * (height - 10):.1f}" y2="{height - mark / top * (height - 10):.1f}" stroke="#c33" stroke-dasharray="4"/>'
    return f'<svg width="{width}" height="{height}">{rule}<polyline points="{points}" fill="none" stroke="#3a6ea5"/></svg>'


def bar_heights(n: Column) -> Column:
    """The same scale as a column."""
    return F.log2(1 + n.cast("double"))


def write_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines: corpora, splits and baselines."""
    df.write.json(path)


def _table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(f'<td>{html.escape(cell(r.get(c)))}</td>' for c in columns) + '</tr>' for r in rows)}</table>"


def report_text(book: DataFrame, exponents: DataFrame, tails: DataFrame, inflation: DataFrame | None = None) -> str:
    """The profile of each agent as text: its levels, exponents with where they are attained, tails with what they claim, inflation.

    Ledgers and what follows from them have a row for each agent and level, so they fit a driver.
    """
    top = {r["agent"]: r for r in exponents.collect()}
    said: dict = {}
    for r in tails.orderBy("agent", "kind").collect():
        said.setdefault(r["agent"], []).append(r)
    out: list[str] = []
    agent = None
    for r in book.orderBy("agent", "level").collect():
        if r["agent"] != agent:
            agent = r["agent"]
            e = top[agent]
            at = lambda c: f"{e[c]:.6f} at level {e[f'{c}_at']} of {e['horizon']}{', shallow: not a rate' if e[f'{c}_shallow'] else ''}"  # noqa: B023, E731
            out += ["", str(agent), f"  D {at('d')}", f"  S {at('s')}", f"  difference {e['delta']:.6f}"]
            out += [f"  tail of {t['kind'].upper()}: {'-' if t['value'] is None else format(t['value'], '.6f')} {t['status']} ({t['label']})" for t in said.get(agent, [])]
        share = r["l"] / r["n"] if r["n"] else 0.0
        out.append(f"  level {r['level']:>3}  explored {r['n']:>9}  live {r['l']:>9}  yield {100 * share:6.2f} %")
    if inflation is not None:
        out += ["", "inflation against the reference"]
        out += [f"  {r['agent']} level {r['level']}: {'-' if r['inflation'] is None else format(r['inflation'], '.2f')}" for r in inflation.orderBy("agent", "level").collect()]
    return "\n".join(out).strip() + "\n"


def compare_text(found: DataFrame) -> str:
    """A comparison of agents (of ``analytics.compare``) as text: a row for each, then whether they kept the same."""
    rows = found.orderBy("agent").collect()
    if not rows:
        return "no agents\n"
    wide = max(len("agent"), *(len(str(r["agent"])) for r in rows))
    out = [f"{'agent':<{wide}}  {'D':>10}  {'S':>10}  {'S - D':>10}  {'waste':>7}  stops at"]
    out += [f"{r['agent']!s:<{wide}}  {r['d']:>10.6f}  {r['s']:>10.6f}  {r['delta']:>10.6f}  {100 * r['waste']:>6.1f}%  {'never' if r['stop_level'] is None else r['stop_level']}" for r in rows]
    low, high = min(r["d"] for r in rows), max(r["d"] for r in rows)
    same = f"every agent kept the same, D = {high:.6f}: S differs by method and not by task"
    out += ["", same if all(r["same_d"] for r in rows) else f"agents kept different things, D from {low:.6f} to {high:.6f}: they may not have solved the same task"]
    return "\n".join(out) + "\n"


def capability_text(table: DataFrame) -> str:
    """What each format can tell (of ``warrants.capability_table``): formats down, semantics across."""
    cells = {(r["format"], r["semantic"]): r["state"] for r in table.collect()}
    formats, semantics = sorted({f for f, _ in cells}), sorted({s for _, s in cells})
    wide = [max(len(s), *(len(cells[f, s]) for f in formats)) for s in semantics]
    first = max(map(len, ["format", *formats]))
    line = lambda name, values: "  ".join([name.ljust(first), *(v.ljust(w) for v, w in zip(values, wide, strict=True))]).rstrip()
    return "\n".join([line("format", semantics), *(line(f, [cells[f, s] for s in semantics]) for f in formats)]) + "\n"


def report_html(book: DataFrame, exponents: DataFrame, title: str = "profile", tails: DataFrame | None = None, inflation: DataFrame | None = None, warrants: DataFrame | None = None) -> str:
    """A page with a section for each agent (classes, yields, ratios by level), and tables of tails, inflation and warrants.

    All of them have a row for each agent and level, or for each format, and no more.
    """
    rows = [r.asDict() for r in book.orderBy("agent", "level").collect()]
    summary = {r["agent"]: r.asDict() for r in exponents.collect()}
    panels = {name: [r.asDict() for r in df.orderBy(*df.columns[:2]).collect()] for name, df in (("tails", tails), ("inflation", inflation), ("warrants", warrants)) if df is not None}
    sections = []
    for agent in sorted({r["agent"] for r in rows}):
        own = [r for r in rows if r["agent"] == agent]
        e = summary.get(agent, {})
        yields = [r["l"] / r["n"] if r["n"] else 0 for r in own]
        ratios = [math.log2(r[c]) / r["level"] if r[c] > 0 and r["level"] else None for c in ("n", "l") for r in own]
        lines = _line(ratios[: len(own)]) + _line(ratios[len(own) :])
        sections.append(f"<h2>{html.escape(str(agent))}</h2><p>S={e.get('s', 0):.4f} D={e.get('d', 0):.4f} &Delta;={e.get('delta', 0):.4f}</p>{_bars(own)}{_line(yields, mark=0.1)}{lines}")
    for name, found in panels.items():
        columns = [c for c in (found[0] if found else {}) if c != "tail"]
        sections.append(f"<h2>{name}</h2>{_table(found, columns)}")
    data = html.escape(json.dumps({"book": rows, "exponents": summary, **panels}, default=str), quote=False)
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{"".join(sections)}<script type="application/json">{data}</script>'
