"""What an input format supports, and which analyses that warrants.

Fixed values: states by rank, semantics, the matrix of formats, and requirements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = {"unavailable": 0, "unknown": 1, "inferred": 2, "supported": 3}
SEMANTICS = ("steps", "run_boundaries", "task_identity", "tool_errors", "terminal_outcome", "cost", "tokens", "verified_outcome")
_S, _I, _U, _N = "supported", "inferred", "unknown", "unavailable"
# in the order of SEMANTICS
CAPABILITIES = {
    "canonical": (_S, _S, _S, _S, _S, _S, _S, _S),
    "pi": (_S, _S, _S, _S, _S, _S, _S, _N),
    "openai": (_S, _S, _S, _N, _S, _N, _N, _N),
    "langsmith": (_S, _S, _S, _S, _S, _N, _N, _N),
    "otel": (_S, _S, _N, _S, _S, _N, _N, _N),
    "autogen": (_S, _S, _N, _S, _S, _N, _N, _N),
    "crewai": (_S, _S, _N, _S, _S, _N, _N, _N),
    "claude": (_S, _S, _S, _S, _I, _N, _N, _N),
    "codex": (_S, _S, _S, _I, _U, _N, _N, _N),
    "opencode": (_S, _S, _S, _S, _U, _S, _S, _N),
    "antigravity": (_I, _N, _N, _N, _N, _N, _N, _N),
}
REQUIREMENTS = {
    "steps_only": {"steps": _I},
    "run_profile": {"steps": _S, "run_boundaries": _S},
    "agent_comparison": {"steps": _S, "run_boundaries": _S, "task_identity": _S},
    "o4b_cost": {"steps": _S, "run_boundaries": _S, "task_identity": _S, "verified_outcome": _S, "cost": _S},
    "o4b_behavioral": {"steps": _S, "run_boundaries": _S, "task_identity": _S, "verified_outcome": _S, "tool_errors": _S},
}


class CapabilityError(ValueError):
    """The input does not warrant the analysis."""


def capability_table(spark: SparkSession) -> DataFrame:
    """format, semantic, state, rank."""
    return spark.createDataFrame([(f, s, state, STATES[state]) for f, row in CAPABILITIES.items() for s, state in zip(SEMANTICS, row, strict=True)], "format string, semantic string, state string, rank int")


def reconciled(formats: DataFrame) -> DataFrame:
    """semantic, state: the weakest state over ``formats`` (format); unknown formats and no formats have nothing."""
    spark = formats.sparkSession
    wanted = formats.select("format").distinct().crossJoin(spark.createDataFrame([(s,) for s in SEMANTICS], "semantic string"))
    states = wanted.join(capability_table(spark), ["format", "semantic"], "left").select("semantic", F.coalesce("rank", F.lit(0)).alias("rank"))
    names = spark.createDataFrame(list(STATES.items()), "state string, rank int")
    least = spark.createDataFrame([(s,) for s in SEMANTICS], "semantic string").join(states.groupBy("semantic").agg(F.min("rank").alias("rank")), "semantic", "left")
    return least.select("semantic", F.coalesce("rank", F.lit(0)).alias("rank")).join(names, "rank").select("semantic", "state")


def require(formats, analysis: str) -> dict[str, str]:
    """The reconciled states; CapabilityError unless they warrant ``analysis``.  A check before any plan is built."""
    if analysis not in REQUIREMENTS:
        raise KeyError(f"unknown analysis {analysis!r}; known: {sorted(REQUIREMENTS)}")
    formats = [formats] if isinstance(formats, str) else list(formats)
    rows = [CAPABILITIES.get(f, (_N,) * len(SEMANTICS)) for f in formats] or [(_N,) * len(SEMANTICS)]
    have = {s: min((row[i] for row in rows), key=STATES.get) for i, s in enumerate(SEMANTICS)}
    short = {s: need for s, need in REQUIREMENTS[analysis].items() if STATES[have[s]] < STATES[need]}
    if short:
        lines = [f"Analysis refused: {analysis}.", "", *(f"  {s}: needs {need}, input has {have[s]}" for s, need in REQUIREMENTS[analysis].items()), "", "What was captured cannot carry this analysis; load a format that records what is missing."]
        raise CapabilityError("\n".join(lines))
    return have
