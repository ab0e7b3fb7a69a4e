"""Profiles a folder of traces: ``python -m tracelode.profile FOLDER [--group model] [--format otel] [--html FILE] [--json FOLDER]``.

Prints what was read, every group's two ledgers with exponents and tails, and a comparison.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import steps as S
from .operators import analytics, ledger, tower
from .shipping import ship
from .sources import detect, sinks
from .tables import held


def profile(runs: DataFrame, group: str = "model", least: int = 1, max_levels: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ledger of ``runs`` by model, project, file or none (groups of at least ``least`` runs), its exponents and its tails."""
    grouped = ledger.groups_of(runs, group)
    if least > 1:
        grouped = ledger.large_groups(grouped, least)
    book = ledger.ledger(grouped, tower.build_tower("tool"), S.succeeded(F.col("outcome")))
    if max_levels:
        book = book.filter(F.col("level") <= max_levels)
    book = held(book, "ledger")
    return book, analytics.exponents(book), analytics.tails(book)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="tracelode.profile", description="ledgers of a folder of traces")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--group", choices=["model", "project", "file", "none"], default="model")
    parser.add_argument("--format", choices=sorted(detect.LOADERS))
    parser.add_argument("--least", type=int, default=1, help="leave out groups of fewer runs")
    parser.add_argument("--levels", type=int, help="look at so many levels only")
    parser.add_argument("--html")
    parser.add_argument("--json", help="a new folder for the ledger as JSON lines")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tracelode.profile").getOrCreate()
    ship(spark)
    # what is reported starts from the runs several times, and loading them is the dear part
    runs = held(detect.load(spark, given.paths, given.format), "runs")
    book, exponents, tails = profile(runs, given.group, given.least, given.levels)
    if not book.take(1):
        return "no runs\n"
    total = ledger.summary(ledger.groups_of(runs, given.group), "agent").filter("agent IS NULL").first()
    head = f"{total['runs']} runs, {total['calls']} calls, {total['errors']} errors, {total['successes']} successes\n\n"
    if given.html:
        Path(given.html).write_text(sinks.report_html(book, exponents, " ".join(given.paths), tails))
    if given.json:
        sinks.write_json(book, given.json)
    return head + sinks.report_text(book, exponents, tails) + "\n" + sinks.compare_text(analytics.compare(book))


if __name__ == "__main__":
    print(main())
