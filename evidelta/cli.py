"""Command line: ``python -m evidelta.cli gate BASELINE CANDIDATE``, and the like.

Exit codes of ``gate``: 0 pass or review, 1 block, 2 bad input.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidelta.operators import gate
from evidelta.sources import jsonl


def render(summary: dict, cases: DataFrame, out) -> None:
    """The summary, then each case that changed with its findings, case by case as they arrive from Spark."""
    labels = {"regressions": "REGRESSIONS", "improvements": "IMPROVEMENTS", "unchanged": "UNCHANGED", "unknown": "UNKNOWN", "world_change": "WORLD_CHANGE"}
    print(f"Cases evaluated: {summary['cases_evaluated']}\n", *[f"{v:<16} {summary[k]}" for k, v in labels.items()], f"\nRESULT: {summary['decision']}", sep="\n", file=out)
    for case in cases.where(F.col("classification") != "UNCHANGED").orderBy("case_id").toLocalIterator():
        print(f"\n{case.classification} {case.case_id}", *[f"- {c.kind}: {c.before} -> {c.after}" for c in case.changes], sep="\n", file=out)


def gate_command(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> int:
    try:
        runs = [gate.check_keys(jsonl.read_run(spark, p), "case_id") for p in (args.baseline, args.candidate)]
        cases = gate.run_diff(*runs)
        summary = gate.run_summary(cases).first().asDict()
    except Exception as e:  # what can't be read: missing files, lines that are no objects, keys that repeat
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    if args.json:
        jsonl.write(cases, args.json, "overwrite")
        print(jsonl.write_report(summary, None), file=out)
    else:
        render(summary, cases, out)
    return 1 if summary["decision"] == "BLOCK" else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evidelta")
    commands = top.add_subparsers(dest="command", required=True)
    g = commands.add_parser("gate", help="compare two runs")
    g.add_argument("baseline")
    g.add_argument("candidate")
    g.add_argument("--json", metavar="FOLDER", help="write the cases there as JSON lines, and print the summary as JSON")
    g.set_defaults(run=gate_command)
    q = commands.add_parser("query", help="run a named query over a folder of Parquet tables and write its rows")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("out")
    q.set_defaults(run=query_command)
    return top


def query_command(spark: SparkSession, args: argparse.Namespace) -> int:
    from evidelta.plans import catalog

    if args.name not in catalog.QUERIES:
        print(f"error: no query {args.name}; there are {', '.join(catalog.QUERIES)}", file=sys.stderr)
        return 2
    catalog.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("evidelta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
