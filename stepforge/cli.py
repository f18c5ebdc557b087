"""Command line: ``check`` files of traces, ``demo`` and ``scorecard``.

Exit codes: 0 nothing provable, 1 a demo case off its expectation, 2 a hard
defect, 3 unusable input.
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from stepforge import __version__, agents, reliability, report, validation
from stepforge.operators import faults, lint
from stepforge.operators.rules import RULES, selected
from stepforge.registry import Registry
from stepforge.sources import loader, model


def listed(text: str) -> list[str]:
    return [x for x in map(str.strip, text.split(",")) if x]


def session() -> SparkSession:
    """The session of spark-submit, or a local one."""
    return SparkSession.builder.appName("stepforge").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stepforge", description="Deterministic checks of the traces of tool-calling agents.")
    p.add_argument("--version", version=__version__, action="version")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("check", help="check files of traces")
    c.add_argument("traces", nargs="+", help="files or patterns; .jsonl has one document a line")
    c.add_argument("--tools", help="JSON file that declares tools")
    c.add_argument("--format", dest="fmt", default="native", choices=list(loader.ADAPTERS))
    c.add_argument("--tool-names", type=listed, default=[], help="observations that are tools, for langfuse")
    c.add_argument("--rules", type=listed, help=f"some of {','.join(RULES)}")
    c.add_argument("--json", dest="json_out", help="file for the reports as JSON")
    c.add_argument("--html", dest="html_out", help="file for the reports as a page")
    c.add_argument("--findings", dest="table_out", help="folder for the findings as Parquet, written by the executors")
    c.add_argument("--include-candidates", help="also show what is for review", action="store_true")
    c.add_argument("--quiet", action="store_true")
    d = sub.add_parser("demo", help="validation cases and recovery scorecards")
    d.add_argument("--html", dest="html_out")
    d.add_argument("--runs", default=3, type=int)
    s = sub.add_parser("scorecard", help="recovery of the demonstration agent")
    s.add_argument("--demo", action="store_true")
    s.add_argument("--buggy", help="the agent that ignores errors", action="store_true")
    s.add_argument("--faults", type=listed, default=["timeout", "error", "rate_limit"])
    s.add_argument("--runs", default=1, type=int)
    return p


def check(a: argparse.Namespace) -> int:
    registry = Registry.load(a.tools) if a.tools else Registry()
    selected(a.rules)
    for path in a.traces:  # before Spark starts
        if "://" not in path and not (os.path.exists(path) or glob.glob(path)):
            raise FileNotFoundError(path)
    spark = session()
    found, worst = [], lint.EXIT_OK
    shown = a.json_out or a.html_out or not a.quiet
    for n, path in enumerate(a.traces):
        traces = loader.load(spark, path, a.fmt, a.tool_names).persist()
        findings = lint.lint(traces, registry, a.rules, keep=True)
        if a.table_out:
            findings.write.mode("overwrite" if n == 0 else "append").parquet(a.table_out)
        if shown:
            found += lint.collected(traces, findings)
        else:  # nothing but the exit code comes to the driver
            worst = max(worst, lint.overall_exit(lint.reports(traces, findings)).first()[0])
        spark.catalog.clearCache()
    if a.json_out:
        report.write(a.json_out, report.as_object(found))
    if a.html_out:
        report.write(a.html_out, report.html("trace report", found))
    if not a.quiet:
        print("\n".join(report.text(r, a.include_candidates) for r in found))
    return max(worst, report.overall(found))


def demo(a: argparse.Namespace) -> int:
    spark = session()
    results = validation.run(spark)
    good = sum(ok for *_, ok in results)
    print(f"validation: {good}/{len(results)} cases behaved as expected")
    for c, _, ok in results:
        print(f"  [{('FAIL', 'PASS')[ok]}] {c.name} - {c.expectation}")
    cards = []
    for careless in (False, True):
        sc = reliability.scorecard(spark, reliability.watering_task(careless), ["timeout", "error", "rate_limit"], runs=max(1, a.runs))
        cards.append((sc, sc.results.collect() if sc.results is not None else []))
        print("\n" + reliability.table(sc))
    if a.html_out:
        trace = agents.demo_trace("deaf")
        t = model.frame(spark, [trace])
        seen = lint.collected(t, lint.lint(t, agents.garden_tools().registry()))[0]
        report.write(a.html_out, report.html("trace checks: demonstration", validation=results, scorecards=cards, worked=[(trace, seen)]))
        print(f"wrote {a.html_out}")
    return lint.EXIT_OK if good == len(results) else lint.EXIT_GATE


def scorecard(a: argparse.Namespace) -> int:
    if not a.demo:
        raise ValueError("only the demonstration task is built in; pass --demo")
    for f in a.faults:
        faults.known(f)
    print(reliability.table(reliability.scorecard(session(), reliability.watering_task(a.buggy), a.faults, runs=max(1, a.runs))))
    return lint.EXIT_OK


def main(argv: Sequence[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command is None:
        p.print_help()
        return lint.EXIT_OK
    try:
        return {"check": check, "demo": demo, "scorecard": scorecard}[a.command](a)
    except (FileNotFoundError, KeyError, ValueError, PySparkException) as e:
        print(f"stepforge: error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return lint.EXIT_INPUT_ERROR
