"""Recovery scorecards and fault experiments: a grid of simulated runs, linted and rolled up as tables.

Every (condition, target, run) is a row; ``mapInPandas`` turns rows into traces
wherever they are, and what follows is joins and aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge import agents
from stepforge.functions import stats
from stepforge.functions.values import Doc, normal
from stepforge.operators import faults, lint
from stepforge.registry import Registry
from stepforge.sources import model

#: Judges a run: (trace, toolset) to true or false.
Oracle = Callable[[Doc, agents.Toolset], bool]


@dataclass
class Task:
    name: str
    text: str
    tools: Callable[[], agents.Toolset]
    decide: Callable[[], Callable[[agents.Steps], Doc]]
    oracle: Oracle | None = None
    system: str | None = None


def _final(trace: Doc) -> str | None:
    return None if trace["final_json"] is None else str(json.loads(trace["final_json"]))


def tool_called(name: str, args: Doc | None = None) -> Oracle:
    def check(trace, tools):
        for c in agents.called(trace["steps"], name):
            own = json.loads(c["args_json"])
            if all(normal(own.get(k)) == normal(v) for k, v in (args or {}).items()):
                return True
        return False

    return check


def final_contains(text: str) -> Oracle:
    return lambda trace, tools: text.lower() in (_final(trace) or "").lower() if _final(trace) is not None else False


def final_not_claims(text: str) -> Oracle:
    said = final_contains(text)
    return lambda trace, tools: not said(trace, tools)


def state_check(fn: Callable[[agents.Toolset], bool]) -> Oracle:
    return lambda trace, tools: bool(fn(tools))


def all_of(*oracles: Oracle) -> Oracle:
    return lambda trace, tools: all(o(trace, tools) for o in oracles)


def _never_blind(trace, tools) -> bool:
    steps = trace["steps"]
    blind = any((r := agents.answer_to(steps, c)) is not None and r["status"] == "error" for c in agents.called(steps, "feel_soil"))
    return not (blind and agents.called(steps, "open_valve"))


def watering_task(careless: bool = False) -> Task:
    """Water a bed unless its soil can't be told, with a careful or a careless agent."""
    policy = agents.careless if careless else agents.careful
    return Task(f"water-unless-wet-{'careless' if careless else 'careful'}", "Water bed F-12 for 120 seconds unless it is wet.", agents.garden_tools, lambda: policy, _never_blind, "You look after a garden.")


def passed(e: Experiment, fault: str = "error") -> bool:
    """Whether an experiment with the careless agent shows what it must: all well at baseline, none under ``fault``."""
    rows = {r["condition"]: r for r in e.conditions.collect()} if e.baseline_ok else {}
    return bool(rows) and rows["baseline"]["recovery_rate"] == 1 and rows[fault]["recovered"] == 0 and rows[fault]["incorrect_continuation"] == rows[fault]["n"]


def self_test(spark: SparkSession, runs: int = 4) -> bool:
    """A run of the whole machinery without a model: the grid, the faults, the checks and the roll-up."""
    return passed(experiment(spark, watering_task(True), ["error"], runs=runs, target="feel_soil"))


_RUN = f"condition string, target string, run long, ok boolean, claimed boolean, {model.TRACE}"


def simulated(spark: SparkSession, task: Task, grid: list[tuple[str, str | None, int]], seed: int = 0, claim: Oracle | None = None) -> DataFrame:
    """Runs of (condition, target, run): the trace, the oracle's verdict (without one: whether there is a final
    answer) and whether success was claimed."""

    def one(condition: str, target: str | None, run: int) -> tuple:
        tools = task.tools()
        plan = tools if condition == "baseline" else agents.Injector(tools, agents.Target(condition, target), seed + run)
        t = agents.run_agent(task.decide(), plan, task.text, task.system, run_id=task.name)
        done = t["final_json"] is not None
        ok = bool(task.oracle(t, tools)) if task.oracle else done
        claimed = bool(claim(t, tools)) if claim else done
        key = f"{condition}/{target or ''}/{run:09d}"
        return (condition, target, run, ok, claimed, key, t["run_id"], t["final_json"], [tuple(s[n] for n in model.STEP_NAMES) for s in t["steps"]])

    names = "condition target run ok claimed trace_key run_id final_json steps".split()

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [one(r.condition, None if pd.isna(r.target) else r.target, int(r.run)) for r in pdf.itertuples()]
            out = pd.DataFrame(rows, columns=names)
            out["steps"] = [[dict(zip(model.STEP_NAMES, s, strict=True)) for s in x] for x in out["steps"]]
            yield out

    cells = spark.createDataFrame([(c, t, r) for c, t, r in grid], "condition string, target string, run long")
    return cells.repartition(max(1, min(len(grid) // 64, 10_000))).mapInPandas(batches, _RUN)


@dataclass
class Scorecard:
    task: str
    baseline_ok: bool
    mode: str
    results: DataFrame | None
    note: str = ""


def scorecard(spark: SparkSession, task: Task, fault_names: list[str], targets: list[str | None] | None = None, runs: int = 1, seed: int = 0) -> Scorecard:
    """Recovery by fault over targets and runs; without numbers if the run without faults fails its own oracle."""
    mode = "correctness" if task.oracle else "behavioral"
    for f in fault_names:
        faults.known(f)
    if not simulated(spark, task, [("baseline", None, 0)], seed).first()["ok"]:
        return Scorecard(task.name, False, mode, None, "the run without faults does not satisfy the oracle, so recovery was not measured")
    grid = [(f, t, r) for f in fault_names for t in (targets if targets is not None else [None]) for r in range(runs)]
    note = "" if task.oracle else "behavioral recovery only (no oracle), which is weaker than correctness"
    return Scorecard(task.name, True, mode, recovery(simulated(spark, task, grid, seed)), note)


def recovery(ran: DataFrame) -> DataFrame:
    """(condition, recovered, total, rate, low, high) of runs with a verdict ``ok``."""
    g = ran.groupBy("condition").agg(F.count(F.when(F.col("ok"), 1)).alias("recovered"), F.count(F.lit(1)).alias("total"))
    return stats.with_rate(g, "recovered", "total")


def flagged(findings: DataFrame) -> DataFrame:
    """(trace_key) of traces with a hard defect or any tool-error finding."""
    return lint.active(findings).filter("tier = 'hard_defect' OR rule IN ('R2a', 'R2b')").select("trace_key").distinct()


def conditions(ran: DataFrame, flags: DataFrame) -> DataFrame:
    """Outcomes by condition: recovered, incorrect_continuation (success claimed but not there), flagged; with rates and intervals."""
    j = ran.join(flags.withColumn("flag", F.lit(True)), "trace_key", "left")
    n = lambda c: F.count(F.when(c, 1))
    g = j.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), n(F.col("ok")).alias("recovered"), n(F.col("claimed") & ~F.col("ok")).alias("incorrect_continuation"), n(F.col("flag")).alias("flagged")
    )
    for name, prefix in (("recovered", "recovery_"), ("incorrect_continuation", "incorrect_"), ("flagged", "flagged_")):
        g = stats.with_rate(g, name, "n", prefix)
    return g.withColumn("failed", F.col("n") - F.col("recovered"))


@dataclass
class Experiment:
    task: str
    baseline_ok: bool
    conditions: DataFrame | None
    note: str = ""


def experiment(
    spark: SparkSession, task: Task, fault_names: list[str], runs: int = 20, seed: int = 0, target: str | None = None, claim: Oracle | None = None, rules=None, registry: Registry | None = None
) -> Experiment:
    """The three rates at baseline and under each fault.  It has none if no run without faults satisfies the oracle."""
    grid = [(c, None if c == "baseline" else target, r) for c in ["baseline", *map(faults.known, fault_names)] for r in range(runs)]
    ran = simulated(spark, task, grid, seed, claim).persist()
    if not ran.filter("condition = 'baseline' AND ok").limit(1).count():
        ran.unpersist()
        return Experiment(task.name, False, None, "no run without faults satisfies the oracle, so the task is invalid")
    found = lint.lint(ran.select("trace_key", "run_id", "final_json", "steps"), registry or task.tools().registry(), rules)
    return Experiment(task.name, True, conditions(ran, flagged(found)))


def table(e: Experiment | Scorecard, order: list[str] | None = None) -> str:
    """Rates with their 95 % intervals as text."""
    head = f"{'fault-injection experiment' if isinstance(e, Experiment) else 'recovery scorecard'}: {e.task}"
    if not e.baseline_ok:
        return f"{head}\n  {e.note}"
    rank = {c: i for i, c in enumerate(["baseline", *(order or faults.FAULTS)])}
    lines = [head]
    if isinstance(e, Scorecard):
        weak = "" if e.mode == "correctness" else "  (the run came to an end; weaker than correctness)"
        lines.append(f"  mode: {e.mode} recovery{weak}")
        for r in sorted(e.results.collect(), key=lambda r: rank[r["condition"]]):
            lines.append(f"    {r['condition']:<14} {r['recovered']}/{r['total']}  rate={r['rate']:.2f}  95% CI [{r['low']:.2f}, {r['high']:.2f}]")
        return "\n".join(lines)
    cell = lambda r, p: f"{r[p + 'rate']:.2f} [{r[p + 'low']:.2f},{r[p + 'high']:.2f}]"
    lines.append(f"  {'condition':<14} {'recovery':>20} {'incorrect-cont.':>20} {'flagged':>20}")
    for r in sorted(e.conditions.collect(), key=lambda r: rank[r["condition"]]):
        lines.append(f"  {r['condition']:<14} {cell(r, 'recovery_'):>20} {cell(r, 'incorrect_'):>20} {cell(r, 'flagged_'):>20}")
    return "\n".join(lines)
