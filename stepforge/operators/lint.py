"""All checks over a set of traces, and the reports that follow from the findings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.values import Doc
from stepforge.operators import rules as R
from stepforge.registry import Registry
from stepforge.sources import loader, model

EXIT_OK, EXIT_GATE, EXIT_HARD_DEFECT, EXIT_INPUT_ERROR = 0, 1, 2, 3


def lint(traces: DataFrame, registry: Registry | None = None, rules: Iterable[str | R.Rule] | None = None, keep: bool = True) -> DataFrame:
    """Finding rows (see rules.FINDING) of canonical traces, suppressions among them.

    ``rules`` are ids or Rule objects, in the order in which they report; all
    eight by default.  If there are several, ``keep`` holds the paired steps in
    memory and on disk, so that the checks share one pass over the documents and
    one exchange; it ends with the session or with
    ``spark.catalog.clearCache()``.
    """
    return lint_views(R.Views(traces, registry or Registry()), rules, keep)


def lint_steps(steps: DataFrame, registry: Registry | None = None, rules: Iterable[str | R.Rule] | None = None, keep: bool = True) -> DataFrame:
    """The same for a table of steps (trace_key, run_id, idx and model.STEP)."""
    return lint_views(R.Views(None, registry or Registry(), steps), rules, keep)


def lint_views(v: R.Views, rules: Iterable[str | R.Rule] | None = None, keep: bool = True) -> DataFrame:
    reg = v.registry
    chosen = [r if isinstance(r, R.Rule) else R.selected([r])[0] for r in rules or ()] or R.selected()
    if v.need is None and "pairs" not in vars(v):  # what others read of these views stays whole
        v = R.Views(v.traces, reg, None if v.nested else v.steps, R.needed(chosen))
    if keep and len(chosen) > 1:
        v.pairs.persist(StorageLevel.MEMORY_AND_DISK)
    parts = [rule.run(v).withColumn("rule_ord", F.lit(n)) for n, rule in enumerate(chosen)]
    reasoned = [(n, rule) for n, rule in enumerate(chosen) if rule.reason is not None]
    if reasoned:
        parts.append(R.suppressed(v.counts, reasoned, reg))
    return reduce(DataFrame.unionByName, parts)


def active(findings: DataFrame) -> DataFrame:
    return findings.filter("suppressed_reason IS NULL")


def suppressions(findings: DataFrame) -> DataFrame:
    return findings.filter("suppressed_reason IS NOT NULL")


def by_tier(findings: DataFrame, tier: str) -> DataFrame:
    return active(findings).filter(F.col("tier") == tier)


def reports(traces: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each trace, also for those without findings: counts by tier and the exit code."""
    on = F.col("suppressed_reason").isNull()
    tier = lambda t: F.count(F.when(on & (F.col("tier") == t), 1))
    g = findings.groupBy("trace_key").agg(
        F.count(F.when(on, 1)).alias("n_active"), F.count(F.when(~on, 1)).alias("n_suppressed"),
        tier(R.HARD_EVENT).alias("n_hard_event"), tier(R.HARD_DEFECT).alias("n_hard_defect"), tier(R.CANDIDATE).alias("n_candidate"),
    )
    out = traces.select("trace_key", "run_id").join(g, "trace_key", "left").fillna(0)
    return out.withColumn("exit_code", F.when(F.col("n_hard_defect") > 0, EXIT_HARD_DEFECT).otherwise(EXIT_OK))


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with ``nth``: their place in the report of their trace, from 0, by rule as asked for and then by step."""
    order = Window.partitionBy("trace_key").orderBy("rule_ord", "finding_ord")
    return findings.withColumn("nth", F.row_number().over(order) - 1)


def overall_exit(reported: DataFrame) -> DataFrame:
    """One row: the greatest exit code; 0 where there is no trace."""
    return reported.agg(F.coalesce(F.max("exit_code"), F.lit(EXIT_OK)).alias("overall_exit"))


def collected(traces: DataFrame, findings: DataFrame) -> list[Doc]:
    """Reports as objects, in the order of traces and rules; for renderings, which one person reads."""
    keys = traces.select("trace_key", "run_id").orderBy("trace_key").collect()
    out = {k["trace_key"]: {"run_id": k["run_id"], "findings": [], "exit_code": EXIT_OK} for k in keys}
    for f in findings.orderBy("trace_key", "rule_ord", "finding_ord").toLocalIterator():
        evidence = json.loads(f["evidence_json"])
        one = {"rule": f["rule"], "finding_type": f["finding_type"], "tier": f["tier"], "summary": f["summary"], "evidence": evidence, "possible_false_positive": f["possible_false_positive"]}
        report = out[f["trace_key"]]
        if f["suppressed_reason"] is not None:
            one["suppressed_reason"] = f["suppressed_reason"]
        elif f["tier"] == R.HARD_DEFECT:
            report["exit_code"] = EXIT_HARD_DEFECT
        report["findings"].append(one)
    return list(out.values())


def trace_rule(id: str, finding_type: str, check: Callable[[Doc], list[Doc]], reason=None) -> R.Rule:
    """A check written for one trace at a time: it gets the trace's native document and returns findings
    (tier, summary, evidence with step_indices).

    For what can't be said over tables; the checks of this library don't use it.
    """

    def per_trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t in pdf.to_dict("records"):
            doc = model.exported({**t, "steps": [dict(s) if isinstance(s, dict) else s.asDict() for s in t["steps"]]})
            for n, f in enumerate(check(doc)):
                evidence = dict(f.get("evidence") or {})
                at = evidence.get("step_indices")
                key = {k: x for k, x in evidence.items() if k not in ("step_indices", "call_id", "consumed_values")}
                rows.append((t["trace_key"], t["run_id"], 0, [n], id, finding_type, f.get("tier", R.CANDIDATE), f.get("summary", ""), json.dumps(evidence), json.dumps(key, sort_keys=True), at, bool(f.get("possible_false_positive", False)), f.get("suppressed_reason")))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in R.FINDING.replace("\n", " ").split(",")])

    return R.Rule(id, finding_type, lambda v: v.traces.groupBy("trace_key").applyInPandas(per_trace, R.FINDING), reason)


def lint_file(spark, path: str, fmt: str | None = None, registry: Registry | None = None, rules=None, tool_names=()) -> DataFrame:
    """Finding rows of a file, folder or pattern of trace documents."""
    return lint(loader.load(spark, path, fmt, tool_names), registry, rules)


def lint_spans(spark, path: str, registry: Registry | None = None, rules=None) -> DataFrame:
    """The same for exports of spans."""
    return lint_file(spark, path, "otel", registry, rules)


def lint_messages(spark, path: str, registry: Registry | None = None, rules=None) -> DataFrame:
    """The same for message lists of chat models."""
    return lint_file(spark, path, "openai", registry, rules)


def lint_observations(spark, path: str, registry: Registry | None = None, rules=None, tool_names=()) -> DataFrame:
    """The same for traces of an observability platform."""
    return lint_file(spark, path, "langfuse", registry, rules, tool_names)


def lint_docs(spark, docs: list[Any], fmt: str, registry: Registry | None = None, rules=None, tool_names=()) -> list[Doc]:
    """Reports of a few documents in the driver's memory."""
    t = loader.from_docs(spark, docs, fmt, tool_names)
    return collected(t, lint(t, registry, rules))
