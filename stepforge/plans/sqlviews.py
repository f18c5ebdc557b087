"""The relations of a set of traces as temporary views for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stepforge.operators import lint, rules
from stepforge.registry import Registry


def register(traces: DataFrame, registry: Registry | None = None, prefix: str = "") -> None:
    """Creates the views traces, steps, calls, results, tools and findings, with ``prefix`` before their names."""
    v = rules.Views(traces, registry or Registry())
    shown = {"traces": traces, "steps": v.steps, "calls": v.calls, "results": v.results, "tools": v.declared, "findings": lint.lint_views(v)}
    for name, df in shown.items():
        df.createOrReplaceTempView(prefix + name)
