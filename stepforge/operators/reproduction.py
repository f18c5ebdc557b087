"""How often each finding comes back over repeated runs of one scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.functions import stats
from stepforge.operators import lint
from stepforge.registry import Registry


def reproduction(findings: DataFrame, runs: int | None = None, traces: DataFrame | None = None) -> DataFrame:
    """(rule, finding_type, tier, summary, count, runs, rate, low, high, flaky), for every distinct finding.

    Findings are the same if rule, type and evidence agree but for positions and
    ids.  A finding counts once in a run.  tier and summary are of the earliest
    one.  ``runs`` is the number of runs, or is counted from ``traces``.
    """
    key = ["rule", "finding_type", "key_json"]
    order = F.struct("trace_key", "rule_ord", "finding_ord")
    # one aggregate for both the distinct runs and the example: no second exchange for a distinct
    g = findings.filter("suppressed_reason IS NULL").groupBy(*key).agg(
        F.min(F.struct(order.alias("o"), "tier", "summary")).alias("x"), F.count_distinct("trace_key").alias("count")
    )
    n = F.lit(runs).cast("long") if runs is not None else None
    if n is None:
        g = g.crossJoin(F.broadcast(traces.agg(F.count(F.lit(1)).alias("runs"))))  # one row
    else:
        g = g.withColumn("runs", n)
    g = stats.with_rate(g, "count", "runs").withColumn("flaky", (F.col("count") > 0) & (F.col("count") < F.col("runs")))
    return g.select("rule", "finding_type", "x.tier", "x.summary", "count", "runs", "rate", "low", "high", "flaky", F.col("x.o").alias("first_seen"))


def lint_runs(traces: DataFrame, registry: Registry | None = None, rules=None) -> DataFrame:
    """reproduction() of traces that are runs of one scenario."""
    return reproduction(lint.lint(traces, registry, rules), traces=traces)


def ordered(reproduced: DataFrame) -> DataFrame:
    """Most frequent first, for reading."""
    return reproduced.orderBy(F.desc("count"), "rule", "finding_type", "first_seen").drop("first_seen")


def stable(runs: int) -> bool:
    """Whether rates mean anything: one run gives none."""
    return runs >= 2
