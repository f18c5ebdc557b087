"""Fault injection as column expressions over recorded results.

A plan says which calls get which fault; ``injected`` renders the faults into
the result columns.  Ordinals are windows over the steps of a trace.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.values import Doc, arrow_column
from stepforge.operators import pairing
from stepforge.sources import model

#: fault: (content, status, error, http status); ``truncated`` is made of the original.
FAULTS: dict[str, tuple[Any, str, str | None, int | None]] = {
    "timeout": ("request timed out", "error", "timeout", None),
    "error": ("internal server error", "error", "server_error", 500),
    "rate_limit": ("rate limited", "error", "rate_limited", 429),
    "malformed_json": ('{"incomplete": ', "ok", None, None),
    "empty": ([], "ok", None, None),
    "truncated": (None, "ok", None, None),
    "wrong_schema": ({"unexpected_field": True}, "ok", None, None),
    "denied": ({"reason": "insufficient_funds", "status": "declined"}, "ok", None, None),
}


def known(fault: str) -> str:
    if fault not in FAULTS:
        raise ValueError(f"{fault!r} is not a valid fault; there are {', '.join(FAULTS)}")
    return fault


def truncated(content: Any) -> Any:
    """The first half; of a text or anything printed as one, at least one character."""
    if isinstance(content, dict):
        return dict(list(content.items())[: len(content) // 2])
    if isinstance(content, list):
        return content[: len(content) // 2]
    text = content if isinstance(content, str) else str(content)
    return text[: max(1, len(text) // 2)]


def rendered(fault: str, call_id: str, original: Any = None, ordinal: int | None = None) -> Doc:
    """The result that a call with this fault gets."""
    content, status, error, http = FAULTS[known(fault)]
    if fault == "truncated":
        content = truncated("" if original is None else original)
    meta = {} if ordinal is None else {"injected": True, "fault_injection_id": f"{fault}@{ordinal}"}
    return model.result(call_id, content, status, error, http, meta)


def _truncated_json(text: str | None) -> str | None:
    return None if text is None else json.dumps(truncated(json.loads(text)), ensure_ascii=False)


def with_ordinals(steps: DataFrame) -> DataFrame:
    """Calls with ``ordinal`` in the trace and ``tool_ordinal`` among calls of the tool, from 1."""
    c = steps.filter(pairing.is_call())
    nth = lambda *by: F.row_number().over(Window.partitionBy("trace_key", *by).orderBy("idx"))
    return c.withColumns({"ordinal": nth(), "tool_ordinal": nth("tool")})


def targeted(fault: str, tool: str | None = None, occurrence: int = 1) -> Column:
    """The fault on the n-th call of a tool; without a tool, on the n-th call of every tool."""
    hit = F.col("tool_ordinal") == occurrence
    return F.when(hit if tool is None else hit & (F.col("tool") == tool), F.lit(known(fault)))


def random_plan(calls: DataFrame, faults: list[str], rate: float = 0.3, seed: int = 0) -> DataFrame:
    """Adds ``fault``: on each call with probability ``rate``, one of ``faults``, from a generator seeded for each trace."""
    names = [known(f) for f in faults]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(seed)
        pdf = pdf.sort_values("idx")
        pdf["fault"] = [names[rng.randrange(len(names))] if names and rng.random() < rate else None for _ in range(len(pdf))]
        return pdf

    slim = calls.select("trace_key", "idx")
    drawn = slim.groupBy("trace_key").applyInPandas(run, "trace_key string, idx int, fault string")
    return calls.join(drawn, ["trace_key", "idx"])


def injected(steps: DataFrame, plan: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps with the results of hit calls replaced; a result is hit through the call it answers.

    ``plan`` is a column over the calls with ordinals, or a function that adds
    ``fault`` to them.
    """
    c = with_ordinals(steps)
    c = plan(c) if callable(plan) and not isinstance(plan, Column) else c.withColumn("fault", plan)
    hits = c.filter("fault IS NOT NULL").select("trace_key", F.col("idx").alias("call_idx"), "fault", "ordinal")
    back = Window.partitionBy("trace_key", "call_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = steps.withColumn("call_idx", F.when(pairing.is_result(), F.last(F.when(pairing.is_call(), F.col("idx")), ignorenulls=True).over(back)))
    s = s.join(hits, ["trace_key", "call_idx"], "left")
    hit = F.col("fault").isNotNull()
    pick = lambda at: F.coalesce(*[F.when(F.col("fault") == f, F.lit(v[at])) for f, v in FAULTS.items() if v[at] is not None])
    content = F.coalesce(
        *[F.when(F.col("fault") == f, F.lit(json.dumps(v[0]))) for f, v in FAULTS.items() if f != "truncated"],
        F.when(F.col("fault") == "truncated", arrow_column("string", _truncated_json)(F.when(F.col("fault") == "truncated", F.col("content_json")))),
    )
    tag = F.concat(F.lit('{"fault_injection_id": "'), "fault", F.lit("@"), F.col("ordinal").cast("string"), F.lit('", "injected": true}'))
    new = {"content_json": content, "status": pick(1), "error": pick(2), "http_status": pick(3).cast("int"), "meta_json": tag}
    return s.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).select(*steps.columns)


def as_traces(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """Canonical traces of changed steps."""
    s = F.struct("idx", F.struct(*model.STEP_NAMES).alias("s"))
    g = steps.groupBy("trace_key").agg(F.array_sort(F.collect_list(s)).alias("all")).select("trace_key", F.transform("all", lambda x: x["s"]).alias("steps"))
    return traces.select("trace_key", "run_id", "final_json").join(g, "trace_key", "left").withColumn("steps", F.coalesce("steps", F.expr(f"CAST(array() AS array<struct<{_ddl()}>>)"))).select("trace_key", "run_id", "final_json", "steps")


def _ddl() -> str:
    return ",".join(":".join(p.split()) for p in model.STEP.replace("\n", " ").split(","))
