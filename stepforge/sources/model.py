"""The canonical trace: one row for each trace, with its steps in order.

Adapters are plain functions from a parsed document to such rows; the loader
runs them over Arrow batches of documents.  ``args_json`` and ``content_json``
keep the values as JSON text, in the order of their keys.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.values import Doc
from stepforge.functions import values

STEP = """kind string, role string, content string, call_id string, tool string, args_json string, raw_text string,
  content_json string, status string, error string, http_status int, meta_json string"""
TRACE = f"trace_key string, run_id string, final_json string, steps array<struct<{STEP}>>"
STEP_NAMES = [p.split()[0] for p in STEP.replace("\n", " ").split(",")]
MESSAGE, CALL, RESULT = "message", "tool_call", "tool_result"
ROLES = ("user", "assistant", "system", "tool")
#: What is kept of a step's metadata.
META = (
    "timestamp duration_ms model provider model_version tokens_in tokens_out parent_span_id retry_attempt fault_injection_id injected tool_schema_version"
).split()
_BLANK = dict.fromkeys(STEP_NAMES)


def _meta(meta: Doc | None) -> str | None:
    kept = {k: meta[k] for k in META if meta.get(k) is not None and meta[k] is not False} if meta else {}
    return values.dumps(kept) if kept else None


def status_of(raw: Any) -> str:
    return raw if raw in ("ok", "error") else "unknown"


def as_text(x: Any) -> str | None:
    return x if x is None or isinstance(x, str) else values.dumps(x)


def message(role: str, text: str, meta: dict | None = None) -> Doc:
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    return _BLANK | {"kind": MESSAGE, "role": role, "content": text, "meta_json": _meta(meta)}


def call(call_id: str, tool: str, args: Doc, raw_text: str | None = None, meta: dict | None = None) -> Doc:
    if not isinstance(args, dict):
        raise ValueError(f"arguments of {tool!r} are no object")
    return _BLANK | {"kind": CALL, "call_id": call_id, "tool": tool, "args_json": values.dumps(args), "raw_text": raw_text, "meta_json": _meta(meta)}


def result(call_id: str, content: Any, status: Any = None, error: Any = None, http_status: Any = None, meta: dict | None = None) -> Doc:
    http = http_status if isinstance(http_status, int) and not isinstance(http_status, bool) else None
    return _BLANK | {
        "kind": RESULT, "call_id": call_id, "content_json": values.dumps(content), "status": status_of(status),
        "error": as_text(error), "http_status": http, "meta_json": _meta(meta),
    }


def trace(run_id: str, steps: list[Doc], final: Any = None) -> Doc:
    return {"run_id": run_id, "final_json": None if final is None else values.dumps(final), "steps": steps}


def last_words(steps: list[Doc]) -> str | None:
    """Text of the last assistant turn that has any."""
    return next((s["content"] for s in reversed(steps) if s["role"] == "assistant" and s["content"]), None)


def exported(t: Doc) -> Doc:
    """The native document of a canonical trace (row or dict)."""
    out = []
    for s in t["steps"]:
        kept = {"meta": json.loads(s["meta_json"])} if s["meta_json"] else {}
        if s["kind"] == MESSAGE:
            out.append({"type": MESSAGE, "role": s["role"], "content": s["content"]} | kept)
        elif s["kind"] == CALL:
            raw = {"raw_text": s["raw_text"]} if s["raw_text"] is not None else {}
            out.append({"type": CALL, "call_id": s["call_id"], "name": s["tool"], "args": json.loads(s["args_json"])} | raw | kept)
        else:
            more = {k: s[k] for k in ("error", "http_status") if s[k] is not None}
            out.append({"type": RESULT, "call_id": s["call_id"], "content": json.loads(s["content_json"]), "status": s["status"]} | more | kept)
    return {"run_id": t["run_id"], "steps": out, "final": json.loads(t["final_json"]) if t["final_json"] else None}


def chat_messages(t: Doc) -> list[Doc]:
    """The trace as the message list of a chat model; consecutive calls share one assistant turn."""
    out: list[Doc] = []
    for s in t["steps"]:
        if s["kind"] == MESSAGE:
            out.append({"role": s["role"], "content": s["content"]})
        elif s["kind"] == CALL:
            if not (out and out[-1]["role"] == "assistant" and "tool_calls" in out[-1]):
                out.append({"role": "assistant", "content": None, "tool_calls": []})
            out[-1]["tool_calls"].append({"id": s["call_id"], "type": "function", "function": {"name": s["tool"], "arguments": s["args_json"]}})
        else:
            value = json.loads(s["content_json"])
            out.append({"role": "tool", "tool_call_id": s["call_id"], "content": value if isinstance(value, str) else values.dumps(value)})
    return out


def frame(spark: SparkSession, traces: list[Doc]) -> DataFrame:
    """Traces made on the driver (fixtures, simulations) as a table; keys follow their order."""
    rows = [(f"trace#{i:09d}", t["run_id"], t["final_json"], [tuple(s[n] for n in STEP_NAMES) for s in t["steps"]]) for i, t in enumerate(traces)]
    return spark.createDataFrame(rows, TRACE)


def first_asked() -> Column:
    """What the first turn of a user says, of a table of traces; null where there is none."""
    turns = F.filter("steps", lambda s: (s["kind"] == MESSAGE) & (s["role"] == "user"))
    return F.get(turns, F.lit(0))["content"]


def steps_of(traces: DataFrame) -> DataFrame:
    """(trace_key, run_id, idx, step columns): positions count from 0."""
    s = traces.select("trace_key", "run_id", F.posexplode("steps").alias("idx", "s"))
    return s.select("trace_key", "run_id", "idx", "s.*")
