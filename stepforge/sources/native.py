"""The engine's own trace documents."""

from __future__ import annotations

from typing import Any

from stepforge.functions.values import Doc
from stepforge.sources import model


def step(d: Doc) -> Doc:
    meta = d.get("meta") or None
    match d.get("type"):
        case model.MESSAGE:
            return model.message(d["role"], d.get("content", ""), meta)
        case model.CALL:
            return model.call(d["call_id"], d["name"], d.get("args") or {}, d.get("raw_text"), meta)
        case model.RESULT:
            return model.result(d["call_id"], d.get("content"), d.get("status"), d.get("error"), d.get("http_status"), meta)
    raise ValueError(f"unknown step type {d.get('type')!r}")


def traces(doc: Any, **_: Any) -> list[Doc]:
    """A trace, or an array of traces."""
    docs = doc if isinstance(doc, list) else [doc]
    return [model.trace(d.get("run_id", ""), [step(s) for s in d.get("steps", [])], d.get("final")) for d in docs]
