"""Declared failure conditions of tools: a JSON pointer into the result and a test on what it finds."""

from __future__ import annotations

import functools
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepforge.functions import values
from stepforge.functions.values import Doc

#: Longest value shown in evidence.
SHOWN = 120


def resolve(content: Any, pointer: str) -> tuple[Any, bool]:
    """(value, found): RFC 6901; "" and "/" are the whole, a name without slash is one key."""
    if pointer == "" or pointer == "/":
        return content, True
    path = [pointer]
    if pointer[0] == "/":
        path = [x.replace("~1", "/").replace("~0", "~") for x in pointer[1:].split("/")]
    for key in path:
        if isinstance(content, list):
            try:
                at = int(key)
            except ValueError:
                return None, False
            if at < 0 or at >= len(content):
                return None, False
            content = content[at]
        elif isinstance(content, dict) and key in content:
            content = content[key]
        else:
            return None, False
    return content, True


def compiled(declared: Any) -> Doc | None:
    """The usable part of a ``failure_when`` declaration, or None if it tests nothing."""
    if not isinstance(declared, dict) or not isinstance(declared.get("pointer"), str):
        return None
    out: Doc = {"pointer": declared["pointer"]}
    if isinstance(declared.get("in"), list) and declared["in"]:
        out["in"] = declared["in"]
    if "equals" in declared:
        out["equals"] = declared["equals"]
    for key in ("contains", "matches"):
        if isinstance(declared.get(key), str):
            out[key] = declared[key]
    if len(out) == 1:
        if not (declared.get("exists") or out["pointer"]):
            return None
        out["exists"] = True
    return out


def text_of(value: Any) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, default=str)


def holds(pred: Doc, content: Any) -> bool:
    value, found = resolve(content, pred["pointer"])
    if not found:
        return False
    if pred.get("exists"):
        return True
    if any(value == x for x in pred.get("in", ())) or ("equals" in pred and value == pred["equals"]):
        return True
    if "contains" in pred and pred["contains"] in text_of(value):
        return True
    try:
        return "matches" in pred and re.search(pred["matches"], text_of(value)) is not None
    except re.error:  # a declaration that can't be read never holds
        return False


def shown(pred: Doc, content: Any) -> str:
    text = repr(resolve(content, pred["pointer"])[0])
    return f"{pred['pointer'] or '(result)'}={text if len(text) <= SHOWN else text[: SHOWN - 3] + '...'}"


@functools.lru_cache(4096)
def _parsed(pred_json: str) -> Doc:
    return json.loads(pred_json)


def failure_of(content_json: str | None, pred_json: str | None) -> str | None:
    """What matched, or None."""
    if content_json is None or pred_json is None:
        return None
    content, pred = json.loads(content_json), _parsed(pred_json)
    return shown(pred, content) if holds(pred, content) else None


def declared_failure(content_json: Column, pred_json: Column) -> Column:
    """Text of the match of a compiled predicate (as JSON) with a result, null where it doesn't hold."""
    return values.arrow_column("string", failure_of)(content_json, pred_json)


def pointer_value_of(content_json: str | None, pointer: str | None) -> dict | None:
    if content_json is None or pointer is None:
        return None
    value, found = resolve(json.loads(content_json), pointer)
    return {"found": found, "value": values.dumps(value, True) if found else None}


def pointer_value(content_json: Column, pointer: Column | str) -> Column:
    """struct<found, value>: value is JSON text, and so "null" where a null is there."""
    p = F.lit(pointer) if isinstance(pointer, str) else pointer
    return values.arrow_column("struct<found boolean, value string>", pointer_value_of)(content_json, p)
