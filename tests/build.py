"""Short names for native steps, and a plain model of the checks that walks one trace at a time."""

from __future__ import annotations

import json

from stepforge.functions import values


def U(text):
    return {"type": "message", "role": "user", "content": text}


def S(text):
    return {"type": "message", "role": "system", "content": text}


def A(text):
    return {"type": "message", "role": "assistant", "content": text}


def C(cid, name, args=None, **more):
    return {"type": "tool_call", "call_id": cid, "name": name, "args": args or {}, **more}


def R(cid, content, status=None, **more):
    return {"type": "tool_result", "call_id": cid, "content": content, "status": status, **more}


def T(*steps, run_id="t", final=None):
    return {"run_id": run_id, "steps": list(steps), "final": final}


def failed(r):
    return r["status"] == "error" or (r.get("http_status") or 0) >= 400 or r.get("error") is not None


def naive(trace, declared):
    """(rule, step indices) of R2a's structured errors, R2b, R4 and R5, by the letter of their definitions.

    ``declared`` maps tools to the set of their flags.
    """
    steps = list(enumerate(trace["steps"]))
    calls = [(i, s) for i, s in steps if s["type"] == "tool_call"]
    results = [(i, s) for i, s in steps if s["type"] == "tool_result"]
    out = set()

    def answer(i, c):
        return next(((j, r) for j, r in results if j > i and r["call_id"] == c["call_id"]), None)

    def asked(j, r):
        return next(((i, c) for i, c in reversed(calls) if i < j and c["call_id"] == r["call_id"]), None)

    for j, r in results:
        if not failed(r):
            continue
        out.add(("R2a", (j,)))
        have = values.identifying(r["content"]) | values.identifying(r.get("error") or "")
        user = next((i for i, c in calls if i > j and have & values.identifying(c["args"])), None)
        if user is not None:
            out.add(("R2b", (j, user)))
        else:
            q = asked(j, r)
            if q is None or not any(i > j and c["name"] == q[1]["name"] for i, c in calls):
                out.add(("R2b", (j,)))
    info = []
    for i, c in calls:
        got = answer(i, c)
        if got is None:
            kind = outcome = "no_result"
        else:
            r = got[1]
            kind = "error" if failed(r) else "empty" if values.nothing(r["content"]) else "ok"
            if kind == "ok" and isinstance(r["content"], dict) and "status" in r["content"]:
                kind = f"status:{values.normal(r['content']['status'])}"
            outcome = json.dumps([r["status"] or "unknown", r["content"]], sort_keys=True)
        info.append((i, c["name"], values.stable_args(c["args"]), kind, outcome))
    at = 0
    while at < len(info):
        end = at
        while end + 1 < len(info) and info[end + 1][1:4] == info[at][1:4]:
            end += 1
        name, args, kind = info[at][1:4]
        waits = kind.startswith("status:") and kind[7:] in values.WAITING
        poll = "polling" in declared.get(name, ()) or (waits and any(x[1:3] == (name, args) and x[3] != kind for x in info[end + 1 :]))
        if end - at >= 2 and not poll:
            out.add(("R4", tuple(x[0] for x in info[at : end + 1])))
        at = end + 1
    anchors = {}
    for pos, (i, name, args, _, outcome) in enumerate(info):
        key = (name, args, outcome)
        if key not in anchors:
            anchors[key] = pos
            continue
        before = anchors[key]
        if pos - before == 1 or any("side_effecting" in declared.get(x[1], ()) for x in info[before + 1 : pos]):
            continue
        out.add(("R5", (info[before][0], i)))
        anchors[key] = pos
    return out
