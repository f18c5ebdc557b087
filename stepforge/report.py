"""Renderings of collected reports: text, JSON and one self-contained HTML page."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path
from typing import Any

from stepforge.functions.values import Doc

Report = Doc
TIERS = {
    "hard_defect": ("#b3261e", "provable from the trace and the declarations alone; fails the build"),
    "hard_event": ("#9a5b00", "something that did happen, such as a tool error; no defect by itself"),
    "candidate": ("#44546a", "may be innocent; for review, never fails the build"),
}
RULES = {
    "R1": "Arguments break the tool's JSON Schema",
    "R2a": "A tool returned an error",
    "R2b": "An error was used further or left alone",
    "R3": "An argument comes from nowhere",
    "R4": "The same call again and again without progress",
    "R5": "A call repeated though its answer was known",
    "R6": "Arguments that are no valid JSON",
    "R7": "A tool that was never declared",
}


def active(r: Report) -> list[dict]:
    return [f for f in r["findings"] if "suppressed_reason" not in f]


def suppressed(r: Report) -> list[dict]:
    return [f for f in r["findings"] if "suppressed_reason" in f]


def where(f: dict) -> str:
    at = f["evidence"].get("step_indices") or []
    return f"step {','.join(map(str, at))}" if at else "no step"


def text(r: Report, include_candidates: bool = False) -> str:
    """One report; candidates only on request, suppressions always."""
    found, hushed = active(r), suppressed(r)
    shown = [f for f in found if include_candidates or f["tier"] != "candidate"]
    out = [f"{r['run_id']}: {len(found)} finding(s), exit {r['exit_code']}"]
    for f in shown:
        out += [f"  [{f['tier']}] {f['rule']} {f['finding_type']}  ({where(f)})", f"    {f['summary']}"]
        out += [f"      {e['path']}  {e['keyword']}: {e['message']}" for e in f["evidence"].get("errors", ())]
        if f["possible_false_positive"]:
            out.append("    (may be a false positive; see the evidence)")
    if len(found) > len(shown):
        out.append(f"  ({len(found) - len(shown)} candidate(s) not shown; --include-candidates shows them)")
    if hushed:
        out.append(f"  suppressed ({len(hushed)}): these were not checked, which is no pass")
        out += [f"    {f['rule']} {f['finding_type']}: {f['suppressed_reason']}" for f in hushed]
    if not r["findings"]:
        out.append("  clean: no findings.")
    return "\n".join(out)


def overall(reports: list[Report]) -> int:
    return max([0, *(r["exit_code"] for r in reports)])


def texts(reports: list[Report], include_candidates: bool = False) -> str:
    defects = sum(r["exit_code"] == 2 for r in reports)
    head = f"linted {len(reports)} trace(s); {defects} with a hard_defect; overall exit {overall(reports)}"
    return "\n\n".join([head, *(text(r, include_candidates) for r in reports)])


def as_object(reports: list[Report]) -> Doc:
    return {"overall_exit": overall(reports), "reports": reports}


def write(path: str | Path, content: Any) -> None:
    """Text as it is, anything else as JSON; folders are made."""
    target = Path(path)
    target.parent.mkdir(exist_ok=True, parents=True)
    target.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2), encoding="utf-8")


def read(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


_STYLE = """
body{font:15px/1.5 system-ui,sans-serif;max-width:68rem;margin:2rem auto;padding:0 1rem;color:#1c2530}
table{border-collapse:collapse;width:100%;margin:.6rem 0}td,th{border-bottom:1px solid #d5dbe3;padding:.35rem .6rem;text-align:left;vertical-align:top}
.tier{color:#fff;border-radius:.6rem;padding:.05rem .55rem;font-size:.8rem}.tiles{display:flex;gap:1rem}.tile{flex:1;border:1px solid #d5dbe3;border-radius:.5rem;padding:.8rem}
.tile b{display:block;font-size:1.5rem}.quiet{color:#66707c}code{background:#f1f4f8;padding:0 .25rem}
"""


def _chip(tier: str) -> str:
    return f'<span class="tier" style="background:{TIERS[tier][0]}">{escape(tier)}</span>'


def _table(head: list[str], rows: list[list[str]]) -> str:
    """Cells are HTML already."""
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    return f"<table>{line('th', head)}{''.join(line('td', r) for r in rows)}</table>"


def _findings(r: Report) -> str:
    rows = []
    for f in r["findings"]:
        if "suppressed_reason" in f:
            rows.append([escape(f["rule"]), '<span class="quiet">not checked</span>', "", escape(f["suppressed_reason"])])
        else:
            rows.append([escape(f["rule"]), _chip(f["tier"]), escape(where(f)), escape(f["summary"])])
    return _table(["rule", "tier", "where", "what"], rows) if rows else "<p>No findings.</p>"


def first_asked(trace: Doc) -> str | None:
    """What the first turn of a user says."""
    return next((s["content"] for s in trace["steps"] if s["kind"] == "message" and s["role"] == "user"), None)


def _steps(trace: Doc) -> str:
    rows = []
    for i, s in enumerate(trace["steps"]):
        said = s["content"] if s["kind"] == "message" else s["args_json"] if s["kind"] == "tool_call" else s["content_json"]
        who = s["role"] or s["tool"] or s["status"]
        rows.append([str(i), escape(s["kind"]), escape(who or ""), f"<code>{escape(said or '')}</code>"])
    return _table(["step", "kind", "who", "content"], rows)


def html(title: str, reports: list[Report] = (), validation=(), scorecards=(), worked=()) -> str:
    """A page without scripts.  ``validation`` holds (case, report, ok), ``scorecards`` (scorecard, collected rows),
    ``worked`` (trace, report)."""
    tiles = []
    if validation:
        tiles.append(("validation cases as expected", f"{sum(ok for *_, ok in validation)}/{len(validation)}"))
        tiles.append(("planted defects", str(sum(c.kind == "planted" for c, *_ in validation))))
    rates = [r["rate"] for _, rows in scorecards for r in rows]
    if rates:
        tiles.append(("mean recovery", f"{sum(rates) / len(rates):.0%}"))
    if reports:
        tiles += [("traces", str(len(reports))), ("findings", str(sum(len(active(r)) for r in reports)))]
    parts = [f"<h1>{escape(title)}</h1>", '<div class="tiles">' + "".join(f'<div class="tile"><b>{escape(v)}</b>{escape(k)}</div>' for k, v in tiles) + "</div>"]
    parts.append("<h2>How to read this</h2>" + _table(["tier", "meaning"], [[_chip(t), escape(m)] for t, (_, m) in TIERS.items()]))
    parts.append(_table(["rule", "finds"], [[k, escape(v)] for k, v in RULES.items()]))
    for trace, r in worked:
        asked = first_asked(trace)
        parts.append(f"<h2>Worked example: {escape(r['run_id'])}</h2>" + (f"<p>Asked: {escape(asked)}</p>" if asked else "") + f"{_steps(trace)}{_findings(r)}")
    if validation:
        rows = [[escape(c.name), escape(c.kind), escape(c.expectation), "yes" if ok else "<b>no</b>"] for c, _, ok in validation]
        parts.append("<h2>Validation</h2>" + _table(["case", "kind", "expected", "as expected"], rows))
    for sc, rows in scorecards:
        body = [[escape(r["condition"]), f"{r['recovered']}/{r['total']}", f"{r['rate']:.2f}", f"{r['low']:.2f} to {r['high']:.2f}"] for r in rows]
        parts.append(f"<h2>Recovery: {escape(sc.task)}</h2>" + (_table(["fault", "recovered", "rate", "95 % interval"], body) if sc.baseline_ok else f"<p>{escape(sc.note)}</p>"))
    for r in reports:
        parts.append(f"<h2>{escape(r['run_id'])} <span class='quiet'>exit {r['exit_code']}</span></h2>{_findings(r)}")
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body>{"".join(parts)}</body></html>'
