import json
import random

import pytest

from stepforge.operators import lint as L
from stepforge.operators import rules
from stepforge.registry import Registry
from stepforge.sources import loader

from tests.build import A, C, R, S, T, U, naive

ORDER = {"type": "object", "properties": {"order_id": {"type": "string", "pattern": "^[0-9]{3,10}$"}, "reason": {"enum": ["fraud", "late"]}}, "required": ["order_id", "reason"], "additionalProperties": False}


def lint(spark, docs, tools=None, ids=None):
    t = loader.from_docs(spark, docs, "native")
    return L.collected(t, L.lint(t, Registry.from_dict(tools or {}), ids))


def brief(report, rule=None):
    return [(f["rule"], f["tier"], f["evidence"].get("step_indices"), f.get("suppressed_reason")) for f in report["findings"] if rule in (None, f["rule"])]


def test_r1_boundaries(spark):
    docs = [
        T(C("a", "cancel", {"order_id": "4521", "reason": "fraud"})),
        T(U("x"), C("a", "cancel", {"order_id": 4521, "reason": "why"})),
        T(C("a", "cancel", {"order_id": "4521"}), C("b", "other", {}), C("c", "broken", {})),
        T(C("a", "cancel", {"order_id": "45", "reason": "late", "more": 1})),
        T(C("a", "other")),
        T(U("hello")),
        T(),
    ]
    tools = {"cancel": {"schema": ORDER}, "other": {}, "broken": {"schema": {"type": "no-such"}}}
    got = lint(spark, docs, tools, ["R1"])
    keywords = lambda r: [e["keyword"] for f in r["findings"] for e in f["evidence"].get("errors", ())]
    assert got[0]["findings"] == [] and got[0]["exit_code"] == 0
    assert keywords(got[1]) == ["type", "enum"] and brief(got[1])[0][2] == [1] and got[1]["exit_code"] == 2
    assert [b[1:3] for b in brief(got[2])] == [("hard_defect", [0]), ("candidate", [1]), ("candidate", [2])]
    assert got[2]["findings"][1]["suppressed_reason"] == "no schema for tool 'other'" and "invalid JSON Schema" in got[2]["findings"][2]["suppressed_reason"]
    assert keywords(got[3]) == ["additionalProperties", "pattern"]
    assert brief(got[4])[0][3] == "no tool schema available for any called tool"
    assert brief(got[5])[0][3] == brief(got[6])[0][3] == "trace has no tool calls to validate"


def test_r2a_ladder(spark):
    tools = {"pay": {"metadata": {"side_effecting": True}}, "ask": {"metadata": {"failure_when": {"pointer": "/status", "in": ["declined"]}}}, "send": {"metadata": {"side_effecting": True, "failure_when": {"pointer": "/no"}}}}
    cases = [
        (C("a", "ask"), R("a", {"status": "declined"}, "ok"), ("hard_event", "failure_predicate")),
        (C("a", "ask"), R("a", {"status": "fine"}, "ok"), None),
        (C("a", "pay"), R("a", "Failed to pay"), ("candidate", None)),  # a suppression goes before the heuristics
        (C("a", "pay"), R("a", "Failed to pay", "ok"), None),
        (C("a", "send"), R("a", "Failed to send"), ("candidate", "exception_text")),
        (C("a", "x"), R("a", "busy", None, http_status=503), ("hard_event", "structured")),
        (C("a", "x"), R("a", "", None, error=""), ("hard_event", "structured")),
        (C("a", "x"), R("a", 'Traceback (most recent call last): "q"'), ("candidate", "exception_text")),
        (C("a", "x"), R("a", "KeyError raised"), ("candidate", "exception_text")),
        (C("a", "x"), R("a", []), ("candidate", "empty_result")),
        (C("a", "x"), R("a", " No results "), ("candidate", "empty_result")),
        (C("a", "x"), R("a", None, "weird"), ("candidate", "empty_result")),
        (C("a", "x"), R("a", {"error": "Exception"}), None),
        (C("a", "x"), R("a", "terrorists"), None),
        (C("b", "pay"), R("orphan", "boom", "error"), ("hard_event", "structured")),
    ]
    got = lint(spark, [T(c, r) for c, r, _ in cases], tools, ["R2a"])
    for (c, r, want), report in zip(cases, got, strict=True):
        seen = [(f["tier"], f["evidence"].get("signal")) for f in report["findings"]]
        assert seen == ([] if want is None else [want]), (c, r)
    assert got[2]["findings"][0]["suppressed_reason"].startswith("side-effecting tool 'pay' returned an unclassifiable result")
    assert got[6]["findings"][0]["summary"].endswith("(status=error)")
    assert got[14]["findings"][0]["evidence"]["tool"] == "?"


def test_r2b(spark):
    bad = R("a", {"id": "CONF-1", "n": 250, "ok": "yes"}, "error")
    tools = {"send": {"metadata": {"side_effecting": True}}, "ask": {"metadata": {"failure_when": {"pointer": "/state", "equals": "lost"}}}}
    docs = [
        T(C("a", "get"), bad, C("b", "send", {"x": ["CONF-1", 250]}), C("c", "log", {"x": "CONF-1"})),
        T(C("a", "get"), bad, C("b", "log", {"x": " CONF-1 "}), C("c", "get")),
        T(C("a", "get"), bad, C("b", "send", {"x": "yes"})),
        T(C("a", "get"), bad, C("b", "get")),
        T(C("a", "ask"), R("a", {"state": "lost", "ref": "REF-9"}, "ok"), C("b", "send", {"r": "REF-9"})),
        T(R("z", "boom", "error")),
    ]
    got = lint(spark, docs, tools, ["R2b"])
    assert brief(got[0]) == [("R2b", "hard_defect", [1, 2], None)] and got[0]["findings"][0]["evidence"]["consumed_values"] == ["250", "CONF-1"]
    assert brief(got[1]) == [("R2b", "candidate", [1, 2], None)] and got[1]["findings"][0]["possible_false_positive"]
    assert brief(got[2]) == [("R2b", "candidate", [1], None)] and got[2]["findings"][0]["evidence"]["signal"] == "not_retried"
    assert got[3]["findings"] == []
    assert brief(got[4]) == [("R2b", "hard_defect", [1, 2], None)]
    assert brief(got[5]) == [("R2b", "candidate", [0], None)] and got[5]["findings"][0]["evidence"]["tool"] is None


@pytest.mark.parametrize(
    ("before", "value", "operation"),
    [
        ([U("pay 1,234.56 dollars")], "1234.56", "digits"),
        ([S("Order AB-77 please")], "ab-77", "substring"),
        ([C("q", "z"), R("q", {"a": "AB", "b": "cd"})], "ab-cd", "concat"),
        ([C("q", "z"), R("q", {"id": "X9"})], "x9", "exact"),
        ([C("q", "z"), R("q", ["12 34"])], "1234", "digits"),
        ([A("the code is zebra")], "zebra", None),
        ([C("q", "z", {"v": "zebra"})], "zebra", None),
        ([], "k", "trivial"),
        ([U("Straße")], "STRASSE", "substring"),
        ([C("q", "z"), R("q", "x", "error", error="ticket 4711")], "4711", "substring"),
        ([C("q", "z"), R("q", {"t": True})], "True", None),
    ],
)
def test_r3_ladder(spark, before, value, operation):
    from stepforge.operators import provenance

    doc = T(*before, C("c", "use", {"v": value, "flag": True, "none": None, "deep": [1]}), U(f"later {value}"))
    v = rules.Views(loader.from_docs(spark, [doc], "native"), Registry())
    rows = [r for r in provenance.derivations(v).collect() if r["tool"] == "use"]
    assert [(r["field"], r["operation"]) for r in rows] == [("v", operation)]


def test_r3_origins(spark):
    props = {"p": {"x-value-origin": "provided"}, "g": {"x-value-origin": "generated"}, "e": {"enum": ["zz"]}, "n": {}}
    doc = T(C("a", "use", {"p": "pppp", "g": "gggg", "e": "zzzz", "n": "nnnn"}))
    got = lint(spark, [doc], {"use": {"schema": {"properties": props}}}, ["R3"])[0]["findings"]
    assert [(f["evidence"]["field"], f["tier"]) for f in got] == [("p", "hard_defect"), ("n", "candidate")]


def test_r4_r5(spark):
    same = lambda n, status="ok", content=1: [x for i in range(n) for x in (C(str(i), "a", {"q": 1, "ts": i}), R(str(i), content, status))]
    poll = [x for i, s in enumerate(["pending"] * 3 + ["done"]) for x in (C(str(i), "p", {}), R(str(i), {"status": s}))]
    stuck = [x for i in range(3) for x in (C(str(i), "p", {}), R(str(i), {"status": "Pending"}))]
    docs = [T(*same(3)), T(*same(2)), T(*poll), T(*stuck), T(*same(4)), T(C("1", "a", {"q": 1.0}), C("2", "b"), C("3", "a", {"q": 1}))]
    got = lint(spark, docs, {"b": {}}, ["R4", "R5"])
    assert brief(got[0]) == [("R4", "candidate", [0, 2, 4], None), ("R5", "candidate", [0, 4], None)]
    assert [b[3] for b in brief(got[1])] == ["fewer than 3 tool calls; no loop possible"]
    assert brief(got[2], "R4") == [] and brief(got[3], "R4") == [("R4", "candidate", [0, 2, 4], None)]
    assert brief(got[4], "R5") == [("R5", "candidate", [0, 4], None)]
    assert brief(got[5], "R5") == []  # 1.0 and 1 are written differently
    declared = lint(spark, [T(*stuck)], {"p": {"metadata": {"polling": True}}}, ["R4"])
    assert declared[0]["findings"] == []


def test_r6_r7(spark):
    docs = [T(*(C(str(i), "t", {}, raw_text=x) for i, x in enumerate(['{"a": 1', '{"a": 1} x', "[1]", "{}", "", '{"a": NaN}'])))]
    assert [b[2] for b in brief(lint(spark, docs, {}, ["R6"])[0])] == [[0], [1], [2]]
    got = lint(spark, docs, {"z": {}, "b": {}}, ["R7"])[0]["findings"]
    assert len(got) == 6 and got[0]["evidence"]["declared_tools"] == ["b", "z"]
    assert brief(lint(spark, docs, {}, ["R7"])[0])[0][3].startswith("no tool registry supplied")


def test_random_traces_against_a_plain_model(spark):
    rng = random.Random(5)
    tools = {"a": {"metadata": {"side_effecting": True}}, "b": {"metadata": {"polling": True}}, "c": {}}
    flags = {"a": {"side_effecting"}, "b": {"polling"}}
    docs = []
    for n in range(60):
        steps = []
        for _ in range(rng.randrange(0, 24)):
            cid = str(rng.randrange(5))
            if rng.random() < 0.55:
                steps.append(C(cid, rng.choice("abcd"), {"v": rng.choice([1, 500, "long value", "x"])}))
            else:
                body = rng.choice([1, 500, "long value", {"status": "pending"}, {"status": "done"}, None, []])
                steps.append(R(cid, body, rng.choice(["ok", "ok", "error", "unknown"]), **({"http_status": 500} if rng.random() < 0.1 else {})))
        docs.append(T(*steps, run_id="same"))
    got = lint(spark, docs, tools, ["R2a", "R2b", "R4", "R5"])
    for doc, report in zip(docs, got, strict=True):
        seen = {(f["rule"], tuple(f["evidence"]["step_indices"])) for f in report["findings"] if "suppressed_reason" not in f and f["evidence"].get("signal") not in ("empty_result", "exception_text", "failure_predicate")}
        assert seen == naive(doc, flags), json.dumps(doc)


def test_selection_order_and_custom_rules(spark):
    docs = [T(U("x"), C("a", "t"))]
    assert [f["rule"] for f in lint(spark, docs, {}, ["R7", "R1"])[0]["findings"]] == ["R7", "R1"]
    with pytest.raises(ValueError):
        rules.selected(["R9"])
    t = loader.from_docs(spark, docs, "native")
    own = L.trace_rule("X1", "talk", lambda doc: [{"summary": f"{len(doc['steps'])} steps", "evidence": {"step_indices": [0]}}])
    f = L.collected(t, L.lint(t, None, [own, "R6"]))[0]["findings"]
    assert [(x["rule"], x["summary"]) for x in f] == [("X1", "2 steps")]


def test_reports(spark):
    t = loader.from_docs(spark, [T(C("a", "t", {}, raw_text="{")), T(U("hi")), T(R("x", 1, "error"))], "native")
    f = L.lint(t, None, ["R2a", "R6"])
    rows = [(r["exit_code"], r["n_active"], r["n_suppressed"]) for r in L.reports(t, f).orderBy("trace_key").collect()]
    assert rows == [(2, 1, 1), (0, 0, 2), (0, 1, 1)]
    assert L.overall_exit(L.reports(t, f)).first()[0] == 2 and L.by_tier(f, "hard_event").count() == 1
    none = loader.from_docs(spark, [], "native")
    assert L.overall_exit(L.reports(none, L.lint(none, None))).first()[0] == 0


def test_steps_are_exchanged_once(spark):
    v = rules.Views(loader.from_docs(spark, [T(C("a", "t"))], "native"), Registry())
    plan = v.calls._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan, plan


def test_lint_exchanges_steps_once(spark):
    t = loader.from_docs(spark, [T(U("x"), C("a", "t"), R("a", 1))], "native")
    v = rules.Views(t, Registry())
    found = L.lint_views(v)
    plan = v.pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython [") == 1, plan
    whole = found._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("InMemoryRelation") >= 8
    spark.catalog.clearCache()


def test_undeclared_tools_between_repeats(spark):
    again = lambda n: [C(n, "a", {"q": 1}), R(n, "same")]
    docs = [T(*again("1"), C("2", "y"), C("3", "x"), C("4", "y"), *again("5"), C("6", "b"), *again("7")), T(*again("1"), C("2", "b"), *again("3"))]
    got = lint(spark, docs, {"a": {}, "b": {}}, ["R5"])
    assert [f["evidence"]["undeclared_between"] for f in got[0]["findings"]] == [["x"], ["x", "y"], []]
    assert "'x', 'y' ran between" in got[0]["findings"][1]["summary"] and got[1]["findings"][0]["evidence"]["undeclared_between"] == []


def test_schemas_that_are_not_checked_say_so(spark):
    schemas = {
        "odd": {"bound": 3, "errors": 1}, "open": {"unevaluatedProperties": False}, "lost": {"$ref": "#/$defs/none"}, "away": {"properties": {"a": {"$ref": "http://x/y"}}},
        "named": {"$ref": "#here", "$defs": {"h": {"$anchor": "here", "required": ["k"]}}}, "regex": {"properties": {"a": {"pattern": "("}}},
    }
    docs = [T(U("x"), C("a", name, {"a": 1})) for name in schemas]
    got = lint(spark, docs, {n: {"schema": s} for n, s in schemas.items()}, ["R1"])
    why = [[f.get("suppressed_reason", f["tier"]) for f in r["findings"]] for r in got]
    assert why[0] == [] and "not supported" in why[1][0] and "resolved" in why[2][0] and "resolved" in why[3][0] and why[4] == ["hard_defect"] and "regular expression" in why[5][0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_of_one_lint_share_counts_and_scans(spark):
    """traces were counted anew for each rule, and R2b read the steps eight times."""
    from stepforge.plans import catalog

    f = L.lint_steps(catalog._reuse(spark, "/root/testdata/sf0.001"), catalog.DECLARED, ["R2a", "R2b", "R7"])
    assert f._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 4
    spark.catalog.clearCache()


def test_r2b_and_r5_read_steps_once_and_join_only_declarations(spark):
    """F12, F14, F15 and F17."""
    from stepforge.plans import catalog

    for name, exchanges in (("r2b_not_retried", 2), ("r5_findings", 2)):
        plan = _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("SortMergeJoin") == 0 and plan.count("Exchange hashpartitioning") == exchanges and plan.count("ArrowEvalPython [") == 1, plan


def test_r3_runs_no_python_after_its_exchange(spark):
    """texts of messages went to Python again, past the exchange by trace, in one more worker a task."""
    t = loader.from_docs(spark, [T(U("find Berlin"), C("a", "t", {"q": "Berlin", "n": "Potsdam"}), R("a", 1))], "native")
    v = rules.Views(t, Registry())
    assert _plan(rules.r3(v)).count("ArrowEvalPython [") == 3
    assert [r["summary"][:14] for r in rules.r3(v).collect()] == ["argument 'n'='"]


def test_a_lint_of_some_rules_leaves_the_views_whole(spark):
    t = loader.from_docs(spark, [T(U("x"), C("a", "t", {"k": 1}), R("a", [], "error"))], "native")
    v = rules.Views(t, Registry())
    L.lint_views(v, ["R7"], keep=False)
    assert v.calls.select("args_key", "rclass").collect() == [('{"k": 1}', "error")] and v.results.select("c.kind").collect() == [("array",)]


def test_an_undeclared_repeat_is_not_between_itself_and_its_anchor(spark):
    again = lambda n: [C(n, "x", {"q": 1}), R(n, "same")]
    (r,) = lint(spark, [T(*again("1"), C("2", "a"), *again("3"))], {"a": {}}, ["R5"])
    assert [(f["evidence"]["step_indices"], f["evidence"]["undeclared_between"]) for f in r["findings"]] == [([0, 3], [])]
