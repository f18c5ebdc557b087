import json

import pytest

from stepforge import agents, reliability, report, validation
from stepforge.cli import main
from stepforge.operators import faults, lint, pairing, reproduction
from stepforge.sources import loader, model

from tests.build import C, R, T, U


def test_fault_rendering():
    get = lambda f, o=None: agents.faults.rendered(f, "c", o)
    assert (get("timeout")["status"], get("error")["http_status"], get("rate_limit")["http_status"]) == ("error", 500, 429)
    assert [json.loads(get(f)["content_json"]) for f in ("empty", "wrong_schema", "malformed_json")] == [[], {"unexpected_field": True}, '{"incomplete": ']
    assert [faults.truncated(x) for x in ("abcdefgh", "a", [1, 2, 3], {"a": 1, "b": 2}, 12345)] == ["abcd", "a", [1], {"a": 1}, "12"]
    with pytest.raises(ValueError):
        faults.known("odd")


def test_faults_over_tables_agree_with_the_simulator(spark):
    docs = [T(C("1", "a"), R("1", "abcdef", "ok"), C("1", "b"), R("1", {"x": 1, "y": 2}, "ok"), C("2", "a"), R("2", [1, 2], "ok"), R("zz", 1, "ok"))]
    steps = model.steps_of(loader.from_docs(spark, docs, "native"))
    for fault in faults.FAULTS:
        got = faults.injected(steps, faults.targeted(fault, "a", 2)).filter(pairing.is_result()).orderBy("idx").collect()
        want = faults.rendered(fault, "2", [1, 2], 3)
        assert [got[2][k] for k in ("content_json", "status", "error", "http_status")] == [want[k] for k in ("content_json", "status", "error", "http_status")]
        assert json.loads(got[2]["meta_json"]) == json.loads(want["meta_json"])
        assert got[0]["status"] == got[1]["status"] == "ok" and got[0]["meta_json"] is None
    hit = faults.injected(steps, faults.targeted("empty")).filter("status = 'ok' AND content_json = '[]'")
    assert sorted(r["idx"] for r in hit.collect()) == [1, 3]
    back = faults.as_traces(loader.from_docs(spark, docs, "native"), steps)
    assert model.steps_of(back).count() == 7


def test_random_plan_draws_like_the_simulator(spark):
    docs = [T(*(C(str(i), "ab"[i % 2]) for i in range(20)), run_id=str(n)) for n in range(2)]
    calls = faults.with_ordinals(model.steps_of(loader.from_docs(spark, docs, "native")))
    plan = agents.Chance(["timeout", "empty"], 0.4)
    rng = __import__("random").Random(9)
    want = [plan.decide("", 0, 0, rng) for _ in range(20)]
    rows = faults.random_plan(calls, ["timeout", "empty"], 0.4, 9).orderBy("trace_key", "idx").collect()
    assert [r["fault"] for r in rows] == want * 2


def test_agents():
    t = agents.demo_trace("plain")
    assert json.loads(t["final_json"]).startswith("F-12 was dry") and [s["kind"] for s in t["steps"]][:4] == ["message", "message", "tool_call", "tool_result"]
    assert agents.demo_trace("plain", "error")["steps"][3]["http_status"] == 500
    tools = agents.garden_tools()
    assert tools.execute("c", "none", {})["error"] == "unknown_tool" and tools.execute("c", "open_valve", {"bed": "K-03"})["http_status"] == 423 and tools.execute("c", "feel_soil", {"bed": "?"})["http_status"] == 410
    broken = agents.Toolset([agents.SimTool("t", "", {}, lambda a: 1 / 0)]).execute("c", "t", {})
    assert broken["error"].startswith("ZeroDivisionError")
    endless = agents.run_agent(lambda steps: agents.use("feel_soil", {"bed": "1"}), tools, "x", max_steps=3)
    assert endless["final_json"] is None and sum(s["kind"] == "tool_call" for s in endless["steps"]) == 3
    assert agents.Script([])([]) == agents.say("(script exhausted)")
    assert tools.registry().get("open_valve").flag("side_effecting") and tools.chat_tools()[0]["function"]["name"] == "feel_soil"


def test_oracles():
    t = agents.demo_trace("plain")
    o = reliability
    assert o.tool_called("open_valve", {"bed": " f-12 "})(t, None) and not o.tool_called("open_valve", {"bed": "1"})(t, None)
    assert o.final_contains("WATER")(t, None) and not o.final_not_claims("water")(t, None)
    assert o.all_of(o.state_check(lambda ts: ts is None), o.tool_called("feel_soil"))(t, None)


def test_scorecards(spark):
    good = reliability.scorecard(spark, reliability.watering_task(), ["timeout", "error"], runs=3)
    bad = reliability.scorecard(spark, reliability.watering_task(True), ["timeout", "error"], targets=["feel_soil", "open_valve"], runs=2)
    assert {(r["condition"], r["recovered"], r["total"]) for r in good.results.collect()} == {("timeout", 3, 3), ("error", 3, 3)}
    assert {(r["condition"], r["recovered"], r["total"]) for r in bad.results.collect()} == {("timeout", 2, 4), ("error", 2, 4)}
    assert "rate=0.50" in reliability.table(bad)
    free = reliability.watering_task()
    free.oracle = None
    assert reliability.scorecard(spark, free, ["error"]).note.endswith("weaker than correctness")
    free.oracle = lambda t, ts: False
    sc = reliability.scorecard(spark, free, ["error"])
    assert not sc.baseline_ok and sc.results is None and "not measured" in reliability.table(sc)
    assert not reliability.experiment(spark, free, ["error"], runs=2).baseline_ok


def test_experiment_sees_a_denial_only_if_declared(spark):
    task = reliability.watering_task(True)
    reg = task.tools().registry()
    plain = reliability.experiment(spark, task, ["denied"], runs=3, target="feel_soil")
    reg.get("feel_soil").metadata = {"failure_when": {"pointer": "/status", "in": ["declined"]}}
    told = reliability.experiment(spark, task, ["denied"], runs=3, target="feel_soil", registry=reg)
    rate = lambda e: {r["condition"]: r["flagged_rate"] for r in e.conditions.collect()}["denied"]
    assert (rate(plain), rate(told)) == (0.0, 1.0) and "denied" in reliability.table(told)


def test_reproduction(spark):
    loop = T(*(x for i in range(3) for x in (C(str(i), "a"), R(str(i), "e", "error"))))
    moved = T(U("x"), *loop["steps"])
    t = loader.from_docs(spark, [loop, T(U("x")), moved, loop], "native")
    rows = reproduction.ordered(reproduction.reproduction(lint.lint(t, None, ["R4", "R2a"]), traces=t)).collect()
    assert [(r["rule"], r["count"], r["runs"], r["flaky"]) for r in rows] == [("R2a", 3, 4, True), ("R4", 3, 4, True)]
    assert reproduction.stable(2) and not reproduction.stable(1)


def test_validation_suite(spark):
    bad = [(c.name, [(f["rule"], f["tier"], f["summary"]) for f in r["findings"]]) for c, r, ok in validation.run(spark) if not ok]
    assert bad == []


def test_renderings():
    f = {"rule": "R1", "finding_type": "schema_violation", "tier": "hard_defect", "summary": "<b>", "evidence": {"step_indices": [1, 2], "errors": [{"path": "/a", "keyword": "type", "message": "m"}]}, "possible_false_positive": False}
    c = f | {"tier": "candidate", "evidence": {}, "possible_false_positive": True}
    s = c | {"suppressed_reason": "why"}
    r = {"run_id": "r", "findings": [f, c, s], "exit_code": 2}
    text = report.text(r)
    assert "r: 2 finding(s), exit 2" in text and "(step 1,2)" in text and "/a  type: m" in text and "1 candidate(s) not shown" in text and "suppressed (1)" in text
    assert "no step" in report.text(r, True) and "clean" in report.text({"run_id": "q", "findings": [], "exit_code": 0})
    assert report.texts([r, r]).startswith("linted 2 trace(s); 2 with a hard_defect; overall exit 2") and report.texts([]).endswith("exit 0")
    page = report.html("<t>", [r])
    assert "&lt;b&gt;" in page and "<script" not in page and "&lt;t&gt;" in page


def test_cli(spark, tmp_path, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.jsonl"
    good.write_text(json.dumps(T(U("shelf 6170"), C("1", "t", {"id": "6170"}), R("1", 1, "ok"))))
    bad.write_text(json.dumps(T(C("1", "t", {}, raw_text="{"))) + "\n")
    assert main(["check", str(good), "--quiet", "--rules", "R1,R6"]) == 0
    out = tmp_path / "deep" / "o.json"
    assert main(["check", str(good), str(bad), "--json", str(out), "--html", str(tmp_path / "o.html"), "--rules", "R6,R7"]) == 2
    assert main(["check", str(bad), "--quiet", "--findings", str(tmp_path / "f"), "--rules", "R6"]) == 2
    assert report.read(out)["overall_exit"] == 2 and "not valid JSON" in capsys.readouterr().out
    assert main(["check", str(good), "--rules", "R9"]) == 3 and main(["check", str(tmp_path / "none.json")]) == 3
    (tmp_path / "odd.json").write_text("{")
    assert main(["check", str(tmp_path / "odd.json")]) == 3
    assert main(["scorecard"]) == 3 and main(["scorecard", "--demo", "--faults", "odd"]) == 3 and main([]) == 0
    assert main(["scorecard", "--demo", "--buggy", "--faults", "error"]) == 0 and "0/1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["check", str(good), "--format", "odd"])


def test_the_experiment_tests_itself(spark):
    assert reliability.self_test(spark, 2)
    careful = reliability.experiment(spark, reliability.watering_task(), ["error"], runs=2, target="feel_soil")
    assert careful.baseline_ok and not reliability.passed(careful)


def test_first_user_turn_in_the_page():
    page = report.html("t", worked=[(agents.demo_trace("plain"), {"run_id": "r", "findings": [], "exit_code": 0})])
    assert "Water bed F-12 for 120 seconds unless it is wet." in page.split("Worked example")[1].split("<table>")[0]
