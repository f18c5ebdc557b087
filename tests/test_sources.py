import json

import pyarrow as pa
import pytest

from stepforge.functions import values
from stepforge.registry import Registry
from stepforge.sources import chat, loader, model, native, observations, spans

from tests.build import A, C, R, T, U


def short(t):
    """Steps as (kind letter, what)."""
    pick = {"message": lambda s: (s["role"][0], s["content"]), "tool_call": lambda s: ("C", s["tool"], json.loads(s["args_json"]), s["raw_text"]), "tool_result": lambda s: ("R", json.loads(s["content_json"]), s["status"], s["error"])}
    return [pick[s["kind"]](s) for s in t["steps"]]


def test_native_round_trip():
    doc = T(U("x"), C("1", "t", {"b": 1, "a": [1.0]}, raw_text="r", meta={"timestamp": 1.5, "injected": False, "odd": 1}), R("1", None, "weird", error="e", http_status=500), run_id="r", final={"x": 1})
    (t,) = native.traces(doc)
    assert short(t)[2] == ("R", None, "unknown", "e") and model.exported(t)["steps"][1]["meta"] == {"timestamp": 1.5}
    assert native.traces(model.exported(t)) == [t]
    assert native.traces([doc, {"steps": []}])[1]["run_id"] == ""
    for bad in ({"type": "odd"}, {"type": "message", "role": "odd"}, {"type": "tool_call", "call_id": "1", "name": "t", "args": [1]}):
        with pytest.raises(ValueError):
            native.step(bad)
    with pytest.raises(KeyError):
        native.step({"type": "tool_call", "call_id": "1"})


def test_chat():
    call = {"id": "c1", "type": "function", "function": {"name": "w", "arguments": '{"city": "Austin"}'}}
    broken = {"id": "c2", "function": {"name": "w", "arguments": '{"city": "Austin"'}}
    t = chat.from_messages(
        [
            {"role": "system", "content": "s"},
            {"role": "User", "content": [{"type": "text", "text": "a"}, {"type": "input_text", "text": "b"}, "c"]},
            {"role": "assistant", "content": None, "tool_calls": [call, broken]},
            {"role": "tool", "tool_call_id": "c1", "content": [{"id": 1}, {"id": 2}], "http_status": 404},
            {"role": "tool", "content": "x", "status": None},
            {"role": "developer", "content": "skip"},
            {"role": "assistant", "text": "done"},
        ]
    )
    assert short(t) == [
        ("s", "s"), ("u", "a\nb\nc"), ("C", "w", {"city": "Austin"}, '{"city": "Austin"}'), ("C", "w", {}, '{"city": "Austin"'),
        ("R", [{"id": 1}, {"id": 2}], "error", None), ("R", "x", "unknown", None), ("a", "done"),
    ]
    assert json.loads(t["final_json"]) == "done" and t["steps"][5]["call_id"] == ""
    share = [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}, {"from": "observation", "value": {"a": 1}}]
    assert short(chat.from_messages(share)) == [("u", "hi"), ("a", "ho"), ("R", {"a": 1}, "unknown", None)]
    assert chat.traces(share) == [] and len(chat.traces([{"messages": []}, {"role": "user", "content": "x"}])) == 2
    assert chat.traces({"messages": [], "run_id": 5, "final": 0})[0]["run_id"] == "5"
    back = model.chat_messages(t)
    assert [m["role"] for m in back] == ["system", "user", "assistant", "tool", "tool", "assistant"] and len(back[2]["tool_calls"]) == 2


def span(sid, kind="TOOL", start="1", **more):
    return {"span_id": sid, "start_time": start, "attributes": {"openinference.span.kind": kind} | more.pop("attributes", {}), **more}


def test_spans():
    tool = {"tool.name": "look", "input.value": "{'query': 'tablet', 'in_stock': True}", "output.value": '{"n": 1}'}
    (t,) = spans.traces([span("b", start="2", attributes=tool), span("a", "LLM", attributes={"llm.input_messages.0.message.role": "user", "llm.input_messages.0.message.content": "find", "llm.output_messages.0.message.content": "ok", "llm.output_messages.0.message.tool_calls.0.tool_call.function.name": "look"})])
    assert short(t) == [("u", "find"), ("a", "ok"), ("C", "look", {"query": "tablet", "in_stock": True}, None), ("R", {"n": 1}, "unknown", None)]
    assert t["run_id"] == "None" and json.loads(t["final_json"]) == "ok"
    kv = {"spanId": "s", "startTimeUnixNano": "5", "attributes": [{"key": "gen_ai.operation.name", "value": {"stringValue": "execute_tool"}}, {"key": "gen_ai.tool.name", "value": {"stringValue": "pay"}}, {"key": "input", "value": {"stringValue": "text"}}, {"key": "output", "value": {"arrayValue": {"values": [{"intValue": 1}]}}}], "status": {"code": 2, "message": "bad"}}
    (t,) = spans.traces({"resourceSpans": [{"scopeSpans": [{"spans": [kv]}]}]})
    assert short(t) == [("C", "pay", {}, "text"), ("R", [1], "error", "bad")]
    flat = {"context.span_id": "x", "context.trace_id": "t1", "span_kind": "tool", "name": "f", "attributes.input.value": '{"args": [{"a": 1}], "kwargs": {"b": 2}}', "attributes.output.value": float("nan"), "events": [{"name": "exception", "attributes": {"exception.message": "boom"}}]}
    (t,) = spans.traces(flat)
    assert t["run_id"] == "t1" and short(t) == [("C", "f", {"a": 1, "b": 2}, None), ("R", None, "error", "boom")]
    nested = {"span_name": "outer", "timestamp": "1", "span_attributes": {"openinference.span.kind": "CHAIN"}, "child_spans": [{"span_name": "inner", "timestamp": "2", "span_attributes": {"openinference.span.kind": "TOOL", "output.value": '{"status_code": 404, "detail": "gone"}'}}]}
    assert short(spans.traces([nested])[0]) == [("C", "inner", {}, None), ("R", {"status_code": 404, "detail": "gone"}, "error", "gone")]
    two = [span("a", trace_id="p"), span("b", trace_id="q"), span("c"), span("d", traceId="p", start="0")]
    assert [[s["call_id"] for s in t["steps"] if s["kind"] == "tool_call"] for t in spans.traces(two)] == [["d", "a"], ["b"], ["c"]]
    genai = {"id": "g", "attributes": {"gen_ai.operation.name": "chat", "gen_ai.input.messages": '[{"role": "user", "parts": [{"type": "text", "content": "p"}, {"type": "x"}]}]', "llm.output_messages.0.message.tool_calls.0.tool_call.id": "k", "llm.output_messages.0.message.tool_calls.0.tool_call.function.name": "n"}}
    assert short(spans.traces([genai])[0]) == [("u", "p"), ("C", "n", {}, None)]
    assert spans.traces([]) == [] and spans.traces(3) == []


def test_observations():
    doc = {
        "id": "tr", "input": {"args": ["do it"], "kwargs": {"x": 1}},
        "observations": [
            {"id": "2", "type": "TOOL", "name": "b", "startTime": "2", "input": {"args": [], "kwargs": {"q": 1}}, "output": {"status": "ok"}},
            {"id": "1", "type": "SPAN", "name": "a", "startTime": "1", "metadata": {"kind": "tool"}, "input": {"args": [{"z": 1}], "kwargs": {}}, "output": {"status_code": 404}, "status_message": "nope"},
            {"id": "3", "type": "GENERATION", "startTime": "3", "output": {"message": {"content": "said", "tool_calls": [{"id": "q", "function": {"name": "no"}}]}}},
            {"id": "4", "type": "tool", "startTime": "4", "level": "ERROR", "input": "{bad", "output": "x", "statusMessage": "m"},
        ],
    }
    t = observations.from_trace(doc)
    assert short(t) == [
        ("u", "do it"), ("C", "a", {"z": 1}, None), ("R", {"status_code": 404}, "error", "nope"), ("C", "b", {"q": 1}, None), ("R", {"status": "ok"}, "ok", None),
        ("a", "said"), ("C", "", {}, "{bad"), ("R", "x", "error", "m"),
    ]
    assert observations.observed_tools(doc) == ["a", "b"] and observations.observed_tools({"observations": [{"name": "z"}]}, ["z"]) == ["z"]
    only = {"input": [{"role": "user", "content": "u"}], "output": "end", "observations": [{"type": "generation", "output": {"choices": [{"message": {"tool_calls": [{"id": "q", "function": {"name": "n", "arguments": "{}"}}]}}]}}]}
    assert short(observations.from_trace(only)) == [("u", "u"), ("C", "n", {}, "{}")] and observations.from_trace(only)["run_id"] == "langfuse-run"
    with pytest.raises(TypeError):
        observations.from_trace(5)


def test_loader(spark, tmp_path):
    lines = [json.dumps(T(U(f"m{i}"), run_id=str(i))) for i in range(30)]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines[:20], "", *lines[20:]]))
    t = loader.load(spark, str(tmp_path / "a.jsonl"))
    assert [r["run_id"] for r in t.orderBy("trace_key").collect()] == [str(i) for i in range(30)]
    (tmp_path / "b.json").write_text(json.dumps([T(A("ü \ud800"), run_id="x"), T(run_id="y")]))
    t = loader.load(spark, str(tmp_path / "b.json"))
    assert [(r["run_id"], len(r["steps"])) for r in t.orderBy("trace_key").collect()] == [("x", 1), ("y", 0)]
    assert model.steps_of(t).first()["content"] == "ü ?"
    (tmp_path / "c.json").write_text("{no")
    with pytest.raises(Exception, match="c.json"):
        loader.load(spark, str(tmp_path / "c.json")).collect()
    with pytest.raises(ValueError, match="unknown format"):
        loader.load(spark, "x", "odd")


def test_registry():
    r = Registry.from_dict({"tools": {"a": {"input_schema": {"properties": {"x": {"x-value-origin": "provided"}}}, "metadata": {"polling": 1, "retryable_errors": ["e"]}}, "b": {"schema": {}, "value_origins": {"y": "generated"}}}})
    assert r.get("a").origins == {"x": "provided"} and r.get("a").flag("polling") and r.get("a").retryable_errors == ["e"]
    assert r.get("b").schema is None and r.get("b").origins == {"y": "generated"} and "c" not in r and len(r) == 2
    made = Registry.from_chat_tools([{"type": "function", "function": {"name": "f", "parameters": {"type": "object"}, "metadata": {"side_effecting": True}}}, {"function": {}}])
    assert made.names() == ["f"] and made.get("f").flag("side_effecting")


def test_stream(spark, tmp_path):
    from stepforge.streaming import lint_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps(T(C("1", "t", {}, raw_text="{"), run_id="s")) + "\n" + json.dumps(T(U("x"))))
    q = lint_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), rules=["R6"])
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["run_id"], r["tier"], r["suppressed_reason"] is None) for r in rows) == [("s", "hard_defect", True), ("t", "candidate", False)]


def test_sql_views(spark):
    from stepforge.plans import sqlviews

    sqlviews.register(loader.from_docs(spark, [T(C("1", "t", {"a": 1}), R("1", 5, "ok"))], "native"), None, "v_")
    assert spark.sql("SELECT s.tool, c.rclass FROM v_steps s JOIN v_calls c USING (trace_key, idx)").collect()[0][:] == ("t", "ok")


def test_folders_hold_lines_and_whole_documents(spark, tmp_path):
    import json

    doc = lambda r: json.dumps({"run_id": r, "steps": []})
    (tmp_path / "many.jsonl").write_text(doc("a") + "\n\n" + doc("b") + "\n")
    (tmp_path / "one.json").write_text(json.dumps({"run_id": "c", "steps": []}, indent=1))
    runs = lambda p: sorted(r["run_id"] for r in loader.load(spark, str(p)).collect())
    assert runs(tmp_path) == runs(tmp_path / "*") == ["a", "b", "c"]
    assert runs(tmp_path / "*.jsonl") == runs(tmp_path / "many.jsonl") == ["a", "b"] and runs(tmp_path / "one.json") == ["c"]


def _batch_of_documents(n, steps):
    texts = [json.dumps(T(*[C(str(i), "t", {"i": i}) for i in range(steps)], run_id=str(r))) for r in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([str(r) for r in range(n)]), pa.array([0] * n, pa.int64()), pa.array(texts)], ["source", "start", "text"])


def _adapted(n, steps):
    return loader.adapted([_batch_of_documents(n, steps)], native.traces, frozenset(), values._arrow(f"struct<{model.TRACE}>"))


def test_traces_leave_a_worker_in_small_batches(spark):
    """F3 to F9: all steps of a batch of 10,000 documents were held at once."""
    out = list(_adapted(40, 1000))
    held = [sum(len(t["steps"]) for t in b.to_pylist()) for b in out]
    assert sum(held) == 40_000 and max(held) < loader.HELD_STEPS + 1000
    assert [k for b in out for k in b.column(0).to_pylist()] == [f"{r}#{0:016d}.{0:09d}.{0:06d}" for r in range(40)]


@pytest.mark.parametrize("fmt", ["openai", "native"])
def test_documents_are_written_in_small_batches(spark, fmt):
    """all steps of a batch of 10,000 traces were held at once."""
    (whole,) = [pa.RecordBatch.from_struct_array(pa.concat_arrays([b.to_struct_array() for b in _adapted(40, 1000)]))]
    out = list(loader.written([whole], fmt))
    assert [json.loads(t)["run_id"] for b in out for t in b.column("text").to_pylist()] == [str(r) for r in range(40)]
    assert max(b.num_rows for b in out) < 10
