"""Registered queries of the document formats, the registry and whole findings, and their DuckDB oracles."""

from __future__ import annotations

import json
import random
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions import predicates, stats
from stepforge.functions.values import json_value
from stepforge.operators import faults, lint, reproduction, rules
from stepforge.plans.catalog import _FOLD, _SIGNAL, DECLARED, EV, _docs, _mixed, _nested, _of, _trace, big, plain, query, rounded, user, views
from stepforge.plans.projections import events, table
from stepforge.registry import Registry, Tool
from stepforge.sources import loader, model, observations


def _traces(s: DataFrame) -> DataFrame:
    """Canonical traces of a table of steps."""
    return faults.as_traces(s.select("trace_key", "run_id").distinct().withColumn("final_json", F.lit(None).cast("string")), s)


def _joined(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _attribute(key: str, kind: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"key":"{key}","value":{{"{kind}":'), value, F.lit("}}"))


# Spans


@query(f"""WITH {EV} SELECT user_id, 't' || (k % 2) AS run_id, 2 * (row_number() OVER (PARTITION BY user_id, k % 2 ORDER BY pos) - 1) + 1 AS idx,
CAST(v AS VARCHAR) AS content FROM ev""")
def otlp_traces(spark, d):
    """Exports of two interleaved traces, with attributes as typed key/value pairs."""
    attrs = [("openinference.span.kind", "stringValue", F.lit('"TOOL"')), ("tool.name", "stringValue", json_value(F.col("tool"))), ("input.value", "stringValue", json_value(F.col("props"))), ("output.value", "intValue", F.col("v").cast("string"))]
    text = F.concat(
        F.lit('{"traceId":"t'), (F.col("k") % 2).cast("string"), F.lit('","spanId":"'), F.col("event_id").cast("string"), F.lit('","startTimeUnixNano":"'),
        F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit('","attributes":['), F.concat_ws(",", *[_attribute(*a) for a in attrs]), F.lit("]}"),
    )
    g = _nested(spark, d, text.alias("text"))
    doc = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":'), _joined(F.transform("all", lambda x: x["text"])), F.lit("}]}]}"))
    s = model.steps_of(loader.adapt(_docs(g, "user_id", doc), "otel")).filter("kind = 'tool_result'")
    return s.select(_of().alias("user_id"), "run_id", *big("idx"), F.col("content_json").alias("content"))


def _span(value: Column) -> Column:
    """A tool span without its closing brace; ``value`` is its recorded input."""
    attrs = F.create_map(F.lit("openinference.span.kind"), F.lit("TOOL"), F.lit("tool.name"), F.col("tool"), F.lit("input.value"), value, F.lit("output.value"), F.col("v").cast("string"))
    return F.concat(F.lit('{"span_id":"'), F.col("event_id").cast("string"), F.lit('","start_time":"'), F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit('","attributes":'), F.to_json(attrs))


@query(f"WITH {EV} SELECT user_id, 2 * pos AS idx, tool FROM ev")
def span_tree(spark, d):
    """Every other span as the child of the one before it."""
    g = _nested(spark, d, _span(F.col("props")).alias("text"))
    at = lambda i: F.get("all", i)["text"]
    two = lambda i: F.when(i + 1 < F.size("all"), F.concat(at(i), F.lit(',"child_spans":['), at(i + 1), F.lit("}]}"))).otherwise(F.concat(at(i), F.lit("}")))
    doc = _joined(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(2)), two))
    s = model.steps_of(loader.adapt(_docs(g, "user_id", doc), "openinference")).filter("kind = 'tool_call'")
    return s.select(_of().alias("user_id"), *big("idx"), "tool")


@query(f"""WITH {EV} SELECT event_id, CASE k % 3 WHEN 0 THEN '{{"k": ' || k || ', "v": 1}}' WHEN 1 THEN '{{"k": ' || k || '}}' ELSE '{{}}' END AS args,
CASE WHEN k % 3 = 2 THEN 'k=' || k END AS raw FROM ev""")
def span_inputs(spark, d):
    """Recorded inputs: positional and named arguments, a Python literal, and text that is neither."""
    k = F.col("k").cast("string")
    value = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"args": [{"k": '), k, F.lit(', "v": 0}], "kwargs": {"v": 1}}'))).when(F.col("k") % 3 == 1, F.concat(F.lit("{'k': "), k, F.lit("}"))).otherwise(F.concat(F.lit("k="), k))
    g = _nested(spark, d, _span(value).alias("text"))
    doc = _joined(F.transform("all", lambda x: F.concat(x["text"], F.lit("}"))))
    s = model.steps_of(loader.adapt(_docs(g, "user_id", doc), "otel")).filter("kind = 'tool_call'")
    return s.select(F.col("call_id").cast("long").alias("event_id"), F.col("args_json").alias("args"), F.col("raw_text").alias("raw"))


def _turns(spark, d) -> DataFrame:
    """(conv_id, heard, said): turns of user and system, and of the assistant, in order."""
    turn = F.struct("turn", "role", "text")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, turn)))
    return table(spark, d, "conversations").groupBy("conv_id").agg(of(F.col("role").isin("user", "system")).alias("heard"), of(F.col("role") == "assistant").alias("said"))


_HEARD_FIRST = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'assistant', turn) - 1 AS idx FROM conversations
  WHERE text <> '' AND role IN ('user', 'system', 'assistant'))"""


def _span_messages(spark, d) -> DataFrame:
    """A model span that records what was heard, and one for each thing said."""
    key = lambda i, field: F.concat(F.lit("llm.input_messages."), i.cast("string"), F.lit(f".message.{field}"))
    part = lambda field, name: F.map_from_entries(F.transform("heard", lambda x, i: F.struct(key(i, field), x[name])))
    kind = F.create_map(F.lit("openinference.span.kind"), F.lit("LLM"))
    first = F.concat(F.lit('{"span_id":"0","start_time":"0","attributes":'), F.to_json(F.map_concat(kind, part("role", "role"), part("content", "text"))), F.lit("}"))
    spoken = lambda x: F.concat(
        F.lit('{"span_id":"1","start_time":"1'), F.lpad(x["turn"].cast("string"), 9, "0"), F.lit('","attributes":'),
        F.to_json(F.map_concat(kind, F.create_map(F.lit("llm.output_messages.0.message.role"), F.lit("assistant"), F.lit("llm.output_messages.0.message.content"), x["text"]))), F.lit("}"),
    )
    doc = _joined(F.concat(F.array(first), F.transform("said", spoken)))
    return loader.adapt(_docs(_turns(spark, d), "conv_id", doc), "openinference")


@query(f"{_HEARD_FIRST} SELECT conv_id, idx, role, length(text) AS n_chars FROM t")
def span_messages(spark, d):
    """Messages rebuilt from indexed attributes of model spans."""
    return model.steps_of(_span_messages(spark, d)).select(_of().alias("conv_id"), *big("idx"), "role", F.length("content").cast("long").alias("n_chars"))


@query("""SELECT conv_id, length(arg_max(text, turn) FILTER (WHERE role = 'assistant' AND text <> '')) AS n_chars FROM conversations GROUP BY conv_id""")
def last_words(spark, d):
    """The final answer of a trace: the last assistant text, if there is any."""
    final = F.get_json_object(F.concat(F.lit('{"x":'), "final_json", F.lit("}")), "$.x")
    return _span_messages(spark, d).select(_of().alias("conv_id"), F.length(final).cast("long").alias("n_chars"))


@query(f"{_HEARD_FIRST} SELECT conv_id, idx, role, length(text) AS n_chars FROM t WHERE role <> 'assistant'")
def genai_messages(spark, d):
    """Messages in parts, as the other vocabulary of spans records them."""
    parts = F.transform("heard", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("content"))).alias("parts")))
    attrs = F.create_map(F.lit("gen_ai.operation.name"), F.lit("chat"), F.lit("gen_ai.input.messages"), F.to_json(parts))
    doc = F.concat(F.lit('[{"span_id":"0","start_time":"0","attributes":'), F.to_json(attrs), F.lit("}]"))
    s = model.steps_of(loader.adapt(_docs(_turns(spark, d), "conv_id", doc), "otel"))
    return s.select(_of().alias("conv_id"), *big("idx"), "role", F.length("content").cast("long").alias("n_chars"))


# Chat and platform


@query(rf"""WITH {EV} SELECT event_id, 'tool_call' AS kind, CASE WHEN k % 3 = 0 THEN '{{"k": ' || k || '}}' ELSE '{{}}' END AS body, CASE k % 3 WHEN 0 THEN '{{"k": ' || k || '}}' WHEN 2 THEN '[1]' END AS detail FROM ev
UNION ALL SELECT event_id, 'tool_result', '"' || v || '\n' || tool || '"', CASE WHEN k % 7 = 3 THEN 'error' ELSE 'unknown' END FROM ev""")
def chat_tools(spark, d):
    """Calls and answers in a message list: arguments as text, content in blocks, a status from the HTTP status."""
    k = F.col("k").cast("string")
    given = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit("}"))).when(F.col("k") % 3 == 2, "[1]").otherwise("")
    call = F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.struct(F.col("tool").alias("name"), given.alias("arguments")).alias("function"))).alias("tool_calls"))
    block = lambda c: F.struct(F.lit("text").alias("type"), c.cast("string").alias("text"))
    answer = F.struct(F.lit("tool").alias("role"), F.col("event_id").cast("string").alias("tool_call_id"), F.array(block(F.col("v")), block(F.col("tool"))).alias("content"), F.when(F.col("k") % 7 == 3, 500).alias("http_status"))
    g = _nested(spark, d, F.concat(F.to_json(call), F.lit(","), F.to_json(answer)).alias("text"))
    doc = F.concat(F.lit('{"messages":'), _joined(F.transform("all", lambda x: x["text"])), F.lit("}"))
    s = model.steps_of(loader.adapt(_docs(g, "user_id", doc), "openai"))
    return s.select(F.col("call_id").cast("long").alias("event_id"), "kind", F.coalesce("args_json", "content_json").alias("body"), F.coalesce("raw_text", "status").alias("detail"))


@query(f"""WITH {EV} SELECT user_id, 2 * pos + 1 AS idx, '"' || v || '"' AS content, 'unknown' AS status FROM ev""")
def chat_export(spark, d):
    """Traces written as message lists and read again: results come back as texts of unknown status."""
    docs = loader.documents(_traces(plain(spark, d)), "openai")
    s = model.steps_of(loader.adapt(docs, "openai")).filter("kind = 'tool_result'")
    return s.select(_of().alias("user_id"), *big("idx"), F.col("content_json").alias("content"), "status")


@query(f"""{_HEARD_FIRST.replace("text <> '' AND", "(text <> '' OR (role = 'assistant' AND turn % 4 = 1)) AND")}
SELECT conv_id, idx, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'tool_call' ELSE 'message' END AS kind, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'look' ELSE role END AS who FROM t""")
def platform_generations(spark, d):
    """Generations of platform traces: their texts, the calls inside some of them, and the turns in a trace's input."""
    heard = F.transform("heard", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    calls = F.lit('{"choices":[{"message":{"tool_calls":[{"id":"c","function":{"name":"look","arguments":"{}"}}]}}]}')
    out = lambda x: F.when(x["turn"] % 4 == 1, calls).otherwise(F.concat(F.lit('{"content":'), json_value(x["text"]), F.lit("}")))
    one = lambda x: F.concat(F.lit('{"type":"GENERATION","startTime":"'), F.lpad(x["turn"].cast("string"), 9, "0"), F.lit('","output":'), out(x), F.lit("}"))
    doc = F.concat(F.lit('{"input":{"messages":'), F.to_json(heard), F.lit('},"observations":'), _joined(F.transform("said", one)), F.lit("}"))
    s = model.steps_of(loader.adapt(_docs(_turns(spark, d), "conv_id", doc), "langfuse"))
    return s.select(_of().alias("conv_id"), *big("idx"), "kind", F.coalesce("role", "tool").alias("who"))


def _observed(spark, d, given: Column) -> DataFrame:
    own = [F.col("event_id").cast("string").alias("id"), F.when(F.col("tool").isin("click", "purchase"), "TOOL").otherwise("SPAN").alias("type"), F.col("tool").alias("name"), given.alias("input"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("startTime")]
    return _docs(_nested(spark, d, *own), "user_id", F.to_json(F.struct(F.col("user_id").alias("id"), F.col("all").alias("observations"))))


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k % 2 = 0 THEN '{{"k": ' || k || '}}' ELSE '{{"v": ' || v || '}}' END AS args FROM ev WHERE tool IN ('click', 'purchase')""")
def platform_inputs(spark, d):
    """Inputs of observed tools that hold positional or named arguments."""
    listed, named = F.when(F.col("k") % 2 == 0, F.array(F.struct("k"))).otherwise(F.expr("CAST(array() AS array<struct<k:bigint>>)")), F.when(F.col("k") % 2 == 1, F.struct("v"))
    s = model.steps_of(loader.adapt(_observed(spark, d, F.struct(listed.alias("args"), named.alias("kwargs"))), "langfuse"))
    return s.filter("kind = 'tool_call'").select(F.col("call_id").cast("long").alias("event_id"), F.col("args_json").alias("args"))


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tools FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id""")
def discovered_tools(spark, d):
    """The tools that a platform's traces show, without reading them into steps."""
    t = _observed(spark, d, F.struct("k")).select(F.col("source").cast("long").alias("user_id"), F.array_join(observations.discovered(F.col("text")), ",").alias("tools"))
    return t.filter("tools <> ''")


@query("""SELECT conv_id, length(arg_min(text, turn) FILTER (WHERE role = 'user')) AS n_chars FROM conversations GROUP BY conv_id""")
def first_user_turn(spark, d):
    """What the user asked first."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    t = loader.adapt(_docs(g, "conv_id", F.to_json(F.struct("messages"))), "openai")
    return t.select(_of().alias("conv_id"), F.length(model.first_asked()).cast("long").alias("n_chars"))


# Files


def _folder(spark) -> str:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="stepforge-")


@query("SELECT user_id, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY user_id")
def lint_folder(spark, d):
    """Traces written as a folder of JSON lines, loaded and checked in one call: unknown tools of each run."""
    where = f"{_folder(spark)}/stepforge-{uuid.uuid4().hex}"
    loader.documents(_traces(plain(spark, d))).select("text").write.text(f"{where}/traces.jsonl")
    f = lint.lint_file(spark, f"{where}/traces.jsonl", "native", DECLARED, ["R7"])
    return lint.active(f).groupBy(F.col("run_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n_errors"))


# Registry and predicates


@query("""SELECT n_name AS tool, n_regionkey = 1 AS side_effecting, n_regionkey = 2 AS polling, CAST(n_nationkey % 3 AS BIGINT) AS n_provided, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_closed,
n_nationkey % 5 = 0 AS has_failure, n_nationkey = 7 AS has_problem FROM nation""")
def registry_rows(spark, d):
    """Declarations as rows: flags, origins of values, closed choices, failure conditions, schemas that can't be used."""
    declared = {}
    for r in table(spark, d, "nation").collect():
        props = {f"p{i}": {"x-value-origin": "provided"} for i in range(r["n_nationkey"] % 3)} | ({"c": {"enum": [1]}} if r["n_nationkey"] % 2 == 0 else {})
        meta = {"side_effecting": r["n_regionkey"] == 1, "polling": r["n_regionkey"] == 2} | ({"failure_when": {"pointer": "/x"}} if r["n_nationkey"] % 5 == 0 else {})
        declared[r["n_name"]] = {"schema": {"properties": props} | ({"type": "odd"} if r["n_nationkey"] == 7 else {}), "metadata": meta}
    names = sorted(declared)
    whole = Registry.from_dict({"tools": {n: declared[n] for n in names[:13]}})
    for t in Registry.from_chat_tools([{"function": {"name": n, "parameters": declared[n]["schema"], "metadata": declared[n]["metadata"]}} for n in names[13:]]).tools.values():
        whole.add(t)
    n = lambda c: F.size(c).cast("long")
    return whole.frame(spark).select("tool", "side_effecting", "polling", n("provided").alias("n_provided"), n("closed").alias("n_closed"), F.col("failure_json").isNotNull().alias("has_failure"), F.col("schema_problem").isNotNull().alias("has_problem"))


@query(f"WITH {EV} SELECT event_id, '/a/1/b~1c=' || k AS shown FROM ev WHERE k % 10 IN (3, 5)")
def predicate_text(spark, d):
    """What a declared failure says of itself, through lists and escaped names."""
    pred = F.lit(json.dumps(predicates.compiled({"pointer": "/a/1/b~1c", "matches": "[35]$"})))
    e = events(spark, d).withColumn("shown", predicates.declared_failure(F.concat(F.lit('{"a": [0, {"b/c": '), F.col("k").cast("string"), F.lit("}]}")), pred))
    return e.filter("shown IS NOT NULL").select("event_id", "shown")


# Whole findings

_CHECKED = Registry([Tool("purchase", {"properties": {"k": {"minimum": 5, "maximum": 49, "multipleOf": 2}}}), Tool("click", {"type": "odd"}), Tool("view")])


@query(f"""WITH {EV}, c AS (SELECT * FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE tool IN ('purchase', 'click')))
SELECT event_id, tool, 'hard_defect' AS tier, '''purchase'' call violates its schema (' || n || CASE n WHEN 1 THEN ' error: ' ELSE ' errors: ' END || words || ')' AS summary FROM (
  SELECT *, (k < 5)::INT + (k > 49)::INT + (k % 2 = 1)::INT AS n, array_to_string(list_filter([CASE WHEN k > 49 THEN 'maximum' END, CASE WHEN k < 5 THEN 'minimum' END, CASE WHEN k % 2 = 1 THEN 'multipleOf' END], lambda x: x IS NOT NULL), ', ') AS words
  FROM c WHERE tool = 'purchase') WHERE n > 0
UNION ALL SELECT event_id, tool, 'candidate', 'rule R1 suppressed for call ' || event_id || ': ' || CASE WHEN tool = 'click' THEN 'tool ''click'' has an invalid JSON Schema: ''odd'' is not valid under any of the given schemas' ELSE 'no schema for tool ''' || tool || '''' END
FROM c WHERE tool <> 'purchase'""")
def r1_findings(spark, d):
    """Rule R1 with declared, missing and unusable schemas."""
    f = rules.r1(views(plain(spark, d), _CHECKED, "R1"))
    return f.select(F.get_json_object("evidence_json", "$.call_id").cast("long").alias("event_id"), F.get_json_object("evidence_json", "$.tool").alias("tool"), "tier", "summary")


_SOURCED = """s AS (SELECT user_id, v, min(pos) AS since FROM ev {where} GROUP BY ALL), x AS (SELECT e.* FROM ev e
  LEFT JOIN s x ON x.user_id = e.user_id AND x.v = e.k AND x.since < e.pos LEFT JOIN s a ON a.user_id = e.user_id AND a.v = e.k // 10 AND a.since < e.pos
  LEFT JOIN s b ON b.user_id = e.user_id AND b.v = e.k % 10 AND b.since < e.pos WHERE e.k >= 10 AND x.v IS NULL AND (a.v IS NULL OR b.v IS NULL))"""


@query(f"""WITH {EV}, {_SOURCED.format(where="")} SELECT event_id, 2 * pos AS idx, 'candidate' AS tier, 'argument ''k''=' || k || ' to ''' || tool || ''' is not derivable from anything the agent observed' AS summary,
'k' AS field, CAST(k AS VARCHAR) AS value FROM x""")
def r3_findings(spark, d):
    """Rule R3: arguments that follow from nothing the agent saw."""
    s = plain(spark, d)
    f = rules.r3(views(s, None, "R3")).select("trace_key", F.col("step_indices")[0].alias("idx"), "tier", "summary", F.get_json_object("evidence_json", "$.field").alias("field"), F.get_json_object("evidence_json", "$.value").alias("value"))
    return f.join(s.select("trace_key", "idx", F.col("call_id").cast("long").alias("event_id")), ["trace_key", "idx"]).select("event_id", *big("idx"), "tier", "summary", "field", "value")


@query(f"""WITH RECURSIVE {EV}, {_FOLD.format(key="k % 10", body="1")} SELECT user_id, 2 * first AS first_idx, 2 * again AS again_idx, '''' || tool || ''' repeats an earlier call with the same arguments and result, and no mutating call came between'
  || CASE WHEN EXISTS (SELECT 1 FROM ev u WHERE u.user_id = f.user_id AND u.tool = 'error' AND u.pos > f.first AND u.pos < f.again) THEN ' (unverified: undeclared tool(s) ''error'' ran between — declare whether they have side effects)' ELSE '' END AS summary
FROM fold f WHERE again IS NOT NULL""")
def r5_findings(spark, d):
    """Rule R5, with the tools between that nothing declares."""
    s = plain(spark, d, args_json=F.concat(F.lit('{"k": '), (F.col("k") % 10).cast("string"), F.lit("}")), content_json=F.lit("1"))
    return rules.r5(views(s, DECLARED, "R5")).select(user(), F.col("step_indices")[0].cast("long").alias("first_idx"), F.col("step_indices")[1].cast("long").alias("again_idx"), "summary")


_LINTED = f"""WITH RECURSIVE {EV}, m AS (SELECT *, CASE WHEN tool = 'error' THEN 'error' WHEN k % 2 = 1 THEN 'ok' ELSE 'unknown' END AS status,
  CASE WHEN k % 3 = 0 AND tool <> 'purchase' THEN '[]' ELSE CAST(v AS VARCHAR) END AS body,
  CASE WHEN tool = 'purchase' AND {_SIGNAL} = 'empty_result' THEN NULL ELSE {_SIGNAL} END AS signal FROM ev),
per AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id),
{_SOURCED.format(where="WHERE NOT (k % 3 = 0 AND tool <> 'purchase')")},
y AS (SELECT *, CASE WHEN tool = 'error' THEN 'error' WHEN body = '[]' THEN 'empty' ELSE 'ok' END AS class FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, tool, k, class ORDER BY pos) AS grp FROM y),
{_FOLD.format(key="k || '/' || CASE WHEN tool = 'error' THEN 'error' WHEN k % 2 = 1 THEN 'ok' ELSE 'unknown' END", body="CASE WHEN k % 3 = 0 AND tool <> 'purchase' THEN '[]' ELSE CAST(v AS VARCHAR) END")},
found AS (
  SELECT 'R1' AS rule, 'candidate' AS tier, true AS suppressed FROM per
  UNION ALL SELECT 'R2a', CASE WHEN signal IN ('structured', 'failure_predicate') THEN 'hard_event' ELSE 'candidate' END, signal = 'unverified' FROM m WHERE signal IS NOT NULL
  UNION ALL SELECT 'R2b', 'candidate', false FROM m WHERE signal IN ('structured', 'failure_predicate') AND NOT EXISTS (SELECT 1 FROM ev z WHERE z.user_id = m.user_id AND z.tool = m.tool AND z.pos > m.pos)
  UNION ALL SELECT 'R3', 'candidate', false FROM x
  UNION ALL SELECT 'R4', 'candidate', false FROM (SELECT 1 FROM g WHERE tool <> 'click' GROUP BY user_id, tool, k, class, grp HAVING count(*) >= 3)
  UNION ALL SELECT 'R4', 'candidate', true FROM per WHERE n < 3
  UNION ALL SELECT 'R5', 'candidate', false FROM fold WHERE again IS NOT NULL
  UNION ALL SELECT 'R5', 'candidate', true FROM per WHERE n < 2
  UNION ALL SELECT 'R7', 'candidate', false FROM ev WHERE tool = 'error')
SELECT rule, tier, suppressed, count(*) AS n FROM found GROUP BY ALL"""


@query(_LINTED)
def lint_all_rules(spark, d):
    """All eight checks in one pass; counts by rule, tier and whether they could run."""
    f = lint.lint_steps(_mixed(spark, d), DECLARED)
    return f.groupBy("rule", "tier", F.col("suppressed_reason").isNotNull().alias("suppressed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, f AS (SELECT user_id, 0 AS ord, 'R7' AS rule, 2 * pos AS idx FROM ev WHERE tool = 'error' UNION ALL SELECT user_id, 1, 'R2a', 2 * pos + 1 FROM ev WHERE tool = 'error' OR (tool = 'purchase' AND v IN (7, 11, 13)))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ord, idx) - 1 AS nth, rule, idx FROM f""")
def finding_order(spark, d):
    """Findings of a trace in the order of the rules asked for, then of the steps."""
    f = lint.numbered(lint.lint_steps(plain(spark, d), DECLARED, ["R7", "R2a"])).filter("suppressed_reason IS NULL")
    return f.select(user(), *big("nth"), "rule", F.col("step_indices")[0].cast("long").alias("idx"))


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS runs, count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS hits FROM events)
SELECT 'R7' AS rule, hits AS "count", runs, round(CAST(hits AS DOUBLE) / runs, 9) AS rate, hits < runs AS flaky FROM n WHERE hits > 0""")
def lint_runs(spark, d):
    """Repeated runs checked and rolled up in one call."""
    r = reproduction.lint_runs(_traces(plain(spark, d)), DECLARED, ["R7"])
    return rounded(r.select("rule", *big("count", "runs"), "rate", "flaky"), "rate")


@query("SELECT user_id, count(*) AS n_calls FROM events GROUP BY user_id HAVING count(*) > 60")
def custom_rule(spark, d):
    """A check written for one trace at a time: traces of more than sixty calls."""
    own = lint.trace_rule("X1", "long_trace", lambda doc: [{"summary": str(n)} for n in [sum(s["type"] == "tool_call" for s in doc["steps"])] if n > 60])
    return lint.lint(_traces(plain(spark, d)), None, [own]).select(user(), F.col("summary").cast("long").alias("n_calls"))


# Faults and intervals


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k % 10 = 0 THEN '[]' WHEN k % 10 = 1 THEN '"rate limited"' ELSE CAST(v AS VARCHAR) END AS content,
CASE WHEN k % 10 = 1 OR (tool = 'error' AND k % 10 <> 0) THEN 'error' ELSE 'ok' END AS status FROM ev""")
def fault_custom(spark, d):
    """A plan of one's own: faults by what the arguments say."""
    k = F.get_json_object("args_json", "$.k").cast("long") % 10
    plan = lambda calls: calls.withColumn("fault", F.when(k == 0, "empty").when(k == 1, "rate_limit"))
    s = faults.injected(plain(spark, d), plan).filter("kind = 'tool_result'")
    return s.select(F.col("call_id").cast("long").alias("event_id"), F.col("content_json").alias("content"), "status")


_PLAN = ["timeout", "error", "empty"]


def _drawn(n: int) -> str:
    """The faults of a trace's first calls as a list in SQL: the draws of Python's generator, which SQL doesn't have."""
    rng = random.Random(7)
    return repr([_PLAN[rng.randrange(3)] if rng.random() < 0.3 else "none" for _ in range(n)])


@query(f"WITH {EV} SELECT {_drawn(4096)}[pos + 1] AS fault, count(*) AS n FROM ev GROUP BY 1")
def fault_random(spark, d):
    """Faults on three calls in ten, from a generator seeded for each trace."""
    c = faults.random_plan(faults.with_ordinals(plain(spark, d)), _PLAN, 0.3, 7)
    return c.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH v AS (SELECT n_regionkey, list_sort(list(n)) AS v FROM (SELECT n_regionkey, n_nationkey, CAST(count(c_custkey) AS DOUBLE) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY ALL),
m AS (SELECT n_regionkey, list_sort(list((v[a] + v[b] + v[c] + v[d] + v[e]) / 5)) AS m FROM v, (SELECT {", ".join(f"CAST(substr(s, 5 * i + {j + 1}, 1) AS INT) + 1 AS {x}" for j, x in enumerate("abcde"))}
  FROM (SELECT '{"".join(map(str, stats.Draws(0).below(5, 10_000)))}' AS s), range(2000) AS r(i)) GROUP BY n_regionkey)
SELECT n_regionkey, round(m[51], 9) AS low, round(m[1951], 9) AS high FROM m""")
def bootstrap_by_region(spark, d):
    """Seeded bootstrap of the mean number of customers of a region's five nations, 2000 resamples."""
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("c_custkey").alias("n"))
    return rounded(stats.bootstrap_by(n, "n_regionkey", "n"), "low", "high")
