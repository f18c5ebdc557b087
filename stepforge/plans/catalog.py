"""Registered queries of the trace engine and their DuckDB oracles.

Every query applies an operator of the library to the whole of a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from stepforge import agents, reliability
from stepforge.functions import jsonschema, predicates, stats
from stepforge.functions.values import json_object, json_value
from stepforge.operators import faults, lint, pairing, provenance, reproduction, rules
from stepforge.plans.projections import conversation_steps, events, loose_steps, steps, table
from stepforge.registry import Registry, Tool
from stepforge.sources import loader, model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What is declared about the tools that event types stand for.
DECLARED = Registry(
    [
        Tool("purchase", None, {"side_effecting": True, "failure_when": {"pointer": "", "in": [7, 11, 13]}}),
        Tool("signup", None, {"side_effecting": True}),
        Tool("click", None, {"polling": True}),
        Tool("view"),
    ]
)
EV = """ev AS (SELECT user_id, event_id, ts, event_type AS tool, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def user() -> Column:
    return F.col("trace_key").cast("long").alias("user_id")




def big(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def query(sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def views(s: DataFrame, registry: Registry | None = None, *ids: str) -> rules.Views:
    """The views of a table of steps, for the rules named or for all."""
    return rules.Views(None, registry or Registry(), s, rules.needed(rules.selected(list(ids))))


def plain(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return steps(events(spark, sf_dir), **columns)


# Steps and pairing


@query(f"""WITH {EV} SELECT user_id, 2 * pos + h AS idx, CASE h WHEN 0 THEN 'tool_call' ELSE 'tool_result' END AS kind, event_id
FROM ev, (VALUES (0), (1)) AS t(h)""")
def steps_index(spark, d):
    """Positions of the steps of every trace."""
    return plain(spark, d).select(user(), *big("idx"), "kind", F.col("call_id").cast("long").alias("event_id"))


_LOOSE = f"""{EV}, c AS (SELECT * FROM ev WHERE tool IN ('view', 'click')), r AS (SELECT * FROM ev WHERE tool NOT IN ('view', 'click'))"""


@query(f"""WITH {_LOOSE} SELECT c.user_id, c.pos AS idx, r.pos AS result_idx FROM c
ASOF LEFT JOIN r ON c.user_id = r.user_id AND c.k % 20 = r.k % 20 AND c.pos < r.pos""")
def pair_result_for(spark, d):
    """For every call the first later result with its id."""
    p = pairing.paired(pairing.derived(loose_steps(events(spark, d)))).filter("kind = 'tool_call'")
    return p.select(user(), *big("idx"), F.col("got.idx").cast("long").alias("result_idx"))


@query(f"""WITH {_LOOSE} SELECT r.user_id, r.pos AS idx, c.pos AS call_idx, c.tool AS tool FROM r
ASOF LEFT JOIN c ON c.user_id = r.user_id AND c.k % 20 = r.k % 20 AND c.pos < r.pos""")
def pair_call_for(spark, d):
    """For every result the latest earlier call with its id."""
    p = pairing.paired(pairing.derived(loose_steps(events(spark, d)))).filter("kind = 'tool_result'")
    return p.select(user(), *big("idx"), F.col("for_call.idx").cast("long").alias("call_idx"), F.col("for_call.tool").alias("tool"))


# Predicates over results


@query(f"""WITH {EV} SELECT tool, count(*) AS n_results, count(*) FILTER (WHERE tool = 'error' OR k % 7 = 3 OR k % 11 = 5) AS n_failed FROM ev GROUP BY tool""")
def structured_error(spark, d):
    """Results that declare an error, by status, HTTP status or error text."""
    s = plain(spark, d, http_status=F.when(F.col("k") % 7 == 3, 503).otherwise(200), error=F.when(F.col("k") % 11 == 5, ""))
    failed = pairing.structured_error(F.col("status"), F.col("http_status"), F.col("error"))
    r = s.withColumn("of", F.lag("tool").over(_trace())).filter("kind = 'tool_result'")
    return r.groupBy(F.col("of").alias("tool")).agg(F.count(F.lit(1)).alias("n_results"), F.count(F.when(failed, 1)).alias("n_failed"))


def _trace() -> WindowSpec:
    return Window.partitionBy("trace_key").orderBy("idx")


_BODIES = ["null", '""', '"No results"', "[]", "{}", '" 0 result "', '"not found."', "0"]


@query(f"""WITH {EV} SELECT k % 8 AS shape, count(*) AS n, count(*) FILTER (WHERE k % 8 < 6) AS n_empty FROM ev GROUP BY 1""")
def looks_empty(spark, d):
    """Results that hold nothing or say so."""
    s = steps(events(spark, d), content_json=F.element_at(F.array(*map(F.lit, _BODIES)), (F.col("k") % 8 + 1).cast("int")), error=F.col("k").cast("string"))
    r = pairing.derived(s.filter("kind = 'tool_result'"))
    return r.groupBy((F.col("error").cast("long") % 8).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("c.nothing"), 1)).alias("n_empty"))


_TEXT = """CASE k % 5 WHEN 0 THEN 'ValueError: ' || k WHEN 1 THEN 'Failed to read' WHEN 2 THEN 'got HTTP 503' WHEN 3 THEN 'terrorist errors unfailing' ELSE 'no exception here' END"""


@query(f"""WITH {EV} SELECT event_id, CASE k % 5 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'Failed' WHEN 2 THEN 'HTTP 503' WHEN 4 THEN 'exception' END AS marker FROM ev""")
def exception_marker(spark, d):
    """The word of a result's text that speaks of an exception."""
    return events(spark, d).withColumn("t", F.expr(_TEXT)).select("event_id", rules.exception_marker(F.col("t")).alias("marker"))


@query("""SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS found, json_extract_string(props, '$.k') AS value FROM events""")
def pointer_extract(spark, d):
    """A value by JSON pointer."""
    p = predicates.pointer_value(F.col("props"), "/k")
    return table(spark, d, "events").withColumn("p", p).select("event_id", "p.found", "p.value")


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _predicate(name: str, declared: dict, sql: str) -> None:
    @query(f"SELECT event_id FROM events WHERE {sql}")
    def run(spark, d):
        pred = F.lit(json.dumps(predicates.compiled(declared)))
        return table(spark, d, "events").filter(predicates.declared_failure(F.col("props"), pred).isNotNull()).select("event_id")

    del QUERIES["run"]
    QUERIES[name], ORACLES[name] = run, ORACLES.pop("run")


_predicate("predicate_in", {"pointer": "/k", "in": [3, 5.0, "7"]}, f"{_K} IN (3, 5)")
_predicate("predicate_equals", {"pointer": "/k", "equals": 69}, f"{_K} = 69")
_predicate("predicate_contains", {"pointer": "/k", "contains": "9"}, f"contains(CAST({_K} AS VARCHAR), '9')")
_predicate("predicate_matches", {"pointer": "", "matches": r'"k": 1\d}'}, f"{_K} BETWEEN 10 AND 19")
_predicate("predicate_exists", {"pointer": "/k"}, "json_extract_string(props, '$.k') IS NOT NULL")

# R1

_ORDER_SCHEMA = {
    "type": "object",
    "required": ["status", "total", "priority"],
    "additionalProperties": False,
    "properties": {
        "status": {"enum": ["F", "O"]},
        "total": {"type": "number", "minimum": 1000, "exclusiveMaximum": 200000},
        "priority": {"type": "string", "pattern": "^[1-3]-", "maxLength": 8},
    },
}


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter([
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'enum' END, CASE WHEN o_totalprice < 1000 THEN 'minimum' END,
  CASE WHEN o_totalprice >= 200000 THEN 'exclusiveMaximum' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'pattern' END,
  CASE WHEN length(o_orderpriority) > 8 THEN 'maxLength' END], lambda x: x IS NOT NULL)), ',') AS keywords FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') OR o_totalprice < 1000 OR o_totalprice >= 200000 OR NOT regexp_matches(o_orderpriority, '^[1-3]-') OR length(o_orderpriority) > 8""")
def r1_flat_schema(spark, d):
    """Orders as calls of one tool, checked against its schema."""
    o = table(spark, d, "orders")
    args = json_object(status=json_value(F.col("o_orderstatus")), total=json_value(F.col("o_totalprice")), priority=json_value(F.col("o_orderpriority")))
    e = jsonschema.schema_errors(args, F.lit(json.dumps(_ORDER_SCHEMA)))
    bad = o.select("o_orderkey", e.alias("errors")).filter("size(errors) > 0")
    return bad.select("o_orderkey", F.array_join(F.array_sort(F.transform("errors", lambda x: x["keyword"])), ",").alias("keywords"))


# R2

_SIGNAL = """CASE WHEN tool = 'error' THEN 'structured' WHEN tool = 'purchase' AND v IN (7, 11, 13) THEN 'failure_predicate'
  WHEN tool = 'signup' AND k % 2 = 0 THEN 'unverified' WHEN k % 2 = 1 THEN NULL WHEN k % 3 = 0 THEN 'empty_result' END"""


def _mixed(spark, d) -> DataFrame:
    """Results of unknown status where k is even, empty where 3 divides it."""
    body = F.when((F.col("k") % 3 == 0) & (F.col("tool") != "purchase"), "[]").otherwise(F.col("v").cast("string"))
    return plain(spark, d, content_json=body, status=F.when(F.col("tool") == "error", "error").when(F.col("k") % 2 == 1, "ok").otherwise("unknown"))


def _ladder(spark, d) -> DataFrame:
    f = rules.r2a(views(_mixed(spark, d), DECLARED, "R2a"))
    signal = F.when(F.col("suppressed_reason").isNotNull(), "unverified").otherwise(F.get_json_object("evidence_json", "$.signal"))
    return f.groupBy(F.get_json_object("evidence_json", "$.tool").alias("tool"), signal.alias("signal"), "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, s AS (SELECT *, CASE WHEN tool = 'purchase' AND {_SIGNAL} = 'empty_result' THEN NULL ELSE {_SIGNAL} END AS signal FROM ev)
SELECT tool, signal, CASE WHEN signal IN ('structured', 'failure_predicate') THEN 'hard_event' ELSE 'candidate' END AS tier, count(*) AS n
FROM s WHERE signal IS NOT NULL GROUP BY ALL""")
def r2a_ladder(spark, d):
    """Tool errors by the first signal that shows them."""
    return _ladder(spark, d)


# calls reuse a value if their k, scaled, is the value of an earlier error
_R2B = f"""{EV}, f AS (SELECT user_id, tool, pos, v FROM ev WHERE tool = 'error' OR (tool = 'purchase' AND v IN (7, 11, 13))),
n AS (SELECT f.user_id, f.tool, f.pos, f.v, min(c.pos) AS consumer FROM f LEFT JOIN ev c ON c.user_id = f.user_id AND c.pos > f.pos AND c.k + 100 = f.v AND f.v >= 100 GROUP BY ALL),
b AS (SELECT n.*, c.tool AS consumer_tool, EXISTS (SELECT 1 FROM ev x WHERE x.user_id = n.user_id AND x.tool = n.tool AND x.pos > n.pos) AS retried
  FROM n LEFT JOIN ev c ON c.user_id = n.user_id AND c.pos = n.consumer)"""


def _reuse(spark, d) -> DataFrame:
    return plain(spark, d, args_json=F.concat(F.lit('{"k": '), (F.col("k") + 100).cast("string"), F.lit("}")))


@query(f"""WITH {_R2B} SELECT user_id, 2 * pos + 1 AS idx, 2 * consumer AS consumer_idx, consumer_tool, consumer_tool IN ('purchase', 'signup') AS acts,
CAST(v AS VARCHAR) AS consumed FROM b WHERE consumer IS NOT NULL""")
def r2b_consumption(spark, d):
    """Failed results whose values a later call uses."""
    c = rules.consumption(views(_reuse(spark, d), DECLARED, "R2b")).filter("consumer IS NOT NULL")
    return c.select(user(), *big("idx"), F.col("consumer").cast("long").alias("consumer_idx"), "consumer_tool", "acts", F.array_join("consumed", ",").alias("consumed"))


@query(f"""WITH {_R2B} SELECT user_id, 2 * pos + 1 AS idx, tool FROM b WHERE consumer IS NULL AND NOT retried""")
def r2b_not_retried(spark, d):
    """Failed results that nothing used and whose tool was not called again."""
    f = rules.r2b(views(_reuse(spark, d), DECLARED, "R2b")).filter("evidence_json LIKE '%not_retried%'")
    return f.select(user(), F.col("step_indices")[0].cast("long").alias("idx"), F.get_json_object("evidence_json", "$.tool").alias("tool"))


# R3


@query(f"""WITH {EV}, s AS (SELECT user_id, v, min(pos) AS since FROM ev GROUP BY ALL)
SELECT e.user_id, 2 * e.pos AS idx, CASE WHEN e.k < 10 THEN 'trivial' WHEN x.since < e.pos THEN 'exact'
  WHEN a.since < e.pos AND b.since < e.pos THEN 'concat' END AS operation
FROM ev e LEFT JOIN s x ON x.user_id = e.user_id AND x.v = e.k LEFT JOIN s a ON a.user_id = e.user_id AND a.v = e.k // 10
LEFT JOIN s b ON b.user_id = e.user_id AND b.v = e.k % 10""")
def r3_ladder(spark, d):
    """How each argument follows from earlier results: itself, or glued from two of them."""
    return provenance.derivations(views(plain(spark, d), None, "R3")).select(user(), *big("idx"), "operation")


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, regexp_extract(text, '[A-Za-z]{4,}', 0) AS word FROM conversations)
SELECT conv_id, turn, CASE WHEN length(word) < 2 THEN 'trivial' WHEN EXISTS (SELECT 1 FROM c s WHERE s.conv_id = c.conv_id AND s.turn < c.turn
  AND s.role IN ('user', 'system') AND contains(replace(lower(s.text), 'ß', 'ss'), lower(c.word))) THEN 'substring' END AS operation
FROM c WHERE role = 'assistant'""")
def r3_substring(spark, d):
    """Whether what an assistant quotes stands in an earlier message of user or system."""
    x = provenance.derivations(views(conversation_steps(spark, d), None, "R3"))
    return x.select(F.col("trace_key").cast("long").alias("conv_id"), (F.col("idx") / 2).cast("long").alias("turn"), "operation")


@query(f"""WITH {EV}, s AS (SELECT user_id, v, min(pos) AS since FROM ev GROUP BY ALL)
SELECT e.user_id, 2 * e.pos AS idx, CASE WHEN x.since < e.pos THEN 'digits' END AS operation
FROM ev e LEFT JOIN s x ON x.user_id = e.user_id AND x.v = e.k WHERE e.k >= 10""")
def r3_digits(spark, d):
    """Arguments written in another format than the value they come from."""
    args = F.concat(F.lit('{"ref": "no-'), F.col("k").cast("string"), F.lit('."}'))
    s = plain(spark, d, args_json=F.when(F.col("k") >= 10, args).otherwise("{}"))
    x = provenance.derivations(views(s, None, "R3"))
    return x.select(user(), *big("idx"), "operation")


# R4, R5

_ISLANDS = """g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, tool, class ORDER BY pos) AS grp FROM x),
i AS (SELECT user_id, tool, class, grp, min(pos) AS first, max(pos) AS last, count(*) AS repeats FROM g GROUP BY ALL HAVING count(*) >= 3)"""


def _loops(f: DataFrame) -> DataFrame:
    return f.select(
        user(), F.get_json_object("evidence_json", "$.tool").alias("tool"), F.get_json_object("evidence_json", "$.result_class").alias("result_class"),
        F.col("step_indices")[0].cast("long").alias("first_idx"), F.size("step_indices").cast("long").alias("repeats"),
    )


@query(f"""WITH {EV}, x AS (SELECT *, CASE WHEN tool = 'error' THEN 'error' ELSE 'ok' END AS class FROM ev), {_ISLANDS}
SELECT user_id, tool, class AS result_class, 2 * first AS first_idx, repeats FROM i""")
def r4_loops(spark, d):
    """Runs of three and more equal calls with one class of result."""
    return _loops(rules.r4(views(plain(spark, d, args_json=F.lit("{}")), None, "R4")))


@query(f"""WITH {EV}, x AS (SELECT *, CASE WHEN tool = 'error' THEN 'error' WHEN tool <> 'view' THEN 'ok' WHEN k % 10 < 8 THEN 'status:pending' ELSE 'status:done' END AS class FROM ev), {_ISLANDS}
SELECT user_id, tool, class AS result_class, 2 * first AS first_idx, repeats FROM i WHERE tool <> 'click' AND NOT (class = 'status:pending'
  AND EXISTS (SELECT 1 FROM x WHERE x.user_id = i.user_id AND x.tool = i.tool AND x.pos > i.last AND x.class <> i.class))""")
def r4_polls_excluded(spark, d):
    """Loops without declared polls and without runs that waited and then went on."""
    state = F.when(F.col("k") % 10 < 8, '{"status": "Pending"}').otherwise('{"status": "done"}')
    s = plain(spark, d, args_json=F.lit("{}"), content_json=F.when(F.col("tool") == "view", state).otherwise("1"))
    return _loops(rules.r4(views(s, DECLARED, "R4")))


#: Folds calls of one tool, ``key`` and ``body`` in order: the anchor, and each repeat with the anchor it repeats.
_FOLD = """acting AS (SELECT *, (tool IN ('purchase', 'signup'))::INT AS own, sum((tool IN ('purchase', 'signup'))::INT) OVER (PARTITION BY user_id ORDER BY pos) AS acts FROM ev),
c AS (SELECT *, {key} AS kk, {body} AS bb, row_number() OVER (PARTITION BY user_id, tool, {key}, {body} ORDER BY pos) AS seq FROM acting),
fold AS (SELECT user_id, tool, kk, bb, seq, pos AS anchor, acts AS anchor_acts, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS again FROM c WHERE seq = 1
  UNION ALL SELECT c.user_id, c.tool, c.kk, c.bb, c.seq,
    CASE WHEN c.pos - f.anchor > 1 AND c.acts - c.own <= f.anchor_acts THEN c.pos ELSE f.anchor END,
    CASE WHEN c.pos - f.anchor > 1 AND c.acts - c.own <= f.anchor_acts THEN c.acts ELSE f.anchor_acts END,
    CASE WHEN c.pos - f.anchor > 1 AND c.acts - c.own <= f.anchor_acts THEN f.anchor END,
    CASE WHEN c.pos - f.anchor > 1 AND c.acts - c.own <= f.anchor_acts THEN c.pos END
  FROM fold f JOIN c ON c.user_id = f.user_id AND c.tool = f.tool AND c.kk = f.kk AND c.bb = f.bb AND c.seq = f.seq + 1)"""


@query(f"""WITH RECURSIVE {EV}, {_FOLD.format(key="k % 10", body="1")}
SELECT user_id, tool, 2 * first AS first_idx, 2 * again AS again_idx FROM fold WHERE again IS NOT NULL""")
def r5_redundant(spark, d):
    """Calls that repeat an earlier one with the same result and no mutation in between."""
    s = plain(spark, d, args_json=F.concat(F.lit('{"k": '), (F.col("k") % 10).cast("string"), F.lit("}")), content_json=F.lit("1"))
    f = rules.repeats(views(s, DECLARED, "R5").calls)
    return f.select(user(), "tool", F.col("first.idx").cast("long").alias("first_idx"), F.col("again.idx").cast("long").alias("again_idx"))


# R6, R7


@query(f"""WITH {EV} SELECT event_id, tool FROM ev WHERE k % 4 IN (1, 2)""")
def r6_malformed(spark, d):
    """Calls whose emitted arguments are no JSON object."""
    raw = F.when(F.col("k") % 4 == 1, F.expr("left(props, length(props) - 1)")).when(F.col("k") % 4 == 2, F.lit("[1]")).when(F.col("k") % 4 == 3, F.lit("")).otherwise(F.lit("{}"))
    f = rules.r6(views(plain(spark, d, args_json=F.lit("{}"), raw_text=raw), None, "R6"))
    return f.select(F.get_json_object("evidence_json", "$.call_id").cast("long").alias("event_id"), F.get_json_object("evidence_json", "$.tool").alias("tool"))


@query("SELECT event_id, event_type AS tool FROM events WHERE event_type NOT IN ('purchase', 'signup', 'click', 'view')")
def r7_unknown_tool(spark, d):
    """Calls of tools that nothing declares."""
    f = rules.r7(views(plain(spark, d), DECLARED, "R7"))
    return f.select(F.get_json_object("evidence_json", "$.call_id").cast("long").alias("event_id"), F.get_json_object("evidence_json", "$.tool").alias("tool"))


# Reports


@query("""WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT 'R1' AS rule, count(*) AS n FROM n UNION ALL SELECT 'R4', count(*) FROM n WHERE n < 3
UNION ALL SELECT 'R5', count(*) FROM n WHERE n < 2 UNION ALL SELECT 'R7', count(*) FROM n""")
def suppressions_by_rule(spark, d):
    """Checks that could not run, over the traces of each user and day; all of R2, R3 and R6 can."""
    s = steps(events(spark, d, F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))))
    f = lint.lint_steps(s, None, ["R1", "R4", "R5", "R7"])
    return lint.suppressions(f).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_FOUND = f"""{_R2B}, found AS (
  SELECT user_id, 'R2a' AS rule, 'hard_event' AS tier FROM f
  UNION ALL SELECT user_id, 'R2b', CASE WHEN consumer_tool IN ('purchase', 'signup') THEN 'hard_defect' ELSE 'candidate' END FROM b WHERE consumer IS NOT NULL OR NOT retried
  UNION ALL SELECT user_id, 'R7', 'candidate' FROM ev WHERE tool = 'error')"""
_REPORTED = ["R2a", "R2b", "R7"]


@query(f"""WITH {_FOUND} SELECT e.user_id, count(f.rule) AS n_active, count(*) FILTER (WHERE f.tier = 'hard_defect') AS n_hard_defect,
  CAST(CASE WHEN count(*) FILTER (WHERE f.tier = 'hard_defect') > 0 THEN 2 ELSE 0 END AS BIGINT) AS exit_code
FROM (SELECT DISTINCT user_id FROM ev) e LEFT JOIN found f USING (user_id) GROUP BY e.user_id""")
def report_exit_codes(spark, d):
    """The report of every trace."""
    s = _reuse(spark, d)
    r = lint.reports(s.select("trace_key", "run_id").distinct(), lint.lint_steps(s, DECLARED, _REPORTED))
    return r.select(user(), *big("n_active", "n_hard_defect", "exit_code"))


@query(f"WITH {_FOUND} SELECT CAST(CASE WHEN count(*) FILTER (WHERE tier = 'hard_defect') > 0 THEN 2 ELSE 0 END AS BIGINT) AS overall_exit FROM found")
def report_overall_exit(spark, d):
    """The exit code of all traces together."""
    s = _reuse(spark, d)
    r = lint.reports(s.select("trace_key", "run_id").distinct(), lint.lint_steps(s, DECLARED, _REPORTED))
    return lint.overall_exit(r).select(*big("overall_exit"))


@query(f"WITH {_FOUND} SELECT rule, tier, count(*) AS n FROM found GROUP BY ALL")
def findings_by_tier(spark, d):
    """Findings by rule and tier."""
    f = lint.active(lint.lint_steps(_reuse(spark, d), DECLARED, _REPORTED))
    return f.groupBy("rule", "tier").agg(F.count(F.lit(1)).alias("n"))


_WILSON = """greatest(0, (k / n + {z2} / (2 * n) - {z} * sqrt(k / n * (1 - k / n) / n + {z2} / (4 * n * n))) / (1 + {z2} / n)) AS low,
  least(1, (k / n + {z2} / (2 * n) + {z} * sqrt(k / n * (1 - k / n) / n + {z2} / (4 * n * n))) / (1 + {z2} / n)) AS high""".format(z=stats.Z_95, z2=stats.Z_95**2)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"""WITH {EV}, x AS (SELECT *, CASE WHEN tool = 'error' THEN 'error' ELSE 'ok' END AS class FROM ev), {_ISLANDS},
a AS (SELECT tool, repeats, CAST(count(DISTINCT user_id) AS DOUBLE) AS k, (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) FROM ev) AS n FROM i GROUP BY ALL), w AS (SELECT *, {_WILSON} FROM a)
SELECT tool, repeats, CAST(k AS BIGINT) AS "count", CAST(n AS BIGINT) AS runs, round(k / n, 9) AS rate, round(low, 9) AS low, round(high, 9) AS high, k < n AS flaky FROM w""")
def reproduction_rates(spark, d):
    """How many users show the same loop."""
    s = plain(spark, d, args_json=F.lit("{}"))
    keys = s.select("trace_key").distinct()
    r = reproduction.reproduction(rules.r4(views(s, None, "R4")).withColumn("rule_ord", F.lit(0)), traces=keys)
    # the key of a loop is its tool, length and class: read back from the text that shows it
    tool = F.regexp_extract("summary", "^'([^']*)'", 1)
    r = r.select(tool.alias("tool"), F.regexp_extract("summary", r"called (\d+) times", 1).cast("long").alias("repeats"), *big("count", "runs"), "rate", "low", "high", "flaky")
    return rounded(r, "rate", "low", "high")


@query(f"""WITH a AS (SELECT l_returnflag, l_linestatus, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, {_WILSON} FROM a)
SELECT l_returnflag, l_linestatus, CAST(k AS BIGINT) AS hits, CAST(n AS BIGINT) AS total, round(k / n, 9) AS rate, round(low, 9) AS low, round(high, 9) AS high FROM w""")
def wilson_interval(spark, d):
    """Rates of large discounts with their intervals."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("hits"), F.count(F.lit(1)).alias("total"))
    return rounded(stats.with_rate(g, "hits", "total"), "rate", "low", "high")


@query()
def bootstrap_interval(spark, d):
    """Seeded bootstrap of the mean retail price of each brand's parts, 2000 resamples."""
    return rounded(stats.bootstrap_by(table(spark, d, "part"), "p_brand", "p_retailprice"), "low", "high")


# Faults and reliability


@query(f"""WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, tool ORDER BY pos) AS nth FROM ev)
SELECT user_id, 2 * pos + 1 AS idx, CASE WHEN nth = 2 THEN 'error' WHEN tool = 'error' THEN 'error' ELSE 'ok' END AS status,
CASE WHEN nth = 2 THEN 'server_error' END AS error, CAST(CASE WHEN nth = 2 THEN 500 END AS BIGINT) AS http_status,
CASE WHEN nth = 2 THEN '"internal server error"' ELSE CAST(v AS VARCHAR) END AS content FROM o""")
def fault_targeted(spark, d):
    """A server error on the second call of every tool."""
    s = faults.injected(plain(spark, d), faults.targeted("error", None, 2)).filter("kind = 'tool_result'")
    return s.select(user(), *big("idx"), "status", "error", *big("http_status"), F.col("content_json").alias("content"))


_NAMES = list(faults.FAULTS)


@query(f"""WITH {EV} SELECT event_id, {_NAMES!r}[k % 8 + 1] AS fault, CASE WHEN k % 8 < 3 THEN 'error' ELSE 'ok' END AS status,
CAST(CASE k % 8 WHEN 1 THEN 500 WHEN 2 THEN 429 END AS BIGINT) AS http_status,
CASE WHEN k % 8 = 5 THEN '"' || left('v' || v, greatest(1, length('v' || v) // 2)) || '"' END AS truncated FROM ev""")
def fault_render(spark, d):
    """Each of the eight faults, by k."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.get_json_object("args_json", "$.k").cast("long") % 8 + 1).cast("int"))
    s = faults.injected(plain(spark, d, content_json=F.concat(F.lit('"v'), F.col("v").cast("string"), F.lit('"'))), name).filter("kind = 'tool_result'")
    fault = F.regexp_extract(F.get_json_object("meta_json", "$.fault_injection_id"), "^([a-z_]+)@", 1)
    return s.select(F.col("call_id").cast("long").alias("event_id"), fault.alias("fault"), "status", *big("http_status"), F.when(fault == "truncated", F.col("content_json")).alias("truncated"))


_RUNS = "WITH a AS (SELECT event_type AS condition, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE {k}) AS DOUBLE) AS k FROM events GROUP BY ALL), w AS (SELECT *, {w} FROM a)"
_K50 = "CAST(json_extract_string(props, '$.k') AS BIGINT) < 50"


@query(_RUNS.format(k=_K50, w=_WILSON) + """ SELECT condition, CAST(k AS BIGINT) AS recovered, CAST(n AS BIGINT) AS total, round(k / n, 9) AS rate, round(low, 9) AS low, round(high, 9) AS high FROM w""")
def scorecard_rates(spark, d):
    """Recovery by condition, events taken for runs."""
    e = events(spark, d).select(F.col("tool").alias("condition"), (F.col("k") < 50).alias("ok"))
    return rounded(reliability.recovery(e), "rate", "low", "high")


@query(_RUNS.format(k=f"value >= 20 AND NOT {_K50}", w=_WILSON) + f""" SELECT condition, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS incorrect_continuation, round(k / n, 9) AS incorrect_rate,
round(low, 9) AS incorrect_low, round(high, 9) AS incorrect_high, (SELECT count(*) FROM events e WHERE e.event_type = condition AND value >= 100) AS flagged FROM w""")
def experiment_conditions(spark, d):
    """Outcomes by condition, events taken for runs."""
    e = table(spark, d, "events")
    ran = e.select(F.col("event_id").cast("string").alias("trace_key"), F.col("event_type").alias("condition"), (F.get_json_object("props", "$.k").cast("long") < 50).alias("ok"), (F.col("value") >= 20).alias("claimed"))
    flags = e.filter("value >= 100").select(F.col("event_id").cast("string").alias("trace_key"))
    c = rounded(reliability.conditions(ran, flags), "incorrect_rate", "incorrect_low", "incorrect_high")
    return c.select("condition", *big("n", "incorrect_continuation"), "incorrect_rate", "incorrect_low", "incorrect_high", *big("flagged"))


@query("""SELECT * FROM (VALUES ('careful', 'timeout', 20, 20), ('careful', 'error', 20, 20), ('careful', 'rate_limit', 20, 20),
('careless', 'timeout', 0, 20), ('careless', 'error', 0, 20), ('careless', 'rate_limit', 0, 20)) AS t(agent, condition, recovered, total)""")
def scorecard_demo(spark, d):
    """Simulated recovery of a careful and a careless agent; reads no table."""
    out = None
    for name, careless in (("careful", False), ("careless", True)):
        sc = reliability.scorecard(spark, reliability.watering_task(careless), ["timeout", "error", "rate_limit"], runs=20)
        one = sc.results.select(F.lit(name).alias("agent"), "condition", F.col("recovered").cast("int").alias("recovered"), F.col("total").cast("int").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT * FROM (VALUES ('baseline', 6, 6, 0, 0), ('error', 6, 0, 6, 6), ('denied', 6, 6, 0, 0)) AS t(condition, n, recovered, incorrect_continuation, flagged)""")
def experiment_demo(spark, d):
    """Simulated experiment with the careless agent; reads no table."""
    e = reliability.experiment(spark, reliability.watering_task(True), ["error", "denied"], runs=6, target="feel_soil")
    return e.conditions.select("condition", *[F.col(c).cast("int").alias(c) for c in ("n", "recovered", "incorrect_continuation", "flagged")])


# Sources


def _docs(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("source"), F.lit(0).cast("long").alias("start"), text.alias("text"))


def _of() -> Column:
    """The source that a trace's key begins with."""
    return F.regexp_extract("trace_key", "^([0-9]+)#", 1).cast("long")


@query("""WITH k AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'assistant' OR text <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, length(text) AS n_chars FROM k""")
def openai_messages(spark, d):
    """Conversations written as message lists and read by the chat adapter."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    t = loader.adapt(_docs(g, "conv_id", F.to_json(F.struct("messages"))), "openai")
    return model.steps_of(t).select(_of().alias("conv_id"), *big("idx"), "role", F.length("content").cast("long").alias("n_chars"))


def _nested(spark, d, *fields: Column) -> DataFrame:
    ev = events(spark, d)
    return ev.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), F.struct(*fields).alias("x")))).alias("all")).withColumn("all", F.transform("all", lambda a: a["x"]))


def _span_kind() -> Column:
    return F.when(F.col("tool").isin("click", "purchase"), "TOOL").otherwise("SPAN")


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tools, count(*) AS n_calls, count(*) FILTER (WHERE value >= 50) AS n_errors
FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id""")
def observed_tools(spark, d):
    """Observations of each user read by the platform adapter: the tools that were seen."""
    g = _nested(spark, d, F.col("event_id").cast("string").alias("id"), _span_kind().alias("type"), F.col("tool").alias("name"), F.struct("k").alias("input"), F.struct("v").alias("output"), F.when(F.expr("v >= 50"), "ERROR").alias("level"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("startTime"))
    t = loader.adapt(_docs(g, "user_id", F.to_json(F.struct(F.col("user_id").alias("id"), F.col("all").alias("observations")))), "langfuse")
    s = model.steps_of(t).groupBy(_of().alias("user_id")).agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.count("tool").alias("n_calls"), F.count(F.when(F.col("status") == "error", 1)).alias("n_errors"))
    return s.filter("n_calls > 0")


@query(f"""WITH {EV}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS n FROM ev WHERE tool IN ('click', 'purchase'))
SELECT user_id, 2 * n AS idx, tool, CASE WHEN v >= 50 THEN 'error' ELSE 'unknown' END AS status, k FROM t""")
def otel_spans(spark, d):
    """Spans of each user read by the span adapter, calls with the status of their results."""
    attrs = F.create_map(F.lit("openinference.span.kind"), _span_kind(), F.lit("tool.name"), F.col("tool"), F.lit("input.value"), F.col("props"), F.lit("output.value"), F.col("v").cast("string"))
    g = _nested(spark, d, F.col("event_id").cast("string").alias("span_id"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("start_time"), F.when(F.expr("v >= 50"), "ERROR").otherwise("OK").alias("status_code"), F.to_json(attrs).alias("attrs"))
    spans = F.transform("all", lambda x: F.concat(F.lit('{"attributes":'), x["attrs"], F.lit(',"span_id":"'), x["span_id"], F.lit('","start_time":"'), x["start_time"], F.lit('","status_code":"'), x["status_code"], F.lit('"}')))
    t = loader.adapt(_docs(g, "user_id", F.concat(F.lit('{"spans":['), F.array_join(spans, ","), F.lit("]}"))), "otel")
    p = pairing.paired(pairing.derived(model.steps_of(t))).filter("kind = 'tool_call'")
    return p.select(_of().alias("user_id"), *big("idx"), "tool", F.col("got.status").alias("status"), F.get_json_object("args_json", "$.k").cast("long").alias("k"))


@query(f"WITH {EV} SELECT user_id, 2 * pos + 1 AS idx, CAST(v AS VARCHAR) AS content, CASE WHEN tool = 'error' THEN 'error' ELSE 'ok' END AS status FROM ev")
def native_traces(spark, d):
    """Traces written as native documents and read again: their results."""
    s = plain(spark, d)
    text = F.when(F.col("kind") == "tool_call", json_object(type=F.lit('"tool_call"'), call_id=json_value(F.col("call_id")), name=json_value(F.col("tool")), args=F.col("args_json"))).otherwise(
        json_object(type=F.lit('"tool_result"'), call_id=json_value(F.col("call_id")), content=F.col("content_json"), status=json_value(F.col("status")))
    )
    g = s.groupBy("trace_key").agg(F.array_sort(F.collect_list(F.struct("idx", text.alias("t")))).alias("all"))
    doc = F.concat(F.lit('{"run_id": "r", "steps": ['), F.array_join(F.transform("all", lambda x: x["t"]), ","), F.lit("]}"))
    t = model.steps_of(loader.adapt(_docs(g, "trace_key", doc), "native")).filter("kind = 'tool_result'")
    return t.select(_of().alias("user_id"), *big("idx"), F.col("content_json").alias("content"), "status")


from stepforge.plans import formats  # noqa: E402, F401  (registers its queries here)
