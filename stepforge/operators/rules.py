"""The eight checks, each one set-at-a-time query over all traces.

A check takes the views of a set of traces and gives finding rows; traces that
lack what it needs give one suppression row that says so.  Nothing here looks
at one trace at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions import jsonschema, predicates
from stepforge.functions.values import is_json_object, json_object, json_value, quoted
from stepforge.operators import pairing, provenance
from stepforge.registry import Registry
from stepforge.sources import model

FINDING = """trace_key string, run_id string, rule_ord int, finding_ord array<int>, rule string, finding_type string, tier string,
  summary string, evidence_json string, key_json string, step_indices array<int>, possible_false_positive boolean, suppressed_reason string"""
HARD_EVENT, HARD_DEFECT, CANDIDATE = "hard_event", "hard_defect", "candidate"
#: Calls in a row that make a loop.
LOOP = 3
_EXCEPTION = r"(?iU)\b(?:exception|[A-Za-z]*Error|failed|failure|errno)\b|http\s*[45]\d\d|traceback \(most recent call last\)"


def exception_marker(content: Column) -> Column:
    """The first word of a text that speaks of an exception, or null."""
    found = F.regexp_extract(content, _EXCEPTION, 0)
    return F.when(found != "", found)


@dataclass
class Views:
    """The relations that the checks share; each is planned once, and Spark computes its exchange once."""

    traces: DataFrame | None
    registry: Registry
    #: Given instead of ``traces`` where steps are rows of a table already.
    steps: DataFrame | None = field(default=None)
    #: What the checks read of pairing.parts(), with "got" and "failure"; all if null.
    need: frozenset[str] | None = field(default=None)

    def __post_init__(self) -> None:
        self.nested = self.steps is None
        if self.nested:
            self.steps = model.steps_of(self.traces)

    @cached_property
    def declared(self) -> DataFrame:
        return self.registry.frame(self.steps.sparkSession)

    @cached_property
    def pairs(self) -> DataFrame:
        # Python columns don't pass on how their input is partitioned: they come first, and one exchange by trace
        # then serves every window below.  A result's declared failure is one of them, and needs the call first.
        wants = lambda part: self.need is None or part in self.need
        s, failure = self.steps, F.lit(None).cast("string")
        if wants("failure") and any(t.failure for t in self.registry.tools.values()):
            d = self.declared.select(F.col("tool").alias("d_tool"), "failure_json").filter("failure_json IS NOT NULL")
            s = pairing.answering(s)
            s = s.join(d, F.col("for_call.tool") == F.col("d_tool"), "left").drop("d_tool")
            failure = predicates.declared_failure(F.when(F.col("failure_json").isNotNull(), F.col("content_json")), F.col("failure_json"))
        s = pairing.parts(s, self.need, declared_failure=failure).drop("failure_json")
        return pairing.paired(s.repartition("trace_key"), wants("got"))

    @cached_property
    def calls(self) -> DataFrame:
        return pairing.calls(self.pairs, self.declared)

    @cached_property
    def results(self) -> DataFrame:
        return pairing.results(self.pairs, self.declared)

    @cached_property
    def counts(self) -> DataFrame:
        """(trace_key, run_id, n_calls, n_results, n_schemas) of every trace, also of one without steps: counted
        inside the row, unless steps are all there is; without an exchange in either case."""
        with_schema = [t.name for t in self.registry.tools.values() if t.schema is not None]
        if not self.nested:
            n = lambda c: F.count(F.when(c, 1))
            has = (F.col("kind") == model.CALL) & F.col("tool").isin(with_schema) if with_schema else F.lit(False)
            return self.pairs.groupBy("trace_key", "run_id").agg(n(pairing.is_call()).alias("n_calls"), n(pairing.is_result()).alias("n_results"), n(has).alias("n_schemas"))
        kinds = lambda k: F.size(F.filter("steps", lambda s: s["kind"] == k))
        schemas = F.size(F.filter("steps", lambda s: (s["kind"] == model.CALL) & s["tool"].isin(with_schema))) if with_schema else F.lit(0)
        return self.traces.select("trace_key", "run_id", kinds(model.CALL).alias("n_calls"), kinds(model.RESULT).alias("n_results"), schemas.alias("n_schemas"))


Check = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Rule:
    """id, what it finds, the query, and the reason (or null) for which a trace is left out."""

    id: str
    finding_type: str
    run: Check
    reason: Callable[[Registry], Column] | None = None
    #: What ``run`` reads of the paired steps (see Views.need); all if null.
    needs: tuple[str, ...] | None = None


def finding(df: DataFrame, rule: str, kind: str, tier, summary: Column, evidence: dict[str, Column], steps: Column, doubtful=False, order: Column | None = None, reason: Column | None = None) -> DataFrame:
    """Finding rows; ``evidence`` holds JSON texts, from which the volatile ones are left out of ``key_json``."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    stable = {k: v for k, v in evidence.items() if k not in ("call_id", "consumed_values")}
    return df.select(
        "trace_key", "run_id", F.lit(0).alias("rule_ord"),
        (F.array(F.col("idx")) if order is None else order).cast("array<int>").alias("finding_ord"),
        F.lit(rule).alias("rule"), F.lit(kind).alias("finding_type"), lit(tier).alias("tier"), summary.alias("summary"),
        json_object(step_indices=json_value(steps.cast("array<int>")), **evidence).alias("evidence_json"),
        json_object(**stable).alias("key_json") if stable else F.lit("{}").alias("key_json"),
        steps.cast("array<int>").alias("step_indices"), lit(doubtful).alias("possible_false_positive"),
        (F.lit(None) if reason is None else reason).cast("string").alias("suppressed_reason"),
    )


def suppressed(counts: DataFrame, chosen: list[tuple[int, Rule]], registry: Registry) -> DataFrame:
    """One row for every trace and rule that has a reason to leave it out; the traces are counted once for all rules."""
    each = [F.struct(F.lit(n).alias("rule_ord"), F.lit(r.id).alias("rule"), F.lit(r.finding_type).alias("kind"), r.reason(registry).cast("string").alias("why")) for n, r in chosen]
    w = counts.select("trace_key", "run_id", F.explode(F.filter(F.array(*each), lambda x: x["why"].isNotNull())).alias("w"))
    return w.select(
        "trace_key", "run_id", F.col("w.rule_ord").alias("rule_ord"), F.array(F.lit(-1)).alias("finding_ord"), F.col("w.rule").alias("rule"),
        F.col("w.kind").alias("finding_type"), F.lit(CANDIDATE).alias("tier"),
        F.concat(F.lit("rule "), "w.rule", F.lit(" suppressed: "), "w.why").alias("summary"), F.lit("{}").alias("evidence_json"), F.lit("{}").alias("key_json"),
        F.lit(None).cast("array<int>").alias("step_indices"), F.lit(False).alias("possible_false_positive"), F.col("w.why").alias("suppressed_reason"),
    )


def _at(*names: str) -> Column:
    return F.array(*names)


# R1


def r1(v: Views) -> DataFrame:
    with_schema = F.max(F.col("schema_json").isNotNull()).over(Window.partitionBy("trace_key"))
    c = v.calls.withColumn("with_schema", with_schema).filter("with_schema") if any(t.schema is not None for t in v.registry.tools.values()) else v.calls.limit(0)
    name = quoted(F.col("tool"))
    why = F.when(F.col("schema_json").isNull(), F.concat(F.lit("no schema for tool "), name)).when(
        F.col("schema_problem").isNotNull(), F.concat(F.lit("tool "), name, F.lit(" has an invalid JSON Schema: "), "schema_problem")
    )
    errors = jsonschema.schema_errors(F.col("args_json"), F.when(F.col("schema_problem").isNull(), F.col("schema_json")))
    c = c.withColumn("why", why).withColumn("errors", errors).filter("why IS NOT NULL OR size(errors) > 0")
    out = F.col("why").isNotNull()
    n = F.size("errors")
    words = F.array_join(F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["keyword"]))), ", ")
    broken = F.concat(name, F.lit(" call violates its schema ("), n.cast("string"), F.when(n == 1, " error: ").otherwise(" errors: "), words, F.lit(")"))
    evidence = {"tool": json_value(F.col("tool")), "call_id": json_value(F.col("call_id")), "errors": F.when(~out, F.to_json("errors"))}  # a null part is left out
    return finding(
        c, "R1", "schema_violation", F.when(out, CANDIDATE).otherwise(HARD_DEFECT),
        F.when(out, F.concat(F.lit("rule R1 suppressed for call "), "call_id", F.lit(": "), "why")).otherwise(broken), evidence, _at("idx"), reason=F.col("why"),
    )


# R2a


def r2a(v: Views) -> DataFrame:
    r = v.results
    name = quoted(F.coalesce("called", F.lit("?")))
    marker = F.when(F.col("c.kind") == "string", exception_marker(F.get_json_object(F.concat(F.lit('{"x":'), "content_json", F.lit("}")), "$.x")))
    r = r.withColumn("marker", marker).withColumn(
        "signal",
        F.when(F.col("failed"), "structured")
        .when(F.col("declared_failure").isNotNull(), "failure_predicate")
        .when(F.col("side_effecting") & F.col("failure_json").isNull() & (F.col("status") != "ok"), "unverified")
        .when(F.col("status") == "ok", None)
        .when(F.col("marker").isNotNull(), "exception_text")
        .when(F.col("c.nothing"), "empty_result"),
    )
    r = r.filter("signal IS NOT NULL")
    detail = F.when(F.col("http_status").isNotNull(), F.concat(F.lit("http "), F.col("http_status").cast("string"))).otherwise(
        F.when(F.col("error") == "", "status=error").otherwise(F.coalesce("error", F.lit("status=error")))
    )
    why = F.concat(F.lit("side-effecting tool "), name, F.lit(" returned an unclassifiable result and declares no failure_when predicate — cannot verify it did not fail"))
    is_ = lambda s: F.col("signal") == s
    summary = (
        F.when(is_("structured"), F.concat(name, F.lit(" returned an error ("), detail, F.lit(")")))
        .when(is_("failure_predicate"), F.concat(name, F.lit(" returned a declared failure ("), "declared_failure", F.lit(")")))
        .when(is_("unverified"), F.concat(F.lit("rule R2a suppressed for "), name, F.lit(": "), why))
        .when(is_("exception_text"), F.concat(name, F.lit(" result may be an error — content matches an exception-like pattern ("), quoted(F.col("marker")), F.lit(")")))
        .otherwise(F.concat(name, F.lit(" result may be an error — result is empty")))
    )
    evidence = {  # a null part is left out
        "tool": json_value(F.coalesce("called", F.lit("?"))),
        "signal": F.when(~is_("unverified"), json_value(F.col("signal"))),
        "http_status": F.when(is_("structured"), json_value(F.col("http_status"))),
        "error": F.when(is_("structured"), json_value(F.col("error"))),
        "matched": F.when(is_("failure_predicate"), json_value(F.col("declared_failure"))),
    }
    tier = F.when(is_("structured") | is_("failure_predicate"), HARD_EVENT).otherwise(CANDIDATE)
    doubtful = is_("exception_text") | is_("empty_result")
    return finding(r, "R2a", "tool_error_event", tier, summary, evidence, _at("idx"), doubtful, reason=F.when(is_("unverified"), why))


# R2b


def consumption(v: Views) -> DataFrame:
    """Failed results (trace_key, run_id, idx, called) with the first later call that uses a value of theirs
    (``consumer``, null if none, with its tool and whether it ``acts``), the values (``consumed``), and whether their
    tool was called again (``retried``).

    Values of failures and of calls are one relation and each failure looks
    ahead within its value's partition, so no pair of them is ever built.  A
    failure has one row more, of a null value, that keeps it without any use.
    All is told by windows and one grouping within a trace: nothing is joined.
    """
    d = v.declared.select(F.col("tool").alias("d_tool"), F.col("side_effecting").alias("acts"))
    use = pairing.is_call()
    p = v.pairs.filter(use | (pairing.is_result() & (F.col("failed") | F.col("declared_failure").isNotNull())))
    values = F.when(use, F.col("a.identifying")).otherwise(F.array_append(F.coalesce("c.identifying", F.expr("CAST(array() AS array<string>)")), F.lit(None).cast("string")))
    p = p.select("trace_key", "run_id", "idx", use.alias("use"), F.when(use, F.col("tool")).otherwise(F.col("for_call.tool")).alias("of"), values.alias("vals"))
    again = F.max(F.when(F.col("use"), F.col("idx"))).over(Window.partitionBy("trace_key", "of")) > F.col("idx")
    p = p.withColumn("retried", F.coalesce(again & F.col("of").isNotNull(), F.lit(False)))
    p = p.join(d, F.when(F.col("use"), F.col("of")) == F.col("d_tool"), "left")
    marks = p.select("trace_key", "run_id", "idx", "use", "of", "retried", F.coalesce("acts", F.lit(False)).alias("acts"), F.explode("vals").alias("value"))
    ahead = Window.partitionBy("trace_key", "value").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    user = F.when(F.col("use"), F.struct("idx", F.col("of").alias("tool"), "acts"))
    marks = marks.withColumn("next", F.last(user, ignorenulls=True).over(ahead)).filter("NOT use")
    g = marks.groupBy("trace_key", "idx").agg(
        F.first("run_id").alias("run_id"), F.first("of").alias("called"), F.first("retried").alias("retried"), F.min("next").alias("first"),
        F.collect_list(F.when(F.col("next").isNotNull(), F.struct(F.col("next.idx").alias("at"), "value"))).alias("all"),
    )
    consumed = F.array_sort(F.transform(F.filter("all", lambda x: x["at"] == F.col("first.idx")), lambda x: x["value"]))
    return g.select("trace_key", "run_id", "idx", "called", "retried", F.col("first.idx").alias("consumer"), F.col("first.tool").alias("consumer_tool"), F.col("first.acts").alias("acts"), F.when(F.col("first").isNotNull(), consumed).alias("consumed"))


def r2b(v: Views) -> DataFrame:
    c = consumption(v).filter("consumer IS NOT NULL OR NOT retried")
    tool, used = F.coalesce("called", F.lit("?")), F.col("consumer").isNotNull()
    eaten = F.concat(
        F.lit("value(s) from the errored "), quoted(tool), F.lit(" result ("), F.array_join("consumed", ", "), F.lit(") reused as arguments to "), quoted(F.col("consumer_tool")),
        F.when(F.col("acts"), " (a side-effecting action, no fallback)").otherwise(""),
    )
    ignored = F.concat(F.coalesce(quoted(F.col("called")), F.lit("None")), F.lit(" failed and was not called again before the agent went on (whether the failure was acknowledged can't be told)"))
    evidence = {  # a null part is left out
        "errored_tool": F.when(used, json_value(tool)), "consumer": F.when(used, json_value(F.col("consumer_tool"))),
        "consumed_values": F.when(used, json_value(F.col("consumed"))), "side_effecting": F.when(used, json_value(F.col("acts"))),
        "tool": F.when(~used, json_value(F.col("called"))), "signal": F.when(~used, F.lit('"not_retried"')),
    }
    return finding(
        c, "R2b", "error_mishandled", F.when(used & F.col("acts"), HARD_DEFECT).otherwise(CANDIDATE), F.when(used, eaten).otherwise(ignored), evidence,
        F.when(used, _at("idx", "consumer")).otherwise(_at("idx")), F.when(used, ~F.col("acts")).otherwise(True),
    )


# R3


def r3(v: Views) -> DataFrame:
    f = provenance.underivable(v)
    provided = F.col("origin") == "provided"
    provided = F.coalesce(provided, F.lit(False))
    note = F.when(provided, "the schema says that this value is provided, yet nothing the agent saw gives it").otherwise(
        "no origin is declared: the value may be generated, or made in a way that is not recognised"
    )
    return finding(
        f, "R3", "hallucinated_arg", F.when(provided, HARD_DEFECT).otherwise(CANDIDATE),
        F.concat(F.lit("argument "), quoted(F.col("field")), F.lit("="), "shown", F.lit(" to "), quoted(F.col("tool")), F.lit(" is not derivable from anything the agent observed")),
        {"tool": json_value(F.col("tool")), "field": json_value(F.col("field")), "value": F.col("value"), "value_origin": json_value(F.col("origin")), "note": json_value(note)},
        _at("idx"), ~provided, F.array("idx", "nth"),
    )


# R4


def runs(calls: DataFrame) -> DataFrame:
    """Maximal runs of calls with one tool, arguments and class of result: (trace_key, run_id, tool, rclass, idx of the
    first, steps, repeats, polling, moved_on).

    ``moved_on`` says that the same call had another class of result later.
    """
    w = Window.partitionBy("trace_key").orderBy("idx")
    same = F.struct("tool", "args_key", "rclass")
    c = calls.withColumn("new", F.when(same.eqNullSafe(F.lag(same).over(w)), 0).otherwise(1))
    c = c.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.partitionBy("trace_key", "tool", "args_key").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    other = (F.min("rclass").over(later) != F.col("rclass")) | (F.max("rclass").over(later) != F.col("rclass"))
    c = c.withColumn("other_later", F.coalesce(other, F.lit(False)))
    return c.groupBy("trace_key", "run_id", "island").agg(
        F.first("tool").alias("tool"), F.first("rclass").alias("rclass"), F.min("idx").alias("idx"), F.count(F.lit(1)).alias("repeats"),
        F.array_sort(F.collect_list("idx")).alias("steps"), F.first("polling").alias("polling"), F.max_by("other_later", "idx").alias("moved_on"),
    )


def r4(v: Views) -> DataFrame:
    stuck = runs(v.calls).filter(F.col("repeats") >= LOOP).filter(~F.col("polling") & ~(pairing.waiting(F.col("rclass")) & F.col("moved_on")))
    return finding(
        stuck, "R4", "loop", CANDIDATE,
        F.concat(quoted(F.col("tool")), F.lit(" called "), F.col("repeats").cast("string"), F.lit(" times in a row with identical arguments and no change in result state ("), "rclass", F.lit(")")),
        {"tool": json_value(F.col("tool")), "repeats": json_value(F.col("repeats")), "result_class": json_value(F.col("rclass"))}, F.col("steps"), True,
    )


# R5


def repeats(calls: DataFrame) -> DataFrame:
    """(trace_key, run_id, tool, first, again): calls that repeat an anchor with the same result.

    Of the calls with one fingerprint the first is the anchor.  One right after
    the anchor is passed over; any other is a repeat and the new anchor, until
    a side-effecting call came strictly between it and the anchor: from there on
    nothing repeats.  So in a row of neighbours every other call is an anchor,
    and all is told by windows.  ``acts`` counts side-effecting calls up to and
    with a call, so that "strictly between" is a difference of two counts.
    """
    return _folded(calls).filter("repeat").select("trace_key", "run_id", "tool", "first", "again")


def _folded(calls: DataFrame) -> DataFrame:
    """All calls, with ``repeat`` for those that repeats() gives, their ``first`` and ``again``, and ``known``."""
    w = Window.partitionBy("trace_key").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    c = calls.withColumn("acts", F.sum(F.col("side_effecting").cast("int")).over(w))
    same = ("trace_key", "tool", "args_key", "outcome")
    of = Window.partitionBy(*same).orderBy("idx")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(of) > 1, F.lit(True))
    c = c.select(*same, "run_id", "known", "idx", "pos", "acts", F.col("side_effecting").cast("int").alias("own"), new.alias("new"), F.row_number().over(of).alias("nth"))
    since = F.max(F.when(F.col("new"), F.col("nth"))).over(of.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("anchor", (F.col("nth") - since) % 2 == 0)
    at = F.struct(F.col("pos").cast("int").alias("pos"), "idx", F.col("acts").cast("int").alias("acts"), F.col("own").alias("own"))
    anchors = Window.partitionBy(*same, "anchor").orderBy("idx")
    c = c.withColumn("again", at).withColumn("first", F.lag("again").over(anchors))
    stopped = F.max(F.coalesce(F.col("acts") - F.col("own") > F.col("first.acts"), F.lit(False))).over(anchors.rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("repeat", F.col("anchor") & F.col("first").isNotNull() & ~stopped)


def undeclared_between(calls: DataFrame) -> DataFrame:
    """repeats() with ``between``: the tools without declaration that were called strictly between, in order of name.

    Each repeat asks each such tool of its trace for its last call before the
    repeat, in a window by trace and tool; one row more, of no tool, keeps a
    repeat that has none.
    """
    c = _folded(calls)
    every = F.collect_set(F.when(~F.col("known"), F.col("tool"))).over(Window.partitionBy("trace_key"))
    none = F.lit(None).cast("string")
    asks = F.when(F.col("repeat"), F.transform(F.array_append("every", none), lambda t: F.struct(t.alias("other"), F.lit(True).alias("asks"))))
    own = F.when(~F.col("known"), F.array(F.struct(F.col("tool").alias("other"), F.lit(False).alias("asks"))))
    empty = F.expr("CAST(array() AS array<struct<other: string, asks: boolean>>)")
    marks = c.withColumn("every", every).filter("repeat OR NOT known").select("trace_key", "run_id", "tool", "first", "again", F.explode(F.concat(F.coalesce(asks, empty), F.coalesce(own, empty))).alias("x"))
    marks = marks.select("trace_key", "run_id", "tool", "first", "again", "x.*", F.col("again.pos").alias("at"))
    before = Window.partitionBy("trace_key", "other").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(~F.col("asks"), F.col("at"))).over(before)
    hits = marks.withColumn("last", last).filter("asks")
    g = hits.groupBy("trace_key", "at").agg(*[F.first(k).alias(k) for k in ("run_id", "tool", "first", "again")], F.collect_set(F.when(F.col("last") > F.col("first.pos"), F.col("other"))).alias("between"))
    return g.select("trace_key", "run_id", "tool", "first", "again", F.array_sort("between").alias("between"))


def r5(v: Views) -> DataFrame:
    found = undeclared_between(v.calls).withColumn("idx", F.col("again.idx"))
    note = F.when(F.size("between") == 0, "").otherwise(
        F.concat(F.lit(" (unverified: undeclared tool(s) "), F.array_join(F.transform("between", quoted), ", "), F.lit(" ran between — declare whether they have side effects)"))
    )
    return finding(
        found, "R5", "redundant_call", CANDIDATE,
        F.concat(quoted(F.col("tool")), F.lit(" repeats an earlier call with the same arguments and result, and no mutating call came between"), note),
        {"tool": json_value(F.col("tool")), "undeclared_between": json_value(F.col("between"))}, _at("first.idx", "again.idx"), True,
    )


# R6, R7


def r6(v: Views) -> DataFrame:
    """A filter over the calls."""
    c = v.pairs.filter(pairing.is_call()).filter("raw_text <> '' AND a.empty")
    c = c.withColumn("object", is_json_object(F.col("raw_text"))).filter("NOT object")
    return finding(
        c, "R6", "malformed_arguments", HARD_DEFECT, F.concat(quoted(F.col("tool")), F.lit(" was called with arguments that are not valid JSON")),
        {"tool": json_value(F.col("tool")), "call_id": json_value(F.col("call_id")), "raw_arguments": json_value(F.col("raw_text"))}, _at("idx"),
    )


def r7(v: Views) -> DataFrame:
    """An anti-join with the declared tools."""
    names = sorted(v.registry.names())
    c = v.pairs.filter(pairing.is_call())
    c = c.join(v.declared.select(F.col("tool").alias("d")), F.col("tool") == F.col("d"), "left_anti") if names else c.limit(0)
    return finding(
        c, "R7", "unknown_tool", CANDIDATE, F.concat(F.lit("tool "), quoted(F.col("tool")), F.lit(" was called but is not in the declared toolset (possible hallucinated tool name)")),
        {"tool": json_value(F.col("tool")), "call_id": json_value(F.col("call_id")), "declared_tools": json_value(F.array(*map(F.lit, names)).cast("array<string>"))}, _at("idx"), True,
    )


def needed(chosen: Iterable[Rule]) -> frozenset[str] | None:
    """What several rules read of the paired steps together."""
    each = [r.needs for r in chosen]
    return None if None in each else frozenset(p for needs in each for p in needs)


def _no(count: str, text: str, less_than: int = 1) -> Column:
    return F.when(F.col(count) < less_than, text)


def _r1_reason(reg: Registry) -> Column:
    return F.coalesce(_no("n_calls", "trace has no tool calls to validate"), _no("n_schemas", "no tool schema available for any called tool"))


def _r7_reason(reg: Registry) -> Column:
    rest = F.lit(None) if len(reg) else F.lit("no tool registry supplied — cannot know which tools were declared")
    return F.coalesce(_no("n_calls", "trace has no tool calls to check"), rest)


_NO_RESULTS = lambda reg: _no("n_results", "trace has no tool results")
_NO_CALLS = lambda reg: _no("n_calls", "trace has no tool calls to check")
RULES: dict[str, Rule] = {
    r.id: r
    for r in (
        Rule("R1", "schema_violation", r1, _r1_reason, ()),
        Rule("R2a", "tool_error_event", r2a, _NO_RESULTS, ("failure", "c.kind", "c.nothing")),
        Rule("R2b", "error_mishandled", r2b, _NO_RESULTS, ("failure", "a.identifying", "c.identifying")),
        Rule("R3", "hallucinated_arg", r3, _NO_CALLS, ("a.fields", "c.texts", "c.scalars", "m")),
        Rule("R4", "loop", r4, lambda reg: _no("n_calls", f"fewer than {LOOP} tool calls; no loop possible", LOOP), ("got", "a.key", "c.nothing", "c.state")),
        Rule("R5", "redundant_call", r5, lambda reg: _no("n_calls", "fewer than 2 tool calls; no repetition possible", 2), ("got", "a.key", "c.canonical")),
        Rule("R6", "malformed_arguments", r6, _NO_CALLS, ("a.empty",)),
        Rule("R7", "unknown_tool", r7, _r7_reason, ()),
    )
}


def selected(ids: list[str] | None = None) -> list[Rule]:
    """Rules in the caller's order; all of them by default."""
    unknown = [i for i in ids or () if i not in RULES]
    if unknown:
        raise ValueError(f"unknown rule(s) {', '.join(unknown)}; there are {', '.join(RULES)}")
    return [RULES[i] for i in ids] if ids else list(RULES.values())
