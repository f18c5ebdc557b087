"""Whether an argument's value follows from what the agent had seen before the call.

Sources are user and system messages and tool results; what the model itself
said is none.  They are gathered once per trace, with their positions, and every
argument is tested against those before its call by a ladder from cheap to
expensive.  Traces are independent, and all steps of one are in one partition
already, so gathering and joining cost no exchange.  A trace's sources and
arguments are one row, which has to fit in a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("", *"/_- ")


def sources(pairs: DataFrame) -> DataFrame:
    """(trace_key, texts, seen): texts with position, normal form, digits and speaker; scalars of results likewise."""
    m = pairs.filter("m IS NOT NULL").select("trace_key", "idx", F.col("role").alias("by"), "m")
    texts = m.select("trace_key", F.struct("idx", "m.norm", "m.digits", "by").alias("text"))
    r = pairs.filter("kind = 'tool_result'").select("trace_key", "idx", "c")
    entry = lambda t: F.struct(F.col("idx"), t["norm"], t["digits"], F.lit("tool").alias("by"))
    both = r.select("trace_key", F.transform("c.texts", entry).alias("texts"), F.transform("c.scalars", entry).alias("values"))
    a = texts.groupBy("trace_key").agg(F.collect_list("text").alias("said"))
    b = both.groupBy("trace_key").agg(F.flatten(F.collect_list("texts")).alias("returned"), F.flatten(F.collect_list("values")).alias("seen"))
    none = "CAST(array() AS array<struct<idx:int,norm:string,digits:string,by:string>>)"
    return a.join(b, "trace_key", "full").select(
        "trace_key",
        F.array_sort(F.concat(F.coalesce("said", F.expr(none)), F.coalesce("returned", F.expr(none)))).alias("texts"),
        F.array_sort(F.coalesce("seen", F.expr(none))).alias("seen"),
    )


def arguments(calls: DataFrame) -> DataFrame:
    """One row for each top-level argument that is worth a check: scalars that aren't generated or a closed choice."""
    f = calls.select("trace_key", "run_id", "idx", "tool", "generated", "closed", "origins", F.posexplode("a.fields").alias("nth", "f"))
    inside = lambda names: F.coalesce(F.array_contains(names, F.col("f.field")), F.lit(False))
    f = f.filter(F.col("f.checkable") & ~inside("generated") & ~inside("closed"))
    return f.select("trace_key", "run_id", "idx", "tool", "nth", "f.*", F.element_at("origins", F.col("f.field")).alias("origin"))


def operation(at: Column, norm: Column, digits: Column, texts: Column, seen: Column) -> Column:
    """How the value follows from the sources before position ``at``, or null: trivial, exact, digits, substring, concat."""
    before = lambda s: s["idx"] < at
    glued = F.exists(
        seen,
        lambda a: before(a)
        & (a["norm"] != "")
        & (F.length(a["norm"]) < F.length(norm))
        & F.startswith(norm, a["norm"])
        & F.exists(
            F.array(*map(F.lit, SEPARATORS)),
            lambda sep: F.startswith(norm, F.concat(a["norm"], sep))
            & F.exists(seen, lambda b: before(b) & (b["norm"] == F.substring(norm, F.length(a["norm"]) + F.length(sep) + 1, F.length(norm)))),
        ),
    )
    return (
        F.when(F.length(norm) < 2, "trivial")
        .when(F.exists(seen, lambda s: before(s) & (s["norm"] == norm)), "exact")
        .when((F.length(digits) >= 2) & F.exists(seen, lambda s: before(s) & (s["digits"] == digits)), "digits")
        .when((F.length(norm) >= 3) & F.exists(texts, lambda t: before(t) & F.contains(t["norm"], norm)), "substring")
        .when((F.length(digits) >= 3) & F.exists(texts, lambda t: before(t) & F.contains(t["digits"], digits)), "digits")
        .when(glued, "concat")
    )


def derivations(v) -> DataFrame:
    """Every checkable argument with ``operation`` (null if it can't be derived) and the first source step that shows it.

    A trace's arguments are one row as its sources are, so these are never
    copied for each argument.
    """
    own = ["idx", "tool", "nth", "field", "value", "shown", "norm", "digits", "checkable", "origin"]
    a = arguments(v.calls).groupBy("trace_key", "run_id").agg(F.collect_list(F.struct(*own)).alias("args"))
    none = F.expr("CAST(array() AS array<struct<idx:int,norm:string,digits:string,by:string>>)")
    j = a.join(sources(v.pairs), "trace_key", "left").withColumns({"texts": F.coalesce("texts", none), "seen": F.coalesce("seen", none)})
    texts, seen = F.col("texts"), F.col("seen")
    with_op = F.transform("args", lambda x: F.struct(x.alias("x"), operation(x["idx"], x["norm"], x["digits"], texts, seen).alias("op")))

    def shows(x: Column, op: Column) -> Column:
        before = lambda s: s["idx"] < x["idx"]
        by_digits = F.filter(seen, lambda s: before(s) & (s["digits"] == x["digits"]))
        return F.get(
            F.when(op == "exact", F.filter(seen, lambda s: before(s) & (s["norm"] == x["norm"])))
            .when((op == "digits") & (F.size(by_digits) > 0), by_digits)
            .when(op == "digits", F.filter(texts, lambda t: before(t) & F.contains(t["digits"], x["digits"])))
            .when(op == "substring", F.filter(texts, lambda t: before(t) & F.contains(t["norm"], x["norm"])))
            .when(op == "concat", F.filter(seen, lambda s: before(s) & (s["norm"] != "") & F.startswith(x["norm"], s["norm"]))),
            F.lit(0),
        )

    found = F.transform(with_op, lambda y: F.struct(y["x"].alias("x"), y["op"].alias("operation"), shows(y["x"], y["op"]).alias("first")))
    out = j.select("trace_key", "run_id", F.explode(found).alias("y"))
    return out.select("trace_key", "run_id", "y.x.*", F.col("y.operation").alias("operation"), F.col("y.first.idx").alias("source_step"), F.col("y.first.by").alias("source_type"))


def underivable(v) -> DataFrame:
    return derivations(v).filter("operation IS NULL")
