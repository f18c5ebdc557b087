"""Calls and their results, as windows over one hash partitioning by trace.

Every window below partitions by trace_key and possibly more columns, which a
hash partitioning by trace_key satisfies: the steps are exchanged once and only
sorted again.  Frames always grow from the partition's start; a look forward
is a look back in descending order, so no frame is evaluated anew for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stepforge.functions import values

_SEEN = (Window.unboundedPreceding, -1)


def is_call() -> Column:
    return F.col("kind") == "tool_call"


def is_result() -> Column:
    return F.col("kind") == "tool_result"


def structured_error(status: Column, http: Column, error: Column) -> Column:
    """What the transport declares to be an error; an empty error text counts."""
    return (status == "error") | F.coalesce(http >= 400, F.lit(False)) | error.isNotNull()


def derived(steps: DataFrame) -> DataFrame:
    """Adds what Python has to tell about arguments (``a``), contents (``c``) and what users and systems said (``m``)."""
    return structs(parts(steps))


def parts(steps: DataFrame, need: frozenset[str] | None = None, **more: Column) -> DataFrame:
    """The same with a column for each part (``a_key`` for ``a.key``): those that nobody reads aren't exchanged.

    ``need`` names parts, such as "a.key" or "m"; others are left out.  ``more``
    are further Python columns, so that rows go to Python once.
    """
    own = {x: [k for k in info if need is None or f"{x}.{k}" in need] for x, info in (("a", values.ARGS_INFO), ("c", values.CONTENT_INFO))}
    heard = F.when((F.col("kind") == "message") & F.col("role").isin("user", "system"), F.col("content"))
    made = dict(more)
    if own["a"]:
        made["a"] = values.args_info(F.col("args_json"), own["a"])
    if own["c"]:
        made["c"] = values.content_info(F.col("content_json"), F.col("error"), own["c"])
    if need is None or "m" in need:
        made["m"] = values.text_info(heard)
    s = steps.withColumns(made) if made else steps
    flat = {f"{x}_{k}": F.col(f"{x}.{k}") for x, names in own.items() for k in names}
    return s.withColumns(flat).drop("a", "c") if flat else s


def structs(flat: DataFrame) -> DataFrame:
    """parts() put together as the structs ``a`` and ``c``, null where left out."""
    have, out = set(flat.columns), {}
    for x, info in (("a", values.ARGS_INFO), ("c", values.CONTENT_INFO)):
        out[x] = F.struct(*[(F.col(f"{x}_{k}") if f"{x}_{k}" in have else F.lit(None).cast(t)).alias(k) for k, t in info.items()])
    if "m" not in have:
        out["m"] = F.lit(None).cast("struct<norm: string, digits: string>")
    return flat.withColumns(out).drop(*[f"{x}_{k}" for x, info in (("a", values.ARGS_INFO), ("c", values.CONTENT_INFO)) for k in info])


def result_class(c: Column, failed: Column) -> Column:
    return (
        F.when(failed, F.lit("error"))
        .when(c["nothing"], F.lit("empty"))
        .when(c["state"].isNotNull(), F.concat(F.lit("status:"), c["state"]))
        .otherwise(F.lit("ok"))
    )


def waiting(rclass: Column) -> Column:
    return rclass.isin([f"status:{w}" for w in values.WAITING])


def _by_id() -> WindowSpec:
    return Window.partitionBy("trace_key", "call_id")


def answering(steps: DataFrame) -> DataFrame:
    """Every step; results carry the latest earlier call of their id (``for_call``)."""
    call = F.when(is_call(), F.struct("idx", "tool"))
    back = F.last(call, ignorenulls=True).over(_by_id().orderBy("idx").rowsBetween(*_SEEN))
    return steps.withColumn("for_call", F.when(is_result(), back))


def paired(steps: DataFrame, ahead: bool = True) -> DataFrame:
    """Every step; results carry the latest earlier call of their id (``for_call``), calls the first
    later result (``got``).

    A result may serve several calls and the other way round; an id that occurs
    again pairs by position.  Both are null where there is no partner, and
    ``got`` is unless ``ahead``.
    """
    if "c" not in steps.columns:
        steps = structs(steps)
    failed = structured_error(F.col("status"), F.col("http_status"), F.col("error"))
    s = steps.withColumn("failed", F.when(is_result(), F.coalesce(failed, F.lit(False))))
    if "for_call" not in steps.columns:
        s = answering(s)
    if not ahead:
        return s.withColumn("got", F.lit(None).cast("struct<idx: int, status: string, failed: boolean, rclass: string, fingerprint: string>"))
    got = F.when(
        is_result(),
        F.struct("idx", "status", "failed", result_class(F.col("c"), F.col("failed")).alias("rclass"), F.sha2(F.concat_ws("|", "status", "c.canonical"), 256).alias("fingerprint")),
    )
    later = F.last(got, ignorenulls=True).over(_by_id().orderBy(F.desc("idx")).rowsBetween(*_SEEN))
    return s.withColumn("got", F.when(is_call(), later))


def calls(pairs: DataFrame, declared: DataFrame) -> DataFrame:
    """Calls with their ordinal among calls, argument key, class and fingerprint of the result, and what is
    declared about their tool (``known`` is false where nothing is)."""
    c = pairs.filter(is_call()).select(
        "trace_key", "run_id", "idx", "call_id", "tool", "args_json", "raw_text", "a",
        F.col("a.key").alias("args_key"),
        F.coalesce("got.rclass", F.lit("no_result")).alias("rclass"),
        F.coalesce("got.fingerprint", F.lit("no_result")).alias("outcome"),
    )
    c = c.withColumn("pos", F.row_number().over(Window.partitionBy("trace_key").orderBy("idx")) - 1)
    return with_declared(c, declared, "tool")


def results(pairs: DataFrame, declared: DataFrame) -> DataFrame:
    """Results with the call they answer (``called`` is null for an orphan) and what is declared about its tool."""
    r = pairs.filter(is_result()).select(
        "trace_key", "run_id", "idx", "call_id", "content_json", "status", "error", "http_status", "failed", "c", "declared_failure", F.col("for_call.tool").alias("called")
    )
    return with_declared(r, declared, "called")


def with_declared(df: DataFrame, declared: DataFrame, tool: str) -> DataFrame:
    d = declared.select(F.col("tool").alias("d_tool"), "schema_json", "schema_problem", "side_effecting", "polling", "failure_json", "provided", "generated", "closed", "origins", F.lit(True).alias("d_known"))
    j = df.join(d, df[tool] == d["d_tool"], "left").drop("d_tool")
    return j.withColumns({"known": F.coalesce("d_known", F.lit(False)), "side_effecting": F.coalesce("side_effecting", F.lit(False)), "polling": F.coalesce("polling", F.lit(False))}).drop("d_known")
