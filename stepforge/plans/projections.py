"""Tables of events, orders and conversations seen as traces of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.sources import model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, by: Column | None = None) -> DataFrame:
    """Events in the order of their trace: (trace_key, pos, event_id, user_id, tool, props, k, v)."""
    e = table(spark, sf_dir, "events")
    key = F.col("user_id").cast("string") if by is None else by
    e = e.select(
        key.alias("trace_key"), "ts", "event_id", "user_id", F.col("event_type").alias("tool"), "props",
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").cast("long").alias("v"),
    )
    pos = F.row_number().over(Window.partitionBy("trace_key").orderBy("ts", "event_id")) - 1
    return e.withColumn("pos", pos.cast("int"))


def steps(ev: DataFrame, **columns: Column) -> DataFrame:
    """A call and its result for every event, at 2 * pos and 2 * pos + 1; ``columns`` replace what they hold.

    By default a call has the event's id, type and props, its result the whole
    part of the event's value, and an ``error`` event's result has failed.
    """
    own = {
        "call_id": F.col("event_id").cast("string"), "args_json": F.col("props"), "raw_text": F.lit(None),
        "content_json": F.col("v").cast("string"), "status": F.when(F.col("tool") == "error", "error").otherwise("ok"),
        "error": F.lit(None), "http_status": F.lit(None),
    } | columns
    in_call, in_result = ("call_id", "args_json", "raw_text"), ("call_id", "content_json", "status", "error", "http_status")

    def step(kind: str, used: tuple[str, ...], tool: Column) -> Column:
        have = {n: own[n] for n in used} | {"kind": F.lit(kind), "tool": tool}
        kinds = {n: "int" if n == "http_status" else "string" for n in model.STEP_NAMES}
        return F.struct(*[have.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in model.STEP_NAMES])

    both = F.array(step(model.CALL, in_call, F.col("tool")), step(model.RESULT, in_result, F.lit(None)))
    s = ev.select("trace_key", F.col("trace_key").alias("run_id"), "pos", F.posexplode(both).alias("half", "s"))
    return s.select("trace_key", "run_id", (2 * F.col("pos") + F.col("half")).cast("int").alias("idx"), "s.*")


def loose_steps(ev: DataFrame) -> DataFrame:
    """Views and clicks as calls, all other events as results, with ids that come again (k modulo 20)."""
    is_call = F.col("tool").isin("view", "click")
    have = {
        "kind": F.when(is_call, model.CALL).otherwise(model.RESULT), "call_id": (F.col("k") % 20).cast("string"),
        "tool": F.when(is_call, F.col("tool")), "args_json": F.when(is_call, F.col("props")),
        "content_json": F.when(~is_call, F.col("v").cast("string")), "status": F.when(F.col("tool") == "error", "error").when(~is_call, "ok"),
    }
    cols = [have.get(n, F.lit(None)).cast("int" if n == "http_status" else "string").alias(n) for n in model.STEP_NAMES]
    return ev.select("trace_key", F.col("trace_key").alias("run_id"), F.col("pos").alias("idx"), *cols)


#: The first word of an assistant's turn that is long enough to be looked for.
WORD = "[A-Za-z]{4,}"


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages; an assistant's turn is also a call that quotes its first long word."""
    c = table(spark, sf_dir, "conversations")
    word = F.regexp_extract("text", WORD, 0)
    message = {"kind": F.lit(model.MESSAGE), "role": F.col("role"), "content": F.col("text")}
    call = {"kind": F.lit(model.CALL), "call_id": F.col("turn"), "tool": F.lit("quote"), "args_json": F.concat(F.lit('{"word": "'), word, F.lit('"}'))}
    make = lambda have: F.struct(*[have.get(n, F.lit(None)).cast("int" if n == "http_status" else "string").alias(n) for n in model.STEP_NAMES])
    both = F.when(F.col("role") == "assistant", F.array(make(call), make(message))).otherwise(F.array(make(message)))
    s = c.select(F.col("conv_id").cast("string").alias("trace_key"), F.col("conv_id").cast("string").alias("run_id"), "turn", F.posexplode(both).alias("half", "s"))
    return s.select("trace_key", "run_id", (2 * F.col("turn") + F.col("half")).cast("int").alias("idx"), "s.*")
