"""Chat formatting with cumulative-snapshot collapse.

Chat services often log the whole conversation again after every turn.  A
logged conversation whose turns are the first turns of a longer one adds
nothing.  Every turn gets the hash of the turns up to and with it, as a sum over a
window of its conversation; a conversation whose last hash occurs before the end
of another is a snapshot and an anti-join drops it before rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm import runtime

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Lanes of a turn's digest that are summed; 15 hexadecimal digits each, so that sums never wrap.
LANES = 4


def _lanes(position: Column, role: Column, text: Column) -> list[Column]:
    """Numbers from the SHA-256 of a turn and its position; role and text can't run into each other, nulls differ from empty."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    digest = F.sha2(F.concat(position.cast("string"), F.lit("|"), part(role), part(text)), 256)
    return [F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(19,0)") for i in range(LANES)]


def escaped(text: Column) -> Column:
    """``text`` in which no marker can stand: every "<|" gets one more bar, so different texts stay different."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _role(role: Column) -> Column:
    """A role on one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the conversations that are no other's prefix.

    Turns are ordered by (turn, role, text), nulls first, so that ties and
    repeated rows have one order; repeated rows stay, as the log has them.
    Among equal conversations the smallest conv_id stays.  Rows with a null
    conv_id belong to no conversation and are dropped.  A null role is rendered
    as ``unknown``, a null text as empty; both take part in comparison as
    nulls, different from empty strings.  "<|" is rendered as "<||" in role and
    text, and a line feed or backslash in a role with a backslash before it, so
    that no text can pose as a turn.  Texts of any length, and conversations of
    any number of turns, are read whole, in time in proportion to them; a
    conversation is one row of the result.  An empty table gives an empty
    result.  Columns besides the four are ignored.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("k", F.row_number().over(order)).withColumn("last", F.lead(F.lit(False), 1, True).over(order))
    lanes = [f"h{i}" for i in range(LANES)]
    t = t.withColumns(dict(zip(lanes, _lanes(F.col("k"), F.col("role"), F.col("text")), strict=True)))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hashed = t.select("conv_id", "k", "last", *[F.sum(x).over(upto).alias(x) for x in lanes])
    # only hashes move; the turns are read again for the conversations that stay
    same = ["k", *lanes]
    with runtime.scratch(turns.sparkSession) as made:
        hashed, _ = runtime.written(hashed)
        inner = hashed.filter("NOT last").select(same).distinct()
        winners, path = runtime.written(hashed.filter("last").join(inner, same, "left_anti").groupBy(same).agg(F.min("conv_id").alias("conv_id")).select("conv_id"))
        made.remove(path)
    line = F.concat(F.lit(BEGIN), F.coalesce(_role(F.col("role")), F.lit("unknown")), F.lit("\n"), F.coalesce(escaped(F.col("text")), F.lit("")), F.lit(END))
    kept = t.join(winners, "conv_id", "left_semi").select("conv_id", F.struct("k", line.alias("line")).alias("turn"))
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["line"]), "\n").alias("rendered"))
