"""Message operators over conversations (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDACTED = "[Previous retrieval result omitted - knowledge base may have changed. Please perform a fresh search.]"


def tokens(role: Column, text: Column) -> Column:
    """A quarter, rounded up, of the characters of role, text, three empty fields and an empty list joined by line feeds; and 8."""
    size = F.length(F.coalesce(role, F.lit(""))) + F.length(F.coalesce(text, F.lit(""))) + 7
    return F.floor((size + 3) / 4).cast("long") + 8


def tail(messages: DataFrame) -> DataFrame:
    """Messages from the last of a user on, or the last one where there is no user."""
    w = Window.partitionBy("conv_id")
    last = F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w), F.max("turn").over(w))
    return messages.withColumn("_last", last).where("turn >= _last").drop("_last")


def compressed(messages: DataFrame, budget: int) -> DataFrame:
    """Leading system messages, the tail, and as many of the newest messages between as the budget allows.

    A message between is kept if all that is newer, the head, the tail and it fit: a suffix sum per conversation.
    """
    w = Window.partitionBy("conv_id")
    o = w.orderBy("turn")
    sized = messages.withColumn("_n", tokens(F.col("role"), F.col("text")))
    sized = sized.withColumn("_last", F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w), F.max("turn").over(w)))
    sized = sized.withColumn("_system", F.min((F.col("role") == "system").cast("int")).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    sized = sized.withColumn("_fixed", (F.col("turn") >= F.col("_last")) | F.col("_system"))
    total = F.sum("_n").over(w)
    fixed = F.sum(F.when(F.col("_fixed"), F.col("_n")).otherwise(0)).over(w)
    newer = F.sum(F.when(~F.col("_fixed"), F.col("_n")).otherwise(0)).over(w.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    short = (total <= budget) | (F.count("*").over(w) <= 2)
    kept = sized.withColumn("_keep", short | F.col("_fixed") | (fixed + newer <= budget))
    return kept.where("_keep").select(*messages.columns)


def merged_roles(messages: DataFrame) -> DataFrame:
    """Neighbours of one role as one message, texts joined by blank lines; empty ones of users and assistants go first."""
    kept = messages.where((F.coalesce("text", F.lit("")) != "") | F.col("role").isin("system", "tool"))
    o = Window.partitionBy("conv_id").orderBy("turn")
    change = (F.lag("role").over(o).isNull() | (F.lag("role").over(o) != F.col("role")) | (F.col("role") == "tool")).cast("int")
    runs = kept.withColumn("_c", change).withColumn("_run", F.sum("_c").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    listed = runs.groupBy("conv_id", "_run").agg(F.min("turn").alias("turn"), F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return listed.select("conv_id", "turn", "role", F.array_join("l.text", "\n\n").alias("text"))


def redacted(messages: DataFrame, tool: str = "knowledge_search", name: str = "name") -> DataFrame:
    return messages.withColumn("text", F.when((F.col("role") == "tool") & (F.col(name) == tool), F.lit(REDACTED)).otherwise(F.col("text")))


def with_orphans_as_system(messages: DataFrame) -> DataFrame:
    """Tool messages whose call no earlier assistant message made, as system messages. calls: array of ids; call_id, name."""
    calls = messages.where("role = 'assistant'").select("conv_id", F.col("turn").alias("_t"), F.explode("calls").alias("call_id"))
    first = calls.groupBy("conv_id", "call_id").agg(F.min("_t").alias("_t"))
    j = messages.join(first, ["conv_id", "call_id"], "left")
    orphan = (F.col("role") == "tool") & (F.coalesce("call_id", F.lit("")) != "") & (F.col("_t").isNull() | (F.col("_t") >= F.col("turn")))
    text = F.when(orphan, F.concat(F.lit("[Tool result for "), F.coalesce("name", F.lit("")), F.lit("]: "), F.col("text"))).otherwise(F.col("text"))
    return j.withColumn("text", text).withColumn("role", F.when(orphan, F.lit("system")).otherwise(F.col("role"))).select(*messages.columns)


def last_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The last 2 x turns messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * turns).drop("_n")
