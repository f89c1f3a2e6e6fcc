"""Parts of messages: what is shown, searched and counted.

Parts are (conv_id, ordinal, position, role, thread, kind, call_id, tool, text) rows; kind is text,
tool_use, tool_result or thinking, and thread is "" for a session's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import sanitize

#: The order of evidence: what was said, then tools, then thoughts.
DIALOGUE, TOOL, THINKING = 0, 1, 2


@dataclass(frozen=True)
class Shown:
    """Which parts are shown besides texts."""

    tools: bool = True
    tool_results: bool = True
    thinking: bool = True
    subagents: bool = True

    def test(self, kind: str = "kind", thread: str = "thread") -> Column:
        hidden = [k for k, shown in (("tool_use", self.tools), ("tool_result", self.tool_results), ("thinking", self.thinking)) if not shown]
        test = ~F.col(kind).isin(hidden) if hidden else F.lit(True)
        return test if self.subagents else test & (F.coalesce(F.col(thread), F.lit("")) == "")


SEARCHED = Shown()


def parts_of(messages: DataFrame) -> DataFrame:
    """Messages that have one text each, as parts; texts of other roles than user and assistant are tools'."""
    kind = F.when(F.col("role").isin("user", "assistant"), "text").otherwise("tool_result")
    null = F.lit(None).cast("string")
    return messages.select("conv_id", "ordinal", F.lit(1).cast("long").alias("position"), "role", F.lit("").alias("thread"), kind.alias("kind"), null.alias("call_id"), null.alias("tool"), "text")


def has_content(kind: str = "kind", text: str = "text") -> Column:
    """Whether a part makes its message visible: calls and results always, texts and thoughts if not blank."""
    return F.col(kind).isin("tool_use", "tool_result") | (F.col(kind).isin("text", "thinking") & (F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != ""))


def shown_messages(parts: DataFrame, shown: Shown) -> DataFrame:
    """(conv_id, ordinal, parts): messages that still have something to show."""
    return parts.where(shown.test() & has_content()).groupBy("conv_id", "ordinal").agg(F.count("*").alias("parts"))


def hidden_counts(parts: DataFrame, shown: Shown) -> DataFrame:
    """For each message the numbers of hidden calls, results, thoughts and parts of sub-agents."""
    away = ~shown.test()
    own = F.coalesce(F.col("thread"), F.lit("")) == ""
    count = lambda kind: F.count_if(away & own & (F.col("kind") == kind))
    return parts.groupBy("conv_id", "ordinal").agg(
        count("tool_use").alias("tools"), count("tool_result").alias("results"), count("thinking").alias("thoughts"), F.count_if(away & ~own).alias("subagent_parts")
    )


def segments(parts: DataFrame, shown: Shown = SEARCHED) -> DataFrame:
    """(conv_id, ordinal, position, source, text, start): clean texts of the shown parts, and the byte at
    which each begins in its message, whose segments a line feed joins."""
    source = F.when(F.col("kind") == "text", DIALOGUE).when(F.col("kind") == "thinking", THINKING).otherwise(TOOL)
    rows = parts.where(shown.test() & F.col("text").isNotNull()).select("conv_id", "ordinal", "position", source.cast("long").alias("source"), sanitize(F.col("text")).alias("text"))
    before = Window.partitionBy("conv_id", "ordinal").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("long"))


def call_numbers(parts: DataFrame) -> DataFrame:
    """Adds number to calls: their place, from 1, among the calls of their message."""
    order = Window.partitionBy("conv_id", "ordinal").orderBy("position")
    return parts.where("kind = 'tool_use'").withColumn("number", F.row_number().over(order).cast("long"))


def call_with_results(parts: DataFrame, conv_id: int, ordinal: int, number: int) -> DataFrame:
    """The call ``mN.K`` of a conversation and its results: those of its thread with its id, if no other
    call has it; a result in the call's own message is left out."""
    own = parts.where(F.col("conv_id") == conv_id)
    call = call_numbers(own).where((F.col("ordinal") == ordinal) & (F.col("number") == number)).drop("number")
    base = lambda c: F.regexp_replace(c, r"#\d+$", "")
    unique = own.where("kind = 'tool_use' AND call_id IS NOT NULL AND call_id <> 'unknown'").where(F.col("call_id") == base("call_id")).groupBy("thread", "call_id").agg(F.count("*").alias("n")).where("n = 1")
    wanted = call.select("thread", base("call_id").alias("call_id"), F.col("ordinal").alias("called")).join(unique.select("thread", "call_id"), ["thread", "call_id"], "left_semi")
    results = own.where("kind = 'tool_result'").withColumn("_base", base("call_id"))
    linked = results.join(wanted.withColumnRenamed("call_id", "_base"), ["thread", "_base"]).where("ordinal <> called").select(call.columns)
    return call.unionByName(linked)


def thread_handles(parts: DataFrame) -> DataFrame:
    """(conv_id, thread, handle): sub-agents as s1, s2 and so on, by their first message and name."""
    first = parts.where("thread <> ''").groupBy("conv_id", "thread").agg(F.min("ordinal").alias("first"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "thread"))
    return first.select("conv_id", "thread", "first", F.concat(F.lit("s"), number.cast("string")).alias("handle"))


def repeats(parts: DataFrame) -> DataFrame:
    """(conv_id, ordinal, position, same_as): the first message of the owner, the session or a sub-agent,
    with the same text or, for a call, the same tool and input."""
    same = Window.partitionBy("conv_id", "thread", F.when(F.col("kind") == "tool_use", F.coalesce("tool", F.lit(""))).otherwise(F.lit(None)), "text")
    return parts.select("conv_id", "ordinal", "position", F.min("ordinal").over(same).alias("same_as"))
