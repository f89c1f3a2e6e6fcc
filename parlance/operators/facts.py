"""Facts of a session that its entries add up to: tokens, titles, model, activity, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USAGE = ("input", "output", "cache_write", "cache_read")


def total_tokens(usage: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, total_tokens) of (key, thread, reply_id, sequence, four counts): the last usage of each reply of
    a thread, and every usage without a reply."""
    whole = sum((F.coalesce(F.col(c), F.lit(0)) for c in USAGE), F.lit(0))
    rows = usage.withColumn("_whole", whole)
    replies = rows.where("reply_id IS NOT NULL").groupBy(key, "thread", "reply_id").agg(F.max_by("_whole", "sequence").alias("_whole"))
    every = replies.select(key, "_whole").unionByName(rows.where("reply_id IS NULL").select(key, "_whole"))
    return every.groupBy(key).agg(F.sum("_whole").cast("long").alias("total_tokens"))


def split_usage(rows: DataFrame, total: str, cached: str, output: str) -> DataFrame:
    """Adds the four counts from a total that holds cached tokens, too; rows without any tokens go."""
    known = {c: F.coalesce(F.col(c), F.lit(0)) for c in (total, cached, output)}
    fresh = F.greatest(known[total] - known[cached], F.lit(0))
    found = rows.withColumns({"input": fresh, "output": known[output], "cache_write": F.lit(0).cast("long"), "cache_read": known[cached]})
    return found.where(F.col("input") + F.col("output") + F.col("cache_read") > 0)


def titles(entries: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, custom_title, summary) of (key, sequence, kind, leading, text) rows of the kinds custom-title,
    ai-title and summary; leading ones stand before the transcript.

    The last custom title counts, one of the entries before a leading one, and a blank one clears. The
    last AI title of the entries that isn't blank is the summary, else the last such leading one, else
    the first summary.
    """
    shown = F.nullif(F.trim("text"), F.lit(""))
    custom, ai, first = (F.col("kind") == k for k in ("custom-title", "ai-title", "summary"))
    own = ~F.col("leading")
    last = lambda test, value: F.max_by(F.when(test, F.struct(value.alias("t"))), F.when(test, F.col("sequence")))
    found = entries.groupBy(key).agg(
        last(custom & own, shown).alias("a"), last(custom & ~own, shown).alias("b"), last(ai & own & shown.isNotNull(), shown).alias("c"), last(ai & ~own & shown.isNotNull(), shown).alias("d"),
        F.min_by(F.when(first, F.col("text")), F.when(first, F.col("sequence"))).alias("e"),
    )
    return found.select(key, F.when(F.col("a").isNotNull(), F.col("a.t")).otherwise(F.col("b.t")).alias("custom_title"), F.coalesce("c.t", "d.t", "e").alias("summary"))


def models(entries: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, model) of (key, sequence, change, model) rows: the last change, else the first assistant's."""
    change = F.col("change") & F.col("model").isNotNull()
    said = ~F.col("change") & F.col("model").isNotNull()
    found = entries.groupBy(key).agg(F.max_by(F.when(change, F.col("model")), F.when(change, F.col("sequence"))).alias("a"), F.min_by(F.when(said, F.col("model")), F.when(said, F.col("sequence"))).alias("b"))
    return found.select(key, F.coalesce("a", "b").alias("model"))


def activity(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, first_second, last_second, latest_second): the first and last in reading order, and the latest."""
    known = F.col("second").isNotNull() & F.col("role").isin("user", "assistant")
    at = F.when(known, F.col("sequence"))
    return messages.groupBy(key).agg(F.min_by("second", at).alias("first_second"), F.max_by("second", at).alias("last_second"), F.max(F.when(known, F.col("second"))).alias("latest_second"))


def elapsed(rows: DataFrame, key: str, order: str, second: str = "second") -> DataFrame:
    """Adds elapsed, the seconds since the row before; null at the start and where time goes back."""
    gone = F.col(second) - F.lag(second).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("elapsed", F.when(gone >= 0, gone))


def turn_durations(systems: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages (uuid) with the duration that a system record under them (parent_uuid, duration_ms) names last."""
    named = systems.where("duration_ms IS NOT NULL").groupBy(F.col("parent_uuid").alias("uuid")).agg(F.max_by("duration_ms", "line").alias("duration_ms"))
    return messages.join(named, "uuid", "left")


def repeated_skill_texts(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds repeated to (key, order, command, skill): whether a skill text follows the slash command of its
    name, which shows it already."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("repeated", F.coalesce(F.col("skill") == F.last("command", ignorenulls=True).over(before), F.lit(False)))


def dispatch(kind: str = "kind", searchable: str = "searchable", numbered: str = "numbered") -> Column:
    """Where the text of an entry goes: dialogue, agent, tools, titles or nowhere, as one name."""
    k = F.col(kind)
    return (
        F.when(k.isin("thinking", "tool_use"), "tools").when(k.isin("summary", "ai-title", "custom-title"), "titles").when(k == "meta", F.when(F.col(searchable), "dialogue").otherwise("nowhere"))
        .when(k == "progress", "agent").when(k.isin("text", "tool_result"), F.when(F.col(numbered), "dialogue").otherwise("outside")).otherwise("nowhere")
    )
