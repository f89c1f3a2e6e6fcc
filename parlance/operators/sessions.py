"""Messages and sessions: numbering, the session fold, windows, listings, reads and outlines.

Messages are (conv_id, ordinal, role, text, ts) rows; the role "system" is metadata. All windows are
partitioned by conversation, so conversations are spread over the cluster and never gathered.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import collapse
from parlance.plans.query import LISTED, TimeFilter

EPOCH = "2024-01-01 00:00:00"


def messages_of(conversations: DataFrame) -> DataFrame:
    """The driver tables' conversations as messages, with a time made of conversation and turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    seconds = F.unix_timestamp(F.lit(EPOCH)) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return conversations.select("conv_id", F.row_number().over(order).cast("long").alias("ordinal"), "role", F.coalesce("text", F.lit("")).alias("text"), seconds.cast("long").alias("second"))


def number_messages(entries: DataFrame) -> DataFrame:
    """Numbers visible entries (conv_id, sequence, thread, role, reply_id, text).

    Entries of one reply share the number of its first entry; assistant entries before the first user
    entry, a first user entry "Warmup" and blank entries have none. Adds thread_number (by first
    appearance, the session's own is 0) and position in the thread.
    """
    by = Window.partitionBy("conv_id").orderBy("sequence")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.trim("text") == ""
    user = (F.col("role") == "user") & ~blank
    warmup = user & (F.trim("text") == "Warmup") & (F.sum(user.cast("int")).over(so_far) == 1)
    rows = entries.withColumn("_user", user & ~warmup).withColumn("_warm", warmup)
    rows = rows.withColumn("_seen", F.max(F.col("_user").cast("int")).over(so_far) == 1)
    rows = rows.withColumn("_visible", ~blank & ~F.col("_warm") & ((F.col("role") != "assistant") | F.col("_seen")))
    reply = Window.partitionBy("conv_id", "thread", F.coalesce("reply_id", F.concat(F.lit("#"), F.col("sequence").cast("string"))), "_visible").orderBy("sequence")
    rows = rows.withColumn("_starts", F.col("_visible") & (F.row_number().over(reply) == 1))
    rows = rows.withColumn("_count", F.sum(F.col("_starts").cast("long")).over(so_far))
    rows = rows.withColumn("ordinal", F.when(F.col("_visible"), F.first("_count").over(reply)))
    first = F.min("sequence").over(Window.partitionBy("conv_id", "thread"))
    rows = rows.withColumn("_first", F.when(F.col("thread") == "", F.lit(-1)).otherwise(first))
    return rows.select(
        *entries.columns, "ordinal", F.col("_starts").alias("starts"), (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("_first")) - 1).cast("long").alias("thread_number"),
        F.row_number().over(Window.partitionBy("conv_id", "thread").orderBy("sequence")).cast("long").alias("position"),
    )


def fold_sessions(messages: DataFrame) -> DataFrame:
    """One row for each session: counts, time span, duration and previews, in one aggregation."""
    user = F.col("role") == "user"
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = messages.withColumn("first_user", F.min(F.when(user, F.col("ordinal"))).over(whole))
    said = said.withColumn("_shown", F.coalesce(F.col("role").isin("user", "assistant") & (F.col("ordinal") >= F.col("first_user")), F.lit(False)).cast("int"))
    said = said.withColumns({"_number": F.sum("_shown").over(so_far), "_all": F.sum("_shown").over(whole)})
    # the first three and the last three
    ends = (F.col("_shown") == 1) & ((F.col("_number") <= 3) | (F.col("_number") > F.col("_all") - 3))
    part = F.when(ends, F.struct("ordinal", F.left(collapse(F.col("text")), F.lit(80)).alias("t")))
    first, last = F.min("second"), F.max("second")
    listed = F.sort_array(F.collect_list(part))
    folded = said.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"), first.alias("first_second"), last.alias("last_second"),
        listed.alias("parts"), F.sum(F.length("text")).cast("long").alias("chars"),
    )
    texts = F.transform("parts", lambda p: p["t"])
    minutes = F.floor((F.col("last_second") - F.col("first_second")) / 60).cast("long")
    return folded.select(
        "conv_id", "message_count", "assistant_messages", "chars", "first_second", "last_second", F.when(minutes > 0, minutes).alias("duration_minutes"),
        F.array_join(F.slice(texts, 1, 3), " ... ").alias("preview_first"),
        F.array_join(F.reverse(F.slice(texts, F.greatest(F.size(texts) - 2, F.lit(1)), 3)), " ... ").alias("preview_last"),
    )


def in_window(window: TimeFilter, first: str = "second", last: str = "second") -> Column:
    """Whether a span overlaps the closed window; one without time is in no active window."""
    test = F.lit(True)
    if window.after:
        test &= F.coalesce(F.col(last) >= int(window.after.timestamp()), F.lit(False))
    if window.before:
        test &= F.coalesce(F.col(first) <= int(window.before.timestamp()), F.lit(False))
    return test


def sessions_in_window(messages: DataFrame, window: TimeFilter) -> DataFrame:
    """Count and span of each session's messages in the window; sessions without any are left out."""
    return messages.where(in_window(window)).groupBy("conv_id").agg(F.count("*").alias("in_window"), F.min("second").alias("first_second"), F.max("second").alias("last_second"))


def list_sessions(messages: DataFrame, window: TimeFilter = TimeFilter(), limit: int = LISTED, offset: int = 0) -> DataFrame:
    """Sessions by their last second in the window, newest first, ties by id."""
    rows = sessions_in_window(messages, window)
    return rows.orderBy(F.desc("last_second"), "conv_id").offset(offset).limit(limit)


def window_runs(messages: DataFrame, window: TimeFilter, hit: Column | None = None) -> DataFrame:
    """Runs of consecutive messages in the window (and hit): first and last ordinal, and count."""
    rows = messages.where(in_window(window) if hit is None else in_window(window) & hit)
    island = F.col("ordinal") - F.row_number().over(Window.partitionBy("conv_id").orderBy("ordinal"))
    return rows.withColumn("island", island).groupBy("conv_id", "island").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n")).drop("island")


def empty_sessions(messages: DataFrame) -> DataFrame:
    """Sessions without an assistant message, newest first."""
    return fold_sessions(messages).where("assistant_messages = 0").select("conv_id", "message_count", "last_second").orderBy(F.desc("last_second"), "conv_id")


def tail(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("ordinal")))
    return messages.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def read_range(messages: DataFrame, conv_id: int, first: int, last: int) -> DataFrame:
    return messages.where((F.col("conv_id") == conv_id) & F.col("ordinal").between(first, last))


def lines(texts: DataFrame, key: str) -> DataFrame:
    """(key, line, content), lines from 1."""
    return texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "content")).select(key, (F.col("at") + 1).cast("long").alias("line"), "content")


def line_slice(texts: DataFrame, key: str, first: int, last: int) -> DataFrame:
    return lines(texts, key).where(F.col("line").between(first, last))


def context_lines(texts: DataFrame, key: str, pattern: str, radius: int = 3) -> DataFrame:
    """Lines that hold the pattern (case aside) and up to ``radius`` around, with whether they match."""
    rows = lines(texts, key).withColumn("match", F.contains(F.lower("content"), F.lit(pattern.lower())))
    around = Window.partitionBy(key).orderBy("line").rowsBetween(-radius, radius)
    return rows.withColumn("near", F.max("match").over(around)).where("near").drop("near")


def outline(messages: DataFrame, size: int, snippet: int = 80) -> DataFrame:
    """Segments of ``size`` messages: range, counts and the snippets of the first and last."""
    order = Window.partitionBy("conv_id").orderBy("ordinal")
    rows = messages.withColumn("segment", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    text = F.left(collapse(F.col("text")), F.lit(snippet))
    return rows.groupBy("conv_id", "segment").agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count_if(F.col("role") == "user").alias("users"), F.sum(F.length("text")).cast("long").alias("chars"),
        F.min_by(text, "ordinal").alias("first_snippet"), F.max_by(text, "ordinal").alias("last_snippet"),
    )


def chars_before(messages: DataFrame) -> DataFrame:
    """Running number of characters before each message."""
    so_far = Window.partitionBy("conv_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return messages.select("conv_id", "ordinal", F.coalesce(F.sum(F.length("text")).over(so_far), F.lit(0)).cast("long").alias("chars_before"))


def since(now: datetime, days: float) -> TimeFilter:
    return TimeFilter(after=datetime.fromtimestamp(now.timestamp() - days * 86_400, now.tzinfo))
