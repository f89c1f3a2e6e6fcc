"""Where results go: session tables, the passage store, the text protocol and exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import duration_text
from parlance.functions.tools import escape_atom, protocol_snippet


def write_sessions(rows: DataFrame, folder: str) -> None:
    """The session table, a folder for each source; only the folders of sources in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(folder)


def add_passages(store: DataFrame | None, made: DataFrame, folder: str) -> int:
    """Appends (key, embedding, used_day) rows whose key the store doesn't have; how many."""
    new = made.dropDuplicates(["key"])
    if store is not None:
        new = new.join(store.select("key"), "key", "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(folder)
        return n
    finally:
        new.unpersist()


def record(name: str, **fields: Column) -> Column:
    """A line of the text protocol: a name and its fields, those that are null left out."""
    made = [F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), escape_atom(value.cast("string")))) for key, value in fields.items()]
    return F.concat_ws(" ", F.lit(name), *made)


def message_records(messages: DataFrame, same: DataFrame | None = None, most: int = 20_000) -> DataFrame:
    """(conv_id, ordinal, record, body): a message's line, with the message that shows its text already in
    place of the body, and the body in one line."""
    rows = messages if same is None else messages.join(same.select("conv_id", "ordinal", "same_as"), ["conv_id", "ordinal"], "left")
    again = F.lit(None).cast("string") if same is None else F.when(F.col("same_as") < F.col("ordinal"), F.concat(F.lit("m"), F.col("same_as").cast("string")))
    line = record("message", ref=F.concat(F.lit("m"), F.col("ordinal").cast("string")), role=F.col("role"), same=again)
    return rows.select("conv_id", "ordinal", line.alias("record"), F.when(again.isNull(), protocol_snippet(F.col("text"), most)).alias("body"))


def session_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of session rows: reference, messages, duration and title."""
    line = record("session", ref=F.col("conv_id"), messages=F.col("message_count"), duration=duration_text(F.col("duration_minutes") * 60), title=protocol_snippet(F.col("title"), 80))
    return rows.select("conv_id", line.alias("record"))


def export(messages: DataFrame, how: str) -> DataFrame:
    """(conv_id, ordinal, value) lines of an export: plain, markdown, ledger or jsonl."""
    who = F.initcap("role")
    shown = {
        "plain": F.concat(who, F.lit(":\n"), "text", F.lit("\n")),
        "markdown": F.concat(F.lit("## "), who, F.lit("\n\n"), "text", F.lit("\n")),
        "ledger": F.concat(F.rpad(who, F.lit(10), F.lit(" ")), F.lit("│ "), F.regexp_replace("text", "\n", "\n" + " " * 10 + "│ ")),
        "jsonl": F.to_json(F.struct("ordinal", "role", "text")),
    }
    if how not in shown:
        raise ValueError(f"no such export: {how}")
    return messages.select("conv_id", "ordinal", shown[how].alias("value"))


def write_export(messages: DataFrame, how: str, folder: str) -> None:
    """A folder for each conversation, its messages in order in one file."""
    rows = export(messages, how).repartition("conv_id").sortWithinPartitions("conv_id", "ordinal")
    rows.select("conv_id", "value").write.mode("overwrite").partitionBy("conv_id").text(folder)


def printed(lines: Iterable[str]) -> str:
    """The output of a verb: its records, a line each, and an end."""
    return "".join(f"{line}\n" for line in lines)
