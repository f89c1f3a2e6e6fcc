"""Which sessions and files are in scope: workspaces, projects, ids, providers, fingerprints, warnings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def resolve_root(agent: str, environment: Mapping[str, str], variable: str, configured: str | None, default: str) -> str:
    """The folder of an agent's transcripts: its environment variable, else the configuration, else the default."""
    found = environment.get(variable, "").strip() or configured or default
    if not found:
        raise ValueError(f"no folder for {agent}")
    return found.rstrip("/") or "/"


def in_workspace(cwd: Column, directories: list[str], repository: bool) -> Column:
    """Whether a recorded folder is one of the directories or, in a repository, below one."""
    tests = [(cwd == d) | (cwd.startswith(f"{d.rstrip('/')}/") if repository else F.lit(False)) for d in directories]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def excluded(project: Column, names: list[str]) -> Column:
    """Whether a project's name, or what comes before its first slash, is one of the names."""
    parent = F.when(F.contains(project, F.lit("/")), F.substring_index(project, "/", 1))
    return F.coalesce(project.isin(names), F.lit(False)) | F.coalesce(parent.isin(names), F.lit(False))


def id_key(column: Column) -> Column:
    """A session id for comparison: UUIDs in lower case, others as they are."""
    return F.when(column.rlike(f"^{_UUID}$"), F.lower(column)).otherwise(column)


def without_sessions(rows: DataFrame, ids: list[str], column: str = "session_id") -> DataFrame:
    """Rows but those of the sessions that are running now."""
    running = [i.lower() if re.fullmatch(_UUID, i) else i for i in ids if i]
    return rows.where(~F.coalesce(id_key(F.col(column)).isin(running), F.lit(False))) if running else rows


def session_query(rows: DataFrame, text: str, column: str = "session_id") -> DataFrame | None:
    """The session that a query names, or None if the query isn't an id."""
    text = text.strip()
    if not re.fullmatch(rf"{_UUID}|(?:ses|session|rollout)[_-][A-Za-z0-9_-]+", text):
        return None
    return rows.where(id_key(F.col(column)) == (text.lower() if re.fullmatch(_UUID, text) else text))


def prune_by_write_time(files: DataFrame, after_second: int | None, modified: str = "modified") -> DataFrame:
    """Files that may hold messages from a time on: those last written before it don't."""
    return files if after_second is None else files.where(F.col(modified) >= after_second)


def listed(sessions: DataFrame, messages: DataFrame, in_window: Column, active: bool) -> DataFrame:
    """Sessions that a listing shows: those found by id or listed already, whatever the window, and
    discovered ones with a message in it."""
    if not active:
        return sessions
    known = F.col("origin").isin("found-by-id", "already-listed")
    seen = messages.where(in_window).select("conv_id").distinct()
    return sessions.where(known).unionByName(sessions.where(~known).join(seen, "conv_id", "left_semi").select(sessions.columns))


def unlisted_reasons(entries: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, reason) of (key, kind, command, text, preview) entries; null for listed sessions.

    A session of ``/clear`` alone, without search text, or without a preview isn't listed.
    """
    said = F.col("kind").isin("text", "meta")
    rows = entries.groupBy(key).agg(
        F.bool_or(said).alias("_said"), F.every(~said | F.coalesce(F.col("command") == "/clear", F.lit(False))).alias("_clear"),
        F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("_text"), F.count("preview").alias("_previews"),
    )
    reason = (
        F.when(~F.col("_said"), "no-conversation").when(F.col("_clear"), "clear-only").when(~F.col("_text"), "no-search-text").when(F.col("_previews") == 0, "no-preview")
    )
    return rows.select(key, reason.alias("reason"))


def first_provider(rows: DataFrame, identity: str, order: str, key: str) -> DataFrame:
    """Of the rows for one file the one of the first provider; of several of its rows the one with the least key."""
    rank = F.row_number().over(Window.partitionBy(identity).orderBy(order, key))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def union_providers(found: Mapping[str, DataFrame]) -> DataFrame:
    """All providers' sessions in one table, with the provider's name and place; absent columns are null."""
    frames = [f.withColumns({"source": F.lit(name), "provider_order": F.lit(k)}) for k, (name, f) in enumerate(found.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fingerprints(files: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, size, modified): the bytes and the last write of a session's files, its sub-agents' included."""
    return files.groupBy(key).agg(F.sum("size").alias("size"), F.max("modified").alias("modified"))


def database_fingerprints(sessions: DataFrame, messages: DataFrame, parts: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, size, modified) of sessions in a database: bytes of their messages' and parts' data, and the
    latest update of any of the three. Sessions (key, updated), messages and parts (key, data, updated)."""
    side = lambda t, n: t.groupBy(key).agg(F.sum(F.octet_length("data")).alias(f"{n}_size"), F.max("updated").alias(f"{n}_at"))
    rows = sessions.select(key, "updated").join(side(messages, "m"), key, "left").join(side(parts, "p"), key, "left")
    size = F.coalesce("m_size", F.lit(0)) + F.coalesce("p_size", F.lit(0))
    return rows.select(key, size.cast("long").alias("size"), F.greatest("updated", "m_at", "p_at").alias("modified"))


def sidecar_titles(sessions: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Sessions (session_id, title, summary) where a title from outside replaces both."""
    outside = sidecar.groupBy(id_key(F.col("session_id")).alias("_id")).agg(F.max_by("title", "updated").alias("_title"))
    rows = sessions.withColumn("_id", id_key(F.col("session_id"))).join(outside, "_id", "left")
    there = F.col("_title").isNotNull()
    return rows.withColumns({"title": F.when(there, F.col("_title")).otherwise(F.col("title")), "summary": F.when(~there, F.col("summary"))}).drop("_id", "_title")


def dropped_records(records: DataFrame) -> DataFrame:
    """(version, kind, outcome, n) of what the readers left out: skipped, unrecognised or failed."""
    return records.where(F.col("outcome").isin("skipped", "unrecognised", "failed")).groupBy("version", "kind", "outcome").agg(F.count("*").alias("n"))


def collapse_warnings(warnings: DataFrame) -> DataFrame:
    """One row for each kind of warning: how many, and the reference if there is only one."""
    return warnings.groupBy("kind").agg(F.count("*").alias("n"), F.when(F.count_distinct("ref") == 1, F.min("ref")).alias("ref"))


def catalogue(sessions: DataFrame, files: DataFrame, messages: DataFrame, entries: DataFrame, parts: DataFrame) -> DataFrame:
    """The catalogue joined to its lowest level: parts with their entry, message, session and its locator
    file; entries without a message, and sessions without files, stay."""
    place = files.where("kind = 'locator'").select("conv_id", "path")
    whole = parts.join(entries.select("entry", "conv_id", "ordinal", "kind"), "entry").join(messages.select("conv_id", "ordinal", "role"), ["conv_id", "ordinal"], "left")
    return whole.join(sessions.select("conv_id", "project"), "conv_id").join(place, "conv_id", "left")
