"""Transcript files: line scan, recognition, and one reader for each dialect.

Each reader gives entries (path, line, session_id, thread, kind, role, reply_id, call_id, tool, text,
ts): a wide table for all dialects. Lines are parsed once as variants, so unknown records and fields
don't fail; malformed lines go to their own table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = ["path", "line", "session_id", "thread", "kind", "role", "reply_id", "call_id", "tool", "text", "ts"]
#: Canonical names of tools.
TOOLS = {
    "Bash": "Shell", "PowerShell": "Shell", "LS": "DirectoryListing", "Task": "Agent", "Agent": "Agent", "SendMessage": "AgentMessage", "SubagentHandback": "AgentReport", "TaskOutput": "Wait",
    "TaskCreate": "TaskList", "TaskUpdate": "TaskList", "TodoWrite": "TaskList", "Read": "Read", "Edit": "Edit", "Write": "Write", "Grep": "Grep", "Glob": "Glob", "WebFetch": "WebFetch", "WebSearch": "WebSearch", "Skill": "Skill",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, start, end, terminated, raw, record) of JSON-lines files: lines from 1 with the bytes
    they take, blank ones left out; record is a variant, or null if malformed.

    Large files are read in blocks, by several tasks: a line's number is its place in its block after the
    lines of the blocks before. A last line without a line feed may still be written; terminated is false.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(path)
    rows = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("place"), "value"
    ).withColumn("bytes", F.octet_length("value") + 1)
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("path", "block").orderBy("place")
    rows = rows.withColumn("line", F.row_number().over(inside)).withColumn("end", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(blocks, ["path", "block"]).withColumns({"line": (F.col("line") + F.col("lines_before")).cast("long"), "end": F.col("end") + F.col("bytes_before")})
    rows = rows.withColumn("raw", F.regexp_replace("value", r"\r$", "")).where(F.trim("raw") != "")
    rows = rows.select("path", "line", (F.col("end") - F.col("bytes")).alias("start"), F.least("end", "size").alias("end"), (F.col("end") <= F.col("size")).alias("terminated"), "raw")
    return rows.withColumn("record", F.try_parse_json("raw"))


def malformed(lines: DataFrame, around: int = 2) -> DataFrame:
    """Malformed lines with up to two lines before and after each."""
    by = Window.partitionBy("path").orderBy("line")
    before = F.array_compact(F.array(*(F.lag("raw", k).over(by) for k in range(around, 0, -1))))
    after = F.array_compact(F.array(*(F.lead("raw", k).over(by) for k in range(1, around + 1))))
    rows = lines.withColumn("before", before).withColumn("after", after)
    return rows.where("record IS NULL").select("path", "line", "raw", "before", "after")


def _get(path: str, kind: str = "string", record: str = "record") -> Column:
    return F.try_variant_get(F.col(record), f"$.{path}", kind)


def recognise(lines: DataFrame) -> DataFrame:
    """(path, source): the dialect of each file by its first well-formed record; null for foreign files."""
    first = lines.where("record IS NOT NULL").groupBy("path").agg(F.min_by("record", "line").alias("record"))
    kind = _get("type")
    source = (
        F.when(_get("method").isNotNull() & _get("params.update.sessionUpdate").isNotNull(), "grok")
        .when(kind.isin("session_meta") | _get("payload.type").isNotNull(), "codex")
        .when(kind.isin("session", "title") & _get("id").isNotNull(), "pi")
        .when((kind == "metadata") & _get("protocol_version").isNotNull(), "kimi")
        .when(_get("sessionId").isNotNull() | kind.isin("summary", "custom-title"), "claude")
    )
    return first.select("path", source.alias("source"))


def _blocks(content: str) -> Column:
    """A content field, a string or an array of blocks, as an array of variants."""
    whole = _get(content, "string")
    return F.when(F.schema_of_variant(F.try_variant_get(F.col("record"), f"$.{content}", "variant")) == "STRING", F.array(F.try_parse_json(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), whole))))).otherwise(
        _get(content, "array<variant>")
    )


def _entries(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*(columns.get(c, F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ENTRY))


def claude_entries(lines: DataFrame) -> DataFrame:
    """User and assistant records by block, titles, summaries and local commands."""
    rows = lines.where("record IS NOT NULL").withColumn("type", _get("type"))
    base = {"session_id": _get("sessionId"), "ts": _get("timestamp"), "thread": F.coalesce(_get("parentToolUseID"), F.lit(""))}
    said = rows.where(F.col("type").isin("user", "assistant") & ~F.coalesce(_get("isMeta", "boolean"), F.lit(False))).withColumn("block", F.explode(_blocks("message.content")))
    kind = _get("type", record="block")
    name = _get("name", record="block")
    tool = F.when(kind == "tool_use", _canonical(name))
    body = F.coalesce(_get("text", record="block"), _get("thinking", record="block"), _get("content", record="block"), F.to_json(F.try_variant_get(F.col("block"), "$.input", "variant")))
    blocks = _entries(said, **base, kind=kind, role=F.col("type"), reply_id=_get("message.id"), call_id=F.coalesce(_get("id", record="block"), _get("tool_use_id", record="block")), tool=tool, text=body)
    titles = rows.where(F.col("type").isin("summary", "custom-title", "ai-title"))
    titled = _entries(titles, **base, kind=F.col("type"), text=F.coalesce(_get("customTitle"), _get("aiTitle"), _get("summary")))
    local = rows.where((F.col("type") == "system") & (_get("subtype") == "local_command"))
    return blocks.unionByName(titled).unionByName(_entries(local, **base, kind=F.lit("text"), role=F.lit("user"), text=_get("content")))


def _canonical(name: Column) -> Column:
    out = F.lit("Other")
    for source, tool in TOOLS.items():
        out = F.when(name == source, tool).otherwise(out)
    return out


def codex_entries(lines: DataFrame) -> DataFrame:
    """Messages, reasoning, calls and results of a rollout; developer messages are left out."""
    rows = lines.where("record IS NOT NULL").withColumn("type", _get("payload.type")).withColumn("role_", _get("payload.role"))
    session = F.first(F.when(_get("type") == "session_meta", _get("payload.id")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("session", session).where(_get("type") == "response_item")
    base = {"session_id": F.col("session"), "ts": _get("timestamp"), "thread": F.lit("")}
    join = lambda path: F.array_join(F.transform(_get(path, "array<variant>"), lambda b: F.try_variant_get(b, "$.text", "string")), "\n")
    said = rows.where((F.col("type") == "message") & F.col("role_").isin("user", "assistant"))
    thought = rows.where(F.col("type") == "reasoning")
    called = rows.where(F.col("type").isin("function_call", "custom_tool_call"))
    result = rows.where(F.col("type").isin("function_call_output", "custom_tool_call_output"))
    parts = [
        _entries(said, **base, kind=F.lit("text"), role=F.col("role_"), reply_id=_get("payload.id"), text=join("payload.content")),
        _entries(thought, **base, kind=F.lit("thinking"), role=F.lit("assistant"), text=join("payload.summary")),
        _entries(called, **base, kind=F.lit("tool_use"), role=F.lit("assistant"), call_id=_get("payload.call_id"), tool=_get("payload.name"), text=F.coalesce(_get("payload.arguments"), _get("payload.input"))),
        _entries(result, **base, kind=F.lit("tool_result"), role=F.lit("user"), call_id=_get("payload.call_id"), text=F.coalesce(_get("payload.output"), join("payload.output"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def grok_entries(lines: DataFrame) -> DataFrame:
    """Neighbouring chunks of one kind and key as one message; its line and time are the first chunk's."""
    update = "params.update"
    rows = lines.where("record IS NOT NULL").withColumn("kind", _get(f"{update}.sessionUpdate"))
    key = F.concat_ws("|", "kind", F.coalesce(_get("params._meta.promptId"), F.lit("")), F.coalesce(_get("params._meta.streamStartMs"), F.lit("")), F.coalesce(_get(f"{update}._meta.promptIndex"), F.lit("")))
    rows = rows.withColumn("key", F.when(F.col("kind").isin("user_message_chunk", "agent_message_chunk", "agent_thought_chunk"), key).otherwise(F.concat(F.lit("#"), F.col("line").cast("string"))))
    by = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("run", F.sum((F.coalesce(F.lag("key").over(by) != F.col("key"), F.lit(True))).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chunks = rows.where(~F.col("key").startswith("#")).groupBy("path", "run", "kind").agg(
        F.min("line").alias("line"), F.min_by(_get("params.sessionId"), "line").alias("session_id"), F.min_by(_get("timestamp"), "line").alias("ts"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", _get(f"{update}.content.text").alias("t")))), lambda x: x["t"]), "").alias("text"),
    )
    said = chunks.where(F.trim("text") != "")
    role = F.when(F.col("kind") == "user_message_chunk", "user").otherwise("assistant")
    return _entries(said.drop("run"), thread=F.lit(""), kind=F.when(F.col("kind") == "agent_thought_chunk", "thinking").otherwise("text"), role=role)


def pi_branch(lines: DataFrame) -> DataFrame:
    """The entries of the branch that ends at each file's last record, from (path, line, record)."""
    from parlance.operators.links import branch, newest

    rows = lines.where("record IS NOT NULL").withColumn("id", _get("id")).withColumn("parent", _get("parentId")).where((_get("type") != "session") & F.col("id").isNotNull())
    rows = newest(rows, "id", [F.desc("line")])
    on = branch(rows, "path", "id", "parent", "line")
    return rows.join(on.select("path", "id"), ["path", "id"], "left_semi")
