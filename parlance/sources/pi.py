"""Pi and OMP transcripts: the shown branch's records as entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.records import emit, entry, filled, get

#: Canonical names of tools.
TOOLS = {"bash": "Shell", "read": "Read", "edit": "Edit", "write": "Write", "grep": "Grep", "find": "Glob", "ls": "DirectoryListing", "task": "Agent", "fetch": "WebFetch", "web_search": "WebSearch", "todo": "TaskList", "todo_write": "TaskList"}


def _tool(name: Column) -> Column:
    out = F.lit("Other")
    for source, tool in TOOLS.items():
        out = F.when(F.lower(name) == source, tool).otherwise(out)
    return out


def with_chain(lines: DataFrame) -> DataFrame:
    """Adds id and parent; in the first version of the format, which has none, each record answers the one before."""
    rows = lines.where("record IS NOT NULL").withColumns({"id": get("id"), "parent": get("parentId"), "type": get("type")})
    by = Window.partitionBy("path").orderBy("line")
    version = F.max(F.when(F.col("type") == "session", get("version", "long"))).over(Window.partitionBy("path"))
    old = (F.coalesce(version, F.lit(1)) < 2) & (F.col("type") != "session")
    own = F.when(old & F.col("id").isNull(), F.concat(F.lit("line-"), F.col("line").cast("string"))).otherwise(F.col("id"))
    rows = rows.withColumn("id", own)
    # the session record is no answer's target
    before = F.lag(F.when(F.col("type") != "session", F.col("id"))).over(by)
    return rows.withColumn("parent", F.when(old & F.col("parent").isNull(), before).otherwise(F.col("parent")))


def _blocks(value: str, role: str) -> tuple[Column, bool]:
    """The entries of a content field: a string, or blocks of text, thinking, calls and images."""
    whole, items = get(value), get(value, "array<variant>")
    field = lambda b, name: F.try_variant_get(b, f"$.{name}", "string")

    def item(b: Column) -> Column:
        kind = field(b, "type")
        return F.coalesce(
            entry((kind == "text") & filled(field(b, "text")), kind="text", role=role, text=field(b, "text")),
            entry((kind == "thinking") & filled(field(b, "thinking")), kind="thinking", role=role, text=field(b, "thinking")),
            entry(
                kind == "toolCall", kind="tool_use", role=role, call_id=F.coalesce(field(b, "id"), F.lit("unknown")), tool=_tool(field(b, "name")), name=F.coalesce(field(b, "name"), F.lit("unknown")),
                input=F.coalesce(F.to_json(F.try_variant_get(b, "$.arguments", "variant")), F.lit("{}")),
            ),
            entry(kind == "image", kind="text", role=role, text=F.concat(F.lit("[image"), F.coalesce(F.concat(F.lit(": "), field(b, "mimeType")), F.lit("")), F.lit("]"))),
        )

    plain = F.array(entry(filled(whole), kind="text", role=role, text=whole))
    return F.when(F.schema_of_variant(get(value, "variant")) == "STRING", plain).otherwise(F.coalesce(F.transform(items, item), F.array())), True


def _usage(at: str) -> dict[str, Column]:
    names = {"input_tokens": "input", "output_tokens": "output", "cache_write": "cacheWrite", "cache_read": "cacheRead"}
    return {ours: get(f"{at}.{theirs}", "long") for ours, theirs in names.items()}


def _only(test: Column, many: tuple[Column, bool]) -> tuple[Column, bool]:
    return F.when(test, many[0]).otherwise(F.array()), True


def pi_entries(lines: DataFrame) -> DataFrame:
    """Entries of (path, line, id, record) rows of the shown branch; each assistant record is its own message."""
    rows = lines.where("record IS NOT NULL").withColumns({"type": get("type"), "says": get("message.role"), "ts": get("timestamp")})
    of = lambda *kinds: F.col("type").isin(*kinds)
    role = lambda *roles: of("message") & F.col("says").isin(*roles)
    joined = lambda path: F.coalesce(
        F.when(F.schema_of_variant(get(path, "variant")) == "STRING", get(path)), F.array_join(F.array_compact(F.transform(get(path, "array<variant>"), lambda b: F.try_variant_get(b, "$.text", "string"))), "\n"), F.lit("")
    )
    shown = lambda at: F.coalesce(get(f"{at}display", "boolean"), F.lit(True))
    meta = lambda label, text, searchable: {"kind": "meta", "label": label, "text": text, "searchable": F.lit(searchable)}
    code = get("message.exitCode", "long")
    printed = F.concat_ws("\n", F.nullif(get("message.output"), F.lit("")), F.when(F.coalesce(get("message.cancelled", "boolean"), F.lit(False)), F.lit("(cancelled)")).when(code != 0, F.concat(F.lit("exit code "), code.cast("string"))))
    model = F.coalesce(get("model"), F.concat(F.coalesce(get("provider"), F.lit("unknown")), F.lit("/"), F.coalesce(get("modelId"), F.lit("unknown"))))
    return emit(
        rows,
        ["path", "line", "ts"],
        _only(role("user"), _blocks("message.content", "user")),
        _only(role("assistant"), _blocks("message.content", "assistant")),
        entry(role("assistant") & get("message.usage", "variant").isNotNull(), kind="meta", label="Usage", searchable=F.lit(False), model=get("message.model"), **_usage("message.usage")),
        entry(role("toolResult"), kind="tool_result", role="user", call_id=F.coalesce(get("message.toolCallId"), F.lit("unknown")), name=get("message.toolName"), text=joined("message.content"), **_usage("message.usage")),
        entry(role("bashExecution"), kind="tool_use", role="user", call_id=F.col("id"), tool="UserShell", name="bash", input=F.to_json(F.struct(F.coalesce(get("message.command"), F.lit("")).alias("command")))),
        entry(role("bashExecution"), kind="tool_result", role="user", call_id=F.col("id"), text=printed),
        entry(role("custom", "hookMessage") & shown("message."), **meta(F.coalesce(get("message.customType"), F.lit("Custom")), joined("message.content"), True)),
        entry(of("custom_message") & shown(""), **meta(F.coalesce(get("customType"), F.lit("Custom")), joined("content"), True)),
        entry(of("compaction"), **meta("Compaction", F.coalesce(get("summary"), F.lit("")), False), **_usage("usage")),
        entry(of("branch_summary"), **meta("Branch summary", F.coalesce(get("summary"), F.lit("")), False), **_usage("usage")),
        entry(of("usage"), **meta("Usage", "", False), **_usage("usage")),
        entry(of("reset_boundary"), **meta("/clear", "Context cleared", True)),
        entry(of("session_info", "title_change"), kind="custom-title", text=F.coalesce(F.when(of("title_change"), get("title")).otherwise(get("name")), F.lit(""))),
        entry(of("model_change"), **meta("Model", model, False), model=model),
    )
