"""OpenCode's database: messages and parts of its first generation, and messages of its second.

The database is read over JDBC or from an export. Rows hold their JSON in a column ``data``; ``record``
is that column as a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators.links import newer_wins
from parlance.sources.records import changed_models, emit, entry, filled, get, millis, with_usage

#: Canonical names of tools, and the openings of texts that narrate a read.
TOOLS = {"bash": "Shell", "read": "Read", "edit": "Edit", "write": "Write", "grep": "Grep", "glob": "Glob", "list": "DirectoryListing", "task": "Agent", "webfetch": "WebFetch", "websearch": "WebSearch", "todowrite": "TaskList", "todoread": "TaskList", "skill": "Skill"}
READ_TOOL, READ_RESOURCE = "Called the Read tool with the following input: ", "Reading MCP resource: "


def read_table(spark: SparkSession, path: str, name: str, busy_seconds: int = 5) -> DataFrame:
    """A table of the SQLite file, read only, waiting for a writer for some seconds."""
    options = {"url": f"jdbc:sqlite:file:{path}?mode=ro", "dbtable": name, "driver": "org.sqlite.JDBC", "queryTimeout": str(busy_seconds)}
    return spark.read.format("jdbc").options(**options).load()


def merged_sessions(second: DataFrame, first: DataFrame) -> DataFrame:
    """Sessions of both generations: of an id in both, the second's."""
    return newer_wins(second, first, "id")


def _tool(name: Column) -> Column:
    out = F.lit("Other")
    for source, tool in TOOLS.items():
        out = F.when(F.lower(name) == source, tool).otherwise(out)
    return out


def read_input(text: Column) -> Column:
    """The input of the read that a text narrates, as JSON; null for other texts."""
    rest = F.substr(text, F.lit(len(READ_TOOL) + 1))
    parsed = F.coalesce(F.to_json(F.try_parse_json(rest)), F.to_json(F.struct(rest.alias("input"))))
    resource = F.to_json(F.struct(F.substr(text, F.lit(len(READ_RESOURCE) + 1)).alias("file_path")))
    return F.when(text.startswith(READ_TOOL), parsed).when(text.startswith(READ_RESOURCE), resource)


def first_entries(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries of the first generation's messages (conv_id, message_id, created, record) and parts
    (conv_id, message_id, position, record). Each assistant part is its own message.

    Of a user's synthetic parts, notes on files are the user's words; a text that narrates a read, and the
    synthetic texts up to the next one, become a read call and its result.
    """
    said = messages.select("conv_id", "message_id", F.col("created"), get("role").alias("says"), F.coalesce(get("modelID"), get("model.id"), get("model.modelID")).alias("model"))
    rows = parts.join(said, ["conv_id", "message_id"])
    synthetic = F.coalesce(get("synthetic", "boolean"), F.lit(False))
    note = get("metadata.opencodeComment", "variant").isNotNull()
    rows = rows.withColumns({"kind_": get("type"), "text_": get("text"), "hidden": synthetic, "note": note, "ts": millis(F.coalesce(get("time.start", "long"), F.col("created"))), "part_id": get("id")})
    opens = (F.col("says") == "user") & F.col("hidden") & (F.col("kind_") == "text")
    rows = rows.withColumn("narrated", F.when(opens, read_input(F.col("text_"))))
    # the narration that a synthetic text belongs to; any other part, and a note, ends it
    by = Window.partitionBy("conv_id", "message_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col("narrated").isNotNull() | ~opens | F.col("note")
    rows = rows.withColumn("island", F.sum(ends.cast("int")).over(by))
    group = Window.partitionBy("conv_id", "message_id", "island").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    contents = F.collect_list(F.when(F.col("narrated").isNull(), F.col("text_"))).over(group)
    rows = rows.withColumn("contents", F.array_join(contents, "\n"))
    user, assistant = F.col("says") == "user", (F.col("says") == "assistant") & ~F.col("hidden")
    part = lambda kind: assistant & (F.col("kind_") == kind)
    part_id = F.col("part_id")
    call_id, read_id = F.coalesce(get("callID"), part_id, F.lit("unknown")), F.coalesce(part_id, F.lit("injected-read"))
    name = F.coalesce(get("tool"), F.lit("unknown"))
    usage = {"input_tokens": get("tokens.input", "long"), "output_tokens": get("tokens.output", "long"), "cache_write": get("tokens.cache.write", "long"), "cache_read": get("tokens.cache.read", "long")}
    meta = {"kind": "meta", "searchable": F.lit(False)}
    made = emit(
        rows,
        ["conv_id", "message_id", "created", "position", "ts"],
        entry(assistant & F.col("model").isNotNull(), **meta, label="Model", text=F.col("model"), model=F.col("model")),
        entry(user & (F.col("kind_") == "text") & (~F.col("hidden") | F.col("note")) & filled(F.col("text_")), kind="text", role="user", text=F.col("text_")),
        entry(F.col("narrated").isNotNull() & ~F.col("note"), kind="tool_use", role="assistant", reply_id=part_id, call_id=read_id, tool="Read", name="read", input=F.col("narrated")),
        entry(F.col("narrated").isNotNull() & ~F.col("note"), kind="tool_result", role="user", call_id=read_id, text=F.col("contents")),
        entry(part("text") & filled(F.col("text_")), kind="text", role="assistant", reply_id=part_id, text=F.col("text_")),
        entry(part("reasoning") & filled(F.col("text_")), kind="thinking", role="assistant", reply_id=part_id, text=F.col("text_")),
        entry(part("tool"), kind="tool_use", role="assistant", reply_id=part_id, call_id=call_id, tool=_tool(name), name=name, input=F.coalesce(F.to_json(get("state.input", "variant")), F.lit("{}"))),
        entry(part("tool") & (get("state.status") == "completed"), kind="tool_result", role="user", call_id=call_id, text=F.coalesce(get("state.output"), F.lit(""))),
        entry(part("step-finish"), **meta, label="Usage", **usage),
        entry(part("compaction") & filled(get("summary")), **meta, label="Compaction", text=get("summary")),
    )
    return with_usage(changed_models(made, "conv_id", ["created", "message_id", "position", "part"]))


def second_entries(messages: DataFrame) -> DataFrame:
    """Entries of the second generation's messages (conv_id, message_id, created, record), by their type."""
    rows = messages.withColumns({"type": get("type"), "ts": millis(F.coalesce(get("time.created", "long"), F.col("created")))})
    of = lambda kind: F.col("type") == kind
    field = lambda b, name, kind="string": F.try_variant_get(b, f"$.{name}", kind)
    own = F.col("message_id")
    attached = F.transform(F.coalesce(get("attachments", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.concat(F.lit("Attached "), F.coalesce(field(a, "filename"), field(a, "url"), F.lit("file"))))
    said = F.filter(F.concat(F.array(F.coalesce(get("text"), F.lit(""))), attached), lambda t: t != "")
    # paragraphs after a narrated read are its result
    paragraphs = F.split(get("text"), "\n\n")
    heads = F.filter(F.transform(paragraphs, lambda p, i: F.struct(i.alias("at"), read_input(p).alias("input"))), lambda h: h["input"].isNotNull())

    def reads(kind: str) -> Column:
        def made(h: Column, k: Column) -> Column:
            call = F.concat(own, F.lit(":"), k.cast("string"))
            if kind == "tool_use":
                return entry(F.lit(True), kind=kind, role="assistant", reply_id=call, call_id=call, tool="Read", name="read", input=h["input"])
            end = F.coalesce(F.get(heads, k + 1)["at"], F.size(paragraphs))
            return entry(F.lit(True), kind=kind, role="user", call_id=call, text=F.array_join(F.slice(paragraphs, h["at"] + 2, F.greatest(end - h["at"] - 1, F.lit(0))), "\n\n"))

        return F.when(of("synthetic") & get("text").isNotNull(), F.transform(heads, made)).otherwise(F.array())

    items = get("content", "array<variant>")

    def item(b: Column, k: Column) -> Column:
        reply, call, name = F.concat(own, F.lit(":"), k.cast("string")), F.coalesce(field(b, "id"), F.lit("unknown")), F.coalesce(field(b, "name"), F.lit("unknown"))
        kind = field(b, "type")
        given = field(b, "state.input", "variant")
        output = F.coalesce(F.when(field(b, "state.status") == "completed", F.coalesce(field(b, "state.output"), F.lit(""))), F.when(field(b, "state.status") == "error", field(b, "state.error")))
        return F.array(
            entry((kind == "text") & filled(field(b, "text")), kind="text", role="assistant", reply_id=reply, text=field(b, "text")),
            entry((kind == "reasoning") & filled(field(b, "text")), kind="thinking", role="assistant", reply_id=reply, text=field(b, "text")),
            entry(kind == "tool", kind="tool_use", role="assistant", reply_id=reply, call_id=call, tool=_tool(name), name=name, input=F.when(F.schema_of_variant(given).startswith("OBJECT"), F.to_json(given)).otherwise("{}")),
            entry((kind == "tool") & output.isNotNull(), kind="tool_result", role="user", call_id=call, text=output),
        )

    spoke = of("assistant") & (F.size(items) > 0)
    code = get("exit", "long")
    printed = F.concat_ws("\n", F.nullif(get("output.output"), F.lit("")), F.when(code != 0, F.concat(F.lit("exit code "), code.cast("string"))))
    meta = {"kind": "meta", "searchable": F.lit(False)}
    usage = {"input_tokens": get("tokens.input", "long"), "output_tokens": get("tokens.output", "long"), "cache_write": get("tokens.cache.write", "long"), "cache_read": get("tokens.cache.read", "long")}
    made = emit(
        rows,
        ["conv_id", "message_id", "created", "ts"],
        (F.when(of("user"), F.transform(said, lambda t: entry(F.lit(True), kind="text", role="user", text=t))).otherwise(F.array()), True),
        (F.flatten(F.transform(F.arrays_zip(reads("tool_use").alias("a"), reads("tool_result").alias("b")), lambda z: F.array(z["a"], z["b"]))), True),
        entry(spoke & filled(get("model.id")), **meta, label="Model", text=get("model.id"), model=get("model.id")),
        (F.when(spoke, F.flatten(F.transform(items, item))).otherwise(F.array()), True),
        entry(spoke & get("tokens", "variant").isNotNull(), **meta, label="Usage", **usage),
        entry(of("shell") & get("command").isNotNull(), kind="tool_use", role="user", call_id=own, tool="UserShell", name="shell", input=F.to_json(F.struct(get("command").alias("command")))),
        entry(of("shell") & get("command").isNotNull(), kind="tool_result", role="user", call_id=own, text=printed),
        entry(of("compaction") & (get("status") == "completed") & filled(get("summary")), **meta, label="Compaction", text=get("summary")),
    )
    return with_usage(changed_models(made, "conv_id", ["created", "message_id", "part"]))
