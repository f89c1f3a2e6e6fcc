"""Kimi transcripts (wire.jsonl): loop events, appended messages by origin, user commands, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.tools import tagged
from parlance.sources.records import changed_models, emit, entry, filled, get, millis, renamed, with_usage

#: Canonical names of tools.
TOOLS = {
    "Bash": "Shell", "Read": "Read", "ReadMediaFile": "Read", "Edit": "Edit", "Write": "Write", "Grep": "Grep", "Glob": "Glob", "Skill": "Skill", "Agent": "Agent", "TodoList": "TaskList",
    "FetchURL": "WebFetch", "TaskOutput": "Wait",
}


def _tool(name: Column) -> Column:
    out = F.lit("Other")
    for source, tool in TOOLS.items():
        out = F.when(name == source, tool).otherwise(out)
    return out


def _texts(content: Column) -> Column:
    return F.array_compact(F.transform(content, lambda b: F.nullif(F.try_variant_get(b, "$.text", "string"), F.lit(""))))


def kimi_entries(lines: DataFrame) -> DataFrame:
    """(path, line, part, ts, …) entries of (path, line, record) rows.

    Prompts and steers restate appended messages and are left out, as are step frames, injected context
    and skills that the model loaded. The output of a user's command answers the command before it, as
    the result of its call; without one it opens a call of its own.
    """
    rows = lines.where("record IS NOT NULL").withColumns({"type": get("type"), "ts": millis(get("time", "long"))})
    event, message = "event.", "message."
    of = lambda kind: F.col("type") == kind
    loop = lambda kind: of("context.append_loop_event") & (get(f"{event}type") == kind)
    part = lambda kind: loop("content.part") & (get(f"{event}part.type") == kind)
    name = F.coalesce(get(f"{event}name"), F.lit("unknown"))
    tool = _tool(name)
    arguments = F.coalesce(F.to_json(get(f"{event}args", "variant")), F.lit("{}"))
    takes_path = tool.isin("Read", "Edit", "Write")
    output = get(f"{event}result.output", "array<variant>")
    shown = F.transform(output, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.nullif(F.try_variant_get(p, "$.text", "string"), F.lit(""))).when(F.try_variant_get(p, "$.type", "string") == "image_url", F.lit("[image]")))
    result = F.coalesce(F.when(F.schema_of_variant(get(f"{event}result", "variant")) == "STRING", get(f"{event}result")), F.array_join(F.array_compact(shown), "\n"), get(f"{event}result.output"), F.lit(""))
    call_id = F.coalesce(get(f"{event}toolCallId"), F.lit("unknown"))

    origin = get(f"{message}origin.kind")
    appended = of("context.append_message")
    user = appended & (get(f"{message}role") == "user")
    content = get(f"{message}content", "array<variant>")
    skills = F.coalesce(F.size(get(f"{message}origin.skillActivations", "array<variant>")), F.lit(0))
    said = F.filter(_texts(F.slice(content, F.greatest(skills, F.lit(0)) + 1, F.greatest(F.size(content), F.lit(1)))), lambda t: ~(F.trim(t).startswith("<system-reminder>") & F.trim(t).endswith("</system-reminder>")))
    joined = F.array_join(_texts(content), "\n")
    silent = origin.isin("injection", "system_trigger", "retry", "skill_activation", "hook_result", "plugin_command", "cron_job", "cron_missed", "shell_command")
    notice = tagged(joined, "notification")
    task = user & origin.isin("background_task", "task") & notice.isNotNull()
    prompt = user & ~F.coalesce(silent, F.lit(False)) & ~F.coalesce(task, F.lit(False))
    command = lambda name, args: F.concat_ws(" ", F.concat(F.lit("/"), name), F.nullif(F.trim(args), F.lit("")))
    typed = F.when(origin == "skill_activation", command(get(f"{message}origin.skillName"), get(f"{message}origin.skillArgs"))).otherwise(
        command(F.concat_ws(":", get(f"{message}origin.pluginId"), get(f"{message}origin.commandName")), get(f"{message}origin.commandArgs"))
    )
    by_user = user & ((origin == "plugin_command") | ((origin == "skill_activation") & (get(f"{message}origin.trigger") == "user-slash")))
    hook = appended & (origin == "hook_result") & get(f"{message}role").isin("user", "assistant")
    blocked = F.when(F.coalesce(get(f"{message}origin.blocked", "boolean"), F.lit(False)), " blocked").otherwise("")
    hook_event = F.coalesce(F.nullif(F.regexp_extract(joined, 'hook_event="([^"]*)"', 1), F.lit("")), get(f"{message}origin.event"), F.lit("hook"))
    hook_body = F.trim(F.regexp_replace(joined, r'</?hook_result[^>]*>', ""), F.lit(" \n\t"))
    hook_text = F.concat_ws(": ", F.concat(hook_event, blocked), F.nullif(hook_body, F.lit("")))
    shell = user & (origin == "shell_command")
    asked = get(f"{message}origin.phase") == "input"
    typed_in = F.trim(F.coalesce(tagged(joined, "bash-input"), joined), F.lit(" \n\t"))
    streams = F.array(*(F.nullif(F.trim(tagged(joined, t), F.lit(" \n\t")), F.lit("")) for t in ("bash-stdout", "bash-stderr")))
    printed = F.array_join(F.array_compact(streams), "\n")
    # the call that a command's output answers: the input before it, unless another output came between
    by = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("_asked", F.when(shell, asked)).withColumn("_last", F.when(shell, F.struct("line", asked.alias("asked"))))
    before = F.last("_last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_call", F.when(F.coalesce(before["asked"], F.lit(False)), before["line"]))
    own = F.concat(F.lit("shell_"), F.col("line").cast("string"))
    open_call = F.concat(F.lit("shell_"), F.col("_call").cast("string"))
    command_input = lambda text: F.to_json(F.struct(text.alias("command")))
    turn = of("usage.record") & (get("usageScope") == "turn")
    meta = {"kind": "meta"}
    made = emit(
        rows,
        ["path", "line", "ts"],
        entry(part("text") & filled(get(f"{event}part.text")), kind="text", role="assistant", text=get(f"{event}part.text")),
        entry(part("think") & filled(get(f"{event}part.think")), kind="thinking", role="assistant", text=get(f"{event}part.think")),
        entry(loop("tool.call"), kind="tool_use", role="assistant", call_id=call_id, tool=tool, name=name, input=F.when(takes_path, renamed(arguments, "path", "file_path")).otherwise(arguments)),
        entry(loop("tool.result"), kind="tool_result", role="user", call_id=call_id, text=result),
        (F.when(prompt, F.transform(said, lambda t: entry(F.lit(True), kind="text", role="user", text=t))).otherwise(F.array()), True),
        entry(task, **meta, label="Task", text=F.coalesce(F.trim(F.regexp_extract(notice, r"(?m)^Title:\s*(.*)$", 1)), F.lit("")), searchable=F.lit(True)),
        entry(by_user, kind="text", role="user", text=typed),
        entry(hook, **meta, label="Hook", text=hook_text, searchable=F.lit(True)),
        entry(user & origin.isin("cron_job", "cron_missed"), **meta, label="Scheduled", text=F.trim(F.coalesce(tagged(joined, "prompt"), joined), F.lit(" \n\t")), searchable=F.lit(True)),
        entry(shell & asked, kind="tool_use", role="user", call_id=own, tool="UserShell", name="shell", input=command_input(typed_in)),
        entry(shell & ~asked & F.col("_call").isNull(), kind="tool_use", role="user", call_id=own, tool="UserShell", name="shell", input=command_input(F.lit(""))),
        entry(shell & ~asked, kind="tool_result", role="user", call_id=F.coalesce(open_call, own), text=printed),
        entry(of("context.apply_compaction") & filled(get("summary")), **meta, label="Compaction", text=get("summary"), searchable=F.lit(False)),
        entry(turn & get("model").isNotNull(), **meta, label="Model", text=get("model"), model=get("model"), searchable=F.lit(False)),
        entry(turn, **meta, label="Usage", searchable=F.lit(False), input_tokens=get("usage.inputOther", "long"), output_tokens=get("usage.output", "long"), cache_write=get("usage.inputCacheCreation", "long"), cache_read=get("usage.inputCacheRead", "long")),
    )
    return with_usage(changed_models(made, "path", ["line", "part"]))


def kimi_dropped(lines: DataFrame) -> DataFrame:
    """(path, line, kind, outcome) of records that give no entry."""
    rows = lines.where("record IS NOT NULL").withColumn("type", get("type"))
    event, origin = get("event.type"), get("message.origin.kind")
    kind = F.when(F.col("type") == "context.append_loop_event", F.concat(F.lit("event:"), event)).when(F.col("type") == "context.append_message", F.concat(F.lit("origin:"), origin)).otherwise(F.col("type"))
    skipped = F.col("type").isin("turn.prompt", "turn.steer") | event.isin("step.begin", "step.end") | origin.isin("injection", "system_trigger", "retry")
    known = F.col("type").isin("usage.record", "context.apply_compaction", "metadata") | event.isin("content.part", "tool.call", "tool.result") | (F.col("type") == "context.append_message")
    outcome = F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(~F.coalesce(known, F.lit(False)), "unrecognised")
    return rows.select("path", "line", kind.alias("kind"), outcome.alias("outcome")).where("outcome IS NOT NULL")
