"""Calls of rollouts as canonical calls, streamed calls, and what sub-agents' launches and hooks leave behind."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.records import changed_models, emit, entry, filled, get, with_usage

#: Functions with the canonical tool and the canonical names of their arguments.
FUNCTIONS = {
    "shell_command": ("Shell", {"command": "command"}), "exec_command": ("Shell", {"cmd": "command"}), "wait": ("Wait", {}), "wait_agent": ("Wait", {}),
    "spawn_agent": ("Agent", {"task_name": "description", "message": "prompt"}), "send_message": ("AgentMessage", {"target": "recipient", "message": "message"}),
    "followup_task": ("AgentMessage", {"target": "recipient", "message": "message"}), "send_input": ("AgentMessage", {"id": "recipient", "message": "message"}),
    "update_plan": ("TaskList", {}), "view_image": ("Read", {"path": "file_path"}),
}
_SECTION = re.compile(r"^\*\*\* (?:Add|Update|Delete) File: (.*)$")
_CALLED = re.compile(r"\btools\.([A-Za-z_][\w$]*)\s*\(")


def balanced(source: str, at: int) -> int:
    """Where the bracket that opens at a place closes, strings and comments passed over; -1 if nowhere."""
    depth, i, n = 0, at, len(source)
    while i < n:
        c = source[i]
        if c in "\"'`":
            i += 1
            while i < n and source[i] != c:
                i += 2 if source[i] == "\\" else 1
        elif source.startswith("//", i):
            i = source.find("\n", i)
            if i < 0:
                return -1
        elif source.startswith("/*", i):
            i = source.find("*/", i) + 1
            if i < 1:
                return -1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def literal(text: str):
    """The value of an object literal with plain keys and strings, or None."""
    quoted = re.sub(r"'((?:[^'\\]|\\.)*)'|`((?:[^`\\$]|\\.)*)`", lambda m: json.dumps((m[1] if m[1] is not None else m[2]).replace("\\'", "'").replace("\\`", "`")), text)
    keyed = re.sub(r'([{,]\s*)([A-Za-z_$][\w$]*)\s*:', r'\1"\2":', quoted)
    for candidate in (text, keyed, re.sub(r",(\s*[}\]])", r"\1", keyed)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def patch_edits(patch: str) -> list[tuple[str, dict]]:
    """An edit for each file of a patch, with its hunk, or its heading if it has none."""
    out: list[list] = []
    for line in patch.splitlines():
        if line == "*** End Patch":
            break
        if m := _SECTION.match(line):
            out.append([m[1], line, []])
        elif out:
            out[-1][2].append(line)
    return [("Edit", {"file_path": path, "patch": "\n".join(hunk) if hunk else head}) for path, head, hunk in out]


def web_calls(value: dict) -> list[tuple[str, dict]]:
    found = [("WebSearch", {"query": q["q"]}) for q in value.get("search_query", []) if isinstance(q, dict) and q.get("q")]
    return found + [("WebFetch", {"url": o["ref_id"]}) for o in value.get("open", []) if isinstance(o, dict) and str(o.get("ref_id", "")).startswith("http")]


def script_calls(source: str) -> list[tuple[str, dict]]:
    """The calls that a script makes of its tools, in order; the script itself if one can't be read."""
    out: list[tuple[str, dict]] = []
    for m in _CALLED.finditer(source):
        end = balanced(source, m.end() - 1)
        value = literal(source[m.end() : end].strip()) if end > 0 else None
        if value is None:
            return [("Script", {"source": source})]
        out += canonical_calls(m[1], value)
    return out or [("Script", {"source": source})]


def canonical_calls(name: str, value) -> list[tuple[str, dict]]:
    """The canonical (tool, input) calls of one recorded call; Other with its input if it has no layout."""
    found: list[tuple[str, dict]] = []
    if name == "exec" and isinstance(value, str):
        found = script_calls(value)
    elif name == "apply_patch":
        patch = value if isinstance(value, str) else value.get("input") or value.get("patch") if isinstance(value, dict) else None
        found = patch_edits(patch) if isinstance(patch, str) else []
    elif name in ("run", "web__run") and isinstance(value, dict):
        found = web_calls(value)
    elif name == "write_stdin" and isinstance(value, dict) and isinstance(value.get("session_id"), (int, str)) and isinstance(value.get("chars") or "", str):
        found = [("Wait", {k: v for k, v in (("process", str(value["session_id"])), ("typed", value.get("chars") or None), ("wait_ms", value.get("yield_time_ms"))) if v is not None})]
    elif name == "request_user_input_async":
        found = [("UserQuestion", value)]
    elif name in FUNCTIONS and isinstance(value, dict):
        tool, keys = FUNCTIONS[name]
        renamed = {keys.get(k, k): v for k, v in value.items()}
        if name == "spawn_agent" or not keys or isinstance(renamed.get(next(iter(keys.values()))), str):
            found = [(tool, renamed)]
    return found or [("Other", value)]


def split_calls(calls: DataFrame) -> DataFrame:
    """Canonical calls of (…, call_id, name, input) rows: the first piece keeps the id, the next are id#2, id#3.
    Adds piece (from 1) and tool; input becomes the piece's. Arguments that aren't JSON are kept raw."""
    columns = [c for c in calls.columns if c not in ("call_id", "input", "tool")]
    schema = ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, pick = [], []
            for i, (call, name, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in ("call_id", "name", "input")), strict=True)):
                try:
                    value = raw if name in ("exec", "apply_patch") and not (raw or "").lstrip().startswith("{") else json.loads(raw or "{}")
                except ValueError:
                    value = {"arguments": raw}
                for k, (tool, made) in enumerate(canonical_calls(name or "", value), 1):
                    rows.append((call if k == 1 else f"{call}#{k}", tool, made if isinstance(made, str) else json.dumps(made, ensure_ascii=False), k))
                    pick.append(i)
            kept = [part.column(c).take(pa.array(pick, pa.int64())) for c in columns]
            call, tool, made, piece = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([*kept, pa.array(call, pa.string()), pa.array(tool, pa.string()), pa.array(made, pa.string()), pa.array(piece, pa.int64())], names=[*columns, "call_id", "tool", "input", "piece"])

    return calls.select(*columns, "call_id", "input").mapInArrow(run, f"{schema}, call_id string, tool string, input string, piece long")


def grok_calls(lines: DataFrame) -> DataFrame:
    """Calls and results of streamed updates: an update opens a call that wasn't, its input is the last object
    given, and completed or failed updates are results."""
    update = "params.update"
    rows = lines.where("record IS NOT NULL").withColumns({"says": get(f"{update}.sessionUpdate"), "call": F.coalesce(get(f"{update}.toolCallId"), F.lit("unknown"))})
    rows = rows.where(F.col("says").isin("tool_call", "tool_call_update")).withColumn("ts", get("timestamp"))
    by = Window.partitionBy("path", "call").orderBy("line")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = get(f"{update}.rawInput", "variant")
    is_object = F.coalesce(F.schema_of_variant(given).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumns({"first": F.row_number().over(by) == 1, "given": F.last(F.when(is_object, F.to_json(given)), ignorenulls=True).over(whole), "title": F.coalesce(get(f"{update}.title"), F.lit("unknown"))})
    name = F.coalesce(get(f'{update}._meta["x.ai/tool"].name'), F.col("title"))
    status = get(f"{update}.status")
    shown = F.array_join(F.array_compact(F.transform(get(f"{update}.content", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.content.text", "string"), F.try_variant_get(b, "$.text", "string")))), "\n")
    return emit(
        rows,
        ["path", "line", "ts"],
        entry(F.col("first"), kind="tool_use", role="assistant", call_id=F.col("call"), tool="Other", name=name, input=F.coalesce("given", F.lit("{}"))),
        entry(status.isin("completed", "failed"), kind="tool_result", role="user", call_id=F.col("call"), text=F.coalesce(F.nullif(shown, F.lit("")), F.when(status == "failed", "failed").otherwise(""))),
    )


def injected_context(text: str = "text") -> Column:
    """Whether a user's block of a rollout is context that the agent put there."""
    return F.ltrim(F.col(text)).rlike(r"(?s)^<(environment_context|user_instructions|permissions instructions|collaboration_mode|turn_aborted|skills_instructions|app-context)>.*</\1>\s*$") | F.ltrim(F.col(text)).startswith("# AGENTS.md instructions")


def codex_facts(lines: DataFrame) -> DataFrame:
    """What a rollout says besides messages: compactions, models on change, and the usage of each request."""
    rows = lines.where("record IS NOT NULL").withColumns({"type": get("type"), "says": get("payload.type"), "ts": get("timestamp")})
    of = lambda kind: F.col("type") == kind
    usage = "payload.info.last_token_usage"
    total, cached = F.coalesce(get(f"{usage}.input_tokens", "long"), F.lit(0)), F.coalesce(get(f"{usage}.cached_input_tokens", "long"), F.lit(0))
    meta = {"kind": "meta", "searchable": F.lit(False)}
    ended = of("event_msg") & (F.col("says") == "turn_aborted") & get("payload.reason").isin("interrupted", "budget_limited")
    made = emit(
        rows,
        ["path", "line", "ts"],
        entry(of("compacted") & filled(get("payload.message")), **meta, label="Compaction", text=get("payload.message")),
        entry(of("turn_context") & get("payload.model").isNotNull(), **meta, label="Model", text=get("payload.model"), model=get("payload.model")),
        entry(of("event_msg") & (F.col("says") == "token_count"), **meta, label="Usage", input_tokens=F.greatest(total - cached, F.lit(0)), output_tokens=get(f"{usage}.output_tokens", "long"), cache_write=F.lit(0), cache_read=cached),
        entry(ended, kind="meta", label="Notice", text=F.concat(F.lit("Turn ended: "), get("payload.reason")), searchable=F.lit(True)),
    )
    return with_usage(changed_models(made, "path", ["line", "part"]))


def grok_turns(lines: DataFrame) -> DataFrame:
    """The models, on change, and the usage that ended turns name."""
    update = "params.update"
    rows = lines.where("record IS NOT NULL").withColumn("ts", get("timestamp")).where(get(f"{update}.sessionUpdate") == "turn_completed")
    models = F.coalesce(F.json_object_keys(F.to_json(get(f"{update}.usage.modelUsage", "variant"))), F.array().cast("array<string>"))
    meta = {"kind": "meta", "searchable": F.lit(False)}
    named = F.transform(F.sort_array(models), lambda m: entry(F.lit(True), **meta, label="Model", text=m, model=m))
    total, cached = F.coalesce(get(f"{update}.usage.inputTokens", "long"), F.lit(0)), F.coalesce(get(f"{update}.usage.cachedReadTokens", "long"), F.lit(0))
    usage = entry(F.lit(True), **meta, label="Usage", input_tokens=F.greatest(total - cached, F.lit(0)), output_tokens=get(f"{update}.usage.outputTokens", "long"), cache_write=F.lit(0), cache_read=cached)
    return with_usage(changed_models(emit(rows, ["path", "line", "ts"], (named, True), usage), "path", ["line", "part"]))


def subagent_cleanup(entries: DataFrame, threads: DataFrame) -> DataFrame:
    """(path, thread, line, kind, call_id, tool, input, text) entries as shown beside their sub-agents.

    The receipt of a background launch says that it runs; a fork's copies of the call that launched it and
    its result go; the first message of another thread goes if it repeats the call's prompt. Threads are
    (path, thread, launch_call, fork).
    """
    prompts = entries.where("kind = 'tool_use' AND tool = 'Agent'").groupBy("path", F.col("call_id").alias("launch_call")).agg(F.max(F.get_json_object("input", "$.prompt")).alias("prompt"))
    known = threads.join(prompts, ["path", "launch_call"], "left")
    first = F.row_number().over(Window.partitionBy("path", "thread").orderBy("line")) == 1
    rows = entries.withColumn("_first", first).join(known, ["path", "thread"], "left")
    forked = F.coalesce(F.col("fork"), F.lit(False))
    copy = forked & F.col("kind").isin("tool_use", "tool_result") & (F.col("call_id") == F.col("launch_call"))
    repeats = ~forked & F.col("_first") & (F.col("kind") == "text") & (F.col("thread") != "") & (F.trim("text") == F.trim("prompt"))
    shown = F.when((F.col("kind") == "tool_result") & F.col("text").startswith("Async agent launched successfully."), "Running in the background").otherwise(F.col("text"))
    kept = rows.where(~F.coalesce(copy, F.lit(False)) & ~F.coalesce(repeats, F.lit(False)))
    return kept.select(*(shown.alias(c) if c == "text" else F.col(c) for c in entries.columns))


def place_hooks(entries: DataFrame, hooks: DataFrame) -> DataFrame:
    """Entries (path, line, kind, call_id, text) with the texts of hooks (path, line, call_id, text) of their
    calls: before or after the text of the call's holder by the order of records, as lines.

    The holder is the first result of the call, or its call; hooks of calls that aren't there become rows of
    the kind hook.
    """
    rank = F.when(F.col("kind") == "tool_result", 0).otherwise(1)
    own = entries.where(F.col("kind").isin("tool_result", "tool_use") & F.col("call_id").isNotNull())
    holder = own.groupBy("path", "call_id").agg(F.min(F.struct(rank.alias("rank"), "line")).alias("h")).select("path", "call_id", F.col("h.line").alias("held"), F.col("h.rank").alias("held_rank"))
    met = hooks.join(holder, ["path", "call_id"])
    texts = lambda test: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("line", "text")))), lambda x: x["text"]), "\n")
    sides = met.groupBy("path", F.col("held").alias("line"), "call_id", "held_rank").agg(texts(F.col("line") < F.col("held")).alias("_before"), texts(F.col("line") >= F.col("held")).alias("_after"))
    kinds = F.when(F.col("held_rank") == 0, "tool_result").otherwise("tool_use")
    rows = entries.join(sides.withColumn("kind", kinds).drop("held_rank"), ["path", "line", "kind", "call_id"], "left")
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    placed = rows.select("path", "line", "kind", "call_id", F.concat_ws("\n", blank(F.col("_before")), F.col("text"), blank(F.col("_after"))).alias("text"))
    alone = hooks.join(holder.select("path", "call_id"), ["path", "call_id"], "left_anti").select("path", "line", F.lit("hook").alias("kind"), "call_id", "text")
    return placed.unionByName(alone)
