"""Texts of tool calls and results, reports in tags, and the text protocol's atoms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import collapse, let, sanitize

#: The field without which a call has no text of its own, and the one that follows it.
FIELDS = {
    "Script": ("source", "source"), "Read": ("file_path", None), "Edit": ("file_path", None), "Write": ("file_path", None), "FileReference": ("file_path", None), "Grep": ("pattern", None),
    "Glob": ("pattern", None), "Skill": ("skill", "args"), "Agent": ("description", "prompt"), "AgentMessage": ("recipient", "message"), "ReceivedMessage": ("sender", "message"),
    "AgentReport": ("message", None), "WebFetch": ("url", "prompt"), "WebSearch": ("query", None),
}
#: What a run of calls says of each tool, in this order: verb, noun and plural.
PHRASES = {
    "Grep": ("Searched for", "pattern", "patterns"), "Glob": ("Searched for", "file pattern", "file patterns"), "DirectoryListing": ("listed", "directory", "directories"), "Read": ("read", "file", "files"),
    "FileReference": ("referenced", "file", "files"), "Shell": ("ran", "shell command", "shell commands"), "Script": ("ran", "script", "scripts"), "Edit": ("edited", "file", "files"), "Write": ("wrote", "file", "files"),
    "Skill": ("loaded", "skill", "skills"), "Agent": ("started", "agent", "agents"), "AgentMessage": ("messaged", "agent", "agents"), "ReceivedMessage": ("received", "message", "messages"),
    "AgentReport": ("handed back", "report", "reports"), "Wait": ("waited", "time", "times"), "UserQuestion": ("asked the user", "time", "times"), "TaskList": ("updated the task list", "time", "times"),
    "WebFetch": ("fetched", "URL", "URLs"), "WebSearch": ("searched the web", "time", "times"), "ResultReceipt": ("received", "tool result", "tool results"), "Other": ("called", "tool", "tools"),
}
#: Bytes that an atom holds as they are.
PLAIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._~:/+-"


def replacement_diff(old: Column, new: Column) -> Column:
    """The old lines, each after a minus, then the new ones, each after a plus; a last line feed ends a line."""

    def signed(text: Column, sign: str) -> Column:
        body = F.regexp_replace(text, r"\r?\n\z", "")
        lines = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))
        return F.transform(lines, lambda x: F.concat(F.lit(sign), x))

    return F.array_join(F.concat(signed(old, "-"), signed(new, "+")), "\n")


def call_text(tool: Column, name: Column, arguments: Column) -> Column:
    """The searched text of a call: what it names, then its body; name and raw input without its field."""
    field = lambda key: F.get_json_object(arguments, f"$.{key}")
    raw = F.concat_ws(" ", name, arguments)
    out = raw
    for canonical, (head, body) in FIELDS.items():
        text = F.concat_ws("\n", field(head), replacement_diff(field("old_string"), field("new_string")) if canonical == "Edit" else field(body) if body and body != head else F.lit(None))
        out = F.when(tool == canonical, F.when(field(head).isNotNull(), F.regexp_replace(text, r"\n\z", "")).otherwise(raw)).otherwise(out)
    commands = F.from_json(field("commands"), "array<string>")
    shell = F.coalesce(F.when(F.size(commands) > 0, F.array_join(commands, "\n")), field("command"), raw)
    listing = F.coalesce(field("path"), F.lit("."))
    return F.when(tool.isin("Shell", "UserShell"), shell).when(tool == "DirectoryListing", listing).otherwise(out)


def result_text(content: Column) -> Column:
    """The shown text of a result: a string, or its items joined by line feeds, images and tools by a placeholder."""
    items = F.from_json(content, "array<struct<type:string,text:string,source:struct<media_type:string>,tool_name:string>>")
    shown = lambda x: (
        F.when(x["type"] == "text", F.nullif(x["text"], F.lit("")))
        .when(x["type"] == "image", F.concat(F.lit("[image"), F.coalesce(F.concat(F.lit(": "), x["source"]["media_type"]), F.lit("")), F.lit("]")))
        .when(x["type"] == "tool_reference", F.concat(F.lit("[tool: "), x["tool_name"], F.lit("]")))
    )
    return F.when(F.ltrim(content).startswith("["), F.array_join(F.array_compact(F.transform(items, shown)), "\n")).otherwise(content)


def tagged(text: Column, tag: str, last: bool = False) -> Column:
    """The text between a tag and its first (or ``last``) end tag; null if either is absent."""
    pattern = rf"(?s)<{tag}>({'.*' if last else '.*?'})</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def task_report(text: Column) -> Column:
    """The report that a notification wraps, as a struct of summary, body, task_id, launch_call, tokens,
    tool_calls and duration_ms; null for other texts. Ids stand before the summary."""
    trimmed = F.trim(text)
    head = F.substring_index(trimmed, "<summary>", 1)
    usage = tagged(trimmed, "usage")
    number = lambda tag: F.trim(tagged(usage, tag)).try_cast("long")
    report = F.struct(
        F.trim(tagged(trimmed, "summary")).alias("summary"), F.nullif(F.trim(tagged(trimmed, "result", last=True)), F.lit("")).alias("body"), F.trim(tagged(head, "task-id")).alias("task_id"),
        F.trim(tagged(head, "tool-use-id")).alias("launch_call"), number("subagent_tokens").alias("tokens"), number("tool_uses").alias("tool_calls"), number("duration_ms").alias("duration_ms"),
    )
    opens = trimmed.startswith("<task-notification>") | trimmed.startswith("<ide-diagnostics>")
    return F.when(opens & tagged(trimmed, "summary").isNotNull(), report)


def slash_command(text: Column) -> Column:
    """The command and arguments that tags hold, as typed; null for other texts."""
    return F.when(tagged(text, "command-name").isNotNull(), F.concat_ws(" ", F.trim(tagged(text, "command-name")), F.nullif(F.trim(F.coalesce(tagged(text, "command-args"), F.lit(""))), F.lit(""))))


def escape_atom(text: Column) -> Column:
    """Bytes other than letters, digits and ._~:/+- as percent signs and two digits."""
    plain = [f"{b:02X}" for b in PLAIN]
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda p: F.when(p.isin(plain), F.decode(F.unhex(p), "UTF-8")).otherwise(F.concat(F.lit("%"), p))), "")


def protocol_snippet(text: Column, most: int) -> Column:
    """Clean text in one line; a longer one ends in three dots within ``most`` characters."""
    return let(collapse(sanitize(text)), lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(max(most - 3, 0))), F.lit("..."))))


def shown_title(custom: Column, summary: Column, preview: Column) -> Column:
    return F.coalesce(custom, summary, preview)


def evidence_preview(text: Column) -> Column:
    """Without elements whose name has a hyphen, bodies included, in one line."""
    whole = F.regexp_replace(text, r"(?s)<\s*([^\s/>][^\s>]*-[^\s>]*|-[^\s>]*)[^>]*>.*?</\1>", " ")
    return collapse(F.regexp_replace(whole, r"<\s*/*[^\s>]*-[^\s>]*[^>]*>", " "))


def activity(counted: Column) -> Column:
    """The sentence about (tool, n) counts of a run, in the order of the phrases."""

    def of(tool: str) -> Column:
        return F.aggregate(F.filter(counted, lambda c: c["tool"] == tool), F.lit(0).cast("long"), lambda a, c: a + c["n"])

    items = []
    for tool, (verb, noun, plural) in PHRASES.items():
        n = of(tool)
        items.append(F.when(n > 0, F.concat(F.lit(f"{verb} "), n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {plural}"))))
    text = F.array_join(F.array_compact(F.array(*items)), ", ")
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))
