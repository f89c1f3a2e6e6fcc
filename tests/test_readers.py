"""Readers of transcripts over records of the wire formats, and calls, launches and hooks."""

import json

from pyspark.sql import functions as F

from parlance.sources import calls, kimi, opencode, pi


def _lines(spark, *records, path="f"):
    rows = [(path, i + 1, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "path string, line long, raw string").withColumn("record", F.try_parse_json("raw"))


def _shown(frame, *columns):
    order = [c for c in ("conv_id", "created", "message_id", "line", "position", "part") if c in frame.columns]
    return [tuple(r) for r in frame.orderBy(*order).select(*columns).collect()]


def _kimi(kind, texts, **origin):
    return {"type": "context.append_message", "time": 1000, "message": {"role": "user", "content": [{"type": "text", "text": t} for t in texts], **({"origin": {"kind": kind, **origin}} if kind else {})}}


def _event(**event):
    return {"type": "context.append_loop_event", "time": 2000, "event": event}


def test_kimi(spark):
    lines = _lines(
        spark,
        {"type": "metadata", "protocol_version": "1"}, {"type": "turn.prompt", "text": "hi"}, _kimi(None, ["hi", "<system-reminder>x</system-reminder>", ""]),
        _event(type="step.begin"), _event(type="content.part", part={"type": "think", "think": "hm"}), _event(type="content.part", part={"type": "text", "text": "hello"}),
        _event(type="tool.call", name="Read", toolCallId="c1", args={"path": "/a", "n": 1}), _event(type="tool.result", toolCallId="c1", result={"output": [{"type": "text", "text": "one"}, {"type": "image_url"}], "note": "n"}),
        _event(type="tool.result", toolCallId="c2", result="plain"), _kimi("injection", ["no"]), _kimi("skill_activation", ["s"], trigger="user-slash", skillName="fix", skillArgs=" it "),
        _kimi("skill_activation", ["s"], trigger="model"), _kimi("shell_command", ["<bash-input>ls</bash-input>"], phase="input"), _kimi("shell_command", ["<bash-stdout>f\n</bash-stdout><bash-stderr></bash-stderr>"], phase="output"),
        _kimi("shell_command", ["<bash-stdout>late</bash-stdout>"], phase="output"), _kimi("hook_result", ['<hook_result hook_event="Stop">\nno\n</hook_result>'], blocked=True), _kimi("odd", ["kept"]), _kimi("user", ["skill file", "ask"], skillActivations=[1]),
        {"type": "usage.record", "usageScope": "session", "model": "z", "usage": {"output": 9}}, {"type": "usage.record", "usageScope": "turn", "model": "k2", "usage": {"inputOther": 3, "output": 2}},
        {"type": "usage.record", "usageScope": "turn", "model": "k2", "usage": {"output": 0}}, {"type": "usage.record", "usageScope": "turn", "model": "k3", "usage": {"output": 1}},
    )
    got = _shown(kimi.kimi_entries(lines), "line", "kind", "call_id", "tool", "text", "label")
    assert got == [
        (3, "text", None, None, "hi", None), (5, "thinking", None, None, "hm", None), (6, "text", None, None, "hello", None), (7, "tool_use", "c1", "Read", None, None), (8, "tool_result", "c1", None, "one\n[image]", None),
        (9, "tool_result", "c2", None, "plain", None), (11, "text", None, None, "/fix it", None), (13, "tool_use", "shell_13", "UserShell", None, None), (14, "tool_result", "shell_13", None, "f", None),
        (15, "tool_use", "shell_15", "UserShell", None, None), (15, "tool_result", "shell_15", None, "late", None), (16, "meta", None, None, "Stop blocked: no", "Hook"), (17, "text", None, None, "kept", None), (18, "text", None, None, "ask", None),
        (20, "meta", None, None, "k2", "Model"), (20, "meta", None, None, None, "Usage"), (22, "meta", None, None, "k3", "Model"), (22, "meta", None, None, None, "Usage"),
    ]
    assert json.loads(kimi.kimi_entries(lines).where("call_id = 'c1' AND kind = 'tool_use'").first().input) == {"file_path": "/a", "n": 1}
    assert {(r.line, r.outcome) for r in kimi.kimi_dropped(lines).collect()} >= {(2, "skipped"), (4, "skipped"), (10, "skipped")}
    assert kimi.kimi_entries(lines.limit(0)).count() == 0


def test_pi(spark):
    message = lambda i, up, **m: {"type": "message", "id": i, "parentId": up, "timestamp": "t", "message": m}
    lines = _lines(
        spark,
        {"type": "session", "version": 3, "id": "s"}, message("a", None, role="user", content="hi"), message("b", "a", role="assistant", model="m", usage={"input": 2}, content=[{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}, {"type": "toolCall", "id": "c", "name": "bash", "arguments": {"command": "ls"}}]),
        message("c", "b", role="toolResult", toolCallId="c", content=[{"type": "text", "text": "f"}]), message("d", "c", role="bashExecution", command="pwd", output="/x", exitCode=2), message("e", "d", role="custom", customType="Note", content="seen", display=True),
        message("f", "e", role="hookMessage", content="no", display=False), {"type": "model_change", "id": "g", "parentId": "f", "provider": "p", "modelId": "q"}, {"type": "session_info", "id": "h", "parentId": "g", "name": " T "}, {"type": "reset_boundary", "id": "i", "parentId": "h"},
        message("j", "a", role="user", content=[{"type": "image", "mimeType": "image/png"}]),
    )
    whole = _shown(pi.pi_entries(pi.with_chain(lines)), "line", "kind", "role", "call_id", "text", "label")
    assert whole == [
        (2, "text", "user", None, "hi", None), (3, "thinking", "assistant", None, "hm", None), (3, "text", "assistant", None, "yes", None), (3, "tool_use", "assistant", "c", None, None), (3, "meta", None, None, None, "Usage"),
        (4, "tool_result", "user", "c", "f", None), (5, "tool_use", "user", "d", None, None), (5, "tool_result", "user", "d", "/x\nexit code 2", None), (6, "meta", None, None, "seen", "Note"), (8, "meta", None, None, "p/q", "Model"), (9, "custom-title", None, None, " T ", None),
        (10, "meta", None, None, "Context cleared", "/clear"), (11, "text", "user", None, "[image: image/png]", None),
    ]
    first = _lines(spark, {"type": "session", "id": "s"}, {"type": "message", "message": {"role": "user", "content": "a"}}, {"type": "message", "message": {"role": "user", "content": "b"}})
    assert [(r.id, r.parent) for r in pi.with_chain(first).orderBy("line").collect()] == [("s", None), ("line-2", None), ("line-3", "line-2")]


def _rows(spark, *records):
    rows = [("s", f"m{i}", i, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "conv_id string, message_id string, created long, raw string").withColumn("record", F.try_parse_json("raw"))


def test_opencode_first(spark):
    messages = _rows(spark, {"role": "user"}, {"role": "assistant", "modelID": "m"}, {"role": "assistant", "modelID": "m"})
    data = [
        ("m0", {"type": "text", "text": "look"}), ("m0", {"type": "text", "synthetic": True, "text": 'Called the Read tool with the following input: {"filePath":"/a"}', "id": "p1"}), ("m0", {"type": "text", "synthetic": True, "text": "one"}),
        ("m0", {"type": "text", "synthetic": True, "text": "two"}), ("m0", {"type": "text", "synthetic": True, "text": "note", "metadata": {"opencodeComment": {}}}), ("m0", {"type": "text", "synthetic": True, "text": "framing"}),
        ("m1", {"type": "step-start"}), ("m1", {"type": "reasoning", "text": "hm", "id": "r"}), ("m1", {"type": "tool", "id": "t", "callID": "c", "tool": "bash", "state": {"status": "completed", "input": {"command": "ls"}, "output": "f"}}),
        ("m1", {"type": "step-finish", "tokens": {"input": 1, "cache": {"read": 4}}}), ("m2", {"type": "text", "text": "done", "id": "x"}), ("m2", {"type": "text", "text": "no", "synthetic": True}),
    ]
    parts = spark.createDataFrame([("s", m, i, json.dumps(r)) for i, (m, r) in enumerate(data)], "conv_id string, message_id string, position long, raw string").withColumn("record", F.try_parse_json("raw"))
    got = _shown(opencode.first_entries(messages, parts), "position", "kind", "reply_id", "call_id", "text", "label")
    assert got == [
        (0, "text", None, None, "look", None), (1, "tool_use", "p1", "p1", None, None), (1, "tool_result", None, "p1", "one\ntwo", None), (4, "text", None, None, "note", None), (6, "meta", None, None, "m", "Model"), (7, "thinking", "r", None, "hm", None),
        (8, "tool_use", "t", "c", None, None), (8, "tool_result", None, "c", "f", None), (9, "meta", None, None, None, "Usage"), (10, "text", "x", None, "done", None),
    ]


def test_opencode_second(spark):
    messages = _rows(
        spark,
        {"type": "user", "text": "hi", "attachments": [{"filename": "a.png"}]}, {"type": "synthetic", "text": "frame\n\nReading MCP resource: r1\n\none\n\ntwo\n\nReading MCP resource: r2\n\nthree"},
        {"type": "assistant", "model": {"id": "m"}, "content": [{"type": "text", "text": "yes"}, {"type": "tool", "id": "c", "name": "bash", "state": {"status": "completed", "input": {"command": "ls"}, "output": "f"}}, {"type": "tool", "id": "d", "name": "edit", "state": {"status": "running", "input": "{"}}], "tokens": {"output": 3}},
        {"type": "shell", "command": "pwd", "output": {"output": "/x"}, "exit": 1}, {"type": "compaction", "status": "running", "summary": "no"}, {"type": "compaction", "status": "completed", "summary": "short"}, {"type": "idle"}, {"type": "assistant", "content": []},
    )
    got = _shown(opencode.second_entries(messages), "message_id", "kind", "reply_id", "call_id", "text", "label")
    assert got == [
        ("m0", "text", None, None, "hi", None), ("m0", "text", None, None, "Attached a.png", None), ("m1", "tool_use", "m1:0", "m1:0", None, None), ("m1", "tool_result", None, "m1:0", "one\n\ntwo", None), ("m1", "tool_use", "m1:1", "m1:1", None, None),
        ("m1", "tool_result", None, "m1:1", "three", None), ("m2", "meta", None, None, "m", "Model"), ("m2", "text", "m2:0", None, "yes", None), ("m2", "tool_use", "m2:1", "c", None, None), ("m2", "tool_result", None, "c", "f", None), ("m2", "tool_use", "m2:2", "d", None, None),
        ("m2", "meta", None, None, None, "Usage"), ("m3", "tool_use", None, "m3", None, None), ("m3", "tool_result", None, "m3", "/x\nexit code 1", None), ("m5", "meta", None, None, "short", "Compaction"),
    ]


def test_calls_are_split(spark):
    patch = "*** Begin Patch\n*** Update File: a.py\n@@\n-x\n+y\n*** Delete File: b.py\n*** End Patch\ntail"
    script = "// read\nconst r = await tools.exec_command({cmd: 'ls (', timeout: 3,});\ntools.apply_patch({input: \"" + patch.replace("\n", "\\n") + '"})'
    rows = [("p", "exec", json.dumps(script)), ("q", "apply_patch", patch), ("r", "shell_command", '{"command": "ls"}'), ("s", "web__run", '{"search_query": [{"q": "a"}, {"q": "b"}]}'), ("t", "odd", "{not"), ("u", "exec", "tools.x(unclosed"), ("v", "write_stdin", '{"session_id": 4, "chars": "y"}')]
    rows = [(c, n, json.loads(a) if c == "p" else a) for c, n, a in rows]
    got = calls.split_calls(spark.createDataFrame(rows, "call_id string, name string, input string"))
    found = {r.call_id: (r.tool, r.input) for r in got.collect()}
    assert {k: v[0] for k, v in found.items()} == {"p": "Shell", "p#2": "Edit", "p#3": "Edit", "q": "Edit", "q#2": "Edit", "r": "Shell", "s": "WebSearch", "s#2": "WebSearch", "t": "Other", "u": "Script", "v": "Wait"}
    assert json.loads(found["p"][1]) == {"command": "ls (", "timeout": 3} and json.loads(found["q"][1]) == {"file_path": "a.py", "patch": "@@\n-x\n+y"}
    assert json.loads(found["q#2"][1])["patch"] == "*** Delete File: b.py" and json.loads(found["t"][1]) == {"arguments": "{not"}


def test_streamed_calls(spark):
    update = lambda **u: {"method": "session/update", "timestamp": "t", "params": {"update": u}}
    lines = _lines(
        spark,
        update(sessionUpdate="tool_call", toolCallId="a", title="Run", rawInput=None), update(sessionUpdate="tool_call_update", toolCallId="a", rawInput={"command": "ls"}), update(sessionUpdate="tool_call_update", toolCallId="b", title="Read", status="failed"),
        update(sessionUpdate="tool_call_update", toolCallId="a", status="completed", content=[{"content": {"text": "f"}}]),
    )
    assert _shown(calls.grok_calls(lines), "line", "kind", "call_id", "name", "input", "text") == [
        (1, "tool_use", "a", "Run", '{"command":"ls"}', None), (3, "tool_use", "b", "Read", "{}", None), (3, "tool_result", "b", None, None, "failed"), (4, "tool_result", "a", None, None, "f"),
    ]


def test_facts_of_rollouts_and_turns(spark):
    record = lambda kind, **p: {"timestamp": "t", "type": kind, "payload": p}
    used = lambda **u: record("event_msg", type="token_count", info={"last_token_usage": u})
    lines = _lines(spark, record("turn_context", model="a"), used(input_tokens=10, cached_input_tokens=4, output_tokens=2), used(input_tokens=0), record("turn_context", model="a"), record("compacted", message="short"), record("turn_context", model="b"), record("event_msg", type="turn_aborted", reason="interrupted"), record("event_msg", type="agent_message"))
    assert _shown(calls.codex_facts(lines), "line", "label", "text", "input_tokens", "cache_read") == [(1, "Model", "a", None, None), (2, "Usage", None, 6, 4), (5, "Compaction", "short", None, None), (6, "Model", "b", None, None), (7, "Notice", "Turn ended: interrupted", None, None)]
    ended = lambda **u: {"timestamp": "t", "params": {"update": {"sessionUpdate": "turn_completed", "usage": u}}}
    lines = _lines(spark, ended(modelUsage={"g": {}}, inputTokens=3, outputTokens=1), ended(modelUsage={"g": {}}), ended())
    assert _shown(calls.grok_turns(lines), "line", "label", "text", "input_tokens") == [(1, "Model", "g", None), (1, "Usage", None, 3)]
    blocks = spark.createDataFrame([("<environment_context>x</environment_context> ",), ("say <environment_context>x</environment_context>",), ("# AGENTS.md instructions for /r",)], "text string")
    assert [r[0] for r in blocks.select(calls.injected_context()).collect()] == [True, False, True]


def test_launches_and_hooks(spark):
    schema = "path string, thread string, line long, kind string, call_id string, tool string, input string, text string"
    rows = [
        ("f", "", 1, "tool_use", "c", "Agent", '{"prompt": "do it"}', None), ("f", "", 2, "tool_result", "c", None, None, "Async agent launched successfully.\nid: 7"), ("f", "x", 3, "text", None, None, None, " do it "), ("f", "x", 4, "text", None, None, None, "do it"),
        ("f", "y", 5, "tool_use", "c", "Agent", '{"prompt": "do it"}', None), ("f", "y", 6, "tool_result", "c", None, None, "copy"), ("f", "y", 7, "text", None, None, None, "own"),
    ]
    threads = spark.createDataFrame([("f", "x", "c", False), ("f", "y", "c", True)], "path string, thread string, launch_call string, fork boolean")
    got = calls.subagent_cleanup(spark.createDataFrame(rows, schema), threads)
    assert [(r.line, r.text) for r in got.orderBy("line").collect()] == [(1, None), (2, "Running in the background"), (4, "do it"), (7, "own")]
    entries = spark.createDataFrame([("f", 1, "tool_use", "c", "run"), ("f", 4, "tool_result", "c", "out"), ("f", 5, "tool_use", "d", "go")], "path string, line long, kind string, call_id string, text string")
    hooks = spark.createDataFrame([("f", 2, "c", "pre"), ("f", 6, "c", "post"), ("f", 7, "d", "late"), ("f", 8, "z", "alone")], "path string, line long, call_id string, text string")
    placed = {(r.line, r.kind): r.text for r in calls.place_hooks(entries, hooks).collect()}
    assert placed == {(1, "tool_use"): "run", (4, "tool_result"): "pre\nout\npost", (5, "tool_use"): "go\nlate", (8, "hook"): "alone"}
