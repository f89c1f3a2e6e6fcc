"""Transcript readers and incremental ingestion on files written here."""

import json

from parlance.sources import jsonl
from parlance.streaming import ingest


def _write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in records) + "\n")


def test_claude(spark, tmp_path):
    common = {"sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z"}
    _write(
        tmp_path / "p/s1.jsonl",
        [
            {"type": "user", "message": {"role": "user", "content": "hello SENTINEL"}, **common},
            "{broken",
            "",
            {"type": "assistant", "message": {"id": "m1", "role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}]}, **common},
            {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "out"}]}, **common},
            {"type": "custom-title", "customTitle": "A title", "sessionId": "s1"},
            {"type": "user", "isMeta": True, "message": {"role": "user", "content": "never"}, **common},
            {"type": "system", "subtype": "local_command", "content": "/cmd", **common},
        ],
    )
    lines = jsonl.read_lines(spark, str(tmp_path)).cache()
    assert [(x.line, x.raw, x.before, x.after) for x in jsonl.malformed(lines).collect()][0][:2] == (2, "{broken")
    assert jsonl.recognise(lines).first().source == "claude"
    out = {(x.line, x.kind, x.role, x.tool, x.text) for x in jsonl.claude_entries(lines).collect()}
    assert out == {(1, "text", "user", None, "hello SENTINEL"), (4, "text", "assistant", None, "hi"), (4, "tool_use", "assistant", "Shell", '{"command":"ls"}'), (5, "tool_result", "user", None, "out"), (6, "custom-title", None, None, "A title"), (8, "text", "user", None, "/cmd")}


def test_codex(spark, tmp_path):
    item = lambda **p: {"timestamp": "t", "type": "response_item", "payload": p}
    _write(
        tmp_path / "rollout.jsonl",
        [
            {"timestamp": "t", "type": "session_meta", "payload": {"id": "th"}},
            item(type="message", role="developer", content=[{"type": "input_text", "text": "never"}]),
            item(type="message", role="user", id="u", content=[{"type": "input_text", "text": "ask"}]),
            item(type="reasoning", summary=[{"type": "summary_text", "text": "think"}]),
            item(type="function_call", call_id="c", name="shell", arguments="{}"),
            item(type="function_call_output", call_id="c", output="done"),
        ],
    )
    lines = jsonl.read_lines(spark, str(tmp_path)).cache()
    assert jsonl.recognise(lines).first().source == "codex"
    assert [(x.session_id, x.kind, x.role, x.text) for x in jsonl.codex_entries(lines).orderBy("line").collect()] == [("th", "text", "user", "ask"), ("th", "thinking", "assistant", "think"), ("th", "tool_use", "assistant", "{}"), ("th", "tool_result", "user", "done")]


def test_grok_chunks_and_pi_branches(spark, tmp_path):
    chunk = lambda kind, text, key="p": {"timestamp": 1, "method": "m", "params": {"sessionId": "g", "update": {"sessionUpdate": kind, "content": {"type": "text", "text": text}}, "_meta": {"promptId": key}}}
    _write(tmp_path / "g.jsonl", [chunk("user_message_chunk", "he"), chunk("user_message_chunk", "llo"), chunk("tool_call", ""), chunk("agent_message_chunk", "a"), chunk("agent_message_chunk", "b", "q")])
    _write(tmp_path / "pi.jsonl", [{"type": "session", "id": "s"}, {"type": "message", "id": "1"}, {"type": "message", "id": "2", "parentId": "1"}, {"type": "message", "id": "3", "parentId": "1"}])
    lines = jsonl.read_lines(spark, str(tmp_path)).cache()
    assert {x.source for x in jsonl.recognise(lines).collect()} == {"grok", "pi"}
    assert [x.text for x in jsonl.grok_entries(lines.where("path LIKE '%g.jsonl'")).orderBy("line").collect()] == ["hello", "a", "b"]
    assert {x.id for x in jsonl.pi_branch(lines.where("path LIKE '%pi.jsonl'")).collect()} == {"1", "3"}


def test_growing_folds_equal_one_fold(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(i % 3, i, "assistant" if i % 2 else "user", "x" * i) for i in range(12)]
    for k in (0, 1):
        spark.createDataFrame(rows[k::2], schema).write.json(str(tmp_path / f"in/{k}"))
        stream = ingest.stream_entries(spark, str(tmp_path / "in"), schema)
        ingest.write_sessions(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {tuple(x) for x in ingest.merged_sessions(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(x) for x in ingest.running_counts(spark.createDataFrame(rows, schema)).collect()}


def test_changed_files(spark):
    found, known = [("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], [("a", 1, 1), ("b", 1, 1), ("d", 1, 1)]
    out = ingest.changed_files(*(spark.createDataFrame(x, "path string, size long, modified long") for x in (found, known)))
    assert {x.path: x.state for x in out.collect()} == {"a": "kept", "b": "changed", "c": "new", "d": "removed"}


def test_lines_of_blocks(spark, tmp_path):
    raw = b"".join(json.dumps({"i": i, "t": "é" * (i % 50)}, ensure_ascii=False).encode() + (b"\r\n" if i % 3 else b"\n") + (b"\n" if i % 7 == 0 else b"") for i in range(4000)) + b'{"i": "open'
    (tmp_path / "a.jsonl").write_bytes(raw)
    (tmp_path / "b.jsonl").write_bytes(b"{}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = jsonl.read_lines(spark, str(tmp_path)).where("path LIKE '%a.jsonl'").orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, at = [], 0
    for k, part in enumerate(raw.split(b"\n"), 1):
        if part.strip():
            want.append((k, at, part.rstrip(b"\r").decode()))
        at += len(part) + 1
    assert [(x.line, x.start, x.raw) for x in found] == want
    assert [x.line for x in found if not x.terminated] == [want[-1][0]] and found[-1].record is None and found[-1].end == len(raw)


def test_resumed_reads(spark, tmp_path):
    from parlance.streaming import cursor

    put = lambda name, text: (tmp_path / name).write_text(text)
    put("grown.jsonl", '{"a":1}\n{"a":2}\n{"a"')
    put("same.jsonl", '{"b":1}\n')
    put("rewritten.jsonl", '{"c":1}\n{"c":2}\n')
    put("shorter.jsonl", '{"d":1}\n{"d":2}\n')
    known = spark.createDataFrame(cursor.cursors(jsonl.read_lines(spark, str(tmp_path))).toArrow())
    assert {x.path.rsplit("/", 1)[1]: (x.at, x.line) for x in known.collect()}["grown.jsonl"] == (16, 2)
    put("grown.jsonl", '{"a":1}\n{"a":2}\n{"a":3}\n')
    put("rewritten.jsonl", '{"c":1}\n{"c":9}\n{"c":3}\n')
    put("shorter.jsonl", '{"d":1}\n')
    put("new.jsonl", '{"e":1}\n')
    lines = jsonl.read_lines(spark, str(tmp_path))
    states = cursor.resume(lines, known)
    assert {x.path.rsplit("/", 1)[1].split(".")[0]: (x.state, x.line) for x in states.collect()} == {"grown": ("resumed", 2), "same": ("resumed", 1), "rewritten": ("rewritten", 0), "shorter": ("rewritten", 0), "new": ("full", 0)}
    assert sorted(x.raw for x in cursor.unread(lines, states).collect()) == ['{"a":3}', '{"c":1}', '{"c":3}', '{"c":9}', '{"d":1}', '{"e":1}']


def test_folds_diffs_and_generations(spark, tmp_path):
    from parlance.streaming import cursor

    schema = "path string, line long, kind string, call_id string, reply_id string"
    entries = spark.createDataFrame([("f", 1, "tool_use", "a", "r1"), ("f", 2, "tool_result", "a", None), ("f", 4, "tool_use", "b", "r2"), ("g", 1, "text", None, "r3")], schema)
    ends = spark.createDataFrame([("f", 9), ("g", 1)], "path string, line long")
    assert {x.path: x.line for x in cursor.stable_lines(entries, ends).collect()} == {"f": 3, "g": 1}
    assert [x.path for x in cursor.continued(entries.where("line = 4"), entries.where("line < 4 OR path = 'g'")).collect()] == []
    assert [x.path for x in cursor.continued(entries.where("path = 'g'"), entries).collect()] == ["g"]
    fold = "conv_id long, message_count long, first_second long, last_second long, model string"
    merged = cursor.merge_folds(spark.createDataFrame([(1, 2, 10, 20, "m"), (2, 1, 5, 5, None)], fold), spark.createDataFrame([(1, 3, 30, 40, None), (3, 1, 7, 7, "n")], fold))
    assert {tuple(x) for x in merged.collect()} == {(1, 5, 10, 40, "m"), (2, 1, 5, 5, None), (3, 1, 7, 7, "n")}
    stored = spark.createDataFrame([(1, 1, "a", 100), (1, 2, "b", 101), (1, 3, "c", 102)], "conv_id long, sequence long, text string, id long")
    new = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 4, "d")], "conv_id long, sequence long, text string")
    assert {tuple(x) for x in cursor.diff(new, stored, ["conv_id", "sequence"]).collect()} == {(1, 1, 100, "kept"), (1, 2, 101, "updated"), (1, 3, 102, "deleted"), (1, 4, None, "inserted")}
    log = spark.createDataFrame([(1, 4, 2), (1, 5, 3), (2, 1, 1)], "conv_id long, previous_generation long, first_sequence long")
    assert [x.sequence for x in cursor.appended(stored, log, 5).collect()] == [3] and cursor.appended(stored, log, 6).count() == 0
    for k in (1, 2):
        cursor.write_generation(new.limit(k), str(tmp_path / "t"), k)
    number, rows = cursor.read_generation(spark, str(tmp_path / "t"))
    assert (number, rows.count()) == (2, 2)


def test_discovery_progress_and_sinks(spark, tmp_path):
    from parlance import sinks
    from parlance.sources import discover
    from parlance.streaming import progress

    for name in ("p/s1.jsonl", "p/agent-7.jsonl", "p/deep/er/x.jsonl", "top.jsonl"):
        _write(tmp_path / name, [{"a": 1}])
    found = discover.discover(discover.files(spark, str(tmp_path)), str(tmp_path), "claude")
    assert {x.below: (x.session, x.subagent, x.size) for x in found.collect()} == {"p/s1.jsonl": (True, False, 9), "p/agent-7.jsonl": (False, True, 9), "p/deep/er/x.jsonl": (False, False, 9), "top.jsonl": (False, False, 9)}
    now, said = [0.0], []
    ticker = progress.Ticker(said.append, lambda: now[0])
    for at in (1, 2.5, 4, 7.6, 8):
        now[0] = at
        ticker.tick(10)
    assert [x["rows"] for x in said] == [20, 40]
    latest = progress.Latest(spark, "search")
    assert latest.run(lambda: spark.range(3).count()) == 3
    assert latest.run(lambda: latest.cancel() or 1) is None
    messages = spark.createDataFrame([(1, 1, "user", "a  b"), (1, 2, "assistant", "c\nd"), (1, 3, "user", "a  b")], "conv_id long, ordinal long, role string, text string")
    same = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1)], "conv_id long, ordinal long, same_as long")
    assert [tuple(x)[2:] for x in sinks.message_records(messages, same).orderBy("ordinal").collect()] == [("message ref=m1 role=user", "a b"), ("message ref=m2 role=assistant", "c d"), ("message ref=m3 role=user same=m1", None)]
    assert [x.value for x in sinks.export(messages, "markdown").orderBy("ordinal").collect()][1] == "## Assistant\n\nc\nd\n"
    sinks.write_export(messages, "jsonl", str(tmp_path / "out"))
    assert [json.loads(x.value)["ordinal"] for x in spark.read.text(str(tmp_path / "out/conv_id=1")).collect()] == [1, 2, 3]
    made = spark.createDataFrame([("k", [1.0], 1), ("k", [1.0], 1), ("l", [2.0], 1)], "key string, embedding array<float>, used_day long")
    assert sinks.add_passages(None, made, str(tmp_path / "store")) == 2 and sinks.add_passages(spark.read.parquet(str(tmp_path / "store")), made, str(tmp_path / "store")) == 0
    rows = spark.createDataFrame([(1, 4, 65, "A  title"), (2, 1, None, None)], "conv_id long, message_count long, duration_minutes long, title string")
    assert sinks.printed(x.record for x in sinks.session_records(rows).orderBy("conv_id").collect()) == "session ref=1 messages=4 duration=1h%205m title=A%20title\nsession ref=2 messages=1\n"
