"""Registered queries of facts, scope, tool texts, passages, fusion and readers, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from parlance.functions import tools
from parlance.operators import evidence, facts, lexical, links, scope, semantic, sessions
from parlance.plans import query as Q
from parlance.queries import _fields, _messages, _now, _parts, _read, _vector
from parlance.sources import calls, kimi, opencode, pi


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def total_tokens(spark, d):
    e = F.col("event_id")
    reply = F.when(e % 4 != 0, _text("r", F.floor(e / 3)))
    usage = _ev(spark, d).select(F.col("user_id").alias("conv_id"), F.when(F.col("event_type") == "click", "a").otherwise("").alias("thread"), reply.alias("reply_id"), e.alias("sequence"), F.col("k").alias("input"), (e % 7).alias("output"), F.when(e % 5 != 0, e % 11).alias("cache_write"), F.lit(1).cast("long").alias("cache_read"))
    return facts.total_tokens(usage)


def usage_split(spark, d):
    rows = _ev(spark, d).select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("k")).alias("total"), (F.col("event_id") % 50).alias("cached"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 3).otherwise(0).alias("out"))
    found = facts.split_usage(rows.withColumn("cached", F.when(F.col("total").isNotNull(), F.col("cached")).otherwise(0)), "total", "cached", "out")
    return found.groupBy(F.col("event_id") % 10).agg(*(F.sum(c).cast("long").alias(c) for c in facts.USAGE), F.count("*").alias("n")).withColumnRenamed("(event_id % 10)", "part")


def session_titles(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "custom-title").when(e % 5 == 1, "ai-title").when(e % 5 == 2, "summary").otherwise("text")
    rows = _ev(spark, d).where("event_id % 41 < 9").select((F.col("user_id") * 10 + e % 10).alias("conv_id"), e.alias("sequence"), kind.alias("kind"), (e % 3 == 0).alias("leading"), F.when(F.col("k") % 6 == 0, "  ").otherwise(_text(" t", F.col("k"))).alias("text"))
    return facts.titles(rows)


def session_models(spark, d):
    rows = _ev(spark, d).select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("sequence"), ((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)).alias("change"), F.when(F.col("k") % 4 != 0, _text("m", F.col("k") % 5)).alias("model"))
    return facts.models(rows)


def activity_span(spark, d):
    role = F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("system")), (F.col("event_id") % 3).cast("int") + 1)
    rows = _ev(spark, d).select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("sequence"), role.alias("role"), F.when(F.col("event_id") % 8 != 0, F.col("event_id") * 31 % 997).alias("second"))
    return facts.activity(rows)


def elapsed_times(spark, d):
    rows = _ev(spark, d).select("user_id", "event_id", (F.col("event_id") * 37 % 101).alias("second"))
    return facts.elapsed(rows, "user_id", "event_id").select("user_id", "event_id", "elapsed")


def turn_durations(spark, d):
    events = _ev(spark, d)
    systems = events.where("event_type = 'error'").select(_text("u", F.col("user_id")).alias("parent_uuid"), F.when(F.col("event_id") % 3 != 0, F.col("k")).alias("duration_ms"), F.col("event_id").alias("line"))
    messages = events.select(_text("u", F.col("user_id") + F.col("event_id") % 2).alias("uuid")).distinct()
    return facts.turn_durations(systems, messages)


def repeated_skills(spark, d):
    command = F.when(F.col("event_type") == "click", _text("s", F.col("k") % 3))
    rows = _ev(spark, d).select("user_id", "event_id", command.alias("command"), F.when(F.col("event_type") == "view", _text("s", F.col("k") % 3)).alias("skill"))
    return facts.repeated_skill_texts(rows, ["user_id"], "event_id").select("user_id", "event_id", "repeated")


def entry_dispatch(spark, d):
    kinds = ["text", "tool_use", "tool_result", "thinking", "meta", "progress", "summary", "ai-title", "custom-title", "system"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") % 10).cast("int") + 1)
    rows = _ev(spark, d).select(kind.alias("kind"), (F.col("event_id") % 2 == 0).alias("searchable"), (F.col("event_id") % 3 > 0).alias("numbered"))
    return rows.select("kind", "searchable", "numbered", facts.dispatch().alias("goes")).groupBy("kind", "goes").agg(F.count("*").alias("n"))


def _sessions(spark, d) -> DataFrame:
    """Documents as sessions, with folders, projects and ids, of which some are UUIDs in any case."""
    doc = F.col("doc_id")
    cwd = F.when(doc % 7 != 0, F.concat(F.lit("/w/repo"), F.when(doc % 3 == 0, "/sub").when(doc % 3 == 1, "-else").otherwise("")))
    uuid = F.regexp_replace(F.md5(doc.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    session = F.when(doc % 2 == 0, F.when(doc % 4 == 0, F.upper(uuid)).otherwise(uuid)).otherwise(_text("ses_", doc))
    project = F.when(doc % 5 != 0, F.concat_ws("/", _text("p", doc % 4), F.when(doc % 3 == 0, F.lit("tree"))))
    return _read(spark, d, "documents").select("doc_id", cwd.alias("cwd"), session.alias("session_id"), project.alias("project"), "lang", F.length("text").cast("long").alias("size"))


def workspace_filter(spark, d):
    rows = _sessions(spark, d)
    return rows.select("doc_id", scope.in_workspace(F.col("cwd"), ["/w/repo"], True).alias("below"), scope.in_workspace(F.col("cwd"), ["/w/repo"], False).alias("same"))


def excluded_projects(spark, d):
    return _sessions(spark, d).where(~scope.excluded(F.col("project"), ["p1", "p2/tree"])).select("doc_id", "project")


def current_sessions(spark, d):
    return scope.without_sessions(_sessions(spark, d), ["ses_3", "CFCD2084-95D5-65EF-66E7-DFF9F98764DA", ""]).select("doc_id")


def session_id_query(spark, d):
    return scope.session_query(_sessions(spark, d), " cfcd2084-95d5-65ef-66e7-dff9f98764da ").select("doc_id", scope.id_key(F.col("session_id")).alias("id"))


def file_prune(spark, d):
    files = _ev(spark, d).groupBy("user_id").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("modified"), F.sum("k").alias("size"))
    return scope.prune_by_write_time(files, 1704500000).select("user_id", "size")


def listed_sessions(spark, d):
    messages = _messages(spark, d)
    origin = F.element_at(F.array(F.lit("discovered"), F.lit("found-by-id"), F.lit("already-listed")), F.when(F.col("conv_id") % 9 < 2, (F.col("conv_id") % 9).cast("int") + 2).otherwise(1))
    rows = messages.select("conv_id").distinct().withColumn("origin", origin)
    from parlance.queries import WINDOW

    return scope.listed(rows, messages, sessions.in_window(WINDOW), True)


def unlisted_reasons(spark, d):
    kind = F.when(F.col("user_id") % 4 == 0, "system").otherwise("text")
    command = F.when(F.col("user_id") % 4 == 1, "/clear")
    text = F.when(F.col("user_id") % 4 == 2, " ").otherwise("x")
    rows = _ev(spark, d).select(F.col("user_id").alias("conv_id"), kind.alias("kind"), command.alias("command"), text.alias("text"), F.when(F.col("user_id") % 8 == 3, "p").alias("preview"))
    return scope.unlisted_reasons(rows)


def first_provider(spark, d):
    rows = _sessions(spark, d).select("doc_id", (F.col("doc_id") % 40).alias("identity"), (F.col("doc_id") * 7 % 1009).alias("provider_order"))
    return scope.first_provider(rows, "identity", "provider_order", "doc_id").select("identity", "doc_id")


def provider_union(spark, d):
    rows = _sessions(spark, d)
    found = scope.union_providers({lang: rows.where(F.col("lang") == lang).select("doc_id", *(["project"] if lang != "de" else [])) for lang in ("en", "de", "fr")})
    return found.groupBy("source", "provider_order").agg(F.count("*").alias("n"), F.count("project").alias("with_project"))


def file_fingerprints(spark, d):
    files = _ev(spark, d).select(F.col("user_id").alias("session_id"), F.col("k").alias("size"), F.col("event_id").alias("modified"))
    return scope.fingerprints(files)


def database_fingerprints(spark, d):
    messages = _messages(spark, d)
    rows = messages.select("conv_id").distinct().withColumn("updated", F.when(F.col("conv_id") % 5 > 0, F.col("conv_id")))
    data = messages.where("conv_id % 4 > 0").select("conv_id", F.col("text").alias("data"), F.col("ordinal").alias("updated"))
    return scope.database_fingerprints(rows, data, data.where("ordinal % 2 = 0"))


def sidecar_titles(spark, d):
    rows = _sessions(spark, d).withColumns({"title": _text("t", F.col("doc_id")), "summary": F.lit("s")})
    outside = rows.where("doc_id % 6 = 0").select(F.lower("session_id").alias("session_id"), _text("new ", F.col("doc_id")).alias("title"), F.col("doc_id").alias("updated"))
    return scope.sidecar_titles(rows, outside).select("doc_id", "title", "summary")


def dropped_records(spark, d):
    outcome = F.element_at(F.array(*map(F.lit, ("skipped", "unrecognised", "failed", "read"))), (F.col("k") % 4).cast("int") + 1)
    return scope.dropped_records(_ev(spark, d).select((F.col("user_id") % 3).alias("version"), F.col("event_type").alias("kind"), outcome.alias("outcome")))


def collapsed_warnings(spark, d):
    rows = _ev(spark, d).where("event_id < 200").select(F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("kind"), F.col("user_id").cast("string").alias("ref"))
    return scope.collapse_warnings(rows)


def catalogue_join(spark, d):
    messages = _messages(spark, d)
    entry = F.col("conv_id") * 1000 + F.col("ordinal")
    rows = _parts(messages).select(entry.alias("entry"), "position", "text")
    entries = messages.select(entry.alias("entry"), "conv_id", F.when(F.col("ordinal") % 3 > 0, F.col("ordinal")).alias("ordinal"), F.lit("text").alias("kind"))
    own = messages.select("conv_id").distinct()
    files = own.where("conv_id % 2 = 0").select("conv_id", F.lit("locator").alias("kind"), _text("/f", F.col("conv_id")).alias("path"))
    found = scope.catalogue(own.withColumn("project", _text("p", F.col("conv_id") % 3)), files, messages, entries, rows)
    return found.groupBy("project", "role", F.col("path").isNotNull().alias("located")).agg(F.count("*").alias("parts"), F.sum(F.length("text")).cast("long").alias("chars"))


def _words(spark, d) -> DataFrame:
    """The first words of documents, and an even number of their lines."""
    w = F.split(F.trim(F.regexp_replace(F.left("text", F.lit(400)), r"[^\p{L}\n ]", "")), r"[\n ]+")
    return _read(spark, d, "documents").select("doc_id", "text", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b"), F.get(w, F.lit(2)).alias("c"))


def call_texts(spark, d):
    names = ["Shell", "Edit", "Skill", "DirectoryListing", "WebFetch", "Other", "Grep"]
    tool = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 7).cast("int") + 1)
    given = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 3 > 0, F.col("a")).alias("command"), F.col("b").alias("file_path"), F.col("a").alias("old_string"), F.concat_ws("\n", "b", "c").alias("new_string"), F.when(F.col("doc_id") % 2 == 0, F.col("c")).alias("skill"),
            F.col("a").alias("args"), F.col("c").alias("url"), F.col("a").alias("prompt"), F.when(F.col("doc_id") % 5 > 0, F.col("b")).alias("pattern"),
        )
    )
    return _words(spark, d).select("doc_id", tools.call_text(tool, F.lit("name"), given).alias("text"))


def result_texts(spark, d):
    item = lambda **f: F.struct(*(v.cast("string").alias(k) for k, v in f.items()))
    items = F.array(item(type=F.lit("text"), text=F.col("a")), item(type=F.when(F.col("doc_id") % 2 == 0, "image").otherwise("video"), text=F.lit(None)), item(type=F.lit("text"), text=F.lit("")), item(type=F.lit("text"), text=F.col("c")))
    content = F.when(F.col("doc_id") % 3 == 0, F.col("b")).otherwise(F.to_json(items))
    return _words(spark, d).select("doc_id", tools.result_text(content).alias("text"))


def edit_diffs(spark, d):
    return _words(spark, d).select("doc_id", F.md5(tools.replacement_diff(F.left("text", F.lit(300)), F.concat(F.col("a"), F.lit("\n"), F.col("b"), F.lit("\n"))).cast("binary")).alias("digest"))


def task_reports(spark, d):
    text = F.concat(
        F.when(F.col("doc_id") % 5 > 0, "  <task-notification>").otherwise("x"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<task-id> "), "a", F.lit(" </task-id>"))).otherwise(""), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("<summary>"), "b", F.lit("</summary>"))).otherwise(""),
        F.lit("<result>"), "c", F.lit("</result> </result><usage><subagent_tokens>"), F.col("doc_id").cast("string"), F.lit("</subagent_tokens><tool_uses>x</tool_uses></usage></task-notification>"),
    )
    return _words(spark, d).select("doc_id", tools.task_report(text).alias("r")).select("doc_id", "r.summary", "r.body", "r.task_id", "r.tokens", "r.tool_calls")


def escaped_atoms(spark, d):
    return _words(spark, d).select("doc_id", F.md5(tools.escape_atom(F.left("text", F.lit(200))).cast("binary")).alias("atom"), F.md5(tools.protocol_snippet(F.col("text"), 100).cast("binary")).alias("snippet"))


def evidence_previews(spark, d):
    text = F.concat("a", F.lit("<my-tag x=1> "), "b", F.lit(" </my-tag>"), "c", F.lit(" <b>bold</b> </other-tag>  < 3 "), "a")
    return _words(spark, d).select("doc_id", tools.evidence_preview(text).alias("preview"))


def artifact_blocks(spark, d):
    block = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("|-- "), "a", F.lit(" | +=+ |"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("const "), "b", F.lit(" = `x`;"))).otherwise(F.left("text", F.lit(60)))
    return _words(spark, d).select("doc_id", semantic.is_artifact(block).alias("artifact"))


def _turns(spark, d) -> DataFrame:
    rows = _messages(spark, d).select("conv_id", F.col("ordinal").alias("sequence"), F.when(F.col("ordinal") % 5 > 0, F.floor(F.col("ordinal") / 2)).alias("ordinal"), "role", F.concat("text", F.when(F.col("ordinal") % 4 == 1, "\n```\ncode\n```\n<system-reminder>x</system-reminder> ── tail").otherwise("")).alias("text"))
    return semantic.turns(rows)


def semantic_turns(spark, d):
    return _turns(spark, d).select("conv_id", "ordinal", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def turn_passages(spark, d):
    """Passages of turns in bytes; no SQL, tested against a plain reading of the rule."""
    return semantic.passages(_turns(spark, d), 400, 60).select("conv_id", "chunk", "first", "last", F.md5(F.col("text").cast("binary")).alias("digest"))


def _ranges(spark, d) -> DataFrame:
    """Four messages as a passage."""
    rows = _messages(spark, d).withColumn("chunk", F.floor((F.col("ordinal") - 1) / 4))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda t: t["text"]), " ")
    return rows.groupBy("conv_id", "chunk").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), text.alias("text"))


def passage_focus(spark, d):
    return semantic.in_messages(_ranges(spark, d), _messages(spark, d).where("(conv_id + ordinal) % 3 = 0")).select("conv_id", "chunk", "first", "last")


def passage_literals(spark, d):
    return semantic.with_literals(_ranges(spark, d), ("of the", "The")).select("conv_id", "chunk")


def chunk_distribution(spark, d):
    return semantic.chunk_distribution(_ranges(spark, d), 12)


def embedding_budget(spark, d):
    docs = _read(spark, d, "documents").where("text IS NOT NULL")
    now, later = semantic.within_budget(semantic.missing_keys(docs, docs.where("doc_id % 3 = 0")), 20)
    return now.select("key").withColumn("left", F.lit(later.first()["left"]))


def store_eviction(spark, d):
    store = _ev(spark, d).groupBy(F.col("user_id").cast("string").alias("key")).agg(F.sum("k").alias("size"), ((F.max("event_id") * 13) % 400 + 100).alias("used_day"))
    return semantic.kept_passages(semantic.used(store, store.where("size % 3 = 0").select("key"), 450), 450)


def _scored_ranges(spark, d) -> DataFrame:
    rows = _ranges(spark, d).withColumn("session", F.lit("s"))
    vectors = semantic.scored(_read(spark, d, "embeddings"), _vector(spark, d)).select("vec_id", "score")
    keyed = rows.withColumn("vec_id", F.col("conv_id") * 3 + F.col("chunk"))
    return semantic.hybrid_scores(keyed.join(vectors, "vec_id"), ["the", "of"])


def evidence_passages(spark, d):
    return semantic.evidence_passages(_scored_ranges(spark, d), 5).select("conv_id", "chunk", F.round("hybrid", 6).alias("hybrid"), F.round("word_match", 6).alias("word_match"))


def hybrid_hits(spark, d):
    messages = _messages(spark, d)
    hits = lexical.message_hits(messages, Q.parse_query("the of")).where("conv_id % 3 < 2")
    first = hits.select("conv_id", F.col("ordinal").alias("first"), F.col("ordinal").alias("last"), F.when(F.col("ordinal") % 5 == 0, semantic.EXACT).otherwise(semantic.LEXICAL).alias("kind"), F.round("score", 6).alias("evidence"))
    near = _scored_ranges(spark, d).where("conv_id % 3 > 0").select("conv_id", "first", F.when(F.col("chunk") % 2 == 0, F.col("first")).otherwise(F.col("last")).alias("last"), F.round("hybrid", 6).alias("evidence"))
    return semantic.hybrid_hits(first, near, 40).select("conv_id", "first", "last", "hit_kind", F.round("evidence", 6).alias("evidence"), F.round("fused", 9).alias("fused"))


def early_stop(spark, d):
    ranks = _messages(spark, d).select("conv_id").distinct().where("conv_id < 60").withColumn("rank", (F.col("conv_id") * 17 % 61).cast("long"))
    hits = ranks.where("conv_id % 4 = 0").select("conv_id")
    return lexical.until_enough(ranks, hits, 5)


def search_coverage(spark, d):
    scores = lexical.rank_sessions(_messages(spark, d), Q.parse_query("the of"), _now())
    return lexical.coverage(scores, lexical.ranked(scores, 7, 3), 3)


def literal_in_project(spark, d):
    """Literals that only a title, a project or a message holds."""
    messages = _messages(spark, d)
    scores = lexical.rank_sessions(messages, Q.parse_query('"the-project-3"'), _now(), fields=_fields(messages))
    return scores.select("conv_id", F.round("score", 6).alias("score"))


def _kimi_lines(spark, d) -> DataFrame:
    """Turns as wire records: appended messages of several origins, loop events, usages."""
    t = F.col("turn")
    text = F.left("text", F.lit(80))
    record = (
        F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("context.append_loop_event").alias("type"), F.struct(F.when(t % 3 == 0, "content.part").when(t % 3 == 1, "tool.call").otherwise("step.begin").alias("type"), F.struct(F.when(t % 2 == 0, "text").otherwise("think").alias("type"), text.alias("text"), text.alias("think")).alias("part"), F.lit("Bash").alias("name"), _text("c", t).alias("toolCallId")).alias("event"))))
        .when(t % 5 == 4, F.to_json(F.struct(F.lit("usage.record").alias("type"), F.lit("turn").alias("usageScope"), _text("m", F.col("conv_id") % 2).alias("model"), F.struct((t % 2).alias("output")).alias("usage"))))
        .otherwise(F.to_json(F.struct(F.lit("context.append_message").alias("type"), F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"), F.struct(F.when(t % 4 == 2, "injection").otherwise("user").alias("kind")).alias("origin")).alias("message"))))
    )
    return _read(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("path"), (t + 1).alias("line"), F.try_parse_json(record).alias("record"))


def kimi_entries(spark, d):
    return kimi.kimi_entries(_kimi_lines(spark, d)).select("path", "line", "kind", "role", "call_id", "tool", F.md5(F.col("text").cast("binary")).alias("digest"), "label", "output_tokens")


def pi_entries(spark, d):
    t = F.col("turn")
    said = F.struct(F.when(t % 4 == 3, "bashExecution").otherwise(F.when(F.col("role") == "assistant", "assistant").otherwise("user")).alias("role"), F.left("text", F.lit(80)).alias("content"), _text("cmd", t).alias("command"), _text("out", t).alias("output"), (t % 2).alias("exitCode"))
    record = F.to_json(F.struct(F.when(t % 5 == 4, "model_change").otherwise("message").alias("type"), _text("i", t).alias("id"), F.lit("m").alias("model"), said.alias("message")))
    lines = _read(spark, d, "conversations").where("text <> ''").select(F.col("conv_id").cast("string").alias("path"), (t + 1).alias("line"), _text("i", t).alias("id"), F.try_parse_json(record).alias("record"))
    return pi.pi_entries(lines).select("path", "line", "part", "kind", "role", "call_id", F.md5(F.col("text").cast("binary")).alias("digest"), "label")


def database_entries(spark, d):
    rows = _read(spark, d, "conversations").where("text <> ''")
    t = F.col("turn")
    messages = rows.select(F.col("conv_id").cast("string").alias("conv_id"), _text("m", t).alias("message_id"), t.alias("created"), F.try_parse_json(F.to_json(F.struct(F.col("role"), _text("x", F.floor(t / 4)).alias("modelID")))).alias("record"))
    part = F.to_json(F.struct(F.when(t % 3 == 1, "tool").otherwise("text").alias("type"), F.left("text", F.lit(80)).alias("text"), (t % 7 == 6).alias("synthetic"), _text("p", t).alias("id"), F.struct(F.when(t % 2 == 1, "completed").otherwise("running").alias("status"), _text("o", t).alias("output")).alias("state")))
    parts = rows.select(F.col("conv_id").cast("string").alias("conv_id"), _text("m", t).alias("message_id"), t.alias("position"), F.try_parse_json(part).alias("record"))
    found = opencode.first_entries(messages, parts)
    return found.select("conv_id", "message_id", "kind", "role", "reply_id", "call_id", F.md5(F.col("text").cast("binary")).alias("digest"), "label")


def split_calls(spark, d):
    """Patches of one file for each word; the first piece keeps the id."""
    words = F.filter(F.slice(F.split(F.left("text", F.lit(200)), r"[^\p{L}]+"), 1, 4), lambda w: w != "")
    patch = F.concat(F.lit("*** Begin Patch\n"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("*** Update File: "), w, F.lit("\n+"), w)), "\n"), F.lit("\n*** End Patch"))
    rows = _read(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("call_id"), F.lit("apply_patch").alias("name"), patch.alias("input"), F.size(words).alias("n"))
    found = calls.split_calls(rows.where("n > 0"))
    return found.select("call_id", "piece", "tool", F.get_json_object("input", "$.file_path").alias("file"))


def hook_texts(spark, d):
    rows = _messages(spark, d)
    entries = rows.where("ordinal % 2 = 0").select(F.col("conv_id").cast("string").alias("path"), F.col("ordinal").alias("line"), F.when(F.col("ordinal") % 4 == 0, "tool_use").otherwise("tool_result").alias("kind"), _text("c", F.floor(F.col("ordinal") / 4)).alias("call_id"), _text("t", F.col("ordinal")).alias("text"))
    hooks = rows.where("ordinal % 2 = 1").select(F.col("conv_id").cast("string").alias("path"), F.col("ordinal").alias("line"), _text("c", F.floor(F.col("ordinal") / 3)).alias("call_id"), _text("h", F.col("ordinal")).alias("text"))
    return calls.place_hooks(entries, hooks)


def message_receivers(spark, d):
    """Purchases as messages to names, clicks as starts of threads with two names each."""
    events = _ev(spark, d)
    shard = (F.col("user_id") % 5).alias("shard")
    starts = events.where("event_type = 'click'").select(shard, F.col("event_id").alias("at"), _text("t", F.col("event_id") % 7).alias("thread"), F.array(_text("n", F.col("k") % 6), _text("n", F.col("k") % 4)).alias("names"))
    messages = events.where("event_type = 'purchase'").select("event_id", shard, F.col("event_id").alias("at"), _text("n", F.col("k") % 8).alias("recipient"), _text("t", F.col("user_id") % 7).alias("sender"))
    return links.running_receivers(messages, starts, "shard", "at").select("event_id", "recipient", "thread")


def rollout_chains(spark, d):
    """Events as rollouts of users: most go on from the one before, some from nowhere."""
    from pyspark.sql import Window

    e = F.col("event_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = _ev(spark, d).withColumn("base_id", F.when(e % 17 == 0, F.lit(-1)).when(e % 29 == 0, e).otherwise(before))
    return links.rollout_chain(rows.select(F.col("user_id").alias("thread"), (e * 7 % 10007).alias("ts"), e.alias("rollout_id"), "base_id", F.col("k").alias("base_end")))


def run_activities(spark, d):
    tool = F.element_at(F.array(*map(F.lit, ("Shell", "UserShell", "Read", "Grep", "Other"))), (F.col("k") % 5).cast("int") + 1)
    rows = _ev(spark, d).where("event_id % 3 = 0").select("user_id", tool.alias("tool"), (F.col("event_id") % 4).alias("commands"))
    return links.run_activity(rows, ["user_id"])


def context_snippets(spark, d):
    """Places of words that a document's beginning doesn't show; no SQL, tested against a plain reading."""
    rows = _read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.left(F.coalesce("text", F.lit("")), F.lit(80)).alias("preview"))
    return evidence.context_lines(rows, Q.parse_query('the und "of the"'), "doc_id").select("doc_id", F.size("ranges").cast("long").alias("n"), "snippet")


def hashed_embeddings(spark, d):
    """Vectors of an embedder without a model; no SQL, tested against plain Python."""
    rows = _read(spark, d, "documents").select(semantic.passage_key(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    return semantic.embed(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [n for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"]
    return {n: globals()[n] for n in names}


