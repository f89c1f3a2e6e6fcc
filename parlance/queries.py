"""The registered queries of the conversation-search operators, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import lexical, links, parts, semantic, sessions
from parlance.plans import query as Q

NOW = datetime(2024, 1, 8, tzinfo=UTC)
WINDOW = Q.TimeFilter(datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 3, 12, 3, tzinfo=UTC))
WORDS = "the of"
PHRASE = '"of the"'
#: 64 terms and one more, which is left out.
TERMS = [*(a + b for a in "tiaoeund" for b in "heninrst"), "zz"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.messages_of(_read(spark, sf_dir, "conversations"))


def _fields(messages: DataFrame) -> DataFrame:
    """Title: the first message's first 60 characters; project by conversation."""
    title = F.min_by(F.left("text", F.lit(60)), "ordinal")
    return messages.groupBy("conv_id").agg(title.alias("title")).withColumn("summary", F.lit("")).withColumn("project", F.concat(F.lit("the-project-"), (F.col("conv_id") % 7).cast("string")))


def _parts(messages: DataFrame) -> DataFrame:
    """Each message as two parts, the second of a kind by its ordinal; every fifth is a sub-agent's."""
    half = F.floor(F.length("text") / 2).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("thinking", "text", "tool_use", "tool_result"))), (F.col("ordinal") % 4).cast("int") + 1)
    thread = F.when(F.col("ordinal") % 5 == 4, F.concat(F.lit("a"), (F.col("ordinal") % 2).cast("string"))).otherwise("")
    base = messages.select("conv_id", "ordinal", "role", thread.alias("thread"), kind.alias("second_kind"), F.left("text", half).alias("head"), F.expr("substr(text, cast(floor(length(text) / 2) as int) + 1)").alias("tail"))
    call = F.when(F.col("second_kind").startswith("tool"), F.concat(F.lit("c"), (F.col("ordinal") % 6).cast("string")))
    null = F.lit(None).cast("string")
    first = base.select("conv_id", "ordinal", F.lit(1).cast("long").alias("position"), "role", "thread", F.lit("text").alias("kind"), null.alias("call_id"), null.alias("tool"), F.col("head").alias("text"))
    second = base.select("conv_id", "ordinal", F.lit(2).cast("long").alias("position"), "role", "thread", F.col("second_kind").alias("kind"), call.alias("call_id"), F.when(F.col("second_kind") == "tool_use", "Shell").alias("tool"), F.col("tail").alias("text"))
    return first.unionByName(second)


def _now() -> int:
    return int(NOW.timestamp())


def normalize_text(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(T.normalize(T.collapse(F.col("text"))).cast("binary")).alias("digest"))


def prefix_count(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", T.normalize(T.collapse(F.col("text"))).alias("low"))
    return docs.select("doc_id", *(T.prefix_count(F.col("low"), w).cast("long").alias(f"n_{w}") for w in ("the", "re", "un")))


def adjacent_pairs(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", T.normalize(T.collapse(F.col("text"))).alias("low"))
    return docs.select("doc_id", T.adjacent_pairs(F.col("low"), ["of", "the", "in"]).cast("long").alias("pairs"))


def literal_match_smartcase(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", T.has_literal(F.col("text"), "the of").alias("lower"), T.has_literal(F.col("text"), "The of").alias("cased"))


def literal_whitespace_runs(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.literal_count(F.col("text"), "of  the").cast("long").alias("n"))


def cjk_contains(spark, d):
    return _read(spark, d, "documents").groupBy("lang").agg(F.count_if(T.contains_cjk(F.col("text"))).alias("with_cjk"), F.count("*").alias("n"))


def word_match_share(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.round(T.word_share(F.col("text"), ["the", "und", "les", "zzz"]), 6).alias("share"))


def matched_terms(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.array_join(T.matched_terms(F.col("text"), ["the", "und", "les", "the"]), ",").alias("terms"))


def message_numbering(spark, d):
    """Turns in three threads, of which neighbours share a reply."""
    rows = _messages(spark, d)
    thread = F.when(F.col("ordinal") % 3 == 2, F.lit("b")).when(F.col("ordinal") % 7 == 0, F.lit("a")).otherwise("")
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("r"), F.floor(F.col("ordinal") / 4).cast("string")))
    rows = rows.select("conv_id", F.col("ordinal").alias("sequence"), thread.alias("thread"), "role", reply.alias("reply_id"), "text")
    return sessions.number_messages(rows).select("conv_id", "sequence", "ordinal", "starts", "thread_number", "position")


def visible_messages(spark, d):
    some = parts.Shown(tools=False, thinking=False, subagents=False)
    return parts.shown_messages(_parts(_messages(spark, d)), some)


def hidden_part_counts(spark, d):
    return parts.hidden_counts(_parts(_messages(spark, d)), parts.Shown(tools=False, thinking=False, subagents=False))


def call_numbers(spark, d):
    return parts.call_numbers(_parts(_messages(spark, d))).select("conv_id", "ordinal", "position", "number")


def thread_handles(spark, d):
    return parts.thread_handles(_parts(_messages(spark, d))).select("conv_id", "thread", "handle")


def segment_offsets(spark, d):
    return parts.segments(_parts(_messages(spark, d))).select("conv_id", "ordinal", "position", "source", "start")


def segment_hits(spark, d):
    """A word and a phrase over parts: the phrase within one part, the word in any."""
    messages = _messages(spark, d)
    hits = lexical.message_hits(messages, Q.parse_query('the "of the"'), parts=_parts(messages))
    return hits.select("conv_id", "ordinal", F.round("score", 6).alias("score"), "source", "offset", "read_first", "read_last", F.md5(F.col("preview").cast("binary")).alias("digest"))


def dialogue_first_hits(spark, d):
    messages = _messages(spark, d)
    hits = lexical.message_hits(messages, Q.exact_query("of the"), parts=_parts(messages))
    return lexical.order_hits(hits, 30, dialogue_first=True).select("conv_id", "ordinal", "source", F.round("score", 6).alias("score"))


def time_inheritance(spark, d):
    rows = _messages(spark, d).select("conv_id", "ordinal", F.when(F.col("ordinal") % 3 == 0, F.col("second")).alias("second"), (F.col("conv_id") * 10).alias("started"))
    return links.inherit(rows, ["conv_id"], "ordinal", "second", "started").select("conv_id", "ordinal", "second")


def launch_links(spark, d):
    """Conversations as sessions: threads launched by calls, of which some ids occur twice."""
    rows = _messages(spark, d)
    calls = rows.select("conv_id", F.concat(F.lit("c"), F.floor(F.col("ordinal") * 2 / 3).cast("string")).alias("call"), "ordinal")
    threads = rows.where("ordinal % 2 = 0").select("conv_id", F.concat(F.lit("c"), F.floor(F.col("ordinal") / 2).cast("string")).alias("launch"))
    return links.link_launches(threads, calls, "conv_id", "launch", "call", "ordinal").select("conv_id", "launch", "ordinal")


def session_fold(spark, d):
    return sessions.fold_sessions(_messages(spark, d)).drop("preview_first", "preview_last")


def session_previews(spark, d):
    return sessions.fold_sessions(_messages(spark, d)).select("conv_id", "preview_first", "preview_last")


def sessions_in_window(spark, d):
    return sessions.sessions_in_window(_messages(spark, d), WINDOW)


def sessions_listing(spark, d):
    return sessions.list_sessions(_messages(spark, d), limit=20, offset=5)


def window_runs(spark, d):
    return sessions.window_runs(_messages(spark, d), WINDOW, T.prefix_count(T.normalize(F.col("text")), "the", 1) > 0)


def empty_sessions(spark, d):
    return sessions.empty_sessions(_messages(spark, d))


def lexical_rank(spark, d):
    messages = _messages(spark, d)
    scores = lexical.rank_sessions(messages, Q.parse_query(WORDS), _now(), fields=_fields(messages))
    return lexical.ranked(scores, Q.TOP).select("conv_id", F.round("score", 6).alias("score"), F.round("body", 6).alias("body"), "pairs", "ranked_second")


def lexical_rank_windowed(spark, d):
    scores = lexical.rank_sessions(_messages(spark, d), Q.parse_query(WORDS), _now(), WINDOW)
    return scores.select("conv_id", F.round("score", 6).alias("score"), "pairs", "ranked_second")


def lexical_explain(spark, d):
    scores = lexical.rank_sessions(_messages(spark, d), Q.parse_query(WORDS), _now())
    return scores.select("conv_id", F.round("score", 6).alias("score"), F.round("body", 6).alias("body"), "pairs", F.round("fresh", 6).alias("fresh"))


def exact_phrase_rank(spark, d):
    scores = lexical.rank_sessions(_messages(spark, d), Q.exact_query("of the"), _now())
    return scores.select("conv_id", F.round("score", 6).alias("score"), "ranked_second")


def browse_freshness(spark, d):
    scores = lexical.rank_sessions(_messages(spark, d), Q.parse_query(""), _now())
    return scores.select("conv_id", F.round("score", 6).alias("score"))


def hit_messages_bitmask(spark, d):
    """64 terms: two-letter beginnings, of which the last is the sign bit."""
    return lexical.term_masks(_messages(spark, d), TERMS)


def _hits(spark, d):
    return lexical.message_hits(_messages(spark, d), Q.parse_query(WORDS))


def within_hits(spark, d):
    return lexical.order_hits(_hits(spark, d), Q.WITHIN_TOP).select("conv_id", "ordinal", F.round("score", 6).alias("score"), "source", "read_first", "read_last")


def preview_text(spark, d):
    return lexical.message_hits(_messages(spark, d), Q.parse_query(PHRASE)).select("conv_id", "ordinal", F.length("preview").cast("long").alias("chars"), F.md5(F.col("preview").cast("binary")).alias("digest"))


def flat_hits_topk(spark, d):
    return lexical.flat_hits(_hits(spark, d), 15).select("conv_id", "ordinal", F.round("score", 6).alias("score"))


def grouped_hits(spark, d):
    return lexical.grouped_hits(_hits(spark, d)).select("conv_id", "rank", "ordinal", F.round("score", 6).alias("score"), "total_hits", F.round("group_score", 6).alias("group_score"))


def dedup_hits(spark, d):
    twice = _hits(spark, d).unionByName(lexical.message_hits(_messages(spark, d), Q.parse_query("the")))
    return lexical.merge_duplicates(twice).select("conv_id", "ordinal", "source", "read_first", "read_last", F.round("score", 6).alias("score"), "merged")


def _vector(spark, d) -> list[float]:
    return list(_read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def cosine_topk(spark, d):
    return semantic.nearest(_read(spark, d, "embeddings"), _vector(spark, d), 20).select("vec_id", "label", F.round("score", 6).alias("score"))


def best_per_conversation(spark, d):
    rows = semantic.scored(_read(spark, d, "embeddings"), _vector(spark, d))
    return semantic.best_of_each(rows, "label", [F.desc("score"), F.col("vec_id")]).select("label", "vec_id", F.round("score", 6).alias("score"))


def _scored_passages(spark, d):
    vectors = _read(spark, d, "embeddings").select("vec_id", semantic.cosine(F.col("embedding"), _vector(spark, d)).alias("score"))
    # passages without a vector aren't scored
    rows = _read(spark, d, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "score")
    return semantic.hybrid_scores(rows, ["the", "of", "und"])


def hybrid_passage_score(spark, d):
    return _scored_passages(spark, d).orderBy(F.desc("hybrid"), F.desc("score"), "doc_id").limit(25).select("doc_id", F.round("hybrid", 6).alias("hybrid"), F.round("word_match", 6).alias("word_match"))


def quality_buckets(spark, d):
    return _scored_passages(spark, d).groupBy("quality", "reason").agg(F.count("*").alias("n"))


def turn_filter(spark, d):
    rows = _messages(spark, d).withColumn("turn", semantic.clean_turn(F.col("text"))).where("turn IS NOT NULL")
    return rows.select("conv_id", "ordinal", F.length("turn").cast("long").alias("chars"), F.md5(F.col("turn").cast("binary")).alias("digest"))


def passage_chunks(spark, d):
    """Documents as one long turn each, in ASCII, as SQL counts characters and passages bytes."""
    turn = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")
    rows = _read(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("ordinal"), turn.alias("text"))
    return semantic.passages(rows).select(F.col("conv_id").alias("doc_id"), "chunk", F.md5(F.col("text").cast("binary")).alias("digest"))


def embedding_lookup_missing(spark, d):
    docs = _read(spark, d, "documents")
    return semantic.missing_keys(docs, docs.where("doc_id % 3 = 0"))


def rrf_fusion(spark, d):
    first = lexical.ranked(lexical.rank_sessions(_messages(spark, d), Q.parse_query(WORDS), _now()), Q.fusion_depth(10))
    second = semantic.nearest(_read(spark, d, "embeddings"), _vector(spark, d), Q.fusion_depth(10)).withColumnRenamed("vec_id", "conv_id")
    from pyspark.sql import Window

    # both lists are at most fusion_depth rows long
    a = first.select("conv_id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("ranked_second"), "conv_id")).cast("long").alias("rank"))
    b = second.select("conv_id", F.row_number().over(Window.orderBy(F.desc("score"), "conv_id")).cast("long").alias("rank"))
    return semantic.reciprocal_ranks(a, b, 30).select("conv_id", "lexical_rank", "semantic_rank", F.round("fused", 9).alias("fused"))


def read_range_rows(spark, d):
    rows = sessions.read_range(_messages(spark, d), 3, 2, 4)
    return rows.select("conv_id", "ordinal", "role", F.length("text").cast("long").alias("chars"))


def tail_messages(spark, d):
    return sessions.tail(_messages(spark, d), 2).select("conv_id", "ordinal", "role")


def line_slice(spark, d):
    return sessions.line_slice(_read(spark, d, "documents"), "doc_id", 2, 4).select("doc_id", "line", F.length("content").cast("long").alias("chars"))


def match_context_lines(spark, d):
    return sessions.context_lines(_read(spark, d, "documents"), "doc_id", "License", 2).select("doc_id", "line", "match")


def outline_segments(spark, d):
    return sessions.outline(_messages(spark, d), 3)


def repeat_detection(spark, d):
    return parts.repeats(_parts(_messages(spark, d)))


def chars_before(spark, d):
    return sessions.chars_before(_messages(spark, d))


def call_result_links(spark, d):
    """Order lines as results of calls by customer: ids that repeat, pieces of split calls, unknown ids."""
    orders, items = _read(spark, d, "orders"), _read(spark, d, "lineitem")
    calls = orders.select(F.lit(1).alias("conv_id"), F.lit("").alias("thread"), F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(F.concat(F.lit("k"), F.floor(F.col("o_orderkey") / F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1)).cast("string"))).alias("call_id"))
    results = items.select(F.lit(1).alias("conv_id"), F.lit("").alias("thread"), "l_returnflag", F.when(F.col("l_orderkey") % 13 == 0, "unknown").otherwise(F.concat(F.lit("k"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("#"), F.col("l_linenumber").cast("string"))).otherwise(""))).alias("call_id"))
    linked = links.link_calls(calls, results, ["conv_id", "thread"], "call_id")
    return linked.groupBy("l_returnflag", "linked").agg(F.count("*").alias("results"), F.countDistinct("call_id").alias("ids"))


def _events(spark, d):
    return _read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def day_markers(spark, d):
    rows = _events(spark, d).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("long"))
    return links.changes(rows, "user_id", ["us", "event_id"], "day").select("user_id", "event_id", "day")


def tool_run_summary(spark, d):
    rows = links.runs(_events(spark, d), "user_id", ["us", "event_id"], "event_type")
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def model_changes(spark, d):
    return links.changes(_events(spark, d), "user_id", ["us", "event_id"], "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


def as_of_links(spark, d):
    """Each purchase with the event of the user's latest click strictly before it."""
    events = _events(spark, d).select("event_id", "us", "user_id", "event_type")
    asked, starts = events.where("event_type = 'purchase'"), events.where("event_type = 'click'")
    return links.as_of(asked, starts, "user_id", "us", "us", "event_id").select("event_id", "user_id", "linked")


def splice_merge(spark, d):
    """Times that go up and down, tie and are absent."""
    at = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 37 % 101 + F.col("event_id") / 40).cast("long"))
    events = _events(spark, d).select("user_id", "event_id", at.alias("at"))
    return links.splice(events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0"), "user_id", "event_id", "at").select("user_id", "event_id", "place", "origin")


def newest_per_thread(spark, d):
    return links.newest(_events(spark, d), "user_id", [F.desc("us"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def version_union_antijoin(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "lang", "source")
    newer = docs.where("doc_id % 2 = 0").withColumn("source", F.concat(F.lit("new-"), "source"))
    return links.newer_wins(newer, docs, "doc_id")


def handle_prefixes(spark, d):
    ids = _read(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    return links.unique_prefixes(ids, "id", 4).select("doc_id", "prefix")


def branch_walk(spark, d):
    """Orders of a ship priority as one long log each: most answer the one before, some the third before,
    some close cycles, and some parents are outside."""
    rows = _read(spark, d, "orders").where("o_orderkey < 6000").select((F.col("o_custkey") % 3).alias("tree"), F.col("o_orderkey").alias("node"))
    back = F.when(F.col("node") % 1999 == 7, F.lit(-1)).when(F.col("node") % 977 == 5, F.lit(10**9)).otherwise(F.lit(1))
    from pyspark.sql import Window

    by = Window.partitionBy("tree").orderBy("node")
    nodes = rows.withColumn("up", F.when(back == 10**9, F.lit(10**9)).when(back == -1, F.lead("node").over(by)).otherwise(F.lag("node", 1).over(by)))
    return links.branch(nodes, "tree", "node", "up", "node")


def props_extract(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))




def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [n for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"]
    return {n: globals()[n] for n in names}
