"""Lexical search: session ranking, message hits, and their order and grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import adjacent_pairs, around, collapse, has_literal, has_word, literal_pattern, normalize, prefix_count
from parlance.operators.parts import SEARCHED, Shown, parts_of, segments
from parlance.operators.sessions import in_window
from parlance.plans import query as Q


def freshness(second: Column, now: int) -> Column:
    """2 for the present or future, halved every seven days of age."""
    age = F.greatest(F.lit(now) - second, F.lit(0)) / 86_400
    return Q.FRESH_WEIGHT * F.pow(F.lit(2.0), -age / Q.FRESH_DAYS)


def searchable(messages: DataFrame, fields: DataFrame | None = None, window: Q.TimeFilter = Q.TimeFilter()) -> DataFrame:
    """(conv_id, second, text): the stored texts of the searchable body, each of which is matched by
    itself: all texts of messages in the window and, without a window, titles and summaries."""
    rows = messages.where(in_window(window)).select("conv_id", "second", "text")
    if fields is None or window.active:
        return rows
    extra = fields.select("conv_id", F.lit(None).cast("long").alias("second"), F.explode(F.array("title", "summary")).alias("text"))
    return rows.unionByName(extra.where(F.coalesce("text", F.lit("")) != ""))


def rank_sessions(messages: DataFrame, query: Q.Query, now: int, window: Q.TimeFilter = Q.TimeFilter(), fields: DataFrame | None = None) -> DataFrame:
    """Ranked sessions (conv_id, score, body, pairs, fresh, ranked_second) for a query.

    Words are counted at word starts in each text by itself, summed for the session up to a cap, so
    the counts are partial aggregates. A session needs every word, in its texts or its project, and
    every literal. ``fields`` adds (conv_id, title, summary, project): titles and summaries are part of
    the body, and outside a window all three are scored by their weights. A query with a CJK word whose
    words occur, but not all at word starts, has half a point for each word. Without words the score is
    the freshness.
    """
    open_fields = fields if fields is not None and not window.active else None
    words, cjk = list(query.words), any(Q.is_cjk(w) for w in query.words)
    rows = searchable(messages, open_fields, window).withColumn("low", normalize(collapse(F.col("text"))))
    low = F.col("low")
    counted = rows.select(
        "conv_id", "second", *(prefix_count(low, w, Q.WORD_CAP).alias(f"w{i}") for i, w in enumerate(words)), adjacent_pairs(low, words, Q.PAIR_CAP).alias("p"),
        *((F.contains(low, F.lit(w)) if cjk else F.lit(False)).alias(f"c{i}") for i, w in enumerate(words)), *(has_literal(F.col("text"), x).alias(f"l{i}") for i, x in enumerate(query.literals)),
    )
    summed = counted.groupBy("conv_id").agg(
        F.max("second").alias("ranked_second"), *(F.least(F.sum(f"w{i}"), F.lit(Q.WORD_CAP)).alias(f"w{i}") for i in range(len(words))), *(F.max(f"c{i}").alias(f"c{i}") for i in range(len(words))),
        F.least(F.sum("p"), F.lit(Q.PAIR_CAP)).alias("p"), *(F.max(f"l{i}").alias(f"l{i}") for i in range(len(query.literals))),
    ).where("ranked_second IS NOT NULL")
    body = reduce(lambda a, b: a + b, (F.log(1.0 + F.col(f"w{i}")) for i in range(len(words))), F.lit(0.0))
    extra = F.lit(0.0)
    found, there = [F.col(f"w{i}") > 0 for i in range(len(words))], [F.col(f"c{i}") for i in range(len(words))]
    held = [F.col(f"l{i}") for i in range(len(query.literals))]
    if open_fields is not None:
        names = ("title", "summary", "project")
        summed = summed.join(open_fields.select("conv_id", *(normalize(F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names), F.col("project").alias("raw_project")), "conv_id", "left")
        for name in names if words else ():
            hits = [prefix_count(F.col(name), w, Q.WORD_CAP) for w in words]
            part = reduce(lambda a, b: a + b, (F.log(1.0 + h) for h in hits), F.lit(0.0))
            extra = extra + F.coalesce(Q.WEIGHTS[name] * (part + Q.PAIR_WEIGHT * adjacent_pairs(F.col(name), words, Q.PAIR_CAP)), F.lit(0.0))
            if name == "project":
                found = [f | F.coalesce(h > 0, F.lit(False)) for f, h in zip(found, hits, strict=True)]
                there = [t | F.coalesce(F.contains(F.col(name), F.lit(w)), F.lit(False)) for t, w in zip(there, words, strict=True)]
        held = [h | F.coalesce(has_literal(F.col("raw_project"), x), F.lit(False)) for h, x in zip(held, query.literals, strict=True)]
    every = lambda tests: reduce(lambda a, b: a & b, tests, F.lit(True))
    whole = every(found)
    keep = every(held) & ((whole | every(there)) if cjk else whole)
    fresh = freshness(F.col("ranked_second"), now)
    score = Q.WEIGHTS["body"] * (body + Q.PAIR_WEIGHT * F.col("p")) + extra if words else F.lit(0.0)
    if cjk:
        score = F.when(whole, score).otherwise(Q.CJK_WEIGHT * len(words))
    return summed.where(keep).select("conv_id", (score + fresh).alias("score"), body.alias("body"), F.col("p").cast("long").alias("pairs"), fresh.alias("fresh"), "ranked_second")


def ranked(scores: DataFrame, top: int, offset: int = 0) -> DataFrame:
    """The places offset + 1 to offset + top, by score, then time, then id."""
    return scores.orderBy(F.desc("score"), F.desc("ranked_second"), "conv_id").offset(offset).limit(top)


def message_hits(messages: DataFrame, query: Q.Query, window: Q.TimeFilter = Q.TimeFilter(), parts: DataFrame | None = None, shown: Shown = SEARCHED) -> DataFrame:
    """Messages that hold all words, in any of their segments, and each literal within one segment, with
    their score, source, read range and preview.

    Score: 4 for each distinct word and literal, 3 more for each literal, 2 for each pair of neighbouring
    words side by side, and 1 / bytes from the first to the last match, where a word matches a whole
    segment and a literal itself. The source is the first of dialogue, tools and thoughts that matched.
    Texts of messages are only gathered where all words and literals are there.
    """
    words, literals = list(query.words), list(query.literals)
    within = messages.withColumn("messages", F.count("*").over(Window.partitionBy("conv_id"))).where(in_window(window))
    rows = segments(parts_of(messages) if parts is None else parts, shown).withColumn("low", normalize(F.col("text")))
    size, end = F.octet_length("text"), F.col("start") + F.octet_length("text")
    tests = [has_word(F.col("low"), w).alias(f"t{i}") for i, w in enumerate(words)]
    for k, x in enumerate(literals):
        pieces = F.split("text", literal_pattern(x), -1)
        tests += [(F.size(pieces) > 1).alias(f"t{len(words) + k}"), F.octet_length(F.get(pieces, F.lit(0))).alias(f"a{k}"), (size - F.octet_length(F.element_at(pieces, -1))).alias(f"b{k}")]
    rows = rows.select("conv_id", "ordinal", "position", "source", "text", "start", end.alias("end"), *tests)
    terms = [F.col(f"t{i}") for i in range(len(words) + len(literals))]
    some = reduce(lambda a, b: a | b, terms, F.lit(False))
    by_word = reduce(lambda a, b: a | b, terms[: len(words)], F.lit(False))
    first = F.least(F.when(by_word, F.col("start")), F.lit(None), *(F.when(t, F.col("start") + F.col(f"a{k}")) for k, t in enumerate(terms[len(words) :])))
    last = F.greatest(F.when(by_word, F.col("end")), F.lit(None), *(F.when(t, F.col("start") + F.col(f"b{k}")) for k, t in enumerate(terms[len(words) :])))
    found = rows.groupBy("conv_id", "ordinal").agg(
        F.min(first).alias("first"), F.max(last).alias("last"), F.min(F.when(some, F.col("source"))).alias("source"), *(F.max(t.cast("int")).alias(f"t{i}") for i, t in enumerate(terms))
    )
    found = found.where(reduce(lambda a, b: a & b, (F.col(f"t{i}") == 1 for i in range(len(terms))), F.col("first").isNotNull()))
    found = found.join(within.select("conv_id", "ordinal", "second", "messages"), ["conv_id", "ordinal"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), "\n")
    bodies = rows.select("conv_id", "ordinal", "position", "text").join(found.select("conv_id", "ordinal"), ["conv_id", "ordinal"], "left_semi").groupBy("conv_id", "ordinal").agg(text.alias("body"))
    hits = found.join(bodies, ["conv_id", "ordinal"]).withColumn("low", normalize(F.col("body")))
    pairs = reduce(lambda a, b: a + b, (F.contains("low", F.lit(f"{a} {b}")).cast("int") for a, b in zip(words, words[1:], strict=False)), F.lit(0))
    distinct = len(dict.fromkeys(words)) + len(literals)
    score = 4.0 * distinct + 3.0 * len(literals) + 2.0 * pairs + 1.0 / F.greatest(F.col("last") - F.col("first"), F.lit(1))
    return hits.select(
        "conv_id", "ordinal", "second", score.alias("score"), "source", F.greatest(F.col("ordinal") - Q.READ_RADIUS, F.lit(1)).alias("read_first"),
        F.least(F.col("ordinal") + Q.READ_RADIUS, F.col("messages")).alias("read_last"), around(F.col("body"), F.col("first").cast("int"), F.col("last").cast("int")).alias("preview"), F.col("first").alias("offset"),
    )


def order_hits(hits: DataFrame, top: int, dialogue_first: bool = False) -> DataFrame:
    """Hits of one search by score, time, conversation, ordinal, source and offset; for a quoted query what
    was said comes first."""
    return hits.orderBy(*(["source"] if dialogue_first else []), F.desc("score"), F.desc("second"), "conv_id", "ordinal", "source", "offset").limit(top)


def bucket(score: Column) -> Column:
    return F.floor(score * 10).cast("long")


def _ties(hits: DataFrame, *names: str) -> list[Column]:
    """Orders by those of the names that the hits have: evidence falls, the kind of hit rises."""
    return [F.desc(n) if n == "evidence" else F.asc(n) for n in names if n in hits.columns]


def flat_hits(hits: DataFrame, top: int = Q.TOP) -> DataFrame:
    """Output order of ungrouped hits: score in tenths, source, score, evidence, kind, conversation, ordinal."""
    return hits.orderBy(F.desc(bucket(F.col("score"))), "source", F.desc("score"), *_ties(hits, "evidence", "hit_kind"), "conv_id", "ordinal").limit(top)


def merge_duplicates(hits: DataFrame) -> DataFrame:
    """One hit for each (conv_id, ordinal, source): the widest range, the best score and, where hits have
    them, any flag (shows_…), the best evidence and the preview of the best score."""
    more = [F.bool_or(c).alias(c) for c in hits.columns if c.startswith("shows_")]
    more += [F.max("evidence").alias("evidence")] if "evidence" in hits.columns else []
    more += [F.max_by("preview", "score").alias("preview")] if "preview" in hits.columns else []
    best = hits.groupBy("conv_id", "ordinal", "source")
    return best.agg(F.min("read_first").alias("read_first"), F.max("read_last").alias("read_last"), F.max("score").alias("score"), F.count("*").alias("merged"), *more)


def grouped_hits(hits: DataFrame, per_conversation: int = Q.HITS_PER_CONVERSATION, top: int = Q.TOP) -> DataFrame:
    """The best hits of the best conversations, with each conversation's number of hits and best score."""
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.desc(bucket(F.col("score"))), "source", *_ties(hits, "evidence"), F.desc("score"), "ordinal", *_ties(hits, "hit_kind"))
    rows = hits.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("total_hits", F.count("*").over(whole))
    kept = rows.where(F.col("rank") <= per_conversation).withColumn("group_score", F.max("score").over(whole))
    best = kept.select("conv_id", "group_score").distinct().orderBy(F.desc("group_score"), "conv_id").limit(top)
    return kept.join(F.broadcast(best.select("conv_id")), "conv_id").select("conv_id", "rank", "ordinal", "score", "total_hits", "group_score")


def term_masks(messages: DataFrame, terms: list[str]) -> DataFrame:
    """For each message a bit mask of the first 64 terms that it holds, and whether it holds all."""
    text = normalize(F.col("text"))
    terms = terms[:64]
    bit = lambda i: F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long")
    bits = [F.when(prefix_count(text, t, 1) > 0, bit(i)).otherwise(F.lit(0).cast("long")) for i, t in enumerate(terms)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))
    full = -1 if len(terms) == 64 else (1 << len(terms)) - 1
    rows = messages.select("conv_id", "ordinal", mask.alias("mask"))
    return rows.groupBy("conv_id").agg(F.bit_or("mask").alias("mask"), F.count_if(F.col("mask") == full).alias("full_messages"))


def until_enough(ranked_sessions: DataFrame, hits: DataFrame, wanted: int) -> DataFrame:
    """The ranked sessions (conv_id, rank), at most a shortlist, up to the one with which so many had hits."""
    held = hits.select("conv_id").distinct().withColumn("_hit", F.lit(1))
    rows = ranked_sessions.join(held, "conv_id", "left")
    before = F.coalesce(F.sum(F.coalesce("_hit", F.lit(0))).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where(F.col("_before") < wanted).drop("_hit", "_before")


def coverage(scores: DataFrame, searched: DataFrame, offset: int = 0) -> DataFrame:
    """One row: matched sessions, offset, searched ones, and the offset to go on from, null at the end."""
    both = scores.select(F.lit(1).alias("m")).unionAll(searched.select(F.lit(0)))
    rows = both.agg(F.count_if(F.col("m") == 1).alias("matched"), F.count_if(F.col("m") == 0).alias("searched")).withColumn("offset", F.lit(offset).cast("long"))
    return rows.withColumn("next_offset", F.when(F.col("offset") + F.col("searched") < F.col("matched"), F.col("offset") + F.col("searched")))
