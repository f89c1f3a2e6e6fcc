"""The search engine over tables of messages and parts: list, search, within, read and outline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance import errors
from parlance.functions.tools import protocol_snippet
from parlance.operators import lexical, scope, semantic, sessions
from parlance.operators import parts as P
from parlance.plans import budget as B
from parlance.plans import query as Q

#: Characters of output, of a read, and messages of an outline that is one record for each.
BUDGET, READ_BUDGET, SHORT = 6000, 20_000, 20


@dataclass(frozen=True)
class Scope:
    """Which sessions a verb sees: folders of a workspace, projects that are left out, sessions that run now."""

    directories: list[str] = field(default_factory=list)
    repository: bool = True
    excluded: list[str] = field(default_factory=list)
    running: list[str] = field(default_factory=list)


class Engine:
    """Queries over (conv_id, ordinal, role, text, second) messages; now is always given, never read.

    ``fields`` has (conv_id, title, summary, project) and, for a scope, (session_id, cwd); ``vectors``
    (key, embedding) of passages by the key of their text.
    """

    def __init__(self, messages: DataFrame, now: datetime, fields: DataFrame | None = None, vectors: DataFrame | None = None, parts: DataFrame | None = None, embedder: Callable[[list[str]], np.ndarray] = semantic.hashed_vectors):
        self.messages, self.now, self.fields, self.vectors, self.embedder = messages, now, fields, vectors, embedder
        self.parts = P.parts_of(messages) if parts is None else parts

    def scoped(self, where: Scope) -> Engine:
        """The engine over the sessions of a scope."""
        if self.fields is None:
            raise errors.VerbError("a scope needs fields")
        rows = scope.without_sessions(self.fields, where.running).where(~scope.excluded(F.col("project"), where.excluded))
        if where.directories:
            rows = rows.where(scope.in_workspace(F.col("cwd"), where.directories, where.repository))
        own = rows.select("conv_id")
        return Engine(self.messages.join(own, "conv_id", "left_semi"), self.now, rows, self.vectors, self.parts.join(own, "conv_id", "left_semi"), self.embedder)

    def sessions(self, window: Q.TimeFilter = Q.TimeFilter(), limit: int = Q.LISTED, offset: int = 0) -> DataFrame:
        return sessions.list_sessions(self.messages, window, limit, offset)

    def passages(self) -> DataFrame:
        """(conv_id, chunk, first, last, text, key) of all sessions."""
        entries = self.messages.withColumn("sequence", F.col("ordinal"))
        found = semantic.passages(semantic.turns(entries))
        return found.withColumn("key", semantic.passage_key(F.col("text")))

    def build_passages(self, store: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(key, embedding) of passages that the store lacks, at most so many, and how many are left."""
        wanted = self.passages().select("key", "text").dropDuplicates(["key"])
        if store is not None:
            wanted = wanted.join(store.select("key"), "key", "left_anti")
        now, left = semantic.within_budget(wanted, most) if most is not None else (wanted, wanted.limit(0).agg(F.count("*").alias("left")))
        return semantic.embed(now, self.embedder), left

    def near_passages(self, query: Q.Query, window: Q.TimeFilter = Q.TimeFilter()) -> DataFrame:
        """Passages with their scores for a query; its literals must be in them, and a message in the window."""
        if self.vectors is None:
            raise errors.SemanticUnavailable("no vectors")
        vector = [float(x) for x in self.embedder([query.text])[0]]
        rows = self.passages().join(self.vectors, "key").where(semantic.valid(F.col("embedding"), len(vector)))
        rows = semantic.with_literals(rows, query.literals) if query.literals else rows
        if window.active:
            rows = semantic.in_messages(rows, self.messages.where(sessions.in_window(window)))
        rows = rows.withColumn("score", semantic.cosine(F.col("embedding"), vector)).drop("embedding").withColumn("session", F.lit(""))
        return semantic.hybrid_scores(rows, list(query.text.split()))

    def search(self, text: str, mode: str | None = None, top: int = Q.TOP, offset: int = 0, window: Q.TimeFilter = Q.TimeFilter(), flat: bool = False, per_conversation: int = Q.HITS_PER_CONVERSATION) -> DataFrame:
        """Hits of the ranked conversations: grouped or flat for words and phrases, merged for semantic and hybrid."""
        query = Q.exact_query(text) if mode == "exact" else Q.parse_query(text)
        mode = Q.resolve_mode(mode, None, query, offset)
        if mode == "semantic":
            return self._near_hits(query, window, top)
        scores = lexical.rank_sessions(self.messages, query, int(self.now.timestamp()), window, self.fields)
        chosen = lexical.ranked(scores, Q.shortlist(top), offset).select("conv_id", "score", "ranked_second")
        hits = self._hits(chosen, query, window)
        if mode == "hybrid":
            depth = Q.fusion_depth(top, 1 if flat else per_conversation)
            kind = semantic.EXACT if query.literals and not query.words else semantic.LEXICAL
            first = hits.orderBy(F.desc("score"), "conv_id", "ordinal").limit(depth).select("conv_id", F.col("ordinal").alias("first"), F.col("ordinal").alias("last"), F.lit(kind).alias("kind"), F.col("score").alias("evidence"))
            near = self.near_passages(query, window).orderBy(*semantic.passage_order()).limit(depth).select("conv_id", "first", "last", F.col("hybrid").alias("evidence"))
            return semantic.hybrid_hits(first, near, top)
        return lexical.flat_hits(hits, top) if flat else lexical.grouped_hits(hits, per_conversation, top)

    def _hits(self, chosen: DataFrame, query: Q.Query, window: Q.TimeFilter) -> DataFrame:
        own = chosen.select("conv_id")
        return lexical.message_hits(self.messages.join(own, "conv_id", "left_semi"), query, window, self.parts.join(own, "conv_id", "left_semi"))

    def _near_hits(self, query: Q.Query, window: Q.TimeFilter, top: int) -> DataFrame:
        """Passages of the best conversations, best first, scored by the rank of their conversation."""
        rows = semantic.evidence_passages(self.near_passages(query, window), top)
        ranks = semantic.conversation_ranks(rows, semantic.passage_order())
        found = rows.join(ranks, "conv_id").withColumn("fused", 1.0 / (Q.RRF + F.col("rank")))
        found = found.dropDuplicates(["conv_id", "first", "last"]).orderBy("rank", F.desc("hybrid"), "chunk")
        return found.select("conv_id", "first", "last", "fused", "hybrid", "quality", "reason")

    def coverage(self, text: str, top: int = Q.TOP, offset: int = 0, window: Q.TimeFilter = Q.TimeFilter()) -> DataFrame:
        scores = lexical.rank_sessions(self.messages, Q.parse_query(text), int(self.now.timestamp()), window, self.fields)
        return lexical.coverage(scores, lexical.ranked(scores, Q.shortlist(top), offset), offset)

    def within(self, conv_id: int, text: str, top: int = Q.WITHIN_TOP, window: Q.TimeFilter = Q.TimeFilter(), mode: str | None = None) -> DataFrame:
        """Hits in one conversation: its messages, or its passages for a semantic search."""
        query, own = Q.exact_query(text) if mode == "exact" else Q.parse_query(text), F.col("conv_id") == conv_id
        if mode == "semantic":
            alone = Engine(self.messages.where(own), self.now, self.fields, self.vectors, self.parts.where(own), self.embedder)
            return alone.near_passages(query, window).orderBy(*semantic.passage_order()).limit(top)
        return lexical.order_hits(lexical.message_hits(self.messages.where(own), query, window, self.parts.where(own)), top, query.quoted_only)

    def read(self, conv_id: int, ref: str | None = None, shown: P.Shown = P.SEARCHED, tail: int | None = None, lines: tuple[int, int] | None = None, match: str | None = None, context: int = 3) -> DataFrame:
        """Messages mN or mN..mM, or the last few; for mN.K and sN the parts of that call and its results, or of
        that sub-agent; with ``lines`` or ``match`` the lines of those messages."""
        own = self.messages.where(F.col("conv_id") == conv_id)
        if tail is not None:
            kept = P.shown_messages(self.parts.where(F.col("conv_id") == conv_id), shown)
            return sessions.tail(own.join(kept.select("conv_id", "ordinal"), ["conv_id", "ordinal"], "left_semi"), tail)
        try:
            where = Q.parse_ref(ref or "")
        except ValueError as bad:
            raise errors.InvalidRef(ref or "") from bad
        if where.call is not None:
            found = P.call_with_results(self.parts, conv_id, where.first, where.call)
        elif where.kind == "subagent":
            handles = P.thread_handles(self.parts.where(F.col("conv_id") == conv_id)).where(F.col("handle") == f"s{where.first}")
            found = self.parts.join(handles.select("conv_id", "thread"), ["conv_id", "thread"], "left_semi").where(shown.test())
        else:
            last = own.agg(F.max("ordinal")).first()[0]
            if last is None:
                raise errors.NotFound(str(conv_id))
            if where.last > last:
                raise errors.OutOfRange(f"{ref}: the last message is m{last}")
            found = own.where(F.col("ordinal").between(where.first, where.last))
            if lines is not None or match is not None:
                key = found.withColumn("message", F.col("ordinal"))
                return sessions.line_slice(key, "message", *lines) if lines is not None else sessions.context_lines(key, "message", match, context)
            return found
        if found.isEmpty():
            raise errors.NotFound(ref)
        return found

    def read_within_budget(self, conv_id: int, ref: str, most: int = READ_BUDGET, focus: int | None = None) -> list[tuple[int, str]]:
        """(ordinal, text) of the messages around the focus that fit, long ones cut to fair shares.

        One session's messages, at most so many characters of each, come to the driver."""
        rows = self.read(conv_id, ref).select("ordinal", F.left("text", F.lit(most)).alias("text")).orderBy("ordinal").collect()
        if most < B.FLOOR:
            raise errors.BudgetTooSmall(str(most), full=sum(len(r.text) for r in rows))
        at = next((k for k, r in enumerate(rows) if r.ordinal == focus), 0)
        kept = B.grow_around([min(len(r.text), B.FLOOR) for r in rows], most, at)
        shares = B.fair_shares([len(rows[k].text) for k in kept], most)
        return [(rows[k].ordinal, rows[k].text[:n]) for k, n in zip(kept, shares, strict=True)]

    def outline(self, conv_id: int, size: int | None = None, most: int = BUDGET) -> DataFrame:
        """A record for each message of a short conversation, else segments of the smallest size, of ten at
        least, whose records fit the budget."""
        own = self.messages.where(F.col("conv_id") == conv_id)
        if size is None:
            n = own.count()
            size = 1 if n <= SHORT else next((s for s in range(10, n + 1) if -(-n // s) * 200 <= most), max(n, 1))
        return sessions.outline(own, size)

    def explain_search(self, text: str) -> DataFrame:
        return lexical.rank_sessions(self.messages, Q.parse_query(text), int(self.now.timestamp()), fields=self.fields)

    def empty_sessions(self) -> DataFrame:
        return sessions.empty_sessions(self.messages)

    def anchor(self, conv_id: int, value: str) -> int:
        """The ordinal of the message whose anchor is the value."""
        found = self.anchors().where((F.col("conv_id") == conv_id) & (F.col("anchor") == value)).select("ordinal").limit(2).collect()
        if not found:
            raise errors.NotFound(value)
        if len(found) > 1:
            raise errors.AmbiguousRef(value)
        return found[0].ordinal

    def anchors(self) -> DataFrame:
        """(conv_id, ordinal, anchor): a digest of a message's role and clean text."""
        text = protocol_snippet(F.col("text"), 1 << 30)
        return self.messages.select("conv_id", "ordinal", F.concat(F.lit("ma_"), F.left(F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), "role", text), 256), F.lit(16))).alias("anchor"))

    def warnings(self, malformed: DataFrame) -> DataFrame:
        """One row for each kind of warning about (path, line) malformed lines."""
        return scope.collapse_warnings(malformed.select(F.lit("malformed-transcript").alias("kind"), F.col("path").alias("ref")))

    def fitting(self, rows: DataFrame, size: str, order: list, most: int = BUDGET) -> DataFrame:
        """The leading rows whose running size fits the budget; rows are a bounded output."""
        so_far = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn("_used", so_far).where(F.col("_used") <= most).drop("_used")
