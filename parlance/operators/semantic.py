"""Semantic search over passages and vectors, and its fusion with lexical ranks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import ALPHANUMERIC, collapse, has_literal, word_share
from parlance.plans import query as Q

#: Bytes of a passage, of what it repeats of the one before, and turns of context that it may repeat.
PASSAGE, OVERLAP, CONTEXT = 2400, 300, 1
#: Tags whose blocks are structure, not conversation.
STRUCTURAL = ("system-reminder", "local-command-caveat", "local-command-stdout", "local-command-stderr", "command-message", "command-name")
#: An assistant's block with one of the first and one of the second is a status report.
VALIDATION = ("validation passed", "all checks pass", "working tree clean", "committed", "commit:", "validation:")
COMMANDS = ("cargo test", "just check", "git status", "git diff")
#: Characters of drawn boxes, punctuation of tables and code, and marks of code.
BOXES = "[─━│┃┌┐└┘├┤┬┴┼╭╮╰╯═║╔╗╚╝]"
PUNCTUATION = r"[|\-+=_`]"
CODE = ("::{", "=>", "</", "<div", "function ", "const ", "let ", "fn ")


def cosine(column: Column, vector: list[float]) -> Column:
    """Cosine similarity to a fixed vector, 0 if either norm is 0, as unrolled JVM arithmetic."""
    norm = sum(x * x for x in vector) ** 0.5
    dot = reduce(lambda a, b: a + b, (F.get(column, F.lit(i)).cast("double") * float(x) for i, x in enumerate(vector)))
    own = F.sqrt(reduce(lambda a, b: a + b, (F.pow(F.get(column, F.lit(i)).cast("double"), F.lit(2.0)) for i in range(len(vector)))))
    return F.when((own == 0) | F.lit(norm == 0), F.lit(0.0)).otherwise(dot / (own * norm))


def valid(column: Column, size: int) -> Column:
    """Whether a vector has the length and finite numbers only."""
    return (F.size(column) == size) & F.forall(column, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def scored(vectors: DataFrame, vector: list[float]) -> DataFrame:
    """(vec_id, label, score) of all valid vectors."""
    return vectors.where(valid(F.col("embedding"), len(vector))).select("vec_id", "label", cosine(F.col("embedding"), vector).alias("score"))


def nearest(vectors: DataFrame, vector: list[float], top: int) -> DataFrame:
    return scored(vectors, vector).orderBy(F.desc("score"), "vec_id").limit(top)


def quality(score: Column) -> Column:
    out = F.lit("weak")
    for least, name in reversed(Q.QUALITY):
        out = F.when(score >= least, name).otherwise(out)
    return out


def hybrid_scores(passages: DataFrame, words: list[str], score: str = "score") -> DataFrame:
    """Adds word_match, hybrid (score + 0.2 word_match), quality and the reason of the match."""
    rows = passages.withColumn("word_match", word_share(F.col("text"), words))
    rows = rows.withColumn("hybrid", F.col(score) + Q.LEXICAL_SHARE * F.col("word_match")).withColumn("quality", quality(F.col("hybrid")))
    reason = F.when(F.col("quality") == "weak", "weak-match").when(F.col("word_match") > 0, "lexical-boosted").otherwise("semantic-only")
    return rows.withColumn("reason", reason)


def best_of_each(rows: DataFrame, group: str, order: list[Column], top: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def is_artifact(block: Column) -> Column:
    """Whether a block is drawing, a table or code rather than prose."""
    count = lambda pattern: F.length(block) - F.length(F.regexp_replace(block, pattern, ""))
    chars, boxes, marks, letters = F.length(F.regexp_replace(block, r"(?U)\s", "")), count(BOXES), count(PUNCTUATION), count(ALPHANUMERIC)
    drawn = (boxes * 4 >= chars) | ((boxes >= 3) & (chars <= 24))
    return (chars == 0) | drawn | ((marks * 2 > letters) & F.contains(block, F.lit("|"))) | ((marks > F.floor(letters / 4)) & _any(block, CODE))


def clean_turn(text: Column, role: Column | None = None) -> Column:
    """A turn without fenced blocks, structural elements, drawings, code and status reports, in one line;
    null if nothing is left. A slash command stands for its arguments."""
    named = F.regexp_extract(text, r"(?s)<command-args>(.*?)</command-args>", 1)
    command = F.contains(text, F.lit("<command-name>")) & F.contains(text, F.lit("</command-name>")) & (F.trim(named) != "")
    text = F.regexp_replace(F.when(command, F.trim(named)).otherwise(text), r"(?s)```.*?(?:```|\z)", "")
    for tag in STRUCTURAL:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?(?:</{tag}>|\z)", "")
    blocks = F.transform(F.regexp_extract_all(collapse(text), F.lit(f"{BOXES}+|[^{BOXES[1:-1]}]+"), F.lit(0)), F.trim)
    tags = tuple(x for t in STRUCTURAL for x in (f"<{t}>", f"</{t}>"))
    status = lambda b: F.lit(False) if role is None else (role == "assistant") & _any(F.lower(b), VALIDATION) & _any(F.lower(b), COMMANDS)
    kept = F.filter(blocks, lambda b: (b != "") & ~b.startswith("/") & ~_any(b, tags) & ~status(b) & ~is_artifact(b))
    return F.nullif(collapse(F.array_join(kept, " ")), F.lit(""))


def turns(entries: DataFrame) -> DataFrame:
    """(conv_id, ordinal, text): the cleaned turns of (conv_id, sequence, ordinal, role, text) entries. The
    records of one reply are one turn; entries without a number, and empty turns, are none."""
    rows = entries.where("ordinal IS NOT NULL").select("conv_id", "ordinal", "sequence", clean_turn(F.col("text"), F.col("role")).alias("turn")).where("turn IS NOT NULL")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "turn"))), lambda t: t["turn"]), " ")
    return rows.groupBy("conv_id", "ordinal").agg(joined.alias("text"))


def cut_turns(found: list[tuple[int, str]], size: int = PASSAGE, overlap: int = OVERLAP, context: int = CONTEXT) -> list[tuple[str, int, int]]:
    """Passages (text, first, last) of a conversation's (ordinal, text) turns.

    Turns are gathered, an empty line apart, up to ``size`` bytes. A new passage begins with the last
    ``context`` turns if they fit ``overlap``. A longer turn is cut by itself, at characters, each piece
    repeating ``overlap`` bytes of the one before.
    """
    out: list[tuple[str, int, int]] = []
    held: list[tuple[int, bytes]] = []
    length = lambda rows: sum(len(t) for _, t in rows) + 2 * max(len(rows) - 1, 0)

    def close() -> None:
        if held:
            ordinals = [o for o, _ in held]
            out.append((b"\n\n".join(t for _, t in held).decode(), min(ordinals), max(ordinals)))
            held.clear()

    def boundary(raw: bytes, at: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    rows = [(o, t.strip().encode()) for o, t in found]
    for i, (ordinal, raw) in enumerate(rows):
        if not raw:
            continue
        if len(raw) > size:
            close()
            while raw:
                end = boundary(raw, size) if len(raw) > size else len(raw)
                out.append((raw[:end].decode(), ordinal, ordinal))
                raw = raw[boundary(raw, end - overlap) :].decode().lstrip().encode() if end < len(raw) else b""
            continue
        if held and length([*held, (ordinal, raw)]) > size:
            close()
            for before in rows[max(i - context, 0) : i]:
                if before[1] and len(before[1]) + length(held) <= overlap:
                    held.append(before)
        held.append((ordinal, raw))
    close()
    return out


def passages(found: DataFrame, size: int = PASSAGE, overlap: int = OVERLAP) -> DataFrame:
    """(conv_id, chunk, first, last, text): passages of (conv_id, ordinal, text) turns, each conversation's in
    one task, as each depends on those before it. chunk counts the passages before blank ones go."""
    kind = found.schema["conv_id"].dataType.simpleString()

    def cut(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ordinal")
        made = cut_turns(list(zip(rows["ordinal"].to_pylist(), rows["text"].to_pylist(), strict=True)), size, overlap)
        kept = [(k, a, b, " ".join(t.split())) for k, (t, a, b) in enumerate(made) if t.strip()]
        chunk, first, last, text = zip(*kept, strict=True) if kept else ((),) * 4
        ids = pa.array([key[0].as_py()] * len(kept), rows.schema.field("conv_id").type)
        return pa.table([ids, pa.array(chunk, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(text, pa.string())], names=["conv_id", "chunk", "first", "last", "text"])

    return found.select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), "text").groupBy("conv_id").applyInArrow(cut, f"conv_id {kind}, chunk long, first long, last long, text string")


def hashed_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """An embedder without a model: each word adds or takes one at a place told by its hash."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            row[h % size] += 1 if h >> 31 else -1
    return out


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_vectors, size: int = 64, batch: int = 8) -> DataFrame:
    """(key, embedding) of (key, text) rows, in batches; a batch with a wrong or endless vector is left out whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for i in range(0, len(texts), batch):
                found = np.asarray(embedder([t or "" for t in texts[i : i + batch]]), np.float32)
                if found.shape == (len(texts[i : i + batch]), size) and np.isfinite(found).all():
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + batch], pa.string()), pa.array(list(found), pa.list_(pa.float32()))], names=["key", "embedding"])

    return rows.select("key", "text").mapInArrow(run, "key string, embedding array<float>")


def passage_key(text: Column) -> Column:
    return F.sha2(text, 256)


def within_budget(missing: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The passages to embed now, by key, and a row with how many are left for later."""
    rows = missing.dropDuplicates(["key"])
    return rows.orderBy("key").limit(most), rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left"))


def kept_passages(store: DataFrame, today: int, days: int = 187) -> DataFrame:
    """The store without passages that weren't used for so many days."""
    return store.where(F.col("used_day") >= today - days)


def used(store: DataFrame, keys: DataFrame, today: int, fresh: int = 7) -> DataFrame:
    """The store with today's stamp on used passages whose stamp is older than ``fresh`` days."""
    hit = keys.select("key").distinct().withColumn("_hit", F.lit(True))
    stamp = F.when(F.col("_hit") & (F.col("used_day") < today - fresh), F.lit(today)).otherwise(F.col("used_day"))
    return store.join(hit, "key", "left").withColumn("used_day", stamp).drop("_hit")


def with_literals(rows: DataFrame, literals: tuple[str, ...]) -> DataFrame:
    """Passages that hold each literal."""
    return rows.where(reduce(lambda a, b: a & b, (has_literal(F.col("text"), x) for x in literals), F.lit(True)))


def in_messages(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Passages with a message of (conv_id, ordinal) among theirs, first and last narrowed to those.

    A passage is spread over its ordinals, so the range becomes an equal join."""
    spread = rows.select("conv_id", "chunk", F.explode(F.sequence("first", "last")).alias("ordinal"))
    focus = spread.join(messages.select("conv_id", "ordinal"), ["conv_id", "ordinal"], "left_semi").groupBy("conv_id", "chunk").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    return rows.drop("first", "last").join(focus, ["conv_id", "chunk"])


def passage_order() -> list[Column]:
    return [F.desc("hybrid"), F.desc("score"), F.desc("word_match"), F.asc("conv_id"), F.asc("session"), F.asc("chunk")]


def evidence_passages(rows: DataFrame, conversations: int, order: list[Column] | None = None) -> DataFrame:
    """All passages of the best conversations, best passage first."""
    by = order or passage_order()
    best = best_of_each(rows, "conv_id", by).orderBy(*by).limit(conversations).select("conv_id")
    return rows.join(F.broadcast(best), "conv_id", "left_semi").orderBy(*by)


def conversation_ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(conv_id, rank): conversations by their best row, from 1. Rows are those of a bounded fusion depth."""
    best = best_of_each(rows, "conv_id", order)
    return best.select("conv_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def chunk_distribution(rows: DataFrame, top: int = 10) -> DataFrame:
    """The conversations with most passages."""
    return rows.groupBy("conv_id").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "conv_id").limit(top)


#: The order of hits by the way they were found.
EXACT, LEXICAL, HYBRID, SEMANTIC = 0, 1, 2, 3


def hybrid_hits(lexical: DataFrame, near: DataFrame, top: int) -> DataFrame:
    """Hits of both searches, (conv_id, first, last, kind or none, evidence), merged where conversation and
    range are equal and ordered by the conversations' fused ranks, way, evidence, reference and place.

    Ranks count conversations by their best hit. A semantic hit merges with one lexical hit at most.
    """
    key = ["conv_id", "first", "last"]
    once = lambda rows: best_of_each(rows, "_key", [F.desc("evidence")]).drop("rank", "_key")
    keyed = lambda rows: rows.withColumn("_key", F.struct(*key))
    a = once(keyed(lexical)).withColumnsRenamed({"kind": "lexical_kind", "evidence": "lexical_evidence"})
    b = once(keyed(near)).withColumnRenamed("evidence", "semantic_evidence")
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("lexical_kind") == EXACT, EXACT).when(F.col("lexical_kind").isNotNull() & F.col("semantic_evidence").isNotNull(), HYBRID).when(F.col("lexical_kind").isNotNull(), LEXICAL).otherwise(SEMANTIC)
    # the way that a merged hit counts as is its first
    way = F.when(F.col("lexical_kind") == EXACT, EXACT).when(F.col("lexical_kind").isNotNull(), LEXICAL).otherwise(SEMANTIC)
    both = both.withColumns({"hit_kind": kind.cast("long"), "_way": way, "evidence": F.greatest("lexical_evidence", "semantic_evidence")})
    ranks = conversation_ranks(lexical, [F.desc("evidence"), F.asc("conv_id"), F.asc("first")]).withColumnRenamed("rank", "lexical_rank")
    near_ranks = conversation_ranks(near, [F.desc("evidence"), F.asc("conv_id"), F.asc("first")]).withColumnRenamed("rank", "semantic_rank")
    part = lambda c: F.coalesce(1.0 / (Q.RRF + F.col(c)), F.lit(0.0))
    rows = both.join(ranks, "conv_id", "left").join(near_ranks, "conv_id", "left").withColumn("fused", part("lexical_rank") + part("semantic_rank"))
    return rows.orderBy(F.desc("fused"), "_way", F.desc("evidence"), "conv_id", "first").limit(top).select(*key, "hit_kind", "evidence", "fused")


def missing_keys(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct passage texts, by their key, that the store doesn't have."""
    keyed = wanted.select(passage_key(F.col("text")).alias("key")).groupBy("key").agg(F.count("*").alias("uses"))
    return keyed.join(stored.select(passage_key(F.col("text")).alias("key")).distinct(), "key", "left_anti")


def reciprocal_ranks(lexical: DataFrame, semantic: DataFrame, top: int) -> DataFrame:
    """(conv_id, lexical_rank, semantic_rank, fused) by reciprocal rank fusion of two (conv_id, rank) lists."""
    both = lexical.withColumnRenamed("rank", "lexical_rank").join(semantic.withColumnRenamed("rank", "semantic_rank"), "conv_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (Q.RRF + F.col(c)), F.lit(0.0))
    return both.withColumn("fused", part("lexical_rank") + part("semantic_rank")).orderBy(F.desc("fused"), "conv_id").limit(top)


def refreshed(index: DataFrame, made: DataFrame, changed: DataFrame) -> DataFrame:
    """An index of passages with those of changed sessions (conv_id) replaced by newly made ones."""
    return index.join(changed.select("conv_id").distinct(), "conv_id", "left_anti").select(index.columns).unionByName(made.join(changed.select("conv_id").distinct(), "conv_id", "left_semi").select(index.columns))
