"""Quality rules from cross-document line frequency.

Lines are normalised (their words, A-Z lower-cased, single spaces) and hashed. For each host the
distinct documents that hold a line are counted, copies of a text included. Lines in more than
``max_docs`` documents of their host are removed, and documents that keep too little are rejected,
as are those that fail the base rules on length and repetition.

Lines are told by 64 bits of a hash within their host, texts by 128.

A text is read once: the scan gives its counts and the hashes and sizes of its distinct lines. Line
counts are partial aggregates, so a line that a third of all documents hold is a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels as K
from parlance.llm.session import chunks, lean, prepare, settle

#: A line in more documents of one host than this is removed.
MAX_DOCS = 20
#: A document is rejected when its other lines hold less than this share of its word characters.
MIN_LEFT = 0.3
MIN_WORDS = 50
#: Percent of words in repeated three-word windows.
MAX_REPEAT = 50
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PROFILE = f"doc_id long, host string, c1 long, c2 long, {', '.join(f'{c} long' for c in _COUNTS)}, lines array<long>, sizes array<long>"


def repeated_words(w: K.Words) -> np.ndarray:
    """For each text, the words inside three-word windows that the text holds twice or more."""
    n = len(w.hash)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    out = np.zeros(n + 1, np.int64)
    if n >= 3:
        window = K.mix(w.hash[:-2] + w.hash[1:-1] * np.uint64(K._STEP) + w.hash[2:] * np.uint64(pow(K._STEP, 2, 1 << 64)))
        window = K.mix(window ^ K.mix(text[:-2].astype(np.uint64) + np.uint64(1)))
        inside = text[:-2] == text[2:]
        order = np.sort(window[inside])
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
            hit = np.flatnonzero(inside & (twice[at] == window))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + 3, -1)
            out = np.cumsum(edge)
    return K.sums((out[:n] > 0).astype(np.int64), w.first)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the first line of each text; a text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    n = np.diff(np.searchsorted(breaks, offsets)) + 1
    return start, end, np.concatenate([[0], np.cumsum(n)])


def line_hashes(low: K.Words, start: np.ndarray, end: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The first word and the word after the last of each line, and the hashes of normalised lines."""
    at = np.searchsorted(low.start, start), np.searchsorted(low.start, end)
    rank = np.arange(len(low.hash))
    total = np.zeros(len(rank) + 1, np.uint64)
    np.cumsum(low.hash * K.powers(K._STEP, len(rank)), out=total[1:])
    back = K.powers(pow(K._STEP, -1, 1 << 64), len(rank) + 1)
    return at, K.mix((total[at[1]] - total[at[0]]) * back[at[0]] + (at[1] - at[0]).astype(np.uint64)).view(np.int64)


def profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        data, offsets = K.buffers(part.column(2))
        exact, low = K.words(data, offsets, lower=False), K.words(data, offsets)
        point = K.code_points(data)
        ink = point * ~K.SPACE[data]
        start, end, first = line_spans(data, offsets)
        at, normal = line_hashes(low, start, end)
        raw = K.span_hash(data, start, end)
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(ink, out=seen[1:])
        size = seen[end] - seen[start]
        whole = K.span_hash(data, offsets[:-1], offsets[1:])
        second = K.mix(K.sums(K.mix(data.astype(np.uint64) + np.uint64(257)).view(np.int64) >> 24, offsets).view(np.uint64) ^ np.diff(offsets).view(np.uint64))
        dup, hashes, sizes = np.zeros(len(offsets) - 1, np.int64), [], []
        for i in range(len(offsets) - 1):
            own = slice(first[i], first[i + 1])
            some = at[1][own] > at[0][own]
            dup[i] = some.sum() - len(np.unique(raw[own][some]))
            line, inverse = np.unique(normal[own][some], return_inverse=True)
            hashes.append(line)
            sizes.append(np.bincount(inverse, size[own][some], len(line)).astype(np.int64))
        counts = [np.diff(exact.first), K.sums(ink, offsets), K.sums(_SYMBOL[data].astype(np.int64), offsets), dup, repeated_words(exact)]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]))) for x in (hashes, sizes)]
        ids = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (part.column(0), part.column(1))]
        yield pa.RecordBatch.from_arrays(
            [*ids, pa.array(whole.view(np.int64)), pa.array(second.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in counts), *arrays],
            names=["doc_id", "host", "c1", "c2", *_COUNTS, "lines", "sizes"],
        )


def line_verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, host: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, removed_chars and removed_lines (hashes of its lines above the limit).

    Defined cases: a null text is empty, so it fails the base rules; a null host is the host "";
    rows that share a doc_id are one document, rows without a doc_id one each; lines without a word
    count nowhere; an empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    profiles = settle(rows.mapInArrow(lean(profile_batches), PROFILE))
    content = ["host", "c1", "c2"]
    # equal texts of a host are one row with the number of their documents; a document's rows count once
    some = profiles.where("size(lines) > 0")
    again = settle(some.where("doc_id IS NOT NULL").groupBy("host", "doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("host", "doc_id"))
    repeated = not again.isEmpty()
    alone = some.join(again, ["host", "doc_id"], "left_anti") if repeated else some
    once = some.groupBy(content).agg(F.first(F.arrays_zip("lines", "sizes")).alias("each"))
    docs_of = alone.groupBy(content).agg(F.count("*").alias("docs"))
    once = once.join(docs_of, content, "left") if repeated else some.groupBy(content).agg(F.first(F.arrays_zip("lines", "sizes")).alias("each"), F.count("*").alias("docs"))
    lines = once.select(*content, F.coalesce("docs", F.lit(0)).alias("docs"), F.explode("each").alias("each")).select(*content, "docs", "each.*")
    counted = lines.select("host", "lines", "docs")
    if repeated:
        counted = counted.unionByName(some.join(again, ["host", "doc_id"], "left_semi").select("host", "doc_id", F.explode("lines").alias("lines")).distinct().select("host", "lines", F.lit(1).cast("long").alias("docs")))
    often = counted.groupBy("host", "lines").agg(F.sum("docs").alias("n")).where(F.col("n") > max_docs).select("host", "lines")
    gone = lines.join(often, ["host", "lines"]).groupBy(content).agg(F.sum("sizes").alias("removed_chars"), F.sort_array(F.collect_list("lines")).alias("removed_lines"))
    out = profiles.drop("lines", "sizes").join(gone, content, "left")
    removed = F.coalesce("removed_chars", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & (F.col("word_chars") - removed >= min_left * F.col("word_chars"))).alias("kept"),
        removed.cast("long").alias("removed_chars"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"),
    )


def without_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, kept, removed_lines) rows with those lines taken out of the text."""
    for part in chunks(batches):
        data, offsets = K.buffers(part.column(1))
        start, end, first = line_spans(data, offsets)
        at, normal = line_hashes(K.words(data, offsets), start, end)
        texts = []
        for i, gone in enumerate(part.column(3).to_pylist()):
            own = slice(first[i], first[i + 1])
            stays = ~(np.isin(normal[own], np.array(gone, np.int64)) & (at[1][own] > at[0][own]))
            texts.append(b"\n".join(data[a:b].tobytes() for a, b in zip(start[own][stays], end[own][stays], strict=True)).decode())
        ids, kept = (part.column(k).combine_chunks() for k in (0, 2))
        ids, kept = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, kept))
        yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), kept], names=["doc_id", "text", "kept"])


def remaining_texts(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row for each row of ``docs``: doc_id, its text without the lines above the limit, and kept."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("source", "text"))  # equal texts of a host have the same lines removed
    verdicts = line_verdicts(rows, key="row", **limits).select(F.col("doc_id").alias("row"), "kept", "removed_lines").dropDuplicates(["row"])
    return rows.join(verdicts, "row").select("doc_id", "text", "kept", "removed_lines").mapInArrow(lean(without_batches), "doc_id long, text string, kept boolean")
