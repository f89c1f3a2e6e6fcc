"""Quality scores by co-training: a text view and a page-metadata view that label for each other.

The text view sees hashed byte trigrams, as shares of the text. The metadata view sees layout numbers
(lengths, lines, repetition, capitals, symbols), in bins, and the hashed language and source. Both are
naive Bayes models, as in Blum and Mitchell's co-training (1998): their statistics are sums over
documents, so every round learns from all documents of the corpus in one distributed pass.

They start from labelled documents. In each round either view scores every unlabelled document; those
whose calibrated probability is at least ``SURE``, or at most 1 - ``SURE``, get that label in the
other view. Both views are calibrated on a fifth of the labelled documents, which they don't learn
from, and the mean of their calibrated log-odds scores all documents.

Only labelled documents are bounded: at most ``LABELLED``, drawn by a hash of doc_id. Sums of whole
numbers don't depend on the order of tasks, so neither do the models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels as K
from parlance.llm.session import chunks, flat, lean, prepare, settle

#: The most labelled documents that the models start from; a row of the list that is broadcast has 16 bytes.
LABELLED = 20_000
ROUNDS = 3
#: How sure a view is of the documents that it labels for the other.
SURE = 0.99
#: Trigrams that say nothing in every text.
SHORT = 64
#: Hashed trigrams, and a document's whole in their counts.
WIDE, WHOLE = 1 << 15, 1 << 20
#: Bins of a layout number, spots of a language or a source, and numbers.
BINS, SPOTS, NUMBERS = 32, 32, 12
#: Counts of a feature before any document is seen, as documents, in either view.
BEFORE = (1e-3, 0.5)
_FEATURES = WIDE + SPOTS * (NUMBERS + 2)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of each text, and where each text's begin."""
    n = np.maximum(np.diff(offsets) - 2, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    wide = data.astype(np.uint32)
    every = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D) if len(data) > 2 else np.zeros(0, np.uint32)
    every ^= every >> np.uint32(15)
    at = np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], n)
    return ((every * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)[at], first


def layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, NUMBERS) layout numbers."""
    w = K.words(data, offsets)
    n = len(offsets) - 1
    words = np.diff(w.first).astype(float)
    size = np.diff(offsets).astype(float)
    share = lambda mask: K.sums(mask.astype(np.int64), offsets) / np.maximum(size, 1)
    lines = K.sums((data == 10).astype(np.int64), offsets) + 1.0
    again = np.zeros(len(w.hash), np.int64)
    again[1:] = w.hash[1:] == w.hash[:-1]
    # a text's number above 40 bits of a word's hash
    each = np.sort((np.repeat(np.arange(n), np.diff(w.first)).astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    new = each[np.flatnonzero(np.append(True, each[1:] != each[:-1]))] if len(each) else each
    distinct = np.bincount((new >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)
    kind = _KIND[data]
    return np.stack(
        [
            size, words, size / lines, size / np.maximum(words, 1), distinct / np.maximum(words, 1), np.log1p(distinct) / np.log(np.maximum(words, 2) + 1),
            K.sums(again, w.first) / np.maximum(words, 1), share(kind == 1), share(kind == 2), share(kind == 3), share(kind == 4), share(kind == 5),
        ],
        axis=1,
    )


#: Capitals, symbols, digits, marks between phrases, and bytes outside ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[np.frombuffer(b"#*$%&|<>!@{}[]^~=+_", np.uint8)] = 2
_KIND[48:58] = 3
_KIND[np.frombuffer(b".,;:", np.uint8)] = 4
_KIND[128:] = 5


def metadata(numbers: np.ndarray, langs: list[str | None], sources: list[str | None], edges: np.ndarray) -> np.ndarray:
    """(texts, features) of the metadata view: the bins of the numbers, and the spots of language and source."""
    out = np.zeros((len(numbers), NUMBERS + 2), np.int64)
    for k in range(NUMBERS):
        out[:, k] = np.searchsorted(edges[k], numbers[:, k], "right")
    for k, values in enumerate((langs, sources)):
        spot = {v: int(K.mix(np.array([sum((b + 1) * 257**i for i, b in enumerate(str(v or "").encode()[:24])) % (1 << 64)], np.uint64))[0] % np.uint64(SPOTS)) for v in set(values)}
        out[:, NUMBERS + k] = [spot[v] for v in values]
    return out + SPOTS * np.arange(NUMBERS + 2)


def weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-ratios of the features of either view, from (bad, good) counts of all."""
    text = counts[:, :WIDE] / WHOLE + BEFORE[0]
    meta = counts[:, WIDE:].reshape(2, NUMBERS + 2, SPOTS) + BEFORE[1]
    text, meta = np.log(text / text.sum(axis=1, keepdims=True)), np.log(meta / meta.sum(axis=2, keepdims=True))
    return text[1] - text[0], (meta[1] - meta[0]).ravel()


def calibrate(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make a view's scores log-odds (Platt's method, by Newton steps)."""
    good, bad = label.sum(), len(label) - label.sum()
    if not good or not bad:
        return 1.0, 0.0
    aim = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    middle, spread = score.mean(), max(score.std(), 1e-9)
    x = np.stack([(score - middle) / spread, np.ones(len(score))])
    w = np.array([1.0, np.log((good + 1) / (bad + 1))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        pull = x @ (p - aim) + 1e-3 * np.array([w[0], 0])
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6]), pull)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        w[0] = max(w[0], 1e-3)
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def view_odds(spot: np.ndarray, first: np.ndarray, meta: np.ndarray, model: dict) -> list[np.ndarray]:
    """Calibrated log-odds of good quality by the text view and by the metadata view."""
    total = np.zeros(len(spot) + 1)
    np.cumsum(model["text"][spot], out=total[1:])
    text = np.diff(total[first]) / (np.diff(first) + SHORT)  # few trigrams say little
    layout = model["meta"][meta].sum(axis=1)
    return [slope * x + offset for x, (slope, offset) in zip((text, layout), model["curves"], strict=True)]


def score_views(data: np.ndarray, offsets: np.ndarray, langs: list, sources: list, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of good quality by the text view, the metadata view, and both."""
    if "text" not in model:
        return (np.full(len(offsets) - 1, model["prior"]),) * 3
    odds = view_odds(*trigrams(data, offsets), metadata(layout(data, offsets), langs, sources, model["edges"]), model)
    return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*odds, (odds[0] + odds[1]) / 2))


def count_batches(batches: Iterator[pa.RecordBatch], edges: np.ndarray, model: dict | None) -> Iterator[pa.RecordBatch]:
    """(feature, bad, good) sums over (doc_id, text, lang, source, label, apart) rows: labelled ones twice
    and, with a model, unlabelled ones of which the other view is sure."""
    counts = np.zeros((2, _FEATURES), np.int64)
    for part in chunks(batches):
        label = flat(part.column(4)).fill_null(-1).to_numpy(zero_copy_only=False)
        part = part.filter(pa.array((label >= 0) if model is None else np.ones(len(label), bool))).combine_chunks()
        if not part.num_rows:
            continue
        label = flat(part.column(4)).fill_null(-1).to_numpy(zero_copy_only=False)
        apart = flat(part.column(5)).fill_null(False).to_numpy(zero_copy_only=False)
        data, offsets = K.buffers(flat(part.column(1)))
        spot, first = trigrams(data, offsets)
        meta = metadata(layout(data, offsets), part.column(2).to_pylist(), part.column(3).to_pylist(), edges)
        odds = view_odds(spot, first, meta, model) if model else [np.zeros(len(label))] * 2
        sure = np.log(SURE / (1 - SURE))
        size = np.maximum(np.diff(first), 1)
        for good in (0, 1):
            given = 2 * ((label == good) & ~apart)
            by_text, by_meta = (np.where(label < 0, x >= sure if good else x <= -sure, given) for x in odds)
            # each view learns what the other is sure of
            own = np.repeat(np.rint(WHOLE / size) * by_meta, np.diff(first))
            counts[good, :WIDE] += np.bincount(spot, own, WIDE).astype(np.int64)
            counts[good, WIDE:] += np.bincount(meta.ravel(), np.repeat(by_text, NUMBERS + 2), _FEATURES - WIDE).astype(np.int64)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["feature", "bad", "good"])


def summed(rows: DataFrame, edges: np.ndarray, model: dict | None) -> np.ndarray:
    """(bad, good) sums of all features, a table of fixed size."""
    found = rows.mapInArrow(lean(lambda it: count_batches(it, edges, model)), "feature int, bad long, good long")
    found = found.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    counts = np.zeros((2, _FEATURES), np.int64)
    at = found["feature"].to_numpy()
    counts[0, at], counts[1, at] = found["bad"].to_numpy(), found["good"].to_numpy()
    return counts


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> dict:
    """Both views' models after ``rounds`` rounds over all documents. Labels without a document, with a null or
    with two values are not used; without ten labels of both kinds the model is their mean."""
    prepare(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    given = given.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    known = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id", "label", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0).alias("apart"))
    known = F.broadcast(docs.sparkSession.createDataFrame(known.toArrow()))  # at most ``labelled`` rows of three numbers
    every = _rows(docs)
    first = settle(every.join(known, "doc_id"))
    numbers = first.mapInArrow(lean(number_batches), f"label int, apart boolean, {', '.join(f'x{k} double' for k in range(NUMBERS))}").toArrow().to_pandas()
    prior = float(numbers["label"].mean()) if len(numbers) else 1.0
    if len(numbers) < 10 or not 0 < prior < 1:
        return {"prior": prior}
    learnt = numbers[~numbers["apart"]]
    edges = np.stack([np.quantile(learnt[f"x{k}"] if len(learnt) else [0.0], np.arange(1, BINS) / BINS) for k in range(NUMBERS)])
    counts = labelled_counts = summed(first, edges, None)
    rows = every.join(known, "doc_id", "left")
    for turn in range(rounds + 1):
        text, meta = weights(counts)
        model = {"prior": prior, "text": text, "meta": meta, "edges": edges, "curves": [(1.0, 0.0)] * 2}
        scored = first.where("apart").mapInArrow(lean(lambda it, model=model: odds_batches(it, model)), "doc_id long, label int, text double, meta double").toArrow().sort_by("doc_id")
        if scored.num_rows:
            model["curves"] = [calibrate(scored[c].to_numpy(), scored["label"].to_numpy().astype(float)) for c in ("text", "meta")]
        if turn < rounds:
            counts = joined(labelled_counts, summed(rows, edges, model) - labelled_counts)
    return model


def joined(given: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Counts of labelled documents and of those labelled by the other view, of which all take part, but in
    either view and kind with no more weight than the labelled ones."""
    out = given.astype(float)
    for kind in (0, 1):
        for view in (slice(0, WIDE), slice(WIDE, None)):
            out[kind, view] += found[kind, view] * min(1.0, given[kind, view].sum() / max(found[kind, view].sum(), 1))
    return out


def number_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, apart) and the layout numbers of (doc_id, text, lang, source, label, apart) rows."""
    for part in chunks(batches):
        numbers = layout(*K.buffers(flat(part.column(1))))
        yield pa.RecordBatch.from_arrays([flat(part.column(4)), flat(part.column(5)), *map(pa.array, numbers.T.copy())], names=["label", "apart", *(f"x{k}" for k in range(NUMBERS))])


def odds_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """The views' scores of (doc_id, text, lang, source, label, apart) rows."""
    for part in chunks(batches):
        data, offsets = K.buffers(flat(part.column(1)))
        found = view_odds(*trigrams(data, offsets), metadata(layout(data, offsets), part.column(2).to_pylist(), part.column(3).to_pylist(), model["edges"]), model)
        yield pa.RecordBatch.from_arrays([flat(part.column(0)), flat(part.column(4)), *map(pa.array, found)], names=["doc_id", "label", "text", "meta"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_score, meta_score, score, kept (score >= least).

    Defined cases: a null text is empty, a null language or source a value of its own; a null doc_id
    stays; repeated rows are scored each; without usable labels every score is 1, with labels of one
    kind only their mean; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = score_views(*K.buffers(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([flat(part.column(0)), *map(pa.array, found), pa.array(found[2] >= least)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return _rows(docs).mapInArrow(score, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text = part.column(at[0]).combine_chunks().cast(pa.string()).fill_null("")
            good = score_views(*K.buffers(text), part.column(at[1]).to_pylist(), part.column(at[2]).to_pylist(), model.value)[2] >= least
            yield from part.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(keep, docs.schema)
