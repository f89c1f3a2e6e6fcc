"""Language-model scores by prediction by partial matching (PPM) over bytes.

The trie of all byte contexts up to ``ORDER`` is counted over the training documents. A byte is
predicted by the longest context that was seen; if the context has not been followed by the byte, it
escapes to the next shorter one (method D: each distinct follower gives half a count to the escape),
and bytes that the longer context has seen are excluded there. The code length of a document is the
sum over its bytes and an end symbol.

The trie grows with the corpus and is never in one place. Its grams are dealt to buckets by the last
``DEALT`` bytes of their contexts, which a context has in common with all longer ones, so a bucket has
each of its contexts whole; only the orders below that go to all executors. Blocks of documents send
each bucket their distinct grams once, get the scores back and look their bytes up in them.

The unigram base model is counted exactly: words meet in buckets as packed arrays, and each bucket
returns, for each document, its share of the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels as K
from parlance.llm.session import chunks, give_back, lean, prepare, release, settle

#: Bytes of the longest context.
ORDER = 5
#: Contexts meet by their last bytes; shorter contexts are known everywhere.
DEALT = 3
#: Bytes of text whose distinct grams are scored together.
BLOCK = 8 << 20
#: Bytes of text for each bucket of words.
SHARE = 32 << 20
U = np.uint64
_FOLD, _HELD = 7, 2
#: Bits of a text's place in a packed word; the rest are the word's hash.
_AT = 10
_ODD = 0x9E3779B97F4A7C15


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    """Whether a document is left out of training; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % _FOLD == _HELD for x in doc_ids], bool)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each text's bytes and its end, A-Z lower-cased, and where a text's begin.

    A gram is ``ORDER`` bytes of context and the byte itself; zeros come before a text, and a zero
    ends it.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    start = offsets[:-1] + np.arange(n) * (ORDER + 1) + ORDER
    wide = np.zeros(len(data) + n * (ORDER + 1), np.uint8)
    wide[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = K.LOWER[data]
    wide = np.concatenate([wide, np.zeros(8, np.uint8)])
    # eight bytes from each place on, the first one highest, of which a gram's are the first
    gram = np.ndarray(max(len(wide) - 8 - ORDER, 0), ">u8", wide, strides=(1,)).astype(U) >> U(8 * (7 - ORDER))
    first = np.concatenate([[0], np.cumsum(size + 1)])
    keep = np.arange(first[-1]) + np.repeat(np.arange(n) * ORDER, size + 1)
    return gram[keep], first


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): the grams of the training documents among (doc_id, text) rows, summed for each task."""
    keys, counts, held = np.zeros(0, U), np.zeros(0, np.int64), []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([keys, *(x for x, _ in held)])
        n = np.concatenate([counts, *(x for _, x in held)])
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        return every[at], np.add.reduceat(n, at) if len(at) else n

    for part in chunks(batches):
        train = pa.array(~held_out(part.column(0).to_pylist()))
        data, offsets = K.buffers(part.column(1).filter(train))
        if len(offsets) < 2:
            continue
        grams = np.sort(padded(data, offsets)[0])
        at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        held.append((grams[at], np.diff(np.append(at, len(grams)))))
        size += len(at)
        if size > 1 << 21:
            keys, counts = merged()
            held, size = [], 0
    keys, counts = merged()
    for i in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(counts[i : i + (1 << 16)])], names=["gram", "n"])


class Model:
    """Probabilities of a trie given as (keys, counts) of grams of 1 .. ORDER + 1 bytes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.contexts = [], []
        self.log_count, self.direct, self.numbers = [], [], []
        below = None
        for order, (keys, counts) in enumerate(levels):
            table = K.Table(keys)
            context = keys >> U(8)
            new = np.append(True, context[1:] != context[:-1])[: len(context)]  # keys are in order
            own, row = context[new], np.cumsum(new) - 1
            total = np.bincount(row, counts, len(own))
            kinds = np.bincount(row, minlength=len(own)).astype(float)
            # what the next shorter context has besides this context's followers
            if order:
                suffix = U((1 << 8 * order) - 1)
                lower = below["table"].find(keys & suffix)
                seen = np.bincount(row, np.where(lower >= 0, below["counts"][lower], 0), len(own))
                many = np.bincount(row, lower >= 0, len(own))
                short = below["contexts"].find(own & U((1 << 8 * (order - 1)) - 1))
                rest = np.where(short >= 0, below["total"][short], 0) - seen
                others = np.where(short >= 0, below["kinds"][short], 0) - many
            else:
                rest = others = np.zeros(len(own))
            with np.errstate(divide="ignore"):
                log = lambda x: np.where(x > 0, np.log10(np.maximum(x, 1e-300)), 0.0)
                numbers = np.stack([log(kinds / 2) - log(total), log(rest), np.where(others > 0, log(others / 2) - log(rest), 0.0)], 1)
            self.grams.append(table)
            self.contexts.append(K.Table(own))
            # a last row of zeros is that of what is not found
            self.log_count.append(np.append(log(counts - 0.5), 0.0))
            self.direct.append(np.append(log(counts - 0.5) - log(total)[row], 0.0))
            self.numbers.append(np.append(numbers, np.zeros((1, 3)), 0))
            below = {"table": table, "counts": np.append(counts, 0.0), "contexts": self.contexts[-1], "total": np.append(total, 0.0), "kinds": np.append(kinds, 0.0)}
        self.unseen = -np.log10(max(256 - len(levels[0][0]), 1))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        top = len(self.grams) - 1
        found = self.grams[top].find(grams)
        out = np.where(found >= 0, self.direct[top][found], 0.0)
        left = np.flatnonzero(found < 0)
        keys = grams[left]
        entered = np.zeros(len(left), bool)  # by an escape, so that bytes are excluded
        divisor, escape = np.zeros(len(left)), np.zeros(len(left))
        for order in range(top, -1, -1):
            keys = keys & U((1 << 8 * (order + 1)) - 1)
            if order < top:
                row = self.grams[order].find(keys)
                hit = row >= 0
                value = np.where(entered, self.log_count[order][row] - divisor, self.direct[order][row])
                out[left[hit]] += value[hit]
                miss = ~hit
                left, keys, entered, divisor, escape = left[miss], keys[miss], entered[miss], divisor[miss], escape[miss]
            if not len(left):
                return out
            row = self.contexts[order].find(keys >> U(8))
            known = row >= 0
            numbers = self.numbers[order][row]
            out[left] += np.where(known, np.where(entered, escape, numbers[:, 0]), 0.0)
            entered = entered | known
            divisor, escape = np.where(known, numbers[:, 1], divisor), np.where(known, numbers[:, 2], escape)
        out[left] += self.unseen
        return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """The highest order of the trie of the training documents among (doc_id, text) rows, packed by bucket (kind 5)."""
    counted = docs.mapInArrow(lean(count_batches), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return settle(counted.mapInArrow(lean(lambda it: node_batches(it, buckets)), PACKED))


def low_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): the nodes below order ``DEALT`` of packed nodes, summed for each batch."""
    for batch in batches:
        every = [unpacked_nodes(b) for b in batch.column("blob").to_pylist()]
        if every:
            keys, counts = summed(np.concatenate([x for x, _ in every]) & U((1 << 8 * DEALT) - 1), np.concatenate([n for _, n in every]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "n"])


def low_levels(nodes: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of the orders below ``DEALT``, whole: at most 2**24 nodes, however large the corpus is."""
    low = settle(nodes.mapInArrow(lean(low_batches), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))).toArrow()
    keys, counts = (low.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    return [summed(keys.view(U) & U((1 << 8 * (order + 1)) - 1), counts) for order in range(DEALT)]


def bucket_model(grams: np.ndarray, counts: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray) -> Model:
    """The model of a bucket that has all of the trie's grams in the contexts of the ``asked`` ones."""
    levels = list(low)
    if DEALT > 1:
        context = U((1 << 8 * (DEALT - 1)) - 1)
        own = np.isin(low[-1][0] >> U(8), K.distinct(np.concatenate([grams, asked]) >> U(8) & context))
        levels[-1] = low[-1][0][own], low[-1][1][own]
    return Model(levels + [summed(grams & U((1 << 8 * (order + 1)) - 1), counts) for order in range(DEALT, ORDER + 1)])


def dealt(grams: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The places of each bucket's grams, in order."""
    own = ((grams >> U(8) & U((1 << 8 * DEALT) - 1)) * U(_ODD) >> U(32)) % U(buckets)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.searchsorted(own[order], np.arange(1, buckets, dtype=U)))


def node_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(gram, n) rows by bucket (kind 5): grams in order, then byte planes of their counts."""
    for part in chunks(batches, 16 << 20):
        grams, counts = (part.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
        order = np.argsort(grams.view(U))
        grams, counts, rows = grams.view(U)[order], counts[order], []
        for k, at in enumerate(dealt(grams, buckets)):
            if len(at):
                planes = np.ascontiguousarray(counts[at].view(np.uint8).reshape(-1, 8).T).tobytes()
                own = squeezed(grams[at])
                rows.append((k, 5, len(at), len(own).to_bytes(8, "little") + own + pa.Codec("zstd", 1).compress(planes, asbytes=True)))
        yield _batch(rows)


def unpacked_nodes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    grams = spread(blob[8 : 8 + size])
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8 + size :], 8 * len(grams), asbytes=True), np.uint8).reshape(8, -1)
    return grams, np.ascontiguousarray(planes.T).view(np.int64).ravel()


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc_id, text) rows, as one row each (kind 7)."""
    task = TaskContext.get().partitionId()
    for k, part in enumerate(chunks(batches, BLOCK)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(part)
        yield _batch([(-1 - (task << 24 | k), 7, 0, sink.getvalue().to_pybytes())])


def _block(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as reader:
        return reader.read_all().combine_chunks()


def gram_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct grams of blocks by bucket (kind 6)."""
    for batch in batches:
        for key, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            grams = block_grams(_block(blob))
            yield _batch([(b, 6, -1 - key, squeezed(grams[at])) for b, at in enumerate(dealt(grams, buckets)) if len(at)])


def squeezed(grams: np.ndarray) -> bytes:
    """Grams in order, as compressed byte planes of their differences."""
    planes = np.ascontiguousarray(np.diff(grams, prepend=U(0)).view(np.uint8).reshape(-1, 8).T)
    return len(grams).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def spread(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def block_grams(part: pa.Table) -> np.ndarray:
    """The distinct grams of (doc_id, text) rows, in order."""
    found = [np.zeros(0, U)]
    for a in range(0, part.num_rows, 512):
        found.append(K.distinct(padded(*K.buffers(part.column(1).slice(a, 512).combine_chunks()))[0]))
    return K.distinct(np.concatenate(found))


def score_bucket(bucket: int, kinds: list[int], ns: list[int], blobs: list[bytes], low: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, bytes]]:
    """The scores of each block's grams in a bucket (kind 8), in the grams' order."""
    asked = [(n, spread(b)) for k, n, b in zip(kinds, ns, blobs, strict=True) if k == 6]
    if not asked:
        return []
    nodes = [unpacked_nodes(b) for k, b in zip(kinds, blobs, strict=True) if k == 5]
    grams = np.concatenate([np.zeros(0, U), *(x for x, _ in nodes)])
    counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in nodes)])
    every = K.distinct(np.concatenate([x for _, x in asked]))
    score = bucket_model(grams, counts, low, every).score(every)
    return [(-1 - block, 8, bucket, score[np.searchsorted(every, x)].tobytes()) for block, x in asked]


class Known:
    """The scores of a block's grams."""

    def __init__(self, part: pa.Table, scores: dict[int, bytes], buckets: int):
        grams = block_grams(part)
        self.table, self.scores = K.Table(grams), np.zeros(len(grams))
        for k, at in enumerate(dealt(grams, buckets)):
            if len(at):
                self.scores[at] = np.frombuffer(scores[k], float)

    def score(self, grams: np.ndarray) -> np.ndarray:
        return self.scores[self.table.find(grams)]


def score_block(kinds: list[int], ns: list[int], blobs: list[bytes], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    part = _block(blobs[kinds.index(7)])
    scores = {n: b for k, n, b in zip(kinds, ns, blobs, strict=True) if k == 8}
    return score_batches(part.to_batches(), Known(part, scores, buckets), buckets, groups)


_SCORE = np.dtype([("row", "<u8"), ("doc", "<i8"), ("null", "u1"), ("held", "u1"), ("words", "<i8"), ("score", "<f8")])
_SHARE = np.dtype([("row", "<u8"), ("known", "<i4"), ("log", "<f8")])
PACKED = "bucket long, kind int, n long, blob binary"


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "n", "blob"])


def score_batches(batches: Iterable[pa.RecordBatch], model: Model | Known, buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Packed words of (doc_id, text) rows by bucket (kind 0), and PPM scores by group (kind 1)."""
    for big in chunks(batches, 1 << 21):
        for at in range(0, big.num_rows, 1 << _AT):
            part = big.slice(at, 1 << _AT).combine_chunks()
            ids = part.column(0).to_pylist()
            data, offsets = K.buffers(part.column(1))
            w = K.words(data, offsets)
            words = np.diff(w.first)
            doc = np.array([-1 if x is None else x for x in ids], np.int64)
            row = K.mix(K.span_hash(data, offsets[:-1], offsets[1:]) + doc.view(U) * U(K._STEP))
            held = held_out(ids)
            grams, first = padded(data, offsets)
            rows = np.zeros(len(ids), _SCORE)
            rows["row"], rows["doc"], rows["null"], rows["held"], rows["words"] = row, doc, [x is None for x in ids], held, words
            for a in range(0, len(ids), 64):  # keeps the arrays of long texts apart
                b = min(a + 64, len(ids))
                rows["score"][a:b] = np.add.reduceat(model.score(grams[first[a] : first[b]]), first[a:b] - first[a])
            out, own = [], (row % U(groups)).astype(np.int64)
            for g in K.distinct(own):
                mine = rows[own == g]
                out.append((-1 - int(g), 1, len(mine), mine.tobytes()))
            packed = np.sort((w.hash >> U(_AT) << U(_AT)) | np.repeat(np.arange(len(ids)), words).astype(U))
            here = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, np.int64)
            pairs, n = packed[here], np.diff(np.append(here, len(packed)))
            word = pairs >> U(_AT)
            cut = np.searchsorted(word, [-(-k * (1 << 64 - _AT) // buckets) for k in range(buckets)] if buckets > 1 else [0])
            for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(pairs)], strict=True)):
                if a < b:
                    new = np.append(True, word[a + 1 : b] != word[a : b - 1])
                    place = (pairs[a:b] & U((1 << _AT) - 1)).astype(np.int64)
                    there = K.distinct(place)  # a bucket gets only the texts that have words in it
                    out.append((k, 0, int(b - a), _pack(row[there], held[there], word[a:b][new], new, np.searchsorted(there, place), n[a:b])))
            yield _batch(out)


def _pack(row: np.ndarray, held: np.ndarray, own: np.ndarray, new: np.ndarray, place: np.ndarray, n: np.ndarray) -> bytes:
    """Texts, distinct words, and pairs of words and texts: whether one begins the next word, its text and count."""
    small = np.minimum(n, 255).astype(np.uint8)
    planes = row.tobytes() + held.tobytes() + own.tobytes() + new.tobytes() + place.astype("<u2").tobytes() + small.tobytes() + n[n >= 255].astype("<i4").tobytes()
    return len(row).to_bytes(4, "little") + len(own).to_bytes(4, "little") + len(planes).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpack(blob: bytes, pairs: int) -> tuple[np.ndarray, ...]:
    """Texts' rows and held-out flags, then word, place and count of each pair."""
    size, own, whole = (int.from_bytes(blob[k : k + 4], "little") for k in (0, 4, 8))
    planes, at, out = pa.Codec("zstd").decompress(blob[12:], whole, asbytes=True), 0, []
    for kind, count in ((U, size), (np.bool_, size), (U, own), (np.bool_, pairs), ("<u2", pairs), (np.uint8, pairs)):
        out.append(np.frombuffer(planes, kind, count, at))
        at += out[-1].nbytes
    row, held, word, new, place, small = out
    n = small.astype(np.int64)
    n[small == 255] = np.frombuffer(planes, "<i4", offset=at)
    return row, held, word[np.cumsum(new) - 1], place.astype(np.int64), n


def count_bucket(bucket: int, blobs: list[bytes], sizes: list[int], groups: int) -> list[tuple[int, int, int, bytes]]:
    """Counts a bucket's words; each document's share of the base score by group (kind 2), and the
    bucket's training tokens (kind 3) and distinct training words (kind 4)."""
    parts = [_unpack(b, pairs) for b, pairs in zip(blobs, sizes, strict=True)]
    word = np.concatenate([p[2] for p in parts])
    count = np.concatenate([np.where(p[1][p[3]], 0, p[4]) for p in parts]).astype(np.int64)
    order = np.argsort(word)
    at = np.flatnonzero(np.append(True, word[order][1:] != word[order][:-1]))
    total = np.add.reduceat(count[order], at)
    every = np.empty(len(word), np.int64)
    every[order] = np.repeat(total, np.diff(np.append(at, len(word))))
    log, known = np.log10(every + 1.0), every > 0
    out, start = [(0, 3, int(total.sum()), b""), (0, 4, int((total > 0).sum()), b"")], 0
    for row, _, own, place, n in parts:
        end = start + len(own)
        share = np.zeros(len(row), _SHARE)
        share["row"] = row
        share["log"] = np.bincount(place, n * log[start:end], len(row))
        share["known"] = np.bincount(place, n * known[start:end], len(row))
        start = end
        group = (row % U(groups)).astype(np.int64)
        for g in K.distinct(group):
            mine = share[group == g]
            out.append((-1 - int(g), 2, len(mine), mine.tobytes()))
    return out


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finish_group(kinds: list[int], blobs: list[bytes], tokens: int, distinct: int, train_docs: int) -> pa.Table:
    """The result rows of a group of documents. Equal rows share what was summed for them."""
    scores = np.concatenate([np.zeros(0, _SCORE), *(np.frombuffer(b, _SCORE) for k, b in zip(kinds, blobs, strict=True) if k == 1)])
    shares = np.concatenate([np.zeros(0, _SHARE), *(np.frombuffer(b, _SHARE) for k, b in zip(kinds, blobs, strict=True) if k == 2)])
    row, inverse, copies = np.unique(scores["row"], return_inverse=True, return_counts=True)
    at = np.searchsorted(row, shares["row"])
    log = (np.bincount(at, shares["log"], len(row)) / copies)[inverse]
    known = np.rint(np.bincount(at, shares["known"], len(row)) / copies).astype(np.int64)[inverse]
    n = scores["words"] + 1
    base = log + np.log10(train_docs + 1) - n * np.log10(tokens + distinct + 1)
    columns = [pa.array(scores["doc"], mask=scores["null"] > 0), pa.array(scores["held"] > 0), pa.array(n), pa.array(known + (train_docs > 0)), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(scores["score"])]
    return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    and score, the log10 probability of its text and end under the PPM model.

    Both models learn from the documents whose crc32(doc_id as text) mod 7 isn't 2. Defined cases: a
    null text is empty and has its end only; a null doc_id counts as empty text for the remainder;
    repeated rows are scored, and learnt from, each; an empty table gives no rows; with no training
    documents all bytes have probability 1/256; a NUL byte in a text is the same symbol as a text's end;
    other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = groups = max(12, -(-total // SHARE))
    nodes = count_grams(rows, buckets)
    low = spark.sparkContext.broadcast(low_levels(nodes))
    release(spark)

    def bucket_scored(key: tuple, t: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_batch(score_bucket(key[0].as_py(), *(t.column(c).to_pylist() for c in ("kind", "n", "blob")), low.value))])
        give_back()
        return out

    def block_scored(t: pa.Table) -> pa.Table:
        out = list(score_block(*(t.column(c).to_pylist() for c in ("kind", "n", "blob")), buckets, groups))
        give_back()
        return pa.Table.from_batches(out or [_batch([])])

    def counted(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return t.select(["bucket", "kind", "n", "blob"])
        return pa.Table.from_batches([_batch(count_bucket(key[0].as_py(), t.column("blob").to_pylist(), t.column("n").to_pylist(), groups))])

    # settled, as a block is what one run of its task has read
    blocks = settle(rows.mapInArrow(lean(block_batches), PACKED))
    asked = blocks.mapInArrow(lean(lambda it: gram_batches(it, buckets)), PACKED)
    scores = asked.unionByName(nodes).groupBy("bucket").applyInArrow(bucket_scored, PACKED)
    scored = blocks.unionByName(scores).groupBy("bucket").applyInArrow(block_scored, PACKED)
    shares = settle(scored.groupBy("bucket").applyInArrow(counted, PACKED))
    release(spark)
    sums = {r["kind"]: r["n"] for r in shares.where("kind > 2").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(_FOLD)) == _HELD
    ends = rows.where(~held).count()
    tokens, distinct = sums.get(3, 0) + ends, sums.get(4, 0) + (ends > 0)
    return shares.where("kind < 3").groupBy("bucket").applyInArrow(lambda t: finish_group(t.column("kind").to_pylist(), t.column("blob").to_pylist(), tokens, distinct, ends), OUT)
