"""Removal of passages that an earlier document holds, by bucket-pointer refinement.

Suffixes are put in buckets by their first ``GRAM`` bytes, and buckets are refined by sorting on the
bucket pointers of later (and earlier) offsets until windows of ``LEAST`` bytes are told apart.

A corpus has too many suffixes to shuffle them all, so the first level keeps a sample that is enough:
in each window of ``LEAST`` bytes the ``GRAM``-byte suffix that is least in a fixed order of grams.
The order depends on the window's bytes only, so equal windows have the same sampled suffix at the
same place. Grams that many documents hold come last in it: a common phrase is sampled only where a
window has nothing else, so its bucket doesn't grow with the corpus.

1. Every block of texts sends its sampled suffixes, with the pointer of their whole surroundings (all
   bytes of all their windows), to the bucket of the suffix; of those with equal surroundings only the
   one of the smallest doc_id, the windows of the others go at once.
2. A bucket sorts them. If surroundings are also in an earlier document, all windows of the suffix
   go. If a bucket has several surroundings, their first holders have to be refined further.
3. Only those send the bytes of their windows to the bucket, which is refined there on the bytes:
   ``window_pointers`` starts from 8-byte buckets and sorts each bucket that isn't down to one suffix
   on the pointers 8, 16 and 18 bytes on, updated pointers serving the next round.
4. The documents meet what was found in them and are cut.

Step 3 compares bytes. In step 2 two surroundings are the same if 64 bits of their pointer, and 40 and
the number of the bucket of their suffix's agree: 104 bits and more.

Buckets travel as packed arrays, a few rows for each task, and hold about ``SHARE`` bytes of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels as K
from parlance.llm.session import chunks, flat, give_back, lean, prepare, release, settle

#: Bytes of the shortest passage that is removed.
LEAST = 50
#: Bytes of a sampled suffix's bucket.
GRAM = 20
_GRAMS = LEAST - GRAM + 1
#: Bytes of text for each bucket.
SHARE = 16 << 20
U = np.uint64
#: Grams in more than one of so many sampled suffixes come last in the order; at most as many go to all executors.
HOT = 1 << 13
_FOUND = np.dtype([("doc", "<i8"), ("h", "<u8"), ("around", "<u8"), ("first", "u1")])
_SPAN = np.dtype([("row", "<u8"), ("start", "<u4"), ("end", "<u4")])
PACKED = "kind int, bucket long, blob binary"


def refine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pointers for two neighbouring stretches from the pointers of each."""
    x = left * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x += right
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def gram_pointers(data: np.ndarray) -> np.ndarray:
    """For each byte the pointer of the ``GRAM`` bytes from it on (shorter at the end of the data)."""
    wide = np.zeros(len(data) + 2 * LEAST, np.uint8)
    wide[: len(data)] = data
    p4 = np.ndarray(len(wide) - 3, "<u4", wide, strides=(1,)).astype(U)  # overlapping, so not aligned
    p8 = p4[:-4] * U(0x9E3779B97F4A7C15)
    p8 += p4[4:]
    p16 = p8[:-8] * U(0xC2B2AE3D27D4EB4F)
    p16 += p8[8:]
    out = p16[: len(data)]
    out *= U(0xA0761D6478BD642F)
    out += p4[16 : 16 + len(data)]
    out ^= out >> U(32)
    out *= U(0xD6E8FEB86659FD93)
    out ^= out >> U(29)
    return out


def _sliding(x: np.ndarray, size: int, best: Callable) -> np.ndarray:
    """best of x[i] .. x[i + size - 1]."""
    have, out = 1, x
    while have * 2 <= size:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(x) - size + 1], out[size - have :][: len(x) - size + 1]) if have < size else out


class Last:
    """The grams that come last in the order of grams."""

    def __init__(self, pointers: np.ndarray):
        self.pointers = np.sort(pointers)
        self.perhaps = np.zeros(1 << 20, bool)
        self.perhaps[self._at(self.pointers)] = True

    @staticmethod
    def _at(pointers: np.ndarray) -> np.ndarray:
        return (pointers >> U(44)).view(np.int64)

    def find(self, pointers: np.ndarray) -> np.ndarray:
        """The places of such grams."""
        at = np.flatnonzero(self.perhaps[self._at(pointers)])
        return at[np.isin(pointers[at], self.pointers)]


class Samples:
    """The sampled suffixes of a batch of texts: place, text, and first and last window of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, last: "Last | None" = None):
        self.data, self.offsets = data, offsets
        n = len(data)
        empty = np.zeros(0, np.int64)
        self.place = self.text = self.low = self.high = empty
        self.pointer = None
        if n < LEAST or (np.diff(offsets) < LEAST).all():
            return
        size = np.diff(offsets)
        self.pointer = gram_pointers(data)
        order = self.pointer >> U(1) | U(1)
        if last is not None:
            order[last.find(self.pointer)] |= U(1 << 63)
        least = _sliding(order, _GRAMS, np.minimum)[: n - LEAST + 1]
        edge = np.zeros(n + 1, np.int8)
        long = size >= LEAST
        np.add.at(edge, offsets[:-1][long], 1)
        np.add.at(edge, offsets[1:][long] - LEAST + 1, -1)
        valid = np.cumsum(edge[: len(least)]) > 0
        start = np.zeros(len(least), bool)
        start[0] = True
        start[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        inner = offsets[:-1][offsets[:-1] < len(least)]
        start[inner] = True
        run = np.flatnonzero(start)
        run_end = np.append(run[1:], len(least)) - 1
        run_value, run_valid = least[run], valid[run]
        # a place is sampled if it is the least of one of the windows that hold it
        padded = np.zeros(n + _GRAMS - 1, U)
        padded[_GRAMS - 1 : _GRAMS - 1 + len(least)] = np.where(valid, least, U(0))
        sampled = np.flatnonzero(_sliding(padded, _GRAMS, np.maximum)[:n] == order)
        # find the run of windows that it belongs to
        k = np.searchsorted(run, np.maximum(sampled - _GRAMS + 1, 0), "right") - 1
        value, open_ = order[sampled], np.arange(len(sampled))
        lost = np.zeros(len(sampled), bool)
        while len(open_):
            at = k[open_]
            bad = ~(run_valid[at] & (run_value[at] == value[open_]))
            open_ = open_[bad]
            k[open_] += 1
            over = (k[open_] >= len(run)) | (run[np.minimum(k[open_], len(run) - 1)] > sampled[open_])
            lost[open_[over]] = True
            k[open_[over]] = 0
            open_ = open_[~over]
        sampled, k = sampled[~lost], k[~lost]
        before = np.full(len(sampled), -1)
        same = k[1:] == k[:-1]
        before[1:][same] = sampled[:-1][same]
        low = np.maximum(np.maximum(run[k], before + 1), sampled - _GRAMS + 1)
        high = np.minimum(run_end[k], sampled)
        some = low <= high
        self.place, self.low, self.high = sampled[some], low[some], high[some]
        self.text = np.searchsorted(offsets, self.place, "right") - 1

    def bucket(self) -> np.ndarray:
        return self.pointer[self.place]

    def named(self, buckets: int) -> np.ndarray:
        """The part of the pointers that comes back from their buckets."""
        h = self.bucket()
        return ((h // U(buckets) & U((1 << 40) - 1)) * U(buckets) + h % U(buckets)) & U((1 << 40) - 1)

    def around(self) -> np.ndarray:
        """The pointer of all bytes of all windows that may hold the suffix, cut at the text's ends."""
        span = LEAST - GRAM
        start, end = self.offsets[self.text], self.offsets[self.text + 1]
        left, right = np.minimum(self.place - start, span), np.minimum(end - self.place, LEAST)
        first, last = self.place - left, self.place + right  # the stretch, of GRAM bytes at least
        p = self.pointer
        out = refine(p[first], p[last - GRAM])
        for step in (10, 30, 50):  # pointers of later offsets that lie inside
            at = np.minimum(first + step, last - GRAM)
            out = refine(out, p[at])
        return refine(out, (left * 64 + right).astype(U))


def _keys(doc: np.ndarray, h: np.ndarray, around: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.mix(doc.astype(np.int64).view(U) + around * U(K._STEP)))


def _ids(part: pa.Table) -> np.ndarray:
    return flat(part.column("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    """The groups of documents: pmod(xxhash64(doc_id), groups), as Spark has it."""
    x = ids.astype(np.int64).view(U)
    turn = lambda v, n: (v << U(n)) | (v >> U(64 - n))
    one, two, three, four, five = (U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (U(42) + five + U(8)) ^ (turn(x * two, 31) * one)
    h = turn(h, 27) * one + four
    h ^= h >> U(33)
    h *= two
    h ^= h >> U(29)
    h *= three
    h ^= h >> U(32)
    return h.view(np.int64) % groups


def _row_keys(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Tells rows apart that share a doc_id, but not a text."""
    return K.mix(K.span_hash(data, offsets[:-1], offsets[1:]) + ids.view(U) * U(K._STEP))


def _pack(kind: int, buckets: np.ndarray, rows: np.ndarray, head: bytes = b"") -> Iterator[tuple[int, int, bytes]]:
    """One blob for each bucket: the length of a head, the head, and the bucket's rows."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    buckets, rows = buckets[order], rows[order]
    cut = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    for a, b in zip(cut, [*cut[1:], len(buckets)], strict=True):
        yield kind, int(buckets[a]), len(head).to_bytes(8, "little") + head + rows[a:b].tobytes()


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], names=["kind", "bucket", "blob"])


def _unpack(blobs: list[bytes], dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for blob in blobs:
        size = int.from_bytes(blob[:8], "little")
        yield np.frombuffer(blob, np.int64, size // 8, 8), np.frombuffer(blob, dtype, offset=8 + size)


def _low5(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5]


def pack_suffixes(h: np.ndarray, around: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """One blob for each bucket: its doc_ids, and 15 bytes for each suffix.

    A bucket is told by the remainder of the pointer, so 40 bits of the quotient are kept: pointers
    that agree in those share a bucket, which their surroundings tell apart.
    """
    bucket, quotient = (h % U(buckets)).astype(np.int64), h // U(buckets)
    order = np.lexsort((ids, bucket))
    bucket, quotient, around, ids = bucket[order], quotient[order], around[order], ids[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        new = np.append(True, ids[a + 1 : b] != ids[a : b - 1])
        own = ids[a:b][new]
        at = (np.cumsum(new) - 1).astype(np.uint16)
        yield 0, int(bucket[a]), len(own).to_bytes(8, "little") + own.tobytes() + _low5(quotient[a:b]).tobytes() + around[a:b].tobytes() + at.tobytes()


def unpack_suffixes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotients, surroundings and doc_ids of a bucket's suffixes."""
    out = []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        ids, at = np.frombuffer(blob, np.int64, n, 8), 8 + 8 * n
        size = (len(blob) - at) // 15
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * size, at).reshape(-1, 5)
        around = np.frombuffer(blob, U, size, at + 5 * size)
        out.append((wide.view(U).ravel(), around, ids[np.frombuffer(blob, np.uint16, size, at + 13 * size)]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_STRETCH = np.dtype([("doc", "<i8"), ("row", "<u8"), ("gram", "<u8"), ("start", "<u4"), ("windows", "u1")])
#: Bytes of stretches that are refined together; more only where they have one gram in common.
REFINED = 1 << 19


def pack_windows(s: Samples, pick: np.ndarray, ids: np.ndarray, row: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """One blob for each bucket of suffixes: the picked ones' documents, windows, and the windows' bytes."""
    if not len(pick):
        return
    pick = pick[np.argsort(s.bucket()[pick] % U(buckets), kind="stable")]
    bucket = (s.bucket()[pick] % U(buckets)).astype(np.int64)
    rows = np.zeros(len(pick), _STRETCH)
    text = s.text[pick]
    rows["gram"] = s.bucket()[pick]
    rows["doc"], rows["row"], rows["start"], rows["windows"] = ids[text], row[text], s.low[pick] - s.offsets[text], s.high[pick] - s.low[pick] + 1
    size = rows["windows"].astype(np.int64) + LEAST - 1
    ends = np.cumsum(size)
    raw = s.data[np.arange(ends[-1]) + np.repeat(s.low[pick] - (ends - size), size)].tobytes()
    first = np.append(0, ends)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(cut, [*cut[1:], len(pick)], strict=True):
        yield 2, int(bucket[a]), int(b - a).to_bytes(8, "little") + rows[a:b].tobytes() + raw[first[a] : first[b]]


def unpack_windows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a bucket, and their bytes one after the other."""
    rows, data = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        rows.append(np.frombuffer(blob, _STRETCH, n, 8))
        data.append(np.frombuffer(blob, np.uint8, offset=8 + n * _STRETCH.itemsize))
    return np.concatenate(rows), np.concatenate(data)


def window_pointers(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each byte of stretches of the given sizes, the bucket of its suffix by ``LEAST`` bytes; -1
    where the stretch has fewer left.

    A pointer is the place of a bucket's first suffix in the order of all. Buckets of one suffix are
    done; the others are sorted on the pointers further on, which are as deep as their own.
    """
    ends = np.repeat(np.cumsum(size), size)
    left = ends - np.arange(len(data))
    depth = 8
    wide = np.concatenate([data, np.zeros(depth, np.uint8)])
    grams = np.ndarray(len(data), ">u8", wide, strides=(1,)).astype(U)
    grams[left < depth] = 0
    order = np.argsort(grams)
    ordered = grams[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    pointer = np.empty(len(data), np.int64)
    pointer[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    pointer[left < depth] = -1
    for step in (8, 16, LEAST - 32):
        depth += step
        some = np.flatnonzero(left >= depth)
        held = np.bincount(pointer[some], minlength=len(data))
        some = some[held[pointer[some]] > 1]
        # both pointers as one number
        pair = pointer[some] << 32 | pointer[some + step]
        order = np.argsort(pair)
        some, pair = some[order], pair[order]
        own, later = pair >> 32, pair & 0xFFFFFFFF
        bucket = np.append(True, own[1:] != own[:-1])
        new = bucket | np.append(True, later[1:] != later[:-1])
        at = np.arange(len(some))
        updated = own + at[new][np.cumsum(new) - 1] - at[bucket][np.cumsum(bucket) - 1] if len(some) else own
        pointer[some] = updated
        pointer[left < depth] = -1
    return pointer


def _small(part: pa.Table) -> Iterator[pa.Table]:
    for i in range(0, part.num_rows, 1 << 15):
        yield part.slice(i, 1 << 15)


def _samples(part: pa.Table, last: Last | None) -> tuple[Samples, np.ndarray]:
    """The sampled suffixes of the rows with a doc_id, and those rows' doc_ids."""
    part = part.filter(flat(part.column("doc_id")).is_valid())
    return Samples(*K.buffers(flat(part.column("text"))), last), _ids(part)


def common_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): sampled grams that blocks hold often, and for null the sum of all; gram -1 has the bytes."""
    for big in chunks(batches, 1 << 21):
        s, _ = _samples(big, None)
        grams, n, size = np.zeros(0, U), np.zeros(0, np.int64), len(s.place)
        if size:
            every = np.sort(s.bucket())
            at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            grams, n = every[at], np.diff(np.append(at, size))
        own = n >= max(4, size // HOT)
        columns = [pa.array([*grams[own].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[own].tolist(), size], pa.int64()), pa.array([0] * int(own.sum()) + [len(s.data)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["gram", "n", "bytes"])


def suffix_batches(batches: Iterator[pa.RecordBatch], buckets: int, groups: int, last: Last | None) -> Iterator[pa.RecordBatch]:
    """Step 1: the sampled suffixes of (doc_id, text) rows, by bucket; spans that a block's own texts repeat, by group."""
    for big in chunks(batches, 1 << 21):
        for part in _small(big):
            s, ids = _samples(part, last)
            if not len(s.place):
                continue
            h, around, doc = s.bucket(), s.around(), ids[s.text]
            # by suffix and surroundings, of which 48 bits sort, then by document; a block has under 2**16
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids)] = np.arange(len(ids))
            order = np.argsort(K.mix(h ^ K.mix(around)) & ~U(0xFFFF) | rank[s.text].view(U))
            ordered, others = h[order], around[order]
            new = np.append(True, (ordered[1:] != ordered[:-1]) | (others[1:] != others[:-1]))
            first = order[new]
            earliest = np.empty(len(doc), np.int64)
            earliest[order] = doc[first][np.cumsum(new) - 1]
            again = np.flatnonzero(doc > earliest)
            out = list(pack_suffixes(h[first], around[first], doc[first], buckets))
            if len(again):
                row = _row_keys(s.data, s.offsets, ids)
                out += [(kind, -1 - group, blob) for kind, group, blob in pack_spans(s, again, ids, row, groups)]
            yield _batch(out)


def pack_spans(s: Samples, pick: np.ndarray, ids: np.ndarray, row: np.ndarray, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """All windows of the picked suffixes as maximal spans, by group of documents."""
    text = s.text[pick]
    rows = np.zeros(len(pick), _SPAN)
    rows["row"], rows["start"], rows["end"] = row[text], s.low[pick] - s.offsets[text], s.high[pick] + LEAST - s.offsets[text]
    rows = _merged(rows)
    order = np.argsort(row, kind="stable")
    doc = ids[order[np.searchsorted(row[order], rows["row"])]]
    yield from _pack(3, _group(doc, groups), rows)


def refine_bucket(blobs: list[bytes], bucket: int, buckets: int, groups: int) -> list[tuple[int, int, bytes]]:
    """Step 2: sorts a bucket; what is repeated, or has to be refined further, for each group of documents."""
    h, around, doc = unpack_suffixes(blobs)
    # only suffixes that two documents hold
    order = np.argsort(h)
    h, around, doc = h[order], around[order], doc[order]
    new = np.append(True, h[1:] != h[:-1])
    at = np.flatnonzero(new)
    spread = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
    keep = np.repeat(spread, np.diff(np.append(at, len(h))))
    h, around, doc = h[keep], around[keep], doc[keep]
    if not len(h):
        return []
    order = np.lexsort((doc, around, h))
    h, around, doc = h[order], around[order], doc[order]
    group = np.append(True, h[1:] != h[:-1])
    kind = group | np.append(True, around[1:] != around[:-1])
    kinds = np.add.reduceat(kind.astype(np.int64), np.flatnonzero(group))
    several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(group), len(h))))
    earliest = np.repeat(doc[kind], np.diff(np.append(np.flatnonzero(kind), len(h))))
    first = doc == earliest
    rows = np.zeros(len(h), _FOUND)
    rows["doc"], rows["around"], rows["first"] = doc, around, first
    rows["h"] = (h * U(buckets) + U(bucket)) & U((1 << 40) - 1)
    rows = rows[~first | several]
    return list(_pack(1, _group(rows["doc"], groups), rows))


def refine_windows(blobs: list[bytes], groups: int) -> list[tuple[int, int, bytes]]:
    """Step 3: windows that an earlier document holds, for each group of documents.

    Equal windows have the same sampled gram, so stretches are refined a few grams at a time.
    """
    rows, data = unpack_windows(blobs)
    size = rows["windows"].astype(np.int64) + LEAST - 1
    first = np.cumsum(size) - size
    order = np.argsort(rows["gram"], kind="stable")
    gram, so_far = rows["gram"][order], np.cumsum(size[order])
    heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    # a batch begins with the first gram that begins in its part of the bytes
    part = (so_far[heads] - size[order][heads]) // REFINED
    cut = heads[np.append(True, part[1:] != part[:-1])]
    found = []
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        pick = order[a:b]
        n = size[pick]
        begin = np.cumsum(n) - n
        pointer = window_pointers(data[np.arange(n.sum()) + np.repeat(first[pick] - begin, n)], n)
        at = np.flatnonzero(pointer >= 0)
        own = np.repeat(np.arange(len(pick)), n)[at]
        doc = rows["doc"][pick][own]
        earliest = np.full(len(pointer), np.iinfo(np.int64).max)
        np.minimum.at(earliest, pointer[at], doc)
        gone = np.flatnonzero(doc > earliest[pointer[at]])
        own = own[gone]
        start = rows["start"][pick][own] + at[gone] - begin[own]
        spans = np.zeros(len(gone), _SPAN)
        spans["row"], spans["start"], spans["end"] = rows["row"][pick][own], start, start + LEAST
        found.append(_merged(spans))
    spans = _merged(np.concatenate([np.zeros(0, _SPAN), *found]))
    by_row = np.argsort(rows["row"], kind="stable")
    doc = rows["doc"][by_row[np.searchsorted(rows["row"][by_row], spans["row"])]] if len(spans) else np.zeros(0, np.int64)
    return list(_pack(3, _group(doc, groups), spans))


def _merged(spans: np.ndarray) -> np.ndarray:
    row, start, end = merged_spans(spans)
    out = np.zeros(len(row), _SPAN)
    out["row"], out["start"], out["end"] = row, start, end
    return out


def mark_group(docs: pa.Table, found: list[bytes], buckets: int, groups: int, last: Last | None) -> list[tuple[int, int, bytes]]:
    """Between 2 and 3: spans of documents that are known to go, and windows to refine, by suffix."""
    have = np.concatenate([rows for _, rows in _unpack(found, _FOUND)]) if found else np.zeros(0, _FOUND)
    keys = _keys(have["doc"], have["h"], have["around"])
    order = np.argsort(keys)
    keys, first = keys[order], have["first"][order]
    out = []
    if not len(keys):
        return out
    docs = docs.filter(pc.is_in(docs["doc_id"], pa.array(K.distinct(have["doc"]))))
    for big in chunks(docs.to_batches(), 1 << 21):
        for part in _small(big):
            s, ids = _samples(part, last)
            if not len(s.place):
                continue
            own = _keys(ids[s.text], s.named(buckets), s.around())
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            row = _row_keys(s.data, s.offsets, ids)
            out += [(kind, -1 - group, blob) for kind, group, blob in pack_spans(s, np.flatnonzero(hit & (first[at] == 0)), ids, row, groups)]
            out += pack_windows(s, np.flatnonzero(hit & (first[at] == 1)), ids, row, buckets)
    return out


def merged_spans(have: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of maximal runs, sorted."""
    have = have[np.lexsort((have["start"], have["row"]))]
    row, start, end = have["row"], have["start"].astype(np.int64), have["end"].astype(np.int64)
    if not len(row):
        return row, start, end
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    number = np.cumsum(np.append(True, row[1:] != row[:-1])) * (1 << 33)
    reach = np.maximum.accumulate(end + number)  # a later row's numbers are above all of an earlier row's
    new = np.append(True, start[1:] + number[1:] > reach[:-1])
    new[edge] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(row)) - 1
    return row[at], start[at], reach[ends] - number[ends]


def cut_group(docs: pa.Table, found: list[bytes], text: bool) -> pa.Table:
    """Step 4: adds to each row n_bytes, n_removed, n_spans, and kept_sha256 or the text that is left."""
    row, start, end = merged_spans(np.concatenate([np.zeros(0, _SPAN), *(rows for _, rows in _unpack(found, _SPAN))]))
    made: list[tuple[int, int, int, str]] = []
    for big in chunks(docs.select(["doc_id", "text"]).to_batches()):
        data, offsets = K.buffers(flat(big.column("text")))
        known = flat(big.column("doc_id")).is_valid().to_numpy(zero_copy_only=False)
        keys = _row_keys(data, offsets, flat(big.column("doc_id")).fill_null(0).to_numpy().astype(np.int64))
        a, b = np.searchsorted(row, keys, "left"), np.searchsorted(row, keys, "right")
        for i in range(len(keys)):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            parts, at = [], 0
            own = slice(a[i], b[i] if known[i] else a[i])
            for x, y in zip(start[own], end[own], strict=True):
                parts.append(raw[at:x])
                at = y
            parts.append(raw[at:])
            kept = b"".join(parts)
            made.append((len(raw), len(raw) - len(kept), len(start[own]), kept.decode("utf-8", "ignore") if text else hashlib.sha256(kept).hexdigest()))
    n, removed, spans, last = zip(*made, strict=True) if made else ((),) * 4
    out = docs
    for name, values, kind in (("n_bytes", n, pa.int64()), ("n_removed", removed, pa.int64()), ("n_spans", spans, pa.int64())):
        out = out.append_column(name, pa.array(values, kind))
    if not text:
        return out.drop_columns(["text", "grp"]).append_column("kept_sha256", pa.array(last, pa.string()))
    return out.drop_columns(["grp"]).set_column(out.schema.get_field_index("text"), "text", pa.array(last, pa.string()))


def remove_repeats(docs: DataFrame, text: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text and any other columns): doc_id, n_bytes, n_removed,
    n_spans and kept_sha256; or, with ``text``, all its columns with the text that is left, n_bytes,
    n_removed and n_spans.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id;
    strings are judged on the input. Where a cut leaves part of a character, the part goes, too, in
    ``text``. Defined cases: a null text is empty; texts under 50 bytes stay; a row without a doc_id
    stays as it is and cuts nothing; rows that share a doc_id don't repeat each other; an empty table
    gives no rows.
    """
    spark = prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if text else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(f"own {c}") for c in rest))
    pairs = rows.select("doc_id", "text")
    grams = pairs.mapInArrow(lean(common_batches), "gram long, n long, bytes long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    grams = settle(grams)
    whole = grams.where("gram IS NULL").first()
    total, least = (whole["bytes"], max(64, whole["n"] // HOT)) if whole else (0, 64)
    # each is held by one in HOT suffixes at least, so there are at most HOT
    common = np.array([r["gram"] for r in grams.where((F.col("gram").isNotNull()) & (F.col("n") > least)).orderBy(F.desc("n")).limit(HOT).collect()], np.int64).view(U)
    lasts = spark.sparkContext.broadcast(Last(common)) if len(common) else None
    last = lambda: lasts.value if lasts is not None else None
    buckets = groups = max(12, -(-total // SHARE))
    # the group of a document; the same as in _group
    grouped = rows.withColumn("grp", F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(groups)))
    narrow = grouped.select("grp", "doc_id", "text")

    def blobs(group: pa.Table) -> list[bytes]:
        return group.column("blob").to_pylist()

    def table(made: list) -> pa.Table:
        out = pa.Table.from_batches([_batch(made)])
        give_back()
        return out

    def sorted_bucket(key: tuple, t: pa.Table) -> pa.Table:
        """Suffixes become decisions; spans pass, under the negative numbers of their groups."""
        bucket = key[0].as_py()
        return table([(3, bucket, b) for b in blobs(t)] if bucket < 0 else refine_bucket(blobs(t), bucket, buckets, groups))

    suffixes = pairs.mapInArrow(lean(lambda it: suffix_batches(it, buckets, groups, last())), PACKED)
    found = settle(suffixes.groupBy("bucket").applyInArrow(sorted_bucket, PACKED))
    release(spark)
    marked = narrow.groupBy("grp").cogroup(found.where("kind = 1").groupBy("bucket")).applyInArrow(lambda d, f: table(mark_group(d, blobs(f), buckets, groups, last())), PACKED)

    def refined(key: tuple, t: pa.Table) -> pa.Table:
        """Windows become spans; spans pass, under the numbers of their groups."""
        bucket = key[0].as_py()
        return table([(3, -1 - bucket, b) for b in blobs(t)] if bucket < 0 else refine_windows(blobs(t), groups))

    spans = settle(marked.unionByName(found.where("kind = 3")).groupBy("bucket").applyInArrow(refined, PACKED))
    release(spark)
    counts = "n_bytes long, n_removed long, n_spans long"
    if not text:
        return narrow.groupBy("grp").cogroup(spans.groupBy("bucket")).applyInArrow(lambda d, f: cut_group(d, blobs(f), False), f"doc_id long, {counts}, kept_sha256 string")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    done = grouped.groupBy("grp").cogroup(spans.groupBy("bucket")).applyInArrow(lambda d, f: cut_group(d, blobs(f), True), f"{schema}, {counts}")
    kept = [F.col("doc_id") if c == "doc_id" else F.col("text") if c == "text" else F.col(f"`own {c}`").alias(c) for c in docs.columns]
    return done.select(*kept, *(F.col(c) for c in ("n_bytes", "n_removed", "n_spans") if c not in docs.columns))
