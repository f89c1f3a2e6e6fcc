"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Four machines are compiled once, on the driver, from a model, to arrays:

* the normaliser: a mark before a text, and the word mark for each space;
* the pieces: a trie over characters whose accepting states give a piece;
* byte fallback: an arc for a character without a piece, which gives the pieces of its bytes;
* the weights: the arc to a piece weighs 0 after a piece beside which merging leaves it as it is, and
  infinity after any other. In a BPE model the sum of piece scores doesn't lead to the pieces that
  merging leads to, but every two neighbours of a BPE encoding fit in this way, and no other path has
  fitting neighbours only, so its path is the one of finite weight.

An input is composed with them to a lattice over its characters, which is relaxed in the tropical
semiring (min, +) from left to right. Since the encoding of each prefix is unique, a place keeps one
state: the last piece of the shortest path to it.

Whether two pieces fit is found by running the merges at their border: the pieces at the right edge of
the first and at the left edge of the second grow in the order of their ranks, and the pair fits if at
no time a merge across the border comes first.

A batch of texts is cut where no piece crosses; all distinct segments of a batch that are not known yet
are relaxed at once, a place of all segments a step, and the paths of short segments are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels as K
from parlance.llm.session import chunks, flat, lean, prepare

#: Where the model lies; a parameter of all functions.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segments whose paths a worker keeps, and the characters of the longest of them.
KEPT, LONGEST = 150_000, 48
#: Characters of segments that are relaxed together.
TOGETHER = 1 << 18
_NEVER = np.iinfo(np.int32).max


def merged(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces that merging leaves, the pair with the best score first and the leftmost of equals,
    and the two parts of the last merge."""
    parts, none, last = list(text), float("-inf"), None
    scores = [score.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while scores:
        best = max(scores)
        if best == none:
            break
        i = scores.index(best)
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = score.get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = score.get(parts[i - 1] + parts[i], none)
    return parts, last


def read_model(path: str = MODEL) -> dict[str, np.ndarray]:
    """The machines of a BPE model with byte fallback as arrays, compiled on the driver.

    Pieces are told by their ids, and ``wall``, the number of pieces, stands for the start and for
    characters without a piece, with which nothing merges.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    wall = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(wall)]
    plain = {p: i for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    if any(MARK in p.lstrip(MARK) for p in plain):
        raise ValueError("a piece goes on past a word mark")
    score = {p: model.get_score(i) for p, i in plain.items()}
    # what a piece stands for
    raw = [bytes((int(p[3:-1], 16),)) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    rank = np.full(wall + 1, _NEVER, np.int32)
    rank[sorted(plain.values(), key=lambda i: (-model.get_score(i), i))] = np.arange(len(plain))
    # edges of the merge trees of the pieces that merging makes at all, smallest first
    left, right = {wall: [wall]}, {wall: [wall]}
    for p, i in sorted(plain.items(), key=lambda x: len(x[0])):
        parts, last = merged(p, score)
        if len(p) == 1:
            left[i], right[i] = [i], [i]
        elif len(parts) == 1 and plain[last[0]] in left and plain[last[1]] in left:
            left[i], right[i] = [*left[plain[last[0]]], i], [*right[plain[last[1]]], i]
    deep = 1 + max(len(x) for x in [*left.values(), *right.values()])
    edges = np.full((2, wall + 1, deep), -1, np.int32)
    for side, trees in enumerate((left, right)):
        for i, tree in trees.items():
            edges[side, i, : len(tree)] = tree
    pairs = [(plain[p[:k]] * (wall + 1) + plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
    # the trie: state 0 is the root; an arc is told by its state and character
    arcs: dict[tuple[int, int], int] = {}
    accepts = [-1]
    for p, i in plain.items():
        at = 0
        for c in map(ord, p):
            if (at, c) not in arcs:
                arcs[at, c] = len(accepts)
                accepts.append(-1)
            at = arcs[at, c]
        accepts[at] = i if i in left else -1
    near = {(ord(a) << 21) | ord(b) for p in plain for a, b in zip(p, p[1:], strict=False)}
    byte = np.full(256, -1, np.int32)
    for i in range(wall):
        if model.is_byte(i):
            byte[raw[i][0]] = i
    return {
        "wall": np.array(wall), "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_first": np.concatenate([[0], np.cumsum([len(x) for x in raw])]), "byte": byte, "rank": rank, "edges": edges,
        "size": np.array([len(p) for p in pieces] + [1], np.int32), "pairs": np.array(pairs, np.int64).reshape(-1, 2), "accepts": np.array(accepts, np.int32),
        "arcs": np.array([(s << 21 | c, t) for (s, c), t in arcs.items()], np.int64).reshape(-1, 2), "near": np.array(sorted(near), np.uint64),
    }


class Transducer:
    """The compiled machines, and the paths of the segments met so far."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.wall, self.byte, self.rank, self.size, self.accepts = int(model["wall"]), model["byte"], model["rank"], model["size"], model["accepts"]
        self.raw, self.raw_first = model["raw"], model["raw_first"]
        self.left, self.right = model["edges"]
        self.pairs, self.pair_rank = K.Table(model["pairs"][:, 0].astype(np.uint64)), np.append(self.rank[model["pairs"][:, 1]], _NEVER)
        self.arcs, self.arc_to = K.Table(model["arcs"][:, 0].astype(np.uint64)), model["arcs"][:, 1]
        # neighbours in some piece; others that share a place here are only not cut apart
        self.near = np.zeros(1 << 22, bool)
        self.near[self._near(model["near"] >> np.uint64(21), model["near"] & np.uint64((1 << 21) - 1))] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.paths, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).view(np.int64)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces a and b as they are when b follows a."""
        out = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(open_):
            x, y = self.right[a, i], self.left[b, j]
            across = self.pair_rank[self.pairs.find(x.astype(np.uint64) * np.uint64(self.wall + 1) + y.astype(np.uint64))]
            up, down = self.right[a, i + 1], self.left[b, j + 1]
            up = np.where(up >= 0, self.rank[up], _NEVER)
            down = np.where(down >= 0, self.rank[down], _NEVER)
            torn = (across < up) & (across <= down) & (across < _NEVER)
            out[open_[torn]] = False
            go = ~torn & ((up < _NEVER) | (down < _NEVER))
            first = (up <= down)[go]
            open_, a, b = open_[go], a[go], b[go]
            i, j = i[go] + first, j[go] + ~first
        return out

    def relax(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of the shortest paths through the lattices of segments, and where each begins.

        Segment s holds the characters first[s] .. first[s + 1] - 1; its places are numbered on from
        first[s] + s, one more than it has characters.
        """
        count, total = len(first) - 1, len(codes)
        segment = np.repeat(np.arange(count), np.diff(first))
        left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
        # composition with the trie: from each place, as far as it leads
        at, state, size = np.arange(total), np.zeros(total, np.int64), 0
        starts, ends, pieces = [], [], []
        while len(at):
            row = self.arcs.find(state.astype(np.uint64) << np.uint64(21) | codes[at + size].astype(np.uint64))
            at, state = at[row >= 0], self.arc_to[row[row >= 0]]
            size += 1
            piece = self.accepts[state]
            some = piece >= 0
            starts.append(at[some])
            pieces.append(piece[some])
            ends.append(at[some] + size)
            go = left[at] > size
            at, state = at[go], state[go]
        alone = np.ones(total, bool)
        if starts:
            alone[starts[0]] = False
        alone = np.flatnonzero(alone)
        start, end, piece = (np.concatenate(x) for x in ([*starts, alone], [*ends, alone + 1], [*pieces, np.full(len(alone), self.wall, np.int32)]))
        own = segment[start]
        start, end = start + own, end + own
        step = end - (first[:-1] + np.arange(count))[own]
        order = np.argsort(step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        cut = np.searchsorted(step, np.arange(1, step[-1] + 2)) if len(step) else np.zeros(1, np.int64)
        state = np.full(total + count, -1, np.int64)
        state[first[:-1] + np.arange(count)] = self.wall
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            before = state[start[a:b]]
            open_ = np.flatnonzero(before >= 0)  # other places are at infinity
            good = open_[self.fits(before[open_], piece[a + open_])]
            state[end[a + good]] = piece[a + good]
        # back along the paths
        taken = np.zeros(total + count, bool)
        at, stop = first[1:] + np.arange(count), first[:-1] + np.arange(count)
        at, stop = at[at > stop], stop[at > stop]
        while len(at):
            taken[at] = True
            at = at - self.size[state[at]]
            at, stop = at[at > stop], stop[at > stop]
        place = np.flatnonzero(taken)
        ids = state[place]
        own = np.searchsorted(first[1:] + np.arange(count), place)
        # byte fallback
        wide = np.ones(len(ids), np.int64)
        lost = np.flatnonzero(ids == self.wall)
        if len(lost):
            code = codes[place[lost] - own[lost] - 1]
            wide[lost] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ids = np.repeat(ids, wide)
        if len(lost):
            raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids[ids == self.wall] = self.byte[raw]
        counts = np.bincount(own, wide, count).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def _paths(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct segments (UTF-32 as binary): an array of ids, and where each one's begin and how many they are."""
        if len(self.known) > KEPT:
            self._forget()
        keys = segments.to_pylist()
        slot = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(slot < 0)
        first, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        extra, base = [], 0
        size = np.array([len(keys[k]) // 4 for k in new], np.int64)
        block = np.cumsum(size) // TOGETHER
        for group in np.split(new, np.flatnonzero(np.diff(block)) + 1) if len(new) else []:
            some = [keys[k] for k in group]
            ids, cut = self.relax(np.frombuffer(b"".join(some), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in some])]))
            first[group], length[group] = cut[:-1] + base, np.diff(cut)
            extra.append(ids)
            base += len(ids)
        old = np.flatnonzero(slot >= 0)
        first[old], length[old] = self.first[slot[old]] + base, self.length[slot[old]]
        made = np.concatenate([*extra, np.zeros(0, np.int32)])
        both = np.concatenate([made, self.paths[: self.used]])
        short = [k for k in new if len(keys[k]) <= 4 * LONGEST]
        if short:
            n, have = int(length[short].sum()), len(self.known)
            while self.used + n > len(self.paths):
                self.paths = np.concatenate([self.paths, np.zeros(len(self.paths), np.int32)])
            while have + len(short) > len(self.first):
                self.first, self.length = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.first, self.length))
            self.paths[self.used : self.used + n] = made[_spread(first[short], length[short])]
            self.first[have : have + len(short)] = self.used + np.cumsum(length[short]) - length[short]
            self.length[have : have + len(short)] = length[short]
            self.known.update((keys[k], have + i) for i, k in enumerate(short))
            self.used += n
        return both, first, length

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all texts, and where each text's begin; none for an empty text."""
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data, _ = K.buffers(texts)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        # the normaliser
        offsets = np.concatenate([[0], np.cumsum(size)])
        codes = np.insert(np.where(codes == 32, ord(MARK), codes), offsets[:-1][size > 0], ord(MARK)).astype("<u4")
        offsets = np.concatenate([[0], np.cumsum(size + (size > 0))])
        if not len(codes):
            return np.zeros(0, np.int32), offsets
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.near[self._near(codes[:-1], codes[1:])]
        cut[offsets] = True
        cut = np.flatnonzero(cut)
        if cut[-1] * 4 >= 1 << 31:
            raise ValueError("a batch of texts over 2 GiB in UTF-32")
        found = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(codes)]).dictionary_encode()
        both, first, length = self._paths(found.dictionary)
        which = found.indices.to_numpy()
        ids = both[_spread(first[which], length[which])]
        total = np.concatenate([[0], np.cumsum(length[which])])
        return ids, total[np.searchsorted(cut, offsets)]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, and where each text's begin: the inverse machine, without the mark before a text."""
        size = self.raw_first[ids + 1] - self.raw_first[ids]
        head = offsets[:-1][np.diff(offsets) > 0]
        start = self.raw_first[ids]
        marked = self.raw[start[head]] == 32
        start[head] += marked
        size[head] -= marked
        total = np.concatenate([[0], np.cumsum(size)])
        return self.raw[_spread(start, size)].tobytes(), total[offsets]

    def encode(self, text: str) -> list[int]:
        """Piece ids of a text; none for an empty one."""
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids."""
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., length[0] numbers, then those of the next."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


_made: dict[str, Transducer] = {}


def _transducer(model) -> Transducer:
    """One for each Python worker."""
    name = str(getattr(model, "_path", ""))
    if name not in _made:
        _made.clear()
        _made[name] = Transducer(model.value)
    return _made[name]


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, tokens (array of ids).

    Defined cases: a null or empty text has no tokens; a null doc_id stays; a character without a
    piece becomes its bytes; repeated rows are encoded each; an empty table gives no rows; other
    columns are not read.
    """
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(read_model(model_path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(model)
        for part in chunks(batches):
            ids, offsets = machine.encode_batch(flat(part.column(1)))
            tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([flat(part.column(0)), pa.array(np.diff(offsets)), tokens], names=["doc_id", "n_tokens", "tokens"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>")


def round_trips(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, n_bytes (tokens of byte fallback),
    tokens_sha256 (hex digest of the ids as 32-bit little-endian numbers), exact (whether decoding
    gives the text again; a word mark in a text comes back as a space). Cases as in ``encode``."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(read_model(model_path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(model)
        is_byte = np.zeros(machine.wall, bool)
        is_byte[machine.byte[machine.byte >= 0]] = True
        for part in chunks(batches):
            texts = flat(part.column(1))
            ids, offsets = machine.encode_batch(texts)
            again, ends = machine.decode_batch(ids, offsets)
            data, first = K.buffers(texts)
            raw, text = ids.astype("<i4").tobytes(), data.tobytes()
            spans = range(len(texts))
            columns = [
                pa.array(np.diff(offsets)), pa.array(K.sums(is_byte[ids].astype(np.int64), offsets)),
                pa.array([hashlib.sha256(raw[4 * offsets[i] : 4 * offsets[i + 1]]).hexdigest() for i in spans], pa.string()), pa.array([text[first[i] : first[i + 1]] == again[ends[i] : ends[i + 1]] for i in spans], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([flat(part.column(0)), *columns], names=["doc_id", "n_tokens", "n_bytes", "tokens_sha256", "exact"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, tokens_sha256 string, exact boolean")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
