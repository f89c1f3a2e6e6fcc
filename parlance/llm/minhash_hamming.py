"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

Each distinct shingle set gets ``chunks * WIDTH`` MinHash values, of which ``BITS`` bits are kept as
one symbol each. The distance of two signatures is the number of symbols that differ (Hamming
distance over symbols). The signature is split into ``chunks`` chunks, and each chunk is entered in
the index once for every symbol that may be wrong in it, under the others. If two signatures differ
in at most ``2 * chunks - 1`` symbols, one chunk has at most one error, by pigeonhole, so the pair
meets under some key: all pairs under that distance are found. At the similarity threshold itself a
pair that is further apart still meets unless *every* chunk has two errors, which has a probability
below 3e-6 at 0.8 and 2e-8 at 0.85.

Copies are folded into one class by the hash of the whole shingle set. In each key, every class is
compared with the smallest one (a star, not all pairs), and then, where a key's classes are still in
different components, with others drawn by a hash, for a few rounds. What is left are classes of
different components that share a key: the open ones. Two of those can only be similar if they share
one of their rarest shingles (of n shingles, the n - ceil(similarity * n) + 1 that the fewest open
classes hold), so they are joined on those, and a key of very many unlike classes makes no pairs.

Signatures, and a finer sketch in the last step, are compared before texts are: pairs go whose
distance has a probability below ``LOSS`` at the threshold. Every link is confirmed on the full
shingle sets; heads with many partners are split among tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels as K
from parlance.llm.components import connected_components
from parlance.llm.session import chunks, each_part, flat, lean, part, parts_mask, prepare, release, settle, texts

WORDS = 5
SIMILARITY = 0.8
CHUNKS = 12
#: Symbols of a chunk; one of them may be wrong.
WIDTH = 6
#: Rounds in which each key compares its classes with another one, drawn by a hash.
ROUNDS = 1
#: The most likely loss, for a pair at the threshold, by comparing signatures, and by comparing sketches.
LOSS = 1e-9
#: Pairs of one text that are confirmed together, and the most texts with more whose list is broadcast (16 bytes each).
TOGETHER, BROADCAST_HEADS = 128, 50_000
#: Bits of a symbol. Three of them go into a long, each with a free bit above it.
BITS = 20
_SYMBOLS = CHUNKS * WIDTH
_LONGS = _SYMBOLS // 3
assert WIDTH == 6  # two longs hold a chunk
_LANES = np.arange(3, dtype=np.uint64) * np.uint64(BITS + 1)
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**62, _SYMBOLS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**62, _SYMBOLS, dtype=np.int64).astype(np.uint64)
_M = (_rng.integers(1, 2**62, _SYMBOLS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)).reshape(CHUNKS, WIDTH)
_S = _rng.integers(1, 2**62, _SYMBOLS, dtype=np.int64).astype(np.uint64).reshape(CHUNKS, WIDTH)

#: Bits of the finer sketch of classes that are still to be compared.
FINE = 512
_FA = _rng.integers(1, 2**62, FINE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FB = _rng.integers(1, 2**62, FINE, dtype=np.int64).astype(np.uint64)

SKETCH = "doc_id long, h1 long, h2 long, n_shingles long, sig array<long>"


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, symbols) MinHash symbols of non-empty runs of shingle hashes."""
    out = np.empty((len(first) - 1, _SYMBOLS), np.uint64)
    for k in range(_SYMBOLS):
        low = np.minimum.reduceat((values ^ _B[k]) * _A[k], first[:-1])
        out[:, k] = K.mix(low) >> np.uint64(64 - BITS)
    return out


def packed(sig: np.ndarray) -> np.ndarray:
    return (sig.reshape(len(sig), _LONGS, 3) << _LANES).sum(axis=2, dtype=np.uint64).view(np.int64)


def unpacked(longs: np.ndarray) -> np.ndarray:
    return ((longs.view(np.uint64)[:, :, None] >> _LANES) & np.uint64((1 << BITS) - 1)).reshape(len(longs), _SYMBOLS)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, symbols) index keys: each chunk once without each of its symbols."""
    value = (sig.reshape(-1, CHUNKS, WIDTH) + np.uint64(1)) * _M
    total = value.sum(axis=2, dtype=np.uint64)
    return K.mix((total[:, :, None] - value) ^ _S).reshape(len(sig), _SYMBOLS)


def sketch_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each document: the hash and size of its shingle set, and its signature (null if empty)."""
    for part in chunks(batches):
        data, offsets = K.buffers(part.column(1))
        values, first = K.shingles(K.words(data, offsets), size)
        n = len(first) - 1
        some = np.flatnonzero(np.diff(first) > 0)
        h1, h2, count = (np.zeros(n, np.int64) for _ in range(3))
        for i in some:
            own = np.unique(values[first[i] : first[i + 1]])
            count[i] = len(own)
            h1[i] = K.mix((own.sum(dtype=np.uint64) ^ np.uint64(len(own))).reshape(1)).view(np.int64)[0]
            h2[i] = K.mix((K.mix(own ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)).reshape(1)).view(np.int64)[0]
        longs = np.zeros((n, _LONGS), np.int64)
        if len(some):
            bounds = np.append(first[some], first[-1])
            longs[some] = packed(signatures(values, bounds))
        offsets = np.zeros(n + 1, np.int32)
        offsets[1:] = np.cumsum(np.where(count > 0, _LONGS, 0))
        sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(longs[some].ravel()))
        yield pa.RecordBatch.from_arrays(
            [flat(part.column(0)), pa.array(h1), pa.array(h2), pa.array(count), sig],
            names=["doc_id", "h1", "h2", "n_shingles", "sig"],
        )


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, slot, node) rows of the index, from (node, sig); the slot is the symbol left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        longs = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, _LONGS)
        keys = index_keys(unpacked(np.ascontiguousarray(longs)))
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), _SYMBOLS)
        slots = np.tile(np.arange(_SYMBOLS, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(slots), pa.array(nodes)], names=["key", "slot", "node"])


def fine_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(node, fine, shingles) of (doc_id, text) rows: a sketch of 1-bit MinHash values, and the set itself."""
    for part in chunks(batches):
        data, offsets = K.buffers(part.column(1))
        values, first = K.shingles(K.words(data, offsets), size)
        some = np.flatnonzero(np.diff(first) > 0)
        bits = np.empty((len(some), FINE), np.uint8)
        for k in range(FINE if len(some) else 0):
            low = np.minimum.reduceat((values ^ _FB[k]) * _FA[k], first[some])
            bits[:, k] = (K.mix(low) >> np.uint64(63)).astype(np.uint8)
        fine = list(np.packbits(bits, axis=1).view(np.int64))
        own = [np.unique(values[first[i] : first[i + 1]]).view(np.int64) for i in some]
        nodes = part.column(0).to_numpy()[some]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(fine, kind), pa.array(own, kind)], names=["node", "fine", "shingles"])


def confirm_batches(batches: Iterator[pa.RecordBatch], size: int, numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    """The rows (a, b) whose two texts' shingle sets have the similarity, from (a, b, text_a, text_b)."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        data, offsets = K.buffers(column)
        values, first = K.shingles(K.words(data, offsets), size)
        return [np.unique(values[first[i] : first[i + 1]]) for i in range(len(first) - 1)]

    for part in chunks(batches):
        keep = []
        for x, y in zip(sets(part.column(2)), sets(part.column(3)), strict=True):
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(same > 0 and denominator * same >= numerator * (len(both) - same))
        yield from part.select([0, 1]).filter(pa.array(keep, pa.bool_())).to_batches()


def differing(a: str, b: str) -> Column:
    """The number of symbols in which two signatures differ, as JVM bit arithmetic.

    Adding all ones to a lane of the exclusive or sets the free bit above it if the lane isn't zero.
    """
    ones, free = (sum(x << int(lane) for lane in _LANES) for x in ((1 << BITS) - 1, 1 << BITS))
    return F.expr(" + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) + {ones}L) & {free}L)" for i in range(_LONGS)))


def farthest(n: int, odds: float) -> int:
    """The least d such that more than d of n differ with a probability below ``LOSS``, each with these odds."""
    tail, d = 0.0, n
    while d > 0:
        tail += math.comb(n, d) * odds**d * (1 - odds) ** (n - d)
        if tail >= LOSS:
            break
        d -= 1
    return d


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a document's set
    holds its distinct ``size``-word shingles, or its whole sequence if it is shorter. Documents
    whose sets have a Jaccard similarity of at least ``similarity`` (taken to four decimals) are
    linked; component_id is the smallest doc_id reachable and kept is doc_id = component_id.

    Defined cases: a null or wordless text has an empty set and no link; a row whose doc_id is null
    has component_id null and is kept; rows that share a doc_id are one document with all links of
    its rows; an empty table gives no rows; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    numerator, denominator = round(similarity * 10_000), 10_000
    rows = texts(docs, key, text)
    sketches = settle(rows.mapInArrow(lean(lambda it: sketch_batches(it, size)), SKETCH)).withColumn("part", part("doc_id"))
    classes = (
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), parts_mask().alias("parts"))
    )
    classes = settle(classes)
    found = _links(spark, classes, rows, similarity, size, numerator, denominator)
    members = sketches.select("doc_id", "n_shingles", "h1", "h2", "part")
    shared = members.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2", "part").distinct()
    # a document with several texts links their classes
    repeated = shared.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    joined = shared.join(repeated, "doc_id").join(classes.select("h1", "h2", "node", each_part("parts").alias("part")), ["h1", "h2", "part"])
    several = joined.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    comps = connected_components(found.unionByName(several))
    ids = classes.join(comps, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"), each_part("parts").alias("part"))
    out = members.join(ids, ["h1", "h2", "part"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _links(spark, classes: DataFrame, rows: DataFrame, similarity: float, size: int, numerator: int, denominator: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect all that are connected."""
    nodes = classes.select("node", "n", "sig")
    index = nodes.select("node", "sig").mapInArrow(lean(key_batches), "key long, slot int, node long")
    heads = index.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head")
    index = settle(index.join(heads, "key"))  # only keys that two classes share
    release(spark)
    limit = farthest(_SYMBOLS, 1 - similarity)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures allow the similarity."""
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        near = F.least("na", "nb") * denominator >= F.greatest("na", "nb") * numerator
        return pairs.join(a, "a").join(b, "b").where(near).where(differing("sa", "sb") <= limit).select("a", "b")

    def with_text(pairs: DataFrame, there: DataFrame, side: str) -> DataFrame:
        """Adds the text of one side; the pairs of a text with many are split, with a copy of the text for each part."""
        other = "b" if side == "a" else "a"
        many = settle(pairs.groupBy(side).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")).where("parts > 1"))
        known = F.broadcast(many) if many.count() <= BROADCAST_HEADS else many
        own_part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
        dealt = pairs.join(known, side, "left").select(*pairs.columns, own_part)
        own = there.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")).join(known, side, "left")
        own = own.select(side, f"t{side}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        return dealt.join(own, [side, "part"]).drop("part")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs, plain=True)
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        there = settle(rows.join(wanted, "doc_id", "left_semi"))
        full = with_text(with_text(pairs, there, "a"), there, "b").select("a", "b", "ta", "tb")
        out = settle(full.mapInArrow(lean(lambda it: confirm_batches(it, size, numerator, denominator)), "a long, b long").distinct(), plain=True)
        release(spark)
        return out

    star = index.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    tried = settle(possible(star))
    links = confirmed(tried)
    open_ = index.select("key", "slot", "node")
    for turn in range(ROUNDS + 1):
        comps = connected_components(links)
        placed = open_.select("key", "slot", "node").join(comps, "node", "left").select("key", "slot", "node", F.coalesce("component", "node").alias("comp"))
        ends = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
        open_ = settle(placed.join(ends, "key"))
        if turn == ROUNDS:
            break
        heads = open_.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))).alias("head"))
        star = open_.join(heads, "key").where("comp <> head.comp")
        star = star.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        new = settle(possible(star.join(tried, ["a", "b"], "left_anti")))
        links, tried = links.unionByName(confirmed(new)), tried.unionByName(new)
        release(spark)
    # of the open classes, pairs that share one of their rarest shingles
    open_ = settle(open_.select("node", "comp").distinct())
    members = rows.join(open_.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    members = settle(members.mapInArrow(lean(lambda it: fine_batches(it, size)), "node long, fine array<long>, shingles array<long>"))
    each = members.select("node", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("k"))
    ranked = each.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("s"))
    # as many as are shared at least by two similar sets, but one
    ranked = ranked.withColumn("first", F.expr(f"slice(s, 1, size(s) - cast(ceil(size(s) * {numerator}L / {denominator}L) as int) + 1)"))
    heads = settle(ranked.select("node", F.posexplode("first").alias("at", "f")).where("f.k > 1").select("node", "at", F.col("f.shingle").alias("shingle")))
    able = nodes.join(members.select("node", "fine"), "node").join(open_, "node")
    left = heads.join(able, "node")
    near = (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & (F.least("x.n", "y.n") * denominator >= F.greatest("x.n", "y.n") * numerator)
    # at the first shingle that both have, no more than all from there on can be shared
    near &= F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) * (denominator + numerator) >= (F.col("x.n") + F.col("y.n")) * numerator
    apart = F.expr(" + ".join(f"bit_count(x.fine[{i}] ^ y.fine[{i}])" for i in range(FINE // 64)))
    near &= (apart <= farthest(FINE, (1 - similarity) / 2)) & (differing("x.sig", "y.sig") <= limit)
    across = left.alias("x").join(left.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & near)
    across = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return links.unionByName(confirmed(across.join(tried, ["a", "b"], "left_anti")))
