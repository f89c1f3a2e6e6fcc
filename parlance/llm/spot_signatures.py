"""Document fingerprints by spot signatures (SpotSigs), in DataFrame functions only.

A spot is a run of common words. Its signature is the chain of the two content words that follow,
common words between them left out, so boilerplate without sentences gives few signatures
and changed common words don't matter. Where ``FAR`` content words have followed without a common
one, as in other scripts or lists, one in ``ONE_IN`` words, told by its hash, stands for a spot, so such
texts have signatures all along, too. A fingerprint is the sorted set of a text's signature hashes; two
fingerprints' likeness is their Jaccard similarity.

``similar_pairs`` joins fingerprints: sets are partitioned by length, so that a set only meets those
whose length allows the similarity, and within that by the signatures of their prefixes, rarest
first, of which similar sets share one. ``similar_documents`` does so for whole tables, with equal sets
as one class.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.session import each_part, part, parts_mask, prepare, settle

#: Common words of the four languages; the anchors of the signatures.
COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were what which who will with you "
    "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist kann mit nach nicht noch nur oder sich sie sind so um und uns von vor war wie wird wir zu zum zur über "
    "al con de del el en es esta este la las lo los no o para pero por que se sin sobre su sus un una y ya "
    "au aux avec ce ces cette d dans des du elle est et il ils je le les leur mais ne nous on ont ou où par pas plus pour qu qui sa se ses son sont sur un une vous"
).split()
SIMILARITY = 0.8


#: Content words without a common one after which one in so many words is a spot.
FAR, ONE_IN = 4, 3
#: Documents of neighbouring doc_ids that are ordered together, and the ranges of doc_ids that are told apart first (a square).
TOGETHER, RANGES = 512, 64 * 64
_SPACE = r"[\x20\x09-\x0D]+"
_SPOT = "\x01"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: higher-order functions share no subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column) -> Column:
    """The distinct signature hashes of a text, sorted: an array of longs.

    The start of a text is a spot, too, so that every text with a content word has a signature. A
    chain that the text's end cuts short is a signature as it is. The character U+0001 counts as a
    common word.
    """
    words = F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(COMMON), F.lit(_SPOT)).otherwise(w)), " ")

    def run(between: Column) -> Column:
        """The content words from a common word up to the next one, and which of them begin a signature."""
        own = F.filter(F.split(between, " "), lambda w: w != "")
        return F.transform(own, lambda w, i: F.struct(w.alias("word"), ((i == 0) | ((i >= FAR) & (F.pmod(F.xxhash64(w), F.lit(ONE_IN)) == 0))).alias("spot")))

    def chains(found: Column) -> Column:
        after = F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
        return F.array_compact(F.zip_with(found, after, lambda a, b: F.when(a["spot"], F.xxhash64(a["word"], b["word"]))))

    return _let(F.flatten(F.transform(F.split(marked, _SPOT), run)), lambda c: F.sort_array(F.array_distinct(chains(c))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    same = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - same
    return F.when(union == 0, F.lit(1.0)).otherwise(same / union).cast("double")


def fingerprint(sigs: Column) -> Column:
    """Signature sets as text: hexadecimal hashes joined by commas."""
    return F.array_join(F.transform(sigs, F.hex), ",")


def neighbourhoods(ids: DataFrame) -> tuple[DataFrame, Column] | None:
    """(bucket, other) for the ends of buckets of neighbouring doc_ids, and the bucket of a doc_id; None
    without doc_ids.

    other is the greatest doc_id below a bucket's, or the greatest of all for the lowest bucket. A
    bucket holds about ``TOGETHER`` rows: doc_ids are first dealt to ``RANGES`` ranges of equally many,
    told by their quantiles, and a range is cut into equal widths. So far-off doc_ids only widen the
    buckets of their own range. Rows without a doc_id are spread over buckets below 0 by their texts.
    """
    side = math.isqrt(RANGES)
    share = [k / RANGES for k in range(1, RANGES)]
    n, low, high, inner = ids.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", share, 10 * RANGES)).first()
    if not n:
        return None
    bounds = [low, *inner]
    row = lambda values: F.lit(np.array(values, np.int64))
    step = F.size(F.filter(row(bounds[::side]), lambda b: b <= F.col("doc_id"))) - 1
    within = lambda k: k * side + F.size(F.filter(F.slice(row(bounds), k * side + 1, side), lambda b: b <= F.col("doc_id"))) - 1
    # as much of a range as holds TOGETHER rows
    width = [min(max(1, (b - a + 1) * TOGETHER // max(n // RANGES, 1)), 1 << 62) for a, b in zip(bounds, [*bounds[1:], high], strict=True)]
    place = lambda k: k * (1 << 44) + F.floor((F.col("doc_id").cast("double") - F.element_at(row(bounds), k + 1).cast("double")) / F.element_at(row(width), k + 1))
    known = _let(step, lambda k: _let(within(k), lambda r: place(r).cast("long")))
    bucket = F.when(F.col("doc_id").isNotNull(), known).otherwise(-1 - F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    tops = settle(ids.where("doc_id IS NOT NULL").groupBy(known.alias("bucket")).agg(F.max("doc_id").alias("top")))
    tops = tops.withColumn("block", F.floor(F.col("bucket") / (1 << 44)).cast("long")).withColumn("before", F.lag("top").over(Window.partitionBy("block").orderBy("bucket")))
    # at most RANGES rows
    blocks = tops.groupBy("block").agg(F.max("top").alias("top")).withColumn("before", F.lag("top").over(Window.orderBy("block"))).select("block", F.col("before").alias("earlier"))
    ends = tops.join(F.broadcast(blocks), "block").select("bucket", F.coalesce("before", "earlier", F.lit(high)).cast("long").alias("other"))
    return ends, bucket


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text is a text whose last floor(n_chars / 2) characters are replaced by the first as
    many (or all) of the next document, in descending doc_id; after the last comes the first.
    Defined cases: a null text is empty; a row without a doc_id is next to none, and its own next is
    the first document, or empty if there is none; rows that share a doc_id follow each other by their
    texts; an only document is its own next; an empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = neighbourhoods(rows.select("doc_id"))
    if found is None:
        joined = rows.select("doc_id", "text", F.lit("").alias("after"), F.length("text").alias("n"))
    else:
        ends, bucket = found
        order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
        dealt = rows.withColumn("bucket", bucket)  # texts are shuffled once; both uses below share that exchange
        near = dealt.withColumn("after", F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)))
        heads = dealt.withColumn("rank", F.row_number().over(order)).where("rank = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("other"), F.col("text").alias("head"))
        # the first document follows the last one, and all rows without a doc_id: one row
        whole = ends.agg(F.max("other").alias("other"))
        tails = ends.join(heads, "other").select("bucket", "head")
        joined = near.join(tails, "bucket", "left").select("doc_id", "text", "after", "head", F.length("text").alias("n"))
        if rows.where("doc_id IS NULL").limit(1).count():
            top = whole.join(heads, "other").select("head").first()
            joined = joined.withColumn("head", F.when(F.col("doc_id").isNull(), F.lit(top["head"])).otherwise(F.col("head")))
        joined = joined.select("doc_id", "text", F.coalesce("after", "head", F.lit("")).alias("after"), "n")
    half = F.floor(F.col("n") / 2).cast("int")
    done = joined.withColumn("edited", F.concat(F.left("text", F.col("n") - half), F.left("after", half)))
    done = done.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("changed"), signatures(F.col("after")).alias("next")
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, n_signatures, class_id (the smallest doc_id with the same
    signatures) and n_links, the classes whose fingerprints have the similarity or more.

    Defined cases: a null text is empty; a document without signatures is a class of its own without
    links; rows without a doc_id are not documents; of rows that share a doc_id the greatest set of
    signatures stands for it; an empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sigs"))
    rows = rows.groupBy("doc_id").agg(F.max("sigs").alias("sigs"))
    rows = settle(rows.withColumn("h1", F.xxhash64("sigs")).withColumn("h2", F.xxhash64(F.lit(1), "sigs")).withColumn("part", part("doc_id")))
    classes = rows.where("size(sigs) > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.max("sigs").alias("sigs"), parts_mask().alias("parts"))
    classes = settle(classes)
    pairs = similar_pairs(classes.select("id", "sigs"), similarity)
    links = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    known = classes.join(links, "id", "left").select("h1", "h2", "id", "n_links", each_part("parts").alias("part"))
    out = rows.select("doc_id", F.size("sigs").cast("long").alias("n_signatures"), "h1", "h2", "part").join(known, ["h1", "h2", "part"], "left")
    return out.select("doc_id", "n_signatures", F.coalesce("id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar_pairs(signed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) for all pairs a < b of (id, sigs) rows with that Jaccard similarity or more.

    Sets are dealt to partitions of lengths a factor 1 / similarity apart, so a set only meets its own
    and the next partition. Its prefix, rarest signatures first, is as long as two similar sets must
    share one; pairs meet under the first signature that their prefixes share, if their lengths
    allow the similarity. Empty sets and null ids are in no pair; equal ids are no pair.
    """
    prepare(signed.sparkSession)
    sets = settle(signed.where("id IS NOT NULL AND size(sigs) > 0").select("id", "sigs").distinct())
    often = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    each = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).join(often, "sig")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "sig"))
    prefix = each.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    part = F.floor(F.log("n") / -math.log(similarity)).cast("int")
    prefix = prefix.where("df > 1").select("id", "n", "sig", part.alias("part"))
    either = prefix.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    x, y = prefix.alias("x"), either.alias("y")
    fits = (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity - 1e-9) & (F.col("x.id") != F.col("y.id"))
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.part") == F.col("y.part")) & fits)
    pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
