"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed in the cells (source, language, topic). Each round multiplies the cells' weights
so that one margin after the other has its target share of the weighted tokens, until all margins
hold. A document is kept if a hash of its id falls below its cell's probability, which is in
proportion to its weight.

No probability may be above 1, so weights are raked under a bound, and targets are such that it can be
kept: no value's share grows by more than ``LIFT`` (before they are evened out to 1), and as many
tokens are drawn as let the value that grows most keep ``SLACK`` of its own. Both are told by the
margins alone, so a rare cell doesn't thin out all others, and the draw grows with the corpus.

Only the table of cells takes part in the rounds; texts are read once and not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.session import prepare, settle

#: Targets are shares of tokens to these powers, evened out again: 1 keeps a margin, 0 levels it.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: How much a value's share may grow, and how much of the value that grows most is drawn.
LIFT, SLACK = 2.0, 0.7
#: Rounds of which one table is written.
TOGETHER = 3
#: Rounds end when each margin is this near to its target, as a share of it, or after so many.
NEAR, ROUNDS = 1e-10, 60
#: Tables of cells up to this many rows (a row is under 200 bytes) are raked in one partition and broadcast.
BROADCAST_CELLS = 20_000
_CELL = ["source", "lang", "topic"]


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def surface_topic(text: Column, n_tokens: Column) -> Column:
    """A topic from the surface of a text, where no topic column is given."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "list")
        .when(text.rlike(r"[%#*$&]{3}"), "symbols")
        .when(n_tokens >= 300, "long")
        .when(n_tokens >= 60, "medium")
        .otherwise("short")
    )


def targets(cells: DataFrame, margin: str, power: float, lift: float = LIFT) -> DataFrame:
    """(margin, target, share): of all values that have tokens, the share of tokens to a power, but no more
    than ``lift`` times the share of tokens, evened out to 1, and that share."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    sums = sums.select(margin, F.col("t").cast("double").alias("t"), F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    t, p = sums.agg(F.sum("t"), F.sum("p")).first()
    known = sums.select(margin, (F.col("t") / F.lit(t)).alias("share"), (F.col("p") / F.lit(p)).alias("level"))
    known = settle(known.select(margin, "share", F.least(F.col("level"), F.col("share") * lift).alias("level")))
    whole = known.agg(F.sum("level")).first()[0]
    return known.select(margin, (F.col("level") / F.lit(whole)).alias("target"), "share")


def together(cells: DataFrame) -> DataFrame:
    """A small table in one partition, where rounds need no shuffle; a larger one stays spread."""
    return cells.coalesce(1) if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else cells


def rake(cells: DataFrame, wanted: dict[str, DataFrame], rounds: int = ROUNDS, near: float = NEAR, most: float | None = None) -> DataFrame:
    """Adds ``weight`` to (source, lang, topic, tokens) cells so that their margins have the wanted
    shares, {margin: (margin, target)}, and no weight is above ``most``. Values without a target, or
    without tokens, keep weight 0.

    Targets that no such weights reach (empty cells can rule them out) leave the weights of the last round.
    """
    for margin, shares in wanted.items():
        cells = cells.join(shares.select(margin, F.col("target").alias(f"to {margin}")), margin, "left").fillna(0.0, [f"to {margin}"])
    cells = together(settle(cells.withColumn("weight", F.lit(1.0))))
    for k in range(rounds):
        worst = F.lit(0.0)
        for margin in wanted:
            mass = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(margin))
            cells = cells.withColumn("mass", mass)
            worst = F.greatest(worst, F.when((F.col("mass") > 0) & (F.col(f"to {margin}") > 0), F.abs(F.col("mass") / F.col(f"to {margin}") - 1)).otherwise(0.0))
            scaled = F.when(F.col("mass") > 0, F.col("weight") * F.col(f"to {margin}") / F.col("mass")).otherwise(0.0)
            cells = cells.withColumn("weight", scaled if most is None else F.least(scaled, F.lit(most))).withColumn("off", worst).drop("mass")
            worst = F.col("off")
        if k % TOGETHER == TOGETHER - 1 or k == rounds - 1:
            cells = together(settle(cells))
            if (cells.agg(F.max("off")).first()[0] or 0.0) < near:
                break
    return cells.drop("off", *(f"to {m}" for m in wanted))


def drawn_share(wanted: dict[str, DataFrame], slack: float = SLACK) -> float:
    """The share of all tokens that can be drawn when the value that grows most keeps ``slack`` of its own."""
    grows = [shares.agg(F.max(F.col("target") / F.col("share"))).first()[0] for shares in wanted.values()]
    return slack / max((g for g in grows if g), default=1.0)


def margins(mixed: DataFrame, powers: dict[str, float] | None = None) -> DataFrame:
    """(margin, value, target, expected) of what ``mix`` returned: each value's target share of the tokens,
    and its share of those that are expected to be drawn."""
    out = None
    for margin, power in (powers or POWERS).items():
        sums = settle(mixed.groupBy(F.col(f"mix_{margin}").alias("value")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e")))
        e = sums.agg(F.sum("e")).first()[0]
        rows = targets(sums, "value", power).join(sums.select("value", "e"), "value").select(F.lit(margin).alias("margin"), "value", "target", (F.col("e") / F.lit(e or 1.0)).alias("expected"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, topic: Column | None = None) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, source, lang and any others but these), and mix_source,
    mix_lang, mix_topic, n_tokens, weight, probability and sampled.

    The topic is the column given, or one named topic, or else the text's surface. Defined cases: a null source or language is the value ""; a null text is empty; a document
    without tokens has its cell's probability, 0 if the whole cell has none; a null doc_id is drawn
    as empty text; rows that share a doc_id are drawn alike; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = tokens(text)
    if topic is None and "topic" in docs.columns:
        topic = F.col("topic")
    label = surface_topic(text, n) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    names = {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": label}
    light = docs.select(*(c.alias(k) for k, c in names.items()), n.alias("n"))
    cells = together(settle(light.groupBy(_CELL).agg(F.sum("n").alias("tokens"))))
    wanted = {m: targets(cells, m, p) for m, p in powers.items()}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    most = 1 / (drawn_share(wanted) * total) if total else 1.0  # the weight of probability 1
    weighted = rake(cells, wanted, rounds, most=most)
    factor = 1 / most
    weighted = settle(weighted.select(*(F.col(c).alias(f"mix_{c}") for c in _CELL), "weight", F.least(F.lit(1.0), F.when(F.col("tokens") > 0, F.col("weight") * factor).otherwise(0.0)).alias("probability")))
    if weighted.count() <= BROADCAST_CELLS:
        weighted = F.broadcast(weighted)
    own = docs.withColumns({f"mix_{k}": c for k, c in names.items()} | {"n_tokens": n})
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return own.join(weighted, [f"mix_{c}" for c in _CELL], "left").select(
        *(F.col(f"`{c}`") for c in docs.columns), *(f"mix_{c}" for c in _CELL), "n_tokens", "weight", "probability", (drawn < F.col("probability")).alias("sampled")
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    """The decision on each document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled."""
    return mix(docs.select("doc_id", "text", "source", "lang")).select(
        "doc_id", *(F.col(f"mix_{c}").alias(c) for c in _CELL), "n_tokens", F.round(F.col("weight") * 1e6, 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled"
    )
