"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.session import each_part, part, parts_mask, settle

#: Rounds double what a star reaches, so this many rounds join any chain that fits a cluster.
MOST_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node that has a link, from links (a, b) in any direction.

    component is the smallest node reachable, the node itself included. Self links, repeated links
    and nulls are ignored; no links give no rows.
    """
    edges = settle(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        plain=True,
    )
    state = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, with_own=True).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(settle(large, plain=True), with_own=False)
        edges = settle(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), plain=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(now)
    raise RuntimeError("components did not settle")


def _with_least(edges: DataFrame, with_own: bool) -> DataFrame:
    """Adds m, the least neighbour v of each u (or u itself, ``with_own``), to (u, v) rows.

    The rows of a node are dealt to parts by their v, and each part gets the node's minimum, so no task
    has all links of a node.
    """
    dealt = edges.withColumn("part", part("v"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), parts_mask().alias("parts"))
    least = least.select("u", (F.least("u", "m") if with_own else F.col("m")).alias("m"), each_part("parts").alias("part"))
    return dealt.join(least, ["u", "part"]).drop("part")
