"""Links, merges and trees: calls and results, as-of links, splices, runs, versions and branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.tools import activity
from parlance.operators.tables import settle


def link_calls(calls: DataFrame, results: DataFrame, key: list[str], call: str) -> DataFrame:
    """Adds ``linked`` to results: whether exactly one call of the key (a session and thread) has their id.

    The pieces ``X#2``, ``X#3`` of a split call are the call ``X``; the id ``unknown`` and a null link
    nothing.
    """
    base = F.regexp_replace(F.col(call), r"#\d+$", "")
    once = calls.where(F.col(call).isNotNull() & (F.col(call) != "unknown")).where(F.col(call) == base).groupBy(*key, base.alias("_base")).agg(F.count("*").alias("_n"))
    rows = results.withColumn("_base", base).join(once, [*key, "_base"], "left")
    return rows.withColumn("linked", F.coalesce(F.col("_n") == 1, F.lit(False))).drop("_base", "_n")


def link_launches(threads: DataFrame, calls: DataFrame, key: str, launch: str, call: str, value: str) -> DataFrame:
    """Adds to threads the value of the call that launched them, where the session has one such call."""
    once = calls.groupBy(key, F.col(call).alias(launch)).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return threads.join(once, [key, launch], "left")


def as_of(events: DataFrame, starts: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """For each event the value of the latest start of its key strictly before it, or null.

    Both sides go in one sorted window, so no pairs are made.
    """
    left = events.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*events.columns).alias("_event"), F.lit(None).cast(starts.schema[value].dataType).alias("_value"))
    right = starts.select(key, F.col(start).alias("_at"), F.lit(2).alias("_side"), F.lit(None).cast(left.schema["_event"].dataType).alias("_event"), F.col(value).alias("_value"))
    # an event comes before a start of the same time, which is not strictly before it
    order = Window.partitionBy(key).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.unionByName(right).withColumn("linked", F.last("_value", ignorenulls=True).over(order))
    return rows.where("_side = 1").select("_event.*", "linked")


def running_receivers(messages: DataFrame, starts: DataFrame, key: str, at: str) -> DataFrame:
    """For each message (key, at, recipient, sender) the thread that its recipient names: of the threads
    that started strictly before it with that name, and aren't the sender's own, the latest; or null.

    Starts are (key, at, thread, names). Each start also knows the latest other thread before it of the same
    name, so one sorted union finds both, and no pairs are made.
    """
    named = starts.select(key, F.col(at).alias("_at"), "thread", F.explode(F.array_distinct("names")).alias("recipient"))
    order = Window.partitionBy(key, "recipient").orderBy("_at", "thread")
    before = F.lag("thread").over(order)
    named = named.withColumn("_left", F.when(before != F.col("thread"), before))
    other = F.last("_left", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = named.select(key, "recipient", "_at", F.struct("thread", other.alias("other")).alias("_found"))
    rows = messages.withColumn("_named", F.struct(F.col(key), F.col("recipient")))
    linked = as_of(rows, named.withColumn("_named", F.struct(F.col(key), F.col("recipient"))), "_named", at, "_at", "_found")
    thread = F.when(F.col("linked.thread") == F.col("sender"), F.col("linked.other")).otherwise(F.col("linked.thread"))
    return linked.withColumn("thread", thread).drop("linked", "_named")


def run_activity(calls: DataFrame, key: list[str]) -> DataFrame:
    """(key, activity) of (key, tool, commands) calls of runs: a sentence that counts each kind, a shell call
    once for each of its commands. What the user ran counts as a shell command."""
    tool = F.when(F.col("tool") == "UserShell", "Shell").otherwise(F.col("tool"))
    n = F.when(tool == "Shell", F.greatest(F.coalesce("commands", F.lit(1)), F.lit(1))).otherwise(1).cast("long")
    counted = calls.groupBy(*key, tool.alias("tool")).agg(F.sum(n).alias("n"))
    return counted.groupBy(*key).agg(activity(F.collect_list(F.struct("tool", "n"))).alias("activity"))


def inherit(rows: DataFrame, key: list[str], order: str, time: str, start: str | None = None) -> DataFrame:
    """Rows without a time take that of the row before them in their thread, or else the thread's start."""
    by = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(time, ignorenulls=True).over(by)
    return rows.withColumn(time, last if start is None else F.coalesce(last, F.col(start)))


def splice(parents: DataFrame, children: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """Merges children into their parents' sequence: a child goes before the first parent that is
    strictly later, ties after the parent, leftovers last. Adds place (from 1) and origin.

    Parents keep their order, whatever their times; children are sorted by time. The first parent later
    than a child is the first at which the parents' greatest time so far is later, so that maximum puts
    both into one sorted union. Parents without a time pull no child; children take the time of the
    child before them, and without any come last.
    """
    columns = [key, order, time]
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.max(time).over(by)
    first = parents.select(*columns, F.lit(0).alias("_child"), F.when(high.isNull(), 0).otherwise(1).alias("_part"), high.alias("_at"))
    later = inherit(children.select(*columns, F.col(time).alias("_at")), [key], order, "_at")
    then = later.select(*columns, F.lit(1).alias("_child"), F.when(F.col("_at").isNull(), 2).otherwise(1).alias("_part"), "_at")
    place = F.row_number().over(Window.partitionBy(key).orderBy("_part", "_at", "_child", order)).cast("long")
    both = first.unionByName(then).withColumn("place", place)
    return both.withColumn("origin", F.when(F.col("_child") == 1, "child").otherwise("parent")).drop("_child", "_part", "_at")


def runs(rows: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """Numbers neighbouring rows of one kind: (…, run) from 1 for each key."""
    by = Window.partitionBy(key).orderBy(*order)
    change = (F.lag(kind).over(by).isNull() | (F.lag(kind).over(by) != F.col(kind))).cast("long")
    return rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_change")


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before them of the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def newest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def newer_wins(newer: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """All newer rows, and the older ones whose key no newer row has."""
    return newer.unionByName(older.join(newer.select(key).distinct(), key, "left_anti").select(newer.columns))


def unique_prefixes(ids: DataFrame, column: str, least: int = 12) -> DataFrame:
    """Each hexadecimal id with its shortest prefix, ``least`` at least, that no neighbour shares.

    Ids are dealt by their first two digits, so that the order isn't made in one task; ids in
    different parts differ before ``least``.
    """
    by = Window.partitionBy(F.left(F.col(column), F.lit(2))).orderBy(column)

    def common(other: Column) -> Column:
        places = F.sequence(F.lit(1), F.lit(64))
        same = F.filter(places, lambda n: (n <= F.length(column)) & (F.left(F.col(column), n) == F.left(other, n)))
        return F.when(other.isNull(), 0).otherwise(F.size(same))

    rows = ids.withColumn("_a", F.lag(column).over(by)).withColumn("_b", F.lead(column).over(by))
    size = F.greatest(common(F.col("_a")) + 1, common(F.col("_b")) + 1, F.lit(least))
    return rows.withColumn("prefix", F.left(F.col(column), size)).drop("_a", "_b")


def branch(nodes: DataFrame, tree: str, node: str, parent: str, order: str) -> DataFrame:
    """The branch that ends at each tree's last node: (tree, node, depth from the end).

    It stops at a root, at a parent outside the tree, or where it would close a cycle. Pointers are
    doubled: each round joins the jump table with itself, so a branch of any length takes as many rounds
    as its length has binary digits, and every round starts from a written table.
    """
    known = nodes.select(tree, F.col(node).alias("_up"))
    jump = nodes.select(tree, F.col(node).alias("_node"), F.col(parent).alias("_up")).where(F.col(parent).isNotNull()).join(known, [tree, "_up"], "left_semi")
    jump = settle(jump.select(tree, "_node", "_up"))
    found = settle(nodes.groupBy(tree).agg(F.max_by(node, order).alias(node)).withColumn("depth", F.lit(0).cast("long")))
    longest = nodes.groupBy(tree).count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest and not jump.isEmpty():
        step = jump.withColumnRenamed("_node", node)
        further = found.join(step, [tree, node]).select(tree, F.col("_up").alias(node), (F.col("depth") + reach).alias("depth"))
        # on a cycle a node is met again, farther away
        found = settle(found.unionByName(further).groupBy(tree, node).agg(F.min("depth").alias("depth")))
        jump = settle(step.join(jump.select(tree, F.col("_node").alias("_up"), F.col("_up").alias("_far")), [tree, "_up"]).select(tree, F.col(node).alias("_node"), F.col("_far").alias("_up")))
        reach *= 2
    return found


def rollout_chain(rollouts: DataFrame) -> DataFrame:
    """(thread, rollout_id, depth, end) of (thread, ts, rollout_id, base_id, base_end): each thread's newest
    rollout, and those that it and its bases go on from, each read up to the byte where the next one took
    over. A base that isn't there, or that closes a cycle, ends the chain."""
    rows = rollouts.withColumn("_order", F.struct("ts", "rollout_id"))
    on = branch(rows, "thread", "rollout_id", "base_id", "_order")
    known = on.join(rollouts.select("thread", "rollout_id", "base_end"), ["thread", "rollout_id"])
    end = F.lag("base_end").over(Window.partitionBy("thread").orderBy("depth"))
    return known.select("thread", "rollout_id", "depth", end.alias("end"))
