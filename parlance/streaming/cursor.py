"""Reading what was added: cursors, rewritten files, resumed folds, diffs, appends and generations.

Lines are those of ``sources.jsonl.read_lines``; cursors are a small table with a row for each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes before a cursor that tell whether a file was rewritten.
CHECKED = 4096


def _tail(lines: DataFrame) -> DataFrame:
    """(path, digest) of the lines that end in the last bytes before the cursor of (…, at) rows."""
    near = lines.where((F.col("end") <= F.col("at")) & (F.col("end") > F.col("at") - CHECKED))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    return near.groupBy("path").agg(F.sha2(text, 256).alias("digest"))


def cursors(lines: DataFrame) -> DataFrame:
    """(path, at, line, digest): the byte and line after the last whole line of each file, and the digest of
    what stands before it. A line without its line feed isn't whole."""
    whole = lines.where("terminated")
    ends = whole.groupBy("path").agg(F.max("end").alias("at"), F.max("line").alias("line"))
    return ends.join(_tail(whole.join(ends.select("path", "at"), "path")), "path", "left")


def resume(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state, line): full for files without a cursor, rewritten for those that are shorter than it or
    differ before it, else resumed, and the line after which to read on."""
    now = lines.groupBy("path").agg(F.max("end").alias("size"))
    again = _tail(lines.join(known.select("path", "at"), "path"))
    rows = now.join(known, "path", "left").join(again.withColumnRenamed("digest", "found"), "path", "left")
    same = (F.col("size") >= F.col("at")) & F.coalesce(F.col("digest") == F.col("found"), F.col("digest").isNull() & F.col("found").isNull())
    state = F.when(F.col("at").isNull(), "full").when(same, "resumed").otherwise("rewritten")
    return rows.select("path", state.alias("state"), F.when(state == "resumed", F.col("line")).otherwise(0).cast("long").alias("line"))


def unread(lines: DataFrame, states: DataFrame) -> DataFrame:
    """The lines that a resumed read has to fold, with the state of their file."""
    rows = lines.join(states.withColumnRenamed("line", "_after"), "path")
    return rows.where(F.col("line") > F.col("_after")).drop("_after")


def stable_lines(entries: DataFrame, ends: DataFrame) -> DataFrame:
    """(path, line): the line up to which entries are settled: before the first call without a result, or
    the cursor."""
    answered = entries.where("kind = 'tool_result'").select("path", "call_id").distinct()
    waiting = entries.where("kind = 'tool_use' AND call_id IS NOT NULL").join(answered, ["path", "call_id"], "left_anti").groupBy("path").agg(F.min("line").alias("open"))
    return ends.select("path", "line").join(waiting, "path", "left").select("path", F.coalesce(F.col("open") - 1, F.col("line")).alias("line"))


def continued(entries: DataFrame, folded: DataFrame) -> DataFrame:
    """Files whose new entries go on with a reply that is folded already; they are read in full."""
    new = entries.where("reply_id IS NOT NULL").select("path", "reply_id").distinct()
    return new.join(folded.where("reply_id IS NOT NULL").select("path", "reply_id").distinct(), ["path", "reply_id"], "left_semi").select("path").distinct()


#: Facts of a fold that add up over parts of a transcript.
SUMS, FIRSTS, LASTS = ("message_count", "assistant_messages", "chars", "total_tokens"), ("first_second",), ("last_second",)


def merge_folds(before: DataFrame, after: DataFrame, key: str = "conv_id") -> DataFrame:
    """Checkpoints of folds with what was folded since: counts add up, the first stays, the last is replaced."""
    rows = before.withColumn("_part", F.lit(0)).unionByName(after.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    made = []
    for c in (c for c in before.columns if c != key):
        if c in SUMS:
            made.append(F.sum(c).cast("long").alias(c))
        elif c in FIRSTS:
            made.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_part"))).alias(c))
        else:
            made.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_part"))).alias(c))
    return rows.groupBy(key).agg(*made)


def digests(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds digest, of all columns but the key."""
    return rows.withColumn("digest", F.xxhash64(*sorted(c for c in rows.columns if c not in key and c != "id")))


def diff(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, change) between new rows and stored ones with ids: inserted, updated, deleted or kept.

    Rows of one key are one row; an unchanged or updated row keeps its id.
    """
    a = digests(new, key).select(*key, F.col("digest").alias("_new"))
    b = digests(stored, key).select(*key, "id", F.col("digest").alias("_old"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(F.col("_new") != F.col("_old"), "updated").otherwise("kept")
    return both.select(*key, "id", change.alias("change"))


def appended(entries: DataFrame, log: DataFrame, generation: int) -> DataFrame:
    """What a reader of a generation hasn't seen: entries from the first one that a later append wrote.

    The log is (conv_id, previous_generation, first_sequence); sessions without an append since then have
    nothing new.
    """
    first = log.where(F.col("previous_generation") >= generation).groupBy("conv_id").agg(F.min("first_sequence").alias("_first"))
    return entries.join(first, "conv_id").where(F.col("sequence") >= F.col("_first")).drop("_first")


def write_generation(frame: DataFrame, folder: str, generation: int) -> None:
    """Writes a table's next version; the pointer is written after it, so a reader sees a whole version."""
    frame.write.mode("overwrite").parquet(f"{folder}/data/generation={generation}")
    spark = frame.sparkSession
    spark.createDataFrame([(generation,)], "generation long").write.mode("append").parquet(f"{folder}/pointer")


def read_generation(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The newest whole version and its rows. A version that is read stays as it is while newer ones come."""
    newest = spark.read.parquet(f"{folder}/pointer").agg(F.max("generation")).first()[0]
    return newest, spark.read.parquet(f"{folder}/data/generation={newest}")


def newest_rows(rows: DataFrame, key: list[str], generation: str = "generation") -> DataFrame:
    """Of each key the row of the latest generation."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(generation)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
