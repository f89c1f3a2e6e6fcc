"""Session helpers the operators share: shared-folder checkpoints, Arrow batch size, input columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts are long, so Spark's default of 10,000 would hold tens of MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the checkpoint folder where none is set, and bounds Arrow batches.

    A cluster names its shared folder in spark.checkpoint.dir; only a local session gets one of its own.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="parlance-checkpoint-"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def settle(frame: DataFrame, plain: bool = False) -> DataFrame:
    """Writes ``frame`` to the shared checkpoint folder and cuts its lineage.

    A checkpoint keeps its plan's partitioning, and its estimated size, which is the product of the
    sizes of all that were joined for it: in a loop of joins it soon has millions of digits, which the
    planner multiplies. ``plain`` forgets both.
    """
    spark = prepare(frame.sparkSession)
    done = frame.checkpoint(eager=True)
    if not plain:
        return done
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are checkpointed.

    The Python side tells the JVM in the background what it no longer holds, so each step waits.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table with any other columns; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


#: The most parts that the rows of a key are dealt to.
PARTS = 64


def part(column: str) -> Column:
    """The part of its key that a row belongs to, by the value of ``column``."""
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def parts_mask() -> Column:
    """The parts that occur in a group with a column ``part``: a bit each, so it is summed before it is shuffled."""
    return F.bit_or(F.expr("shiftleft(1L, part)"))


def each_part(mask: str) -> Column:
    """A row for each part of a mask. A table with one row for a key then joins rows of the key, however
    many there are, on key and part, and no task has all of them."""
    return F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), i -> (shiftright({mask}, i) & 1L) = 1L)"))


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    column = column.combine_chunks()
    if not isinstance(column, pa.ChunkedArray):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def give_back() -> None:
    """Returns memory that this Python worker no longer uses, as Spark keeps idle workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(task: Callable) -> Callable:
    """A generator of Arrow batches, or a function of Arrow tables, after which its worker gives memory back."""

    @functools.wraps(task)
    def stream(batches: Iterable) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return stream


def chunks(batches: Iterable, most: int = 1 << 20) -> Iterator:
    """Joins small Arrow batches, and splits large ones, to about ``most`` bytes each."""
    held, size = [], 0
    for batch in batches:
        if batch.nbytes > 2 * most and batch.num_rows > 1:
            step = max(1, batch.num_rows * most // batch.nbytes)
            parts = [batch.slice(i, step) for i in range(0, batch.num_rows, step)]
        else:
            parts = [batch]
        for part in parts:
            held.append(part)
            size += part.get_total_buffer_size() if len(parts) == 1 else most
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
