"""Tables that a loop writes between its rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(frame: DataFrame) -> DataFrame:
    """Writes ``frame`` to the shared checkpoint folder and cuts its lineage.

    A cluster names the folder in spark.checkpoint.dir; only a local session gets one of its own. The
    checkpoint is read as a plain table: the estimated size that it would keep is the product of the
    sizes of all that were joined for it, which grows beyond all bounds in a loop.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="parlance-"))
    done = frame.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
