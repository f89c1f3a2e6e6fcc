"""Files of agents: a walk of their folders, with sizes and times, and which are sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where below its folder each agent keeps sessions.
LAYOUTS = {
    "claude": r"^[^/]+/[^/]+\.jsonl$", "codex": r"^(?:sessions/\d{4}/\d{2}/\d{2}|archived_sessions)/rollout-[^/]+\.jsonl$", "kimi": r"^[^/]+/[^/]+/(?:agents/[^/]+/)?wire\.jsonl$",
    "grok": r"^[^/]+/[^/]+/updates\.jsonl$", "pi": r"^[^/]+/[^/]+\.jsonl$", "omp": r"^[^/]+/[^/]+\.jsonl$",
}


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, size, modified) of all files below a folder; their contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified"))


def discover(found: DataFrame, root: str, agent: str) -> DataFrame:
    """Adds below (the path below the folder), session (whether it's where sessions are) and subagent."""
    below = F.regexp_replace(F.col("path"), "^.*?" + _escaped(root.rstrip("/")) + "/", "")
    rows = found.withColumn("below", below)
    subagent = F.col("below").rlike(r"(?:^|/)(?:subagents/|agent-[^/]+\.jsonl$)")
    return rows.withColumns({"session": F.col("below").rlike(LAYOUTS[agent]) & ~subagent, "subagent": subagent})


def _escaped(text: str) -> str:
    return r"\Q" + text + r"\E"
