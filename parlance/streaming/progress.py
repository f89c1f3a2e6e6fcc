"""Progress of long reads and their cancellation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Seconds until the first report and between reports.
FIRST, EVERY = 2.0, 5.0


class Ticker:
    """Tells when to report: after two seconds, then every five."""

    def __init__(self, report: Callable[[dict], None], clock: Callable[[], float] = time.monotonic):
        self.report, self.clock = report, clock
        self.due, self.done = clock() + FIRST, 0

    def tick(self, rows: int, **facts: object) -> bool:
        self.done += rows
        if self.clock() < self.due:
            return False
        self.due = self.clock() + EVERY
        self.report({"rows": self.done, **facts})
        return True


class Progress(StreamingQueryListener):
    """Reports the rows that a stream has read."""

    def __init__(self, report: Callable[[dict], None]):
        self.ticker = Ticker(report)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.ticker.tick(event.progress.numInputRows, batch=event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Latest:
    """Requests of which a newer one ends the older: each runs under a tag of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.number = spark, name, 0

    def run(self, action: Callable[[], object]) -> object | None:
        """The action's result, or None if a newer request came meanwhile."""
        self.cancel()
        mine, tag = self.number, f"{self.name}-{self.number}"
        self.spark.addTag(tag)
        try:
            found = action()
        except Exception:
            if mine != self.number:
                return None
            raise
        finally:
            self.spark.removeTag(tag)
        return found if mine == self.number else None

    def cancel(self) -> None:
        self.spark.interruptTag(f"{self.name}-{self.number}")
        self.number += 1
