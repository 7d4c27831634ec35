"""The scan over a stream of hits: repeats dropped within a watermark, progress told, and a way to stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lodesieve.operators import scan as S


def stream_findings(hits: DataFrame, lateness: str = "10 minutes", heuristics: bool = False) -> DataFrame:
    """``hits`` has id, index, message and the event time ts; an id that comes again within ``lateness`` counts once."""
    once = hits.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])
    return S.gated(S.findings(S.scan(once)), heuristics=heuristics)


def write_findings(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append findings to a Parquet folder, with what is there now, then stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Progress(StreamingQueryListener):
    def __init__(self, told: Callable[[int], None]) -> None:
        self.told, self.rows = told, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        try:
            self.told(self.rows)
        except Exception as error:  # a failing callback never ends a scan
            print(f"progress callback: {error}")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


@contextmanager
def progress(spark: SparkSession, told: Callable[[int], None]) -> Iterator[None]:
    """Tells after every batch how many hits have been read so far."""
    listener = _Progress(told)
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        spark.streams.removeListener(listener)


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[None]:
    """Batch scans of this thread inside can be ended by ``cancel`` with the same name, from another thread."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, name: str) -> None:
    """Ends the scans under a name; they fail, and what they have written stays."""
    spark.sparkContext.cancelJobGroup(name)
