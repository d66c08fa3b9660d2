"""Pattern queries over a stream of token files against a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from colweave.functions.scratch import settle


class PatternProgress(StreamingQueryListener):
    """Hears of the batches of pattern streams: ``batches`` has (batch, patterns, different ones) of each that had any."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int, int]] = []
        self.failed: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("patterns")
        if seen is not None and seen["patterns"]:
            self.batches.append((event.progress.batchId, seen["patterns"], seen["different"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)


def pattern_stream(spark: SparkSession, folder: str) -> DataFrame:
    """pattern: tokens of the text files that arrive in ``folder``."""
    return spark.readStream.format("text").load(folder).select(F.explode(F.split("value", r"\s+")).alias("pattern")).where("pattern <> ''")


def answer(patterns: DataFrame, find: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Append the answers of every micro-batch to the Parquet folder ``sink``; each batch rewrites its own part, so that a replay leaves no doubles.

    A batch is read once: its different patterns are written before ``find`` asks for them,
    as often as it does.  ``PatternProgress`` hears of their number, the different ones
    estimated (within some hundredths).
    """

    def write(batch: DataFrame, epoch: int) -> None:
        find(settle(batch.distinct(), "asked")).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    seen = patterns.observe("patterns", F.count(F.lit(1)).alias("patterns"), F.approx_count_distinct("pattern").alias("different"))
    return seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
