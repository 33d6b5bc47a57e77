"""Progress feeds (D18, S-1, S-2, F25): JSON lines, of which malformed ones are passed over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "progress string, show boolean, quit boolean, done boolean"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with progress, of well-formed messages that have one."""
    got = lines.withColumn("m", F.from_json(column, MESSAGE))
    return got.where("m.progress is not null").withColumn("progress", F.col("m.progress")).drop("m", column)


def routed(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with route: show, quit, done, progress, or ignore for all else."""
    got = lines.withColumn("m", F.from_json(column, MESSAGE))
    route = F.when(F.col("m.quit"), "quit").when(F.col("m.show"), "show").when(F.col("m.done"), "done").when(F.col("m.progress").isNotNull(), "progress").otherwise("ignore")
    return got.withColumn("route", route).drop("m")


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of files that come to a folder, as a stream."""
    return parsed(spark.readStream.text(folder))


def polled(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each new batch to a function, at an interval or, without one, until all that is there is read."""
    writer = feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
