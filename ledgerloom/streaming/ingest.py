"""Streams: idempotent ingestion of transactions, daily spend, rates, and a queue of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.sinks import append_new


class Progress(StreamingQueryListener):
    """STR-06: says each tenth of `total` rows that the session's streams have come past, and 100 at their end."""

    def __init__(self, total: int, say: Callable[[int], None]):
        self.total, self.say, self.rows, self.said = total, say, 0, 0

    def seen(self, rows: int) -> None:
        self.rows += rows
        tenth = min(100, 100 * self.rows // max(1, self.total)) // 10 * 10
        if tenth > self.said:
            self.said = tenth
            self.say(tenth)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen(event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:
        self.seen(max(0, self.total - self.rows))


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """STR-03: the first row of each key within the watermark; state is bounded by `late`. Later repeats meet the sink's anti-join."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def daily_spend(stream: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Tumbling days: spend and income by user, given out once the watermark has passed the day. Days that it hasn't passed stay open, for the next run."""
    day = stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), "user_id")
    return day.agg(F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0)).alias("spend"), F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("income")).select("user_id", F.to_date("window.start").alias("date"), "spend", "income")


def request_rate(stream: DataFrame, time: str, size: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """STR-07: requests of each user in sliding windows."""
    return stream.withWatermark(time, size).groupBy(F.window(time, size, step), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def category_totals(stream: DataFrame) -> DataFrame:
    """STR-08: totals by user and category, for complete output."""
    return stream.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


def ingest(spark: SparkSession, source: str, schema: str, ledger: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """STR-01 to 03: files that are new since the checkpoint, in micro-batches, appended to the ledger if it doesn't hold them."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, ledger, keys, order)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
