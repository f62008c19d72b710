"""Scans of what has changed since the last run, with a mark that is kept.

A run first writes down which interval of time it is about to hand out, and the mark moves only when the run says that it
is done. A run that stopped in between is taken up with its own interval, so its rows come again as they were, under the same
number, and no row is left out or handed out under two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Changes:
    """Manual changes of a ledger by `column`; marks are files in a folder, one to each run that began and one to each that ended."""

    SCHEMA = "run long, done boolean, low timestamp, high timestamp"

    def __init__(self, spark: SparkSession, folder: str, column: str = "updated_at"):
        self.spark, self.folder, self.column = spark, folder.rstrip("/"), column
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def marks(self) -> DataFrame:
        self._fs.mkdirs(self._hadoop.Path(self.folder))
        return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", True).parquet(self.folder)

    def _put(self, run: int, done: bool, low, high) -> None:
        self.spark.createDataFrame([(run, done, low, high)], self.SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/{run}-{'done' if done else 'begun'}")

    def begin(self, df: DataFrame) -> tuple[int, DataFrame] | None:
        """The number and the rows of the next run, or of one that began and didn't end; None if nothing has changed.

        The rows are manual ones after the last mark, up to the newest at hand; null times never count as changed.
        """
        manual = df.where("is_manual")
        last = self.marks().groupBy("run").agg(F.max("done").alias("done"), F.max("low").alias("low"), F.max("high").alias("high")).orderBy(F.desc("run")).first()
        if last is not None and not last["done"]:
            run, low, high = last["run"], last["low"], last["high"]
        else:
            run, low = (1, None) if last is None else (last["run"] + 1, last["high"])
            high = manual.where(F.lit(True) if low is None else F.col(self.column) > F.lit(low)).agg(F.max(F.col(self.column).cast("timestamp"))).first()[0]
            if high is None:
                return None
            self._put(run, False, low, high)
        after = F.lit(True) if low is None else F.col(self.column) > F.lit(low)
        return run, manual.where(after & (F.col(self.column) <= F.lit(high)))

    def done(self, run: int) -> None:
        """Moves the mark past a run that has begun."""
        begun = self.marks().where((F.col("run") == run) & ~F.col("done")).first()
        if begun is None:
            raise ValueError(f"run {run} hasn't begun")
        self._put(run, True, begun["low"], begun["high"])
