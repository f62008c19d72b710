"""A ledger with a unique key: Parquet batches that are bucketed by the key, each registered by one rename.

Rows are stored with `row_key`, a hash of the key columns that tells nulls apart, and bucketed by it. So what is to be
added meets the ledger bucket by bucket: only the new rows are shuffled, and of the ledger only row_key is read.

A batch is written to a folder of its own that no reader looks into, and then renamed to the next number. The rename takes
no target that exists: of two writers that saw the same ledger one gets the number, and the other compares its rows
with what has come and tries the next. A write that stops half way leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import re
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "row_key"
BUCKETS = 32
_RENAMING = threading.Lock()


def row_key(keys: list[str]) -> Column:
    """128 bits and more of the key columns: equal for equal values, nulls being equal to nulls."""
    parts = [x for k in keys for x in (F.col(k).isNull().cast("string"), F.length(F.coalesce(F.col(k).cast("string"), F.lit(""))).cast("string"), F.coalesce(F.col(k).cast("string"), F.lit("")))]
    return F.sha2(F.concat_ws("|", *parts), 256)


class Ledger:
    """Rows at a path with unique keys. `buckets` holds for a new ledger; one that exists keeps its own."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.name = f"ledger_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self._held_buckets() or buckets

    def _held_buckets(self) -> int | None:
        found = self._fs.globStatus(self._hadoop.Path(f"{self.path}/_buckets=*"))
        return int(found[0].getPath().getName().partition("=")[2]) if found else None

    def batches(self) -> list[int]:
        """The numbers of the registered batches."""
        found = self._fs.globStatus(self._hadoop.Path(f"{self.path}/batch=*")) or []
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"batch=(\d+)", f.getPath().getName())))

    def _stored(self, batches: list[int]) -> DataFrame | None:
        """The batches with row_key, as one bucketed table; the session's catalog knows it by a name made of the path."""
        if not batches:
            return None
        spark = self.spark
        schema = spark.read.parquet(f"{self.path}/batch={batches[0]}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        known = {r[0] for r in spark.sql(f"SHOW PARTITIONS {self.name}").collect()}
        if new := [f"PARTITION (batch={n})" for n in batches if f"batch={n}" not in known]:
            spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {' '.join(new)}")
        return spark.table(self.name).where(F.col("batch") <= batches[-1])

    def table(self) -> DataFrame | None:
        """All rows, or None before there are any."""
        held = self._stored(self.batches())
        return None if held is None else held.drop(KEY, "batch")

    def fresh(self, incoming: DataFrame, order: str, batches: list[int] | None = None) -> DataFrame:
        """The incoming rows, with row_key, whose key the ledger doesn't hold, the first of each by `order` (null last)."""
        rows = incoming.withColumn(KEY, row_key(self.keys))
        rest = [c for c in rows.columns if c != KEY]
        held = self._stored(self.batches() if batches is None else batches)
        if held is not None:
            rows = rows.join(held.select(KEY), KEY, "left_anti")
        best = rows.groupBy(KEY).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order)).alias("r"))
        return best.select(KEY, *[F.col(f"r.`{c}`").alias(c) for c in rest])

    def _stage(self, rows: DataFrame) -> str:
        """Writes rows where no reader looks; the folder."""
        folder, name = f"{self.path}/_staged/{uuid.uuid4().hex}", f"staged_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY).option("path", folder).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return folder

    def _register(self, folder: str, batch: int) -> bool:
        """Renames a staged folder to a batch; False if there is such a batch already."""
        path = self._hadoop.Path
        uri = self._fs.makeQualified(path(self.path)).toUri()
        context = self._hadoop.FileContext.getFileContext(uri, self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = lambda p: self._fs.makeQualified(path(p))
        with _RENAMING:  # a local file system looks and renames in two steps
            if self._fs.exists(path(f"{self.path}/batch={batch}")):
                return False
            try:
                context.rename(qualified(folder), qualified(f"{self.path}/batch={batch}"), none)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
        return True

    def append(self, incoming: DataFrame, order: str) -> DataFrame:
        """Adds the rows whose key is new; the rows added."""
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/_buckets={self.buckets}"))
        rows = incoming
        while True:
            seen = self.batches()
            fresh = self.fresh(rows, order, seen)
            folder = self._stage(fresh)
            staged = self.spark.read.schema(fresh.schema).parquet(folder)
            if staged.isEmpty():
                self._fs.delete(self._hadoop.Path(folder), True)
                return incoming.limit(0)
            number = (seen[-1] if seen else 0) + 1
            if self._register(folder, number):
                return self.spark.read.parquet(f"{self.path}/batch={number}").select(incoming.columns)
            rows = staged.drop(KEY)  # another batch has come meanwhile


def held(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """All rows of a ledger that has some."""
    found = Ledger(spark, path, keys).table()
    if found is None:
        raise ValueError(f"no ledger at {path}")
    return found
