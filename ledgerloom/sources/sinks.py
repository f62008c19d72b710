"""Writers: idempotent appends, exports, deletions, and a manifest of fitted models."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger_store import Ledger


def append_new(incoming: DataFrame, path: str, keys: list[str], order: str) -> DataFrame:
    """SNK-01 to 03: appends what the ledger at `path` doesn't hold; the rows appended. They come in whole or not at all, and once, whoever else writes."""
    return Ledger(incoming.sparkSession, path, keys).append(incoming, order)


def export_csv(df: DataFrame, path: str) -> None:
    """SNK-04, CSV-01: date, description, merchant, category, amount and type, newest first, quoted where needed."""
    out = df.select("transaction_date", "description", "merchant_name", "category", "amount", F.coalesce("type", F.lit("expense")).alias("type"))
    out.orderBy(F.desc("transaction_date")).write.csv(path, header=True, quote='"', escape='"')


def csv_field(c: str):
    """CSV-01: one field: in quotes if it holds a comma, a quote or a line break."""
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def without_user(df: DataFrame, user_id) -> DataFrame:
    """SNK-06: what stays when a user goes."""
    return df.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def append_corrections(df: DataFrame, path: str) -> None:
    """SNK-07"""
    df.select("user_id", "description", "original_category", "corrected_category").write.mode("append").parquet(path)


class ModelStore:
    """SNK-08 to 10: fitted models: id, when, metric and parameters, a folder each; the latest, the best, and a bounded number kept."""

    SCHEMA = "saved_at double, metric double, parameters string, model_id string"

    def __init__(self, spark: SparkSession, path: str, keep: int = 5):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def save(self, parameters: dict, metric: float) -> str:
        """Saves a model; those older than the last `keep` go."""
        name = uuid.uuid4().hex
        row = self.spark.createDataFrame([(time.time(), float(metric), json.dumps(parameters))], "saved_at double, metric double, parameters string")
        row.coalesce(1).write.parquet(f"{self.path}/model_id=m{name}")
        old = self.table().orderBy(F.desc("saved_at")).offset(self.keep).select("model_id").collect()
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for r in old:
            at = fs.Path(f"{self.path}/model_id={r['model_id']}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return f"m{name}"

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def holds(self) -> bool:
        """Whether a model has been saved."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = files.Path(f"{self.path}/model_id=*/*.parquet")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return found is not None and len(found) > 0

    def listing(self) -> DataFrame:
        """Newest first, with their size in MB."""
        return self.table().orderBy(F.desc("saved_at")).withColumn("mb", F.round(F.length("parameters") / 1e6, 2))

    def latest(self) -> dict | None:
        row = self.table().orderBy(F.desc("saved_at")).first()
        return row and json.loads(row["parameters"])

    def best(self) -> dict | None:
        row = self.table().orderBy("metric").first()
        return row and json.loads(row["parameters"])
