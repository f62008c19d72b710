"""Tables in the shared folder, and batch-wise maps over Arrow data."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import staging

SLICE_BYTES = 2 << 20
#: Spark contexts that have the package.
_SHIPPED: list = []


#: Folders made since the innermost temporary() began, for it to remove.
_MADE: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = staging.fresh_path(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the folders that were made in it: for results that are written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _MADE.pop():
            at = fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of df, in which case doesn't count."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers where their path doesn't lead to it already."""
    root = Path(__file__).resolve().parents[2]
    if root in {Path.cwd(), *(Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)} or spark.sparkContext in _SHIPPED:
        return
    package = f"{tempfile.mkdtemp(prefix='ledgerloom-')}/ledgerloom.zip"
    with zipfile.ZipFile(package, "w") as z:
        for f in sorted((root / "ledgerloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(package)
    _SHIPPED.append(spark.sparkContext)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of the column; a longer value stays whole, alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
            col = col.cast(pa.string())
            batch = batch.set_column(at, column, col)
        # offsets of this batch's values, without copying the data
        import numpy as np

        ofs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        i = 0
        while i < n:
            j = int(np.searchsorted(ofs, ofs[i] + most, side="right")) - 1
            j = min(n, max(i + 1, j))
            yield batch.slice(i, j - i)
            i = j


def release() -> None:
    """Gives memory that is free back to the system: a worker outlives its tasks, and what it keeps counts for its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size; fn returns a batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, most):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
        release()

    return df.mapInArrow(run, schema)
