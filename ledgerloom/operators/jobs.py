"""A table of jobs as a state machine: pending (or queued), processing, completed or failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOVES = {"pending": {"processing"}, "queued": {"processing"}, "processing": {"completed", "failed", "pending"}, "completed": set(), "failed": set()}
RETRIES = 3


def next_pending(jobs: DataFrame) -> DataFrame:
    """TOP-05: the oldest job that waits."""
    return jobs.where(F.col("status").isin("pending", "queued")).orderBy("created_at", "id").limit(1)


def moved(jobs: DataFrame, job_id, was: str, now: str) -> DataFrame:
    """MDL-17: compare and set: only a job in state `was` moves; others stay as they are."""
    if now not in MOVES.get(was, set()):
        raise ValueError(f"a job can't go from {was} to {now}")
    hit = (F.col("id") == job_id) & (F.col("status") == was)
    return jobs.withColumn("status", F.when(hit, now).otherwise(F.col("status")))


def failed_or_retried(jobs: DataFrame, job_id) -> DataFrame:
    """A failing job waits again until it has failed RETRIES times."""
    hit = (F.col("id") == job_id) & (F.col("status") == "processing")
    tries = F.col("attempts") + 1
    return jobs.withColumns({"status": F.when(hit, F.when(tries < RETRIES, "pending").otherwise("failed")).otherwise(F.col("status")), "attempts": F.when(hit, tries).otherwise(F.col("attempts"))})


def latest(jobs: DataFrame) -> DataFrame:
    """WIN-06"""
    rest = [c for c in jobs.columns if c not in ("user_id", "created_at")]
    return jobs.groupBy("user_id").agg(F.max(F.struct("created_at", *rest)).alias("j")).select("user_id", "j.*")


def stops_early(metrics: list[float], patience: int = 10) -> bool:
    """WIN-09: no better value among the last `patience`."""
    return len(metrics) > patience and min(metrics[-patience:]) >= min(metrics[:-patience])
