"""Decisions about keyed streams: a rate limiter, and the life of jobs with leases and retries.

Both keep a little state for each key with transformWithState. Rows of a key are taken in order of time and id within a micro-batch;
across batches a row that is earlier than what was decided already is decided against what is still known.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = 1_000_000


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class _Limiter(StatefulProcessor):
    """Allows a user's request if fewer than `most` came in the `seconds` before it; the newest `most` times are all it takes."""

    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, seconds * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", _longs("at"))

    def decide(self, held: list[int], at: int) -> tuple[bool, list[int]]:
        """Whether a request at `at` is allowed after those held, and what is held then."""
        before = [x for x in held if at - self.span < x <= at]
        return len(before) < self.most, sorted([*held, at])[-self.most :]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = sorted(int(x[0]) for x in self.times.get())
        allowed = []
        for at in pdf["at"].tolist():
            allow, held = self.decide(held, at)
            allowed.append(allow)
        newest = held[-1]
        self.times.put([(x,) for x in held if x > newest - self.span])
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "user_id": key[0], "allowed": allowed})

    def close(self) -> None:
        pass


def limited(stream: DataFrame, time: str, most: int, seconds: int = 60) -> DataFrame:
    """STR-07: (id, user_id, allowed) of each request (id, user_id, time) by a sliding window over all requests of its user.

    Requests of a user at one time are taken by id. One that comes in a later batch than newer ones is decided by those of its
    span that are still kept: the newest `most`, of the span before the newest. Rows without a time are left out.
    """
    rows = stream.select("user_id", "id", F.unix_micros(F.col(time).cast("timestamp")).alias("at")).where("at is not null")
    return rows.groupBy("user_id").transformWithStateInPandas(_Limiter(most, seconds), "id long, user_id long, allowed boolean", "Append", "None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start in it keep their state in RocksDB, which transformWithState asks for."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Job(StatefulProcessor):
    """A job's life: submitted, claimed, heartbeat, completed, failed; a claim is a lease that lapses."""

    def __init__(self, lease: int, retry: int, tries: int):
        self.lease, self.retry, self.tries = lease * _MICROS, retry * _MICROS, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", StructType([StructField("status", StringType()), StructField("attempts", LongType()), StructField("until", LongType()), StructField("seen", LongType())]))

    def lapse(self, job: tuple, now: int) -> tuple:
        """What time alone has done to a job by `now`: a lapsed lease is a failure, and a failed job waits until its retry."""
        status, attempts, until, seen = job
        if status == "processing" and now > until:
            status, until = ("waiting", until + self.retry) if attempts < self.tries else ("failed", 0)
        if status == "waiting" and now >= until:
            status, until = "pending", 0
        return status, attempts, until, seen

    def step(self, job: tuple | None, event: str, at: int, i: int) -> tuple | None:
        """A job after an event; what doesn't fit its state, or is not newer than what was seen, changes nothing."""
        if job is None:
            return ("pending", 0, 0, i) if event == "submitted" else None
        if i <= job[3]:
            return job
        status, attempts, until, _ = self.lapse(job, at)
        if event == "claimed" and status == "pending":
            status, attempts, until = "processing", attempts + 1, at + self.lease
        elif event == "heartbeat" and status == "processing":
            until = at + self.lease
        elif event == "completed" and status == "processing":
            status, until = "completed", 0
        elif event == "failed" and status == "processing":
            status, until = ("waiting", at + self.retry) if attempts < self.tries else ("failed", 0)
        return status, attempts, until, i

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # jobs are many and have few events each: plain rows, as a frame of its own for each would be most of the work
        events = sorted(((r["at"], r["id"], r["event"]) for r in rows), key=lambda e: e[:2])
        before = job = self.state.get()
        for at, i, event in events:
            job = self.step(job, event, at, i)
        if job is not None:
            if job != before:
                self.state.update(job)
            yield Row(job_id=key[0], status=job[0], attempts=job[1], last_id=max(i for _, i, _ in events))

    def close(self) -> None:
        pass


def job_states(stream: DataFrame, lease: int = 300, retry: int = 60, tries: int = 3) -> DataFrame:
    """STR-01, MDL-17: each job's state and attempts after each batch of its events (id, job_id, event, ts), ids rising with time.

    A claim counts only for a pending job and holds for `lease` seconds, which heartbeats renew; a job that fails, or whose lease
    lapses, waits `retry` seconds for its next claim, `tries` in all. Events that a replay repeats change nothing. `last_id` orders the states of a job.
    """
    rows = stream.select("job_id", "id", "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("at is not null and id is not null")
    return rows.groupBy("job_id").transformWithState(_Job(lease, retry, tries), "job_id long, status string, attempts long, last_id long", "Update", "None")
