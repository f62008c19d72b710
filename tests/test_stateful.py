"""The limiter, the life of jobs, and scans with a mark, against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import Row

from ledgerloom.sources.incremental import Changes
from ledgerloom.streaming import stateful as T

T0 = datetime.datetime(2026, 1, 1)
at = lambda s: T0 + datetime.timedelta(seconds=s)


def run(spark, tmp_path, batches, schema, make):
    """All rows that a stream gives out when each batch comes as a file of its own, the query starting anew for each."""
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        with T.keyed_state(spark):
            out = make(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
            out.writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_limiter_in_order(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((i, rng.randint(0, 3), at(rng.randint(0, 900))) for i in range(300)), key=lambda r: (r[2], r[0]))
    want = {i: sum(u2 == u and t - datetime.timedelta(seconds=60) < t2 and (t2, i2) < (t, i) for i2, u2, t2 in rows) < 4 for i, u, t in rows}
    # batches that keep equal times together
    cut = next(k for k in range(150, 300) if rows[k][2] != rows[k - 1][2])
    got = run(spark, tmp_path, [rows[:cut], rows[cut:] + [(999, 1, None)]], "id long, user_id long, ts timestamp", lambda s: T.limited(s, "ts", 4))
    assert {r.id: r.allowed for r in got} == want and len(got) == 300 and len(set(want.values())) == 2


def test_limiter_out_of_order():
    limiter = T._Limiter(2, 60)
    step = lambda held, s: limiter.decide(held, s * 1_000_000)
    ok, held = step([], 100)
    assert ok and len(held) == 1
    # earlier than what is known: decided by what lies before it
    ok, held = step(held, 50)
    assert ok and [x // 1_000_000 for x in held] == [50, 100]
    assert step(held, 105)[0] is False and step(held, 110)[0] is True
    assert step(held, 40)[0] is True


def fold(events, lease=300, retry=60, tries=3):
    """What becomes of a job, second by second in words."""
    status, attempts, until = None, 0, 0
    for t, _, event in events:
        if status == "processing" and t > until:
            status, until = ("waiting", until + retry) if attempts < tries else ("failed", 0)
        if status == "waiting" and t >= until:
            status = "pending"
        if status is None:
            status = "pending" if event == "submitted" else None
        elif event == "claimed" and status == "pending":
            status, attempts, until = "processing", attempts + 1, t + lease
        elif status == "processing" and event == "heartbeat":
            until = t + lease
        elif status == "processing" and event == "completed":
            status = "completed"
        elif status == "processing" and event == "failed":
            status, until = ("waiting", t + retry) if attempts < tries else ("failed", 0)
    return status, attempts


JOB = "job_id long, id long, event string, ts timestamp"


def test_jobs_equal_a_plain_fold_and_replays_change_nothing(spark, tmp_path):
    rng = random.Random(12)
    jobs = {}
    for j in range(60):
        t, events = 0, [(0, 0, "submitted")] * (j % 9 > 0)
        for n in range(1, rng.randint(2, 14)):
            t += rng.choice([5, 59, 60, 61, 150, 299, 301, 400])
            events.append((t, n, rng.choice(["claimed", "claimed", "failed", "heartbeat", "completed", "submitted", "other"])))
        jobs[j] = events
    rows = [(j, j * 100 + n, e, at(t)) for j, events in jobs.items() for t, n, e in events]
    early = [r for r in rows if r[1] % 100 < 5]
    got = run(spark, tmp_path, [early, rows, rows + [(1, None, "claimed", at(0)), (2, 299, "claimed", None)]], JOB, T.job_states)
    last = {}
    for r in got:
        if r.job_id not in last or r.last_id >= last[r.job_id].last_id:
            last[r.job_id] = r
    want = {j: fold(e) for j, e in jobs.items()}
    assert {j: (r.status, r.attempts) for j, r in last.items()} == {j: w for j, w in want.items() if w[0]}
    assert {w[0] for w in want.values()} >= {"pending", "processing", "waiting", "completed"} and max(w[1] for w in want.values()) == 3


def test_a_job_takes_plain_rows_and_touches_its_state_once():
    class State:
        held, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, job):
            self.calls.append("update")
            self.held = job

    job = T._Job(300, 60, 3)
    job.state = State()
    events = [Row(job_id=7, id=i, event=e, at=s * 1_000_000) for i, s, e in ((2, 10, "claimed"), (1, 0, "submitted"), (3, 20, "completed"))]
    for calls in (["get", "update"], ["get"]):
        State.calls.clear()
        assert [tuple(r) for r in job.handleInputRows((7,), iter(events), None)] == [(7, "completed", 1, 3)]
        # the second time is a replay
        assert State.calls == calls
    job.state.held = None
    assert list(job.handleInputRows((7,), iter(events[:1]), None)) == []


CHANGE = "id long, is_manual boolean, updated_at timestamp"


def test_each_change_is_handed_out_once(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, i % 5 != 0, at(i)) for i in ids] + [(-1, True, None), (-2, None, at(1))], CHANGE)
    ids = lambda got: sorted(r.id for r in got[1].collect())
    changes = Changes(spark, f"{tmp_path}/marks")
    first = changes.begin(rows(1, 2, 3))
    assert (first[0], ids(first)) == (1, [1, 2, 3])
    changes.done(1)
    assert changes.begin(rows(1, 2, 3)) is None
    stopped = changes.begin(rows(1, 2, 3, 4, 5, 6))
    assert (stopped[0], ids(stopped)) == (2, [4, 6])
    # a run that stopped before it was done: another session takes the same rows up, not those that came since
    again = Changes(spark, f"{tmp_path}/marks").begin(rows(*range(1, 12)))
    assert (again[0], ids(again)) == (2, [4, 6])
    changes.done(2)
    third = changes.begin(rows(*range(1, 12)))
    assert (third[0], ids(third)) == (3, [7, 8, 9, 11])
    changes.done(3)
    with pytest.raises(ValueError):
        changes.done(9)
    assert changes.begin(rows()) is None
