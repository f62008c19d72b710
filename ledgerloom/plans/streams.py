"""Streaming queries over the events, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.ledger_store import held
from ..staging import fresh_path
from ..sources.incremental import Changes
from ..streaming import ingest as I
from ..streaming import stateful as T
from .adapters import duck
from .registry import query


def _folder(spark) -> str:
    return fresh_path(spark, "stream")


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a stream reads a folder: of this one only the events
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.when(F.col("event_type").isin("purchase", "click"), -F.col("value")).otherwise(F.col("value"))
    return s.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"), kind.cast("decimal(12,2)").alias("amount"))


def _run(spark, stream, mode: str = "append"):
    folder = _folder(spark)
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT event_id AS id, user_id, event_type AS category FROM events")
def str03_dedup(spark, d):
    s = _stream(spark, d)
    return _run(spark, I.deduplicated(s, ["id"], "ts", "40 days")).select("id", "user_id", "category")


@query(f"""WITH m AS (SELECT max(ts) AS t FROM events) SELECT user_id, transaction_date AS date, CAST(coalesce(sum(-amount) FILTER (WHERE amount < 0), 0) AS DECIMAL(18,2)) AS spend, CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DECIMAL(18,2)) AS income FROM {duck('moves')}, m WHERE CAST(transaction_date AS TIMESTAMP) + INTERVAL 1 DAY <= m.t - INTERVAL 1 DAY GROUP BY 1, 2""")
def str_daily_spend(spark, d):
    out = _run(spark, I.daily_spend(_stream(spark, d), "ts", "1 day"))
    return out.select("user_id", "date", F.col("spend").cast("decimal(18,2)").alias("spend"), F.col("income").cast("decimal(18,2)").alias("income"))


_ENDS = "(SELECT max(epoch_us(ts)) FROM events) - 60000000"


@query(f"""WITH w AS (SELECT user_id, CAST(floor(epoch_us(ts) / 10000000.0) AS BIGINT) * 10 - 10 * k AS start FROM events, range(6) r(k)) SELECT user_id, start, count(*) AS n FROM w WHERE (start + 60) * 1000000 <= {_ENDS} GROUP BY 1, 2""")
def str07_request_rate(spark, d):
    return _run(spark, I.request_rate(_stream(spark, d), "ts")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query(f"SELECT user_id, category, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM {duck('moves')} GROUP BY 1, 2")
def str08_category_totals(spark, d):
    folder = _folder(spark)
    totals = I.category_totals(_stream(spark, d))
    # complete output: each batch has all totals
    totals.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{folder}/out").withColumn("total", F.col("total").cast("decimal(18,2)"))


@query(f"SELECT min(id) AS id, user_id, category FROM {duck('moves')} GROUP BY 2, 3")
def str01_ingest(spark, d):
    folder = _folder(spark)
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("category"))
    first = events.groupBy("user_id", "category").agg(F.min("id").alias("first"))
    early = events.join(first.where("user_id % 2 = 0"), ["user_id", "category"], "left_semi")
    # two deliveries, of which the second repeats the first; each run takes up where the last one ended
    for part in (early, events):
        part.write.mode("append").parquet(f"{folder}/in")
        I.ingest(spark, f"{folder}/in", events.schema, f"{folder}/ledger", f"{folder}/state", ["user_id", "category"], "id").awaitTermination()
    return held(spark, f"{folder}/ledger", ["user_id", "category"])


_MOST, _SPAN = 3, 21_600


@query(f"SELECT event_id AS id, user_id, coalesce(lag(ts, {_MOST}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= ts - INTERVAL {_SPAN} SECOND, true) AS allowed FROM events WHERE ts IS NOT NULL")
def str07_limiter(spark, d):
    with T.keyed_state(spark):
        return _run(spark, T.limited(_stream(spark, d), "ts", _MOST, _SPAN))


#: Each customer as a job and its orders as events: submitted, then claimed, renewed, completed and failed at changing pace.
_EVENTS = """
SELECT job_id, id, secs, n, CASE WHEN n = 0 THEN 'submitted' ELSE CASE (id * 7 + n) % 5 WHEN 0 THEN 'claimed' WHEN 1 THEN 'failed' WHEN 2 THEN 'claimed' WHEN 3 THEN 'heartbeat' ELSE 'completed' END END AS event
FROM (SELECT o_custkey AS job_id, o_orderkey AS id, CAST(floor(o_orderkey / 10) AS BIGINT) AS secs, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
"""
_JOBS_SQL = f"""
WITH RECURSIVE numbered AS ({_EVENTS}),
life AS (
  SELECT job_id, n, 'pending' AS status, 0 AS attempts, 0 AS until FROM numbered WHERE n = 0
  UNION ALL
  SELECT job_id, n, CASE WHEN event = 'claimed' AND status = 'pending' THEN 'processing' WHEN event = 'completed' AND status = 'processing' THEN 'completed'
      WHEN event = 'failed' AND status = 'processing' THEN if(attempts < 3, 'waiting', 'failed') ELSE status END,
    attempts + if(event = 'claimed' AND status = 'pending', 1, 0),
    CASE WHEN event = 'claimed' AND status = 'pending' OR event = 'heartbeat' AND status = 'processing' THEN secs + 300
      WHEN event = 'failed' AND status = 'processing' AND attempts < 3 THEN secs + 60 WHEN status IN ('processing', 'waiting') AND event NOT IN ('completed', 'failed') THEN until WHEN status = 'waiting' THEN until ELSE 0 END
  FROM (SELECT e.job_id, e.n, e.secs, e.event, w.attempts,
      CASE WHEN lapsed AND e.secs >= w.until + 60 AND w.attempts < 3 OR w.status = 'waiting' AND e.secs >= w.until THEN 'pending' WHEN lapsed AND w.attempts < 3 THEN 'waiting' WHEN lapsed THEN 'failed' ELSE w.status END AS status,
      CASE WHEN lapsed THEN w.until + 60 ELSE w.until END AS until
    FROM (SELECT l.*, e2.secs AS now, l.status = 'processing' AND e2.secs > l.until AS lapsed FROM life l JOIN numbered e2 ON e2.job_id = l.job_id AND e2.n = l.n + 1) w
    JOIN numbered e ON e.job_id = w.job_id AND e.n = w.n + 1))
SELECT job_id, max_by(status, n) AS status, CAST(max_by(attempts, n) AS BIGINT) AS attempts FROM life GROUP BY job_id
"""


@query(_JOBS_SQL)
def mdl17_job_states(spark, d):
    folder = _folder(spark)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    events = spark.sql(_EVENTS.replace("FROM orders)", "FROM {orders})"), orders=orders)
    events = events.select("job_id", "id", "event", F.timestamp_seconds("secs").alias("ts"))
    # two deliveries, of which the second brings the first once more
    early = F.col("id") <= orders.agg(F.expr("max(o_orderkey) div 2")).scalar()
    for part in (events.where(early), events):
        part.write.mode("append").parquet(f"{folder}/in")
        with T.keyed_state(spark):
            states = T.job_states(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
            states.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(states.schema).parquet(f"{folder}/out").groupBy("job_id").agg(F.max_by(F.struct("status", "attempts"), "last_id").alias("s"))
    return last.select("job_id", "s.*")


@query("SELECT event_id AS id, CAST(CASE WHEN ts <= (SELECT min(ts) FROM events) + INTERVAL 5 DAY THEN 1 WHEN ts <= (SELECT min(ts) FROM events) + INTERVAL 12 DAY THEN 2 ELSE 3 END AS BIGINT) AS run FROM events WHERE event_id % 3 <> 0")
def src14_incremental(spark, d):
    """Three runs over events that grow; the second one stops before it is done and is taken up when there are more events already."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("event_id") % 3 != 0).alias("is_manual"))
    begin = events.agg(F.min("updated_at")).scalar()
    changes = Changes(spark, f"{folder}/marks")
    upto = lambda days: events.where(F.col("updated_at") <= begin + F.expr(f"interval {days} days"))
    for days, ends in ((5, True), (12, False), (99, True), (99, True)):
        run, rows = changes.begin(upto(days))
        if ends:
            rows.select("id", F.lit(run).cast("bigint").alias("run")).write.mode("append").parquet(f"{folder}/out")
            changes.done(run)
    return spark.read.parquet(f"{folder}/out")
