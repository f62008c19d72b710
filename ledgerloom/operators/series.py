"""Daily series of ledgers, their features, paydays, windows and forecasts, by user."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import global_rank
from .quantiles import exact_quantiles

ENCODER, HORIZON, LEAST_DAYS = 60, 30, 90


def daily_totals(df: DataFrame, date: str = "transaction_date") -> DataFrame:
    """AGG-01: (user_id, date, daily_income, daily_spend) of days with movement; amounts of 0 make no day."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,2)")
    return df.where("amount <> 0").groupBy("user_id", F.to_date(date).alias("date")).agg(z(F.sum(F.when(F.col("amount") > 0, F.col("amount")))).alias("daily_income"), z(F.sum(F.when(F.col("amount") < 0, -F.col("amount")))).alias("daily_spend"))


def densified(totals: DataFrame, mode: str = "full") -> DataFrame:
    """JOI-08, JOI-09, AGG-02: each user's days without gaps: from first to last, or within each series' own range."""
    if mode == "full":
        spans = totals.groupBy("user_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
        days = spans.select("user_id", F.explode(F.sequence("a", "b")).alias("date"))
    else:
        on = lambda c, f: f(F.when(F.col(c) > 0, F.col("date")))
        spans = totals.groupBy("user_id").agg(*[on(c, f).alias(f"{c}_{n}") for c in ("daily_income", "daily_spend") for f, n in ((F.min, "a"), (F.max, "b"))])
        days = spans.select("user_id", F.sequence("daily_income_a", "daily_income_b").alias("i"), F.sequence("daily_spend_a", "daily_spend_b").alias("s"))
        days = days.select("user_id", F.explode(F.array_union(F.coalesce("i", F.array().cast("array<date>")), F.coalesce("s", F.array().cast("array<date>")))).alias("date"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,2)").alias(c)
    return days.join(totals, ["user_id", "date"], "left").select("user_id", "date", z("daily_income"), z("daily_spend"))


def with_balance(daily: DataFrame) -> DataFrame:
    """WIN-01: closing_balance, from 0."""
    w = Window.partitionBy("user_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("closing_balance", F.sum(F.col("daily_income") - F.col("daily_spend")).over(w))


def with_calendar(daily: DataFrame) -> DataFrame:
    """WIN-02, WIN-03: time_idx from 0, day_of_week from Monday, day_of_month, both as text, and the group."""
    w = Window.partitionBy("user_id").orderBy("date")
    return daily.withColumns({"time_idx": (F.row_number().over(w) - 1).cast("int"), "day_of_week": F.weekday("date").cast("string"), "day_of_month": F.dayofmonth("date").cast("string"), "group_id": F.lit("main_user")})


def with_paydays(daily: DataFrame, percentile: float = 0.9, times: int = 2) -> DataFrame:
    """DTE-01, AGG-13, AGG-14, JOI-11: is_payday for days of the month on which incomes of at least the percentile came `times` times."""
    threshold = exact_quantiles(daily.where("daily_income > 0"), "daily_income", [percentile], ["user_id"]).select("user_id", F.col("quantiles")[0].alias("__t"))
    dom = F.dayofmonth("date").alias("__dom")
    large = daily.join(threshold, "user_id").where(F.col("daily_income").cast("double") >= F.col("__t")).groupBy("user_id", dom).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= times).select("user_id", "__dom", F.lit(1).alias("__p"))
    return daily.withColumn("__dom", F.dayofmonth("date")).join(large, ["user_id", "__dom"], "left").withColumn("is_payday", F.coalesce("__p", F.lit(0)).cast("int")).drop("__dom", "__p")


def robust_scaled(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG-15, MTH-01: (x - median) / IQR, an IQR of 0 as 1; adds <column>_scaled."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    stats = robust_stats(df, columns, by)
    joined = df.join(stats, by) if by else df.join(F.broadcast(stats))
    out = joined.withColumns({f"{c}_scaled": (F.col(c).cast("double") - F.col(f"__{c}_mid")) / F.col(f"__{c}_iqr") for c in columns})
    return out.drop(*[f"__{c}_{s}" for c in columns for s in ("mid", "iqr")])


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles over all rows, linear between neighbours: by rank, so that no task holds all values."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    ranked = global_rank(values, ["x"])
    n = values.count()
    at = [(n - 1) * q for q in shares]
    wanted = sorted({int(f(p)) + 1 for p in at for f in (math.floor, math.ceil)}) if n else []
    x = {r["rank"]: r["x"] for r in ranked.where(F.col("rank").isin(wanted)).collect()} if n else {}
    return [x[math.floor(p) + 1] + (x[math.ceil(p) + 1] - x[math.floor(p) + 1]) * (p - math.floor(p)) if n else None for p in at]


def robust_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Median and IQR (0 as 1) of each column, by group or, in one row, of all rows."""
    if not by:
        found = {c: quantiles(df, c, [0.25, 0.5, 0.75]) for c in columns}
        row = [x for lo, mid, hi in found.values() for x in (mid, None if lo is None else (hi - lo) or 1.0)]
        return df.sparkSession.createDataFrame([row], ", ".join(f"`__{c}_mid` double, `__{c}_iqr` double" for c in columns))

    def of(c: str) -> DataFrame:
        q = F.col("quantiles")
        return exact_quantiles(df, c, [0.25, 0.5, 0.75], by).select(*by, q[1].alias(f"__{c}_mid"), F.when(q[2] == q[0], 1.0).otherwise(q[2] - q[0]).alias(f"__{c}_iqr"))

    stats = of(columns[0])
    for c in columns[1:]:
        more = of(c)
        more = more.select(*[F.col(b).alias(f"__by_{i}") for i, b in enumerate(by)], *[x for x in more.columns if x not in by])
        same = [F.col(b).eqNullSafe(F.col(f"__by_{i}")) for i, b in enumerate(by)]
        stats = stats.join(more, reduce(lambda a, b: a & b, same)).drop(*[f"__by_{i}" for i in range(len(by))])
    return stats


def unscaled(col: Column, mid: Column, iqr: Column) -> Column:
    return col * iqr + mid


def last_days(daily: DataFrame, n: int) -> DataFrame:
    """WIN-05: each user's last n rows."""
    w = Window.partitionBy("user_id").orderBy(F.desc("date"))
    return daily.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def trailing_means(daily: DataFrame, n: int = 30) -> DataFrame:
    """AGG-12: means of each user's last n daily rows, and the number of all."""
    counts = daily.groupBy("user_id").agg(F.count(F.lit(1)).alias("days_analyzed"))
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return last_days(daily, n).groupBy("user_id").agg(mean("daily_income").alias("avg_income"), mean("daily_spend").alias("avg_spend")).join(counts, "user_id")


def rounded(amount: Column, digits: int = 2) -> Column:
    """Half up on the decimal digits, so that 39.565 gives 39.57 whatever its nearest double is."""
    return F.round(amount.cast("decimal(28,8)"), digits).cast("double")


def safe_to_spend(daily: DataFrame, days: int = 7) -> DataFrame:
    """AGG-26: what a week leaves, and the confidence that the history gives."""
    m = trailing_means(daily)
    return m.select("user_id", rounded((F.col("avg_income") - F.col("avg_spend")) * days).alias("safe_amount"), F.round(F.least(F.col("days_analyzed") / 90.0, F.lit(1.0)), 2).alias("confidence"), rounded(F.col("avg_income")).alias("avg_income"), rounded(F.col("avg_spend")).alias("avg_spend"), "days_analyzed")


def statistical_forecast(daily: DataFrame, horizon: int = 7) -> DataFrame:
    """MDL-15, SET-04: the next days, each with the trailing means."""
    ends = daily.groupBy("user_id").agg(F.max("date").alias("last"))
    m = trailing_means(daily).join(ends, "user_id")
    return m.select("user_id", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("date"), rounded(F.col("avg_income")).alias("predicted_income"), rounded(F.col("avg_spend")).alias("predicted_spend"))


def future_rows(daily: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """SET-01, SET-04: the days after each user's last, time_idx going on, all values 0, under the history."""
    ends = daily.groupBy("user_id").agg(F.max("date").alias("last"), F.max("time_idx").alias("i"))
    ahead = ends.select("user_id", F.posexplode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("p", "date"), "i")
    ahead = ahead.select("user_id", "date", (F.col("i") + F.col("p") + 1).cast("int").alias("time_idx"), F.weekday("date").cast("string").alias("day_of_week"), F.dayofmonth("date").cast("string").alias("day_of_month"))
    return daily.unionByName(ahead, allowMissingColumns=True).fillna(0, [c for c, t in daily.dtypes if t.startswith(("decimal", "double", "int")) and c != "user_id"])


def encoder_windows(daily: DataFrame, value: str, size: int = ENCODER) -> DataFrame:
    """WIN-08: the last `size` values up to each row, for rows that have them all."""
    w = Window.partitionBy("user_id").orderBy("date").rowsBetween(-(size - 1), 0)
    return daily.withColumn("window", F.collect_list(value).over(w)).where(F.size("window") == size)


def training_cutoff(daily: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """EXP-04: is_train for rows up to the horizon before each user's end."""
    ends = daily.groupBy("user_id").agg((F.max("time_idx") - horizon).alias("__c"))
    return daily.join(ends, "user_id").withColumn("is_train", F.col("time_idx") <= F.col("__c")).drop("__c")


def _quantile(x: np.ndarray, share: float) -> float:
    """Linear between neighbours of sorted values."""
    at = (len(x) - 1) * share
    lo = int(at)
    return float(x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (at - lo))


def _forecast(at: np.ndarray, moved: np.ndarray, doms: np.ndarray, paid: np.ndarray, horizon: int, least_days: int) -> tuple:
    """(error, days, p10, p50, p90) of one user, whose days with movement come in order: days since 1970, changes, days of the month, paydays."""
    first, last = int(at[0]), int(at[-1])
    if last - first + 1 < least_days:
        gap = np.full(1, np.nan)
        return f"at least {least_days} days of history are needed, got {last - first + 1}", np.zeros(1, np.int64), gap, gap, gap
    day = np.arange(first, last + 1 + horizon)
    change = np.zeros(last - first + 1)
    change[at - first] = moved
    balance = round(float(change.sum()), 2)
    months = day.astype("datetime64[D]").astype("datetime64[M]")
    pays = np.zeros(32, bool)
    pays[doms[paid.astype(bool)]] = True
    payday = pays[day - months.astype("datetime64[D]").astype(np.int64) + 1]
    weekday = (day + 3) % 7
    n = len(change)
    usual = ~payday[:n] if not payday[:n].all() else np.ones(n, bool)
    normal, kinds = change[usual], weekday[:n][usual]
    paid_change = float(np.median(change[payday[:n]])) if payday[:n].any() else 0.0
    ordered = np.sort(normal)
    middle = float(np.median(ordered))
    mid = np.array([np.median(x) if len(x := normal[kinds == k]) else middle for k in range(7)])
    lo, hi = _quantile(ordered, 0.1) - middle, _quantile(ordered, 0.9) - middle
    steps = np.where(payday[n:], paid_change, mid[weekday[n:]]).cumsum()
    root = np.arange(1, horizon + 1) ** 0.5
    return None, day[n:], *((balance + steps + x * root).round(2) for x in (lo, 0.0, hi))


def quantile_forecast(totals: DataFrame, horizon: int = HORIZON, least_days: int = LEAST_DAYS) -> DataFrame:
    """MDL-13, MDL-14: (user_id, date, p10, p50, p90, error) of the closing balance ahead.

    totals has each user's days with movement; the days between are filled in one user at a time. Daily changes by
    weekday, paydays aside, are drawn together to quantiles that widen with the root of the horizon. Users whose days,
    first to last, are fewer than `least_days` get one row with an error.
    """

    kind = dict(totals.dtypes)["user_id"]
    net = F.col("daily_income").cast("double") - F.col("daily_spend").cast("double")
    rows = with_paydays(totals).select("user_id", F.unix_date("date").alias("day"), net.alias("change"), F.dayofmonth("date").alias("dom"), (F.col("is_payday") == 1).alias("paid"))
    # a user's days go to the task in one array; many users are one batch, where a group of its own for each costs more than its work
    days = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "change", "dom", "paid"))).alias("d"))
    days = days.select("user_id", *[F.col(f"d.{c}").alias(c) for c in ("day", "change", "dom", "paid")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cells = [part.column(c) for c in ("day", "change", "dom", "paid")]
                made = [_forecast(*[c[k].values.to_numpy(zero_copy_only=False) for c in cells], horizon, least_days) for k in range(part.num_rows)]
                lengths = [len(m[1]) for m in made]
                late = np.repeat([m[0] is not None for m in made], lengths)
                day, *values = (np.concatenate([m[k] for m in made]) for k in (1, 2, 3, 4))
                errors = [m[0] for m, n in zip(made, lengths, strict=True) for _ in range(n)]
                users = part.column("user_id").take(pa.array(np.repeat(np.arange(part.num_rows), lengths)))
                arrays = [users, pa.array(day.astype(np.int32), pa.int32(), mask=late).cast(pa.date32()), *[pa.array(v, pa.float64(), mask=late) for v in values], pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["user_id", "date", "p10", "p50", "p90", "error"])

    return days.mapInArrow(run, f"user_id {kind}, date date, p10 double, p50 double, p90 double, error string")
