"""Aggregates of a ledger as dashboards show them. `as_of` stands for today; it is a literal or one row's value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spent() -> Column:
    return F.when(F.col("amount") < 0, -F.col("amount"))


def earned() -> Column:
    return F.when(F.col("amount") > 0, F.col("amount"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _in_months(date: str, as_of: Column, n: int = 1) -> Column:
    """Whether the date lies in the month of as_of or the n - 1 before: a range, so that scans can skip by statistics."""
    this = F.trunc(as_of, "month")
    return (F.col(date) >= F.add_months(this, 1 - n)) & (F.col(date) < F.add_months(this, 1))


def weekday_spend(df: DataFrame, date: str = "transaction_date") -> DataFrame:
    """AGG-03: Sunday (0) to Saturday, also those without spend."""
    sums = df.where("amount < 0").groupBy((F.dayofweek(date) - 1).alias("weekday")).agg(F.sum(-F.col("amount")).alias("spend"))
    days = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return days.join(sums, "weekday", "left").select("weekday", _zero(F.col("spend")).alias("spend"))


def percent_change(now: Column, before: Column) -> Column:
    """From 0 to something counts as 100 percent."""
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(100.0)).otherwise((now - before) / before * 100)


def month_over_month(df: DataFrame, as_of: Column, date: str = "transaction_date") -> DataFrame:
    """AGG-04"""
    this = F.trunc(as_of, "month")
    two = df.where(_in_months(date, as_of, 2) & (F.col("amount") < 0))
    s = two.agg(_zero(F.sum(F.when(F.col(date) >= this, -F.col("amount")))).alias("current"), _zero(F.sum(F.when(F.col(date) < this, -F.col("amount")))).alias("previous"))
    return s.select("current", "previous", percent_change(F.col("current").cast("double"), F.col("previous").cast("double")).alias("pct"))


def category_name(c: str = "category") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Uncategorized"))


def top_categories(df: DataFrame, n: int = 6) -> DataFrame:
    """AGG-05; names break ties."""
    return df.where("amount < 0").groupBy(category_name().alias("category")).agg(F.sum(-F.col("amount")).alias("spend")).orderBy(F.desc("spend"), "category").limit(n)


def merchant_leaderboard(df: DataFrame, n: int = 5) -> DataFrame:
    """AGG-06: what stands before a '*' in the merchant, else in the description."""
    said = F.coalesce(F.nullif(F.trim("merchant_name"), F.lit("")), F.nullif(F.trim("description"), F.lit("")), F.lit("Unknown"))
    name = F.trim(F.substring_index(said, "*", 1))
    return df.where("amount < 0").groupBy(name.alias("merchant")).agg(F.sum(-F.col("amount")).alias("spend"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("spend"), "merchant").limit(n)


def month_groups(df: DataFrame, date: str = "transaction_date", by: list[str] | None = None) -> DataFrame:
    """AGG-07"""
    return df.groupBy(*(by or []), F.date_format(date, "yyyy-MM").alias("month")).agg(_zero(F.sum(spent())).alias("spent"), _zero(F.sum(earned())).alias("credited"), F.sum("amount").alias("net"), F.count(F.lit(1)).alias("n"))


def tab_counts(df: DataFrame) -> DataFrame:
    """AGG-08"""
    return df.agg(F.count(F.lit(1)).alias("all_rows"), F.count_if(F.col("amount") < 0).alias("debits"), F.count_if(F.col("amount") >= 0).alias("credits"))


def week_of_month(date: str) -> Column:
    return (F.floor((F.dayofmonth(date) - 1) / 7) + 1).cast("int")


def period_average(df: DataFrame, as_of: Column, period: str = "month", date: str = "transaction_date") -> DataFrame:
    """AGG-09: total spend of the period, and by active week of the month or active day of the last seven."""
    day = F.to_date(date)
    if period == "month":
        own, active = df.where(_in_months(date, as_of)), F.countDistinct(F.when(F.col("amount") < 0, week_of_month(date)))
    else:
        own, active = df.where((day > F.date_sub(as_of, 7)) & (day <= as_of)), F.countDistinct(F.when(F.col("amount") < 0, day))
    s = own.agg(_zero(F.sum(spent())).alias("total"), active.alias("active"))
    return s.select("total", "active", (F.col("total").cast("double") / F.greatest("active", F.lit(1))).alias("average"))


def seven_days(df: DataFrame, as_of: Column, date: str = "transaction_date") -> DataFrame:
    """AGG-10: spend of each of the last seven days, also those without."""
    day = F.to_date(date)
    sums = df.where((day > F.date_sub(as_of, 7)) & (day <= as_of) & (F.col("amount") < 0)).groupBy(day.alias("day")).agg(F.sum(-F.col("amount")).alias("spend"))
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(as_of, 6), as_of)).alias("day"))
    return days.join(sums, "day", "left").select("day", _zero(F.col("spend")).alias("spend"))


def month_weeks(df: DataFrame, as_of: Column, date: str = "transaction_date") -> DataFrame:
    """AGG-10: spend of W1 to W5 of the month."""
    sums = df.where(_in_months(date, as_of) & (F.col("amount") < 0)).groupBy(week_of_month(date).alias("w")).agg(F.sum(-F.col("amount")).alias("spend"))
    weeks = df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("w"))
    return weeks.join(sums, "w", "left").select(F.concat(F.lit("W"), F.col("w").cast("string")).alias("week"), _zero(F.col("spend")).alias("spend"))


def category_stats(df: DataFrame) -> DataFrame:
    """AGG-11"""
    return df.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


def distinct_sorted(df: DataFrame, column: Column, name: str) -> DataFrame:
    """AGG-25, AGG-27"""
    return df.select(column.alias(name)).where(F.col(name).isNotNull()).distinct().orderBy(name)


def with_default_categories(df: DataFrame, defaults: list[str]) -> DataFrame:
    """SET-02"""
    own = df.select("category").where("category is not null")
    return own.unionByName(df.sparkSession.createDataFrame([(c,) for c in defaults], "category string")).distinct()


def largest_spends(df: DataFrame, n: int = 3, key: str = "id") -> DataFrame:
    """TOP-03"""
    return df.where("amount < 0").orderBy(F.col("amount"), key).limit(n)
