"""Daily series: totals, balances, features, paydays, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from .adapters import adapted, duck
from .registry import query

_L, _M, _B = duck("ledger"), duck("moves"), duck("branches")


def _daily_sql(x: str) -> str:
    return f"t AS (SELECT user_id, transaction_date AS date, CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DECIMAL(18,2)) AS daily_income, CAST(coalesce(sum(-amount) FILTER (WHERE amount < 0), 0) AS DECIMAL(18,2)) AS daily_spend FROM {x} WHERE amount <> 0 GROUP BY 1, 2)"


def _dense_sql(x: str) -> str:
    return f"""{_daily_sql(x)}, sp AS (SELECT user_id, min(date) AS a, max(date) AS b FROM t GROUP BY 1), dy AS (SELECT user_id, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
f AS (SELECT dy.user_id, dy.date, CAST(coalesce(daily_income, 0) AS DECIMAL(18,2)) AS daily_income, CAST(coalesce(daily_spend, 0) AS DECIMAL(18,2)) AS daily_spend FROM dy LEFT JOIN t ON t.user_id = dy.user_id AND t.date = dy.date)"""


def _daily(spark, d, name="moves"):
    return S.daily_totals(adapted(spark, d, name))


def _dense(spark, d, name="moves"):
    return S.densified(_daily(spark, d, name))


@query(f"WITH {_daily_sql(_L)} SELECT * FROM t")
def agg01_daily_totals(spark, d):
    return _daily(spark, d, "ledger")


@query(f"WITH {_dense_sql(_M)} SELECT * FROM f")
def joi09_calendar(spark, d):
    return _dense(spark, d)


@query(f"""WITH {_daily_sql(_M)}, r AS (SELECT user_id, min(date) FILTER (WHERE daily_income > 0) AS ia, max(date) FILTER (WHERE daily_income > 0) AS ib, min(date) FILTER (WHERE daily_spend > 0) AS sa, max(date) FILTER (WHERE daily_spend > 0) AS sb FROM t GROUP BY 1),
dy AS (SELECT user_id, CAST(unnest(generate_series(ia::TIMESTAMP, ib::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM r WHERE ia IS NOT NULL UNION SELECT user_id, CAST(unnest(generate_series(sa::TIMESTAMP, sb::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) FROM r WHERE sa IS NOT NULL)
SELECT dy.user_id, dy.date, CAST(coalesce(daily_income, 0) AS DECIMAL(18,2)) AS daily_income, CAST(coalesce(daily_spend, 0) AS DECIMAL(18,2)) AS daily_spend FROM dy LEFT JOIN t ON t.user_id = dy.user_id AND t.date = dy.date""")
def agg02_per_series(spark, d):
    return S.densified(_daily(spark, d), "per_series")


@query(f"WITH {_dense_sql(_M)} SELECT *, CAST(sum(daily_income - daily_spend) OVER (PARTITION BY user_id ORDER BY date) AS DECIMAL(18,2)) AS closing_balance FROM f")
def win01_balance(spark, d):
    return S.with_balance(_dense(spark, d)).withColumn("closing_balance", F.col("closing_balance").cast("decimal(18,2)"))


@query(f"WITH {_dense_sql(_M)} SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS INT) AS time_idx, CAST(isodow(date) - 1 AS VARCHAR) AS day_of_week, CAST(day(date) AS VARCHAR) AS day_of_month, 'main_user' AS group_id FROM f")
def win03_features(spark, d):
    return S.with_calendar(_dense(spark, d))


@query(f"""WITH {_daily_sql(_L)}, q AS (SELECT user_id, quantile_cont(daily_income::DOUBLE, 0.9) AS p FROM t f WHERE daily_income > 0 GROUP BY 1),
g AS (SELECT f.user_id, day(date) AS dom FROM t f JOIN q ON f.user_id = q.user_id AND daily_income::DOUBLE >= p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT f.user_id, f.date, CAST(g.dom IS NOT NULL AS INT) AS is_payday FROM t f LEFT JOIN g ON g.user_id = f.user_id AND g.dom = day(f.date)""")
def dte01_paydays(spark, d):
    return S.with_paydays(_daily(spark, d, "ledger")).select("user_id", "date", "is_payday")


@query(f"WITH s AS (SELECT quantile_cont(amount::DOUBLE, 0.25) AS a, quantile_cont(amount::DOUBLE, 0.5) AS m, quantile_cont(amount::DOUBLE, 0.75) AS b FROM {_L}) SELECT id, round((amount::DOUBLE - m) / (CASE WHEN a = b THEN 1 ELSE b - a END), 5) AS amount_scaled FROM {_L}, s")
def mth01_robust_scaled(spark, d):
    return S.robust_scaled(adapted(spark, d, "ledger").select("id", "amount"), ["amount"]).select("id", F.round("amount_scaled", 5).alias("amount_scaled"))


@query(f"WITH s AS (SELECT user_id, quantile_cont(amount::DOUBLE, 0.25) AS a, quantile_cont(amount::DOUBLE, 0.5) AS m, quantile_cont(amount::DOUBLE, 0.75) AS b FROM {_M} GROUP BY 1) SELECT id, round((amount::DOUBLE - m) / (CASE WHEN a = b THEN 1 ELSE b - a END), 5) AS amount_scaled FROM {_M} x JOIN s USING (user_id)")
def mth01_robust_scaled_by_user(spark, d):
    return S.robust_scaled(adapted(spark, d, "moves").select("id", "user_id", "amount"), ["amount"], ["user_id"]).select("id", F.round("amount_scaled", 5).alias("amount_scaled"))


_TAIL = f"WITH {_dense_sql(_M)}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n, max(date) OVER (PARTITION BY user_id) AS last FROM f), m AS (SELECT user_id, avg(daily_income::DOUBLE) AS i, avg(daily_spend::DOUBLE) AS s, any_value(n) AS n, any_value(last) AS last FROM k WHERE r <= 30 GROUP BY 1) "


@query(_TAIL + "SELECT user_id, round(CAST(i AS DECIMAL(28,8)), 3)::DOUBLE AS avg_income, round(CAST(s AS DECIMAL(28,8)), 3)::DOUBLE AS avg_spend, n AS days_analyzed FROM m")
def agg12_trailing_means(spark, d):
    return S.trailing_means(_dense(spark, d)).select("user_id", S.rounded(F.col("avg_income"), 3).alias("avg_income"), S.rounded(F.col("avg_spend"), 3).alias("avg_spend"), "days_analyzed")


@query(_TAIL + "SELECT user_id, round(CAST((i - s) * 7 AS DECIMAL(28,8)), 2)::DOUBLE AS safe_amount, round(least(n / 90.0, 1.0)::DOUBLE, 2) AS confidence, round(CAST(i AS DECIMAL(28,8)), 2)::DOUBLE AS avg_income, round(CAST(s AS DECIMAL(28,8)), 2)::DOUBLE AS avg_spend, n AS days_analyzed FROM m")
def agg26_safe_to_spend(spark, d):
    return S.safe_to_spend(_dense(spark, d))


@query(_TAIL + "SELECT user_id, CAST(last + h AS DATE) AS date, round(CAST(i AS DECIMAL(28,8)), 2)::DOUBLE AS predicted_income, round(CAST(s AS DECIMAL(28,8)), 2)::DOUBLE AS predicted_spend FROM m, range(1, 8) r(h)".replace("last + h", "last + h::INT"))
def mdl15_statistical_forecast(spark, d):
    return S.statistical_forecast(_dense(spark, d))


@query(f"WITH {_dense_sql(_M)}, k AS (SELECT user_id, date, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS INT) AS time_idx, max(date) OVER (PARTITION BY user_id) AS last, count(*) OVER (PARTITION BY user_id) AS n FROM f) SELECT user_id, date, time_idx FROM k UNION ALL SELECT user_id, CAST(last + h::INT AS DATE), CAST(n - 1 + h AS INT) FROM (SELECT DISTINCT user_id, last, n FROM k), range(1, 31) r(h)")
def set04_future_rows(spark, d):
    return S.future_rows(S.with_calendar(_dense(spark, d))).select("user_id", "date", "time_idx")


@query(f"WITH {_dense_sql(_B)}, k AS (SELECT user_id, date, sum(daily_spend) OVER w AS total, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT user_id, date, CAST(total AS DECIMAL(18,2)) AS total FROM k WHERE n = 60")
def win08_encoder_windows(spark, d):
    w = S.encoder_windows(_dense(spark, d, "branches"), "daily_spend")
    return w.select("user_id", "date", F.aggregate("window", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x).cast("decimal(28,2)")).cast("decimal(18,2)").alias("total"))


@query(f"WITH {_dense_sql(_B)}, k AS (SELECT user_id, date, row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY user_id) - 1 - 30 AS c FROM f) SELECT user_id, date, i <= c AS is_train FROM k")
def exp04_cutoff(spark, d):
    return S.training_cutoff(S.with_calendar(_dense(spark, d, "branches"))).select("user_id", "date", "is_train")


@query()
def mdl14_quantile_forecast(spark, d):
    return S.quantile_forecast(_daily(spark, d, "ledger"), 30)
