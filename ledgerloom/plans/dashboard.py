"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard as D
from ..operators import ledger as L
from .adapters import adapted, duck, last_day
from .registry import query



def _money(df, *cols):
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})


@query(f"WITH l AS (SELECT * FROM {duck('ledger')}) SELECT CAST(w.weekday AS INT) AS weekday, CAST(coalesce(sum(-amount), 0) AS DECIMAL(18,2)) AS spend FROM range(7) w(weekday) LEFT JOIN (SELECT * FROM l WHERE amount < 0) x ON dayofweek(transaction_date) = w.weekday GROUP BY 1")
def agg03_weekday_spend(spark, d):
    return _money(D.weekday_spend(adapted(spark, d, "ledger")), "spend")


@query(f"""WITH l AS (SELECT * FROM {duck('ledger')}), t AS (SELECT date_trunc('month', max(transaction_date)) AS m FROM l),
s AS (SELECT coalesce(sum(-amount) FILTER (WHERE date_trunc('month', transaction_date) = m), 0) AS c, coalesce(sum(-amount) FILTER (WHERE date_trunc('month', transaction_date) = m - INTERVAL 1 MONTH), 0) AS p FROM l, t WHERE amount < 0)
SELECT CAST(c AS DECIMAL(18,2)) AS current, CAST(p AS DECIMAL(18,2)) AS previous, round(CASE WHEN p = 0 THEN CASE WHEN c = 0 THEN 0.0 ELSE 100.0 END ELSE (c::DOUBLE - p::DOUBLE) / p::DOUBLE * 100 END, 4)::DOUBLE AS pct FROM s""")
def agg04_month_over_month(spark, d):
    df = adapted(spark, d, "ledger")
    return _money(D.month_over_month(df, last_day(df)), "current", "previous").withColumn("pct", F.round("pct", 4))


@query(f"SELECT category, CAST(sum(-amount) AS DECIMAL(18,2)) AS spend FROM {duck('purchases')} WHERE amount < 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def agg05_top_categories(spark, d):
    return _money(D.top_categories(adapted(spark, d, "purchases")), "spend")


@query(f"SELECT trim(split_part(coalesce(nullif(trim(merchant_name), ''), nullif(trim(description), ''), 'Unknown'), '*', 1)) AS merchant, CAST(sum(-amount) AS DECIMAL(18,2)) AS spend, count(*) AS n FROM {duck('ledger')} WHERE amount < 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg06_merchant_leaderboard(spark, d):
    return _money(D.merchant_leaderboard(adapted(spark, d, "ledger")), "spend")


@query(f"SELECT strftime(transaction_date, '%Y-%m') AS month, CAST(coalesce(sum(-amount) FILTER (WHERE amount < 0), 0) AS DECIMAL(18,2)) AS spent, CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DECIMAL(18,2)) AS credited, CAST(sum(amount) AS DECIMAL(18,2)) AS net, count(*) AS n FROM {duck('ledger')} GROUP BY 1")
def agg07_month_groups(spark, d):
    return _money(D.month_groups(adapted(spark, d, "ledger")), "spent", "credited", "net")


@query(f"SELECT user_id, strftime(transaction_date, '%Y-%m') AS month, CAST(coalesce(sum(-amount) FILTER (WHERE amount < 0), 0) AS DECIMAL(18,2)) AS spent, CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DECIMAL(18,2)) AS credited, CAST(sum(amount) AS DECIMAL(18,2)) AS net, count(*) AS n FROM {duck('purchases')} GROUP BY 1, 2")
def agg07_month_groups_by_user(spark, d):
    return _money(D.month_groups(adapted(spark, d, "purchases"), by=["user_id"]), "spent", "credited", "net")


@query(f"SELECT count(*) AS all_rows, count(*) FILTER (WHERE amount < 0) AS debits, count(*) FILTER (WHERE amount >= 0) AS credits FROM {duck('ledger')}")
def agg08_tab_counts(spark, d):
    return D.tab_counts(adapted(spark, d, "ledger"))


@query(f"""WITH l AS (SELECT *, (SELECT max(transaction_date) FROM {duck('ledger')}) AS t FROM {duck('ledger')}), o AS (SELECT * FROM l WHERE date_trunc('month', transaction_date) = date_trunc('month', t) AND amount < 0), s AS (SELECT coalesce(sum(-amount), 0) AS total, count(DISTINCT (day(transaction_date) - 1) // 7) AS active FROM o)
SELECT CAST(total AS DECIMAL(18,2)) AS total, active, round(total::DOUBLE / greatest(active, 1), 4) AS average FROM s""")
def agg09_period_average(spark, d):
    df = adapted(spark, d, "ledger")
    return _money(D.period_average(df, last_day(df)), "total").withColumn("average", F.round("average", 4))


@query(f"""WITH l AS (SELECT *, (SELECT max(transaction_date) FROM {duck('ledger')}) AS t FROM {duck('ledger')}), s AS (SELECT coalesce(sum(-amount) FILTER (WHERE amount < 0), 0) AS total, count(DISTINCT transaction_date) FILTER (WHERE amount < 0) AS active FROM l WHERE transaction_date > t - 7 AND transaction_date <= t)
SELECT CAST(total AS DECIMAL(18,2)) AS total, active, round(total::DOUBLE / greatest(active, 1), 4) AS average FROM s""")
def agg09_week_average(spark, d):
    df = adapted(spark, d, "ledger")
    return _money(D.period_average(df, last_day(df), "week"), "total").withColumn("average", F.round("average", 4))


@query(f"""WITH l AS (SELECT * FROM {duck('ledger')}), t AS (SELECT max(transaction_date) AS t FROM l), days AS (SELECT CAST(t - i::INT AS DATE) AS day FROM t, range(7) r(i))
SELECT day, CAST(coalesce(sum(-amount), 0) AS DECIMAL(18,2)) AS spend FROM days LEFT JOIN (SELECT * FROM l WHERE amount < 0) x ON x.transaction_date = day GROUP BY 1""")
def agg10_seven_days(spark, d):
    df = adapted(spark, d, "ledger")
    return _money(D.seven_days(df, last_day(df)), "spend")


@query(f"""WITH l AS (SELECT *, (SELECT max(transaction_date) FROM {duck('ledger')}) AS t FROM {duck('ledger')}), o AS (SELECT * FROM l WHERE date_trunc('month', transaction_date) = date_trunc('month', t) AND amount < 0)
SELECT 'W' || w AS week, CAST(coalesce(sum(-amount), 0) AS DECIMAL(18,2)) AS spend FROM range(1, 6) r(w) LEFT JOIN o ON (day(transaction_date) - 1) // 7 + 1 = w GROUP BY 1""")
def agg10_month_weeks(spark, d):
    df = adapted(spark, d, "ledger")
    return _money(D.month_weeks(df, last_day(df)), "spend")


@query(f"SELECT user_id, category, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM {duck('ledger')} GROUP BY 1, 2")
def agg11_category_stats(spark, d):
    return _money(D.category_stats(adapted(spark, d, "ledger")), "total")


@query(f"SELECT DISTINCT category FROM {duck('purchases')} WHERE category IS NOT NULL")
def agg25_categories(spark, d):
    return D.distinct_sorted(adapted(spark, d, "purchases"), F.col("category"), "category")


@query(f"SELECT DISTINCT CAST(year(transaction_date) AS INT) AS year FROM {duck('ledger')}")
def agg25_years(spark, d):
    return D.distinct_sorted(adapted(spark, d, "ledger"), F.year("transaction_date"), "year")


@query(f"SELECT category FROM {duck('ledger')} UNION SELECT unnest(['Food', 'Transport', '5-LOW']) AS category")
def set02_categories_with_defaults(spark, d):
    return D.with_default_categories(adapted(spark, d, "ledger"), ["Food", "Transport", "5-LOW"])


@query(f"SELECT id, user_id, transaction_date, amount, merchant_name FROM {duck('purchases')} WHERE amount < 0 ORDER BY amount, id LIMIT 3")
def top03_largest_spends(spark, d):
    return D.largest_spends(adapted(spark, d, "purchases")).select("id", "user_id", "transaction_date", "amount", "merchant_name")


@query(f"SELECT id, user_id, transaction_date, amount FROM {duck('ledger')} ORDER BY transaction_date DESC, id DESC LIMIT 50")
def top01_recent(spark, d):
    return L.recent(adapted(spark, d, "ledger")).select("id", "user_id", "transaction_date", "amount")


@query(f"SELECT id, user_id, transaction_date, amount FROM {duck('ledger')} WHERE (transaction_date, id) < (DATE '1999-06-15', 7000) ORDER BY transaction_date DESC, id DESC LIMIT 50")
def top06_keyset_page(spark, d):
    return L.page_after(adapted(spark, d, "ledger"), F.lit("1999-06-15").cast("date"), 7000, 50).select("id", "user_id", "transaction_date", "amount")


@query(f"SELECT id, transaction_date FROM {duck('ledger')} ORDER BY transaction_date DESC, id DESC LIMIT 25 OFFSET 100")
def top07_offset_page(spark, d):
    return L.page_at(adapted(spark, d, "ledger"), 100, 25).select("id", "transaction_date")


@query(f"SELECT user_id, max_by(transaction_date, (transaction_date, id)) AS transaction_date, max_by(id, (transaction_date, id)) AS id, max_by(amount, (transaction_date, id)) AS amount FROM {duck('ledger')} GROUP BY 1")
def win06_latest_per_user(spark, d):
    return L.latest_per_user(adapted(spark, d, "ledger"), ["transaction_date", "id"], ["amount"])


@query(f"WITH r AS (SELECT id, strftime(transaction_date, '%Y-%m') AS month, row_number() OVER (ORDER BY transaction_date DESC, id DESC) AS rank FROM {duck('ledger')}) SELECT id, month FROM r WHERE rank <= 120")
def win07_visible_prefix(spark, d):
    return L.visible_prefix(adapted(spark, d, "ledger"), 120).select("id", "month")
