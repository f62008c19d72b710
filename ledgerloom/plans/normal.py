"""Normalising queries on amounts, dates and status written as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..sources import readers as R
from .adapters import adapted, duck, table
from .registry import query

#: Amounts in many spellings, of whole numbers so that no rounding differs.
_AMOUNTS = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN concat('INR ', CAST(o_custkey AS STRING), '.50') WHEN 1 THEN concat('$', CAST(o_custkey AS STRING)) WHEN 2 THEN concat('(', CAST(o_custkey AS STRING), ')')
 WHEN 3 THEN concat('1,', CAST(100 + o_custkey % 900 AS STRING)) WHEN 4 THEN 'nan' WHEN 5 THEN concat('-', CAST(o_custkey AS STRING), '.25') WHEN 6 THEN '' WHEN 7 THEN concat(CAST(o_custkey AS STRING), 'd') ELSE CAST(o_custkey AS STRING) END AS raw,
 CASE o_orderkey % 5 WHEN 0 THEN 'Debit' WHEN 1 THEN 'CR' WHEN 2 THEN 'deposit' WHEN 3 THEN 'dr/cr' ELSE 'xyz' END AS kind,
 CASE o_orderkey % 7 WHEN 0 THEN ' Refunded ' WHEN 1 THEN 'Cancelled' WHEN 2 THEN 'Complete' WHEN 3 THEN '' WHEN 4 THEN 'Payment failed' WHEN 5 THEN 'SUCCESS' ELSE 'on hold' END AS status
 FROM orders"""
_D = f"({_AMOUNTS.replace('STRING', 'VARCHAR')})"
_NUM = "CASE WHEN regexp_full_match({x}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST({x} AS DOUBLE) END"


def _amounts(spark, d):
    return spark.sql(_AMOUNTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def _num(x: str) -> str:
    return _NUM.replace("{x}", x)


_PLAIN = f"coalesce({_num(chr(34) + 'p' + chr(34))}, 0)"
_BANK_TEXT = "replace(CASE WHEN contains(b, '(') AND contains(b, ')') THEN '-' || regexp_replace(b, '[()]', '', 'g') ELSE b END, ',', '')"


@query(f"WITH a AS (SELECT id, trim(regexp_replace(raw, '^[A-Za-z₹$€£¥]+\\s*', '')) AS p FROM {_D}) SELECT id, {_PLAIN} AS amount FROM a")
def nrm06_plain_amount(spark, d):
    return _amounts(spark, d).select("id", N.plain_amount("raw").alias("amount"))


_BANK = f"WITH a AS (SELECT id, kind, status, regexp_replace(raw, '[₹$€£¥\\s]', '', 'g') AS b FROM {_D}), c AS (SELECT id, kind, status, {_BANK_TEXT} AS t FROM a), n AS (SELECT id, kind, status, coalesce({_num('t')}, 0) AS amount FROM c) "


@query(_BANK + "SELECT id, amount FROM n")
def nrm07_bank_amount(spark, d):
    return _amounts(spark, d).select("id", N.bank_amount("raw").alias("amount"))


@query(_BANK + "SELECT id, CASE WHEN regexp_matches(lower(kind), 'debit|dr|withdrawal|out') THEN 0 - abs(amount) WHEN regexp_matches(lower(kind), 'credit|cr|deposit|in') THEN abs(amount) ELSE amount END + 0 AS amount FROM n")
def nrm08_signed_by_type(spark, d):
    return _amounts(spark, d).select("id", (N.signed_by_type(N.bank_amount("raw"), "kind") + 0).alias("amount"))


@query(f"WITH a AS (SELECT id, regexp_extract(regexp_replace(regexp_replace(raw, 'INR', '', 'gi'), '[₹,\\s()]', '', 'g'), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?', 0) AS t FROM {_D}) SELECT id, TRY_CAST(nullif(t, '') AS DOUBLE) AS amount FROM a")
def nrm09_import_amount(spark, d):
    return _amounts(spark, d).select("id", N.import_amount("raw").alias("amount"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 AND id > 0 THEN CAST(id AS DOUBLE) WHEN id % 3 = 1 THEN -CAST(id AS DOUBLE) WHEN regexp_matches(lower(kind), 'income|credit|deposit') THEN CAST(id AS DOUBLE) ELSE 0 - CAST(id AS DOUBLE) END + 0 AS amount FROM {_D}")
def nrm10_import_sign(spark, d):
    x = F.col("id").cast("double")
    zero = F.lit(0.0)
    return _amounts(spark, d).select("id", (N.import_sign(x, F.when(F.col("id") % 3 == 0, x).otherwise(zero), F.when(F.col("id") % 3 == 1, x).otherwise(zero), "kind") + 0).alias("amount"))


@query(f"SELECT id, CAST(CASE lower(trim(status)) WHEN 'cancelled' THEN 0 WHEN 'refunded' THEN id + 1 ELSE -(id + 1) END AS DECIMAL(12,2)) AS amount FROM {_D}")
def nrm11_status_sign(spark, d):
    rows = _amounts(spark, d).select("id", (F.col("id") + 1).cast("string").alias("Amount"), F.col("status").alias("Status"), F.col("id").cast("string").alias("Description"))
    return R.normalised(rows).select(F.col("description").cast("bigint").alias("id"), "amount")


@query(f"SELECT id, CASE WHEN contains(s, 'refund') THEN 'refunded' WHEN contains(s, 'cancel') THEN 'cancelled' WHEN contains(s, 'fail') THEN 'failed' WHEN contains(s, 'complete') OR contains(s, 'success') THEN 'completed' WHEN s = '' THEN 'completed' ELSE s END AS status FROM (SELECT id, lower(trim(status)) AS s FROM {_D})")
def nrm15_status(spark, d):
    return _amounts(spark, d).select("id", N.status_name("status").alias("status"))


_DATES = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN '2026-02-30' WHEN 4 THEN {3} ELSE '' END AS raw FROM {4}"""


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def nrm12_dates(spark, d):
    fmt = lambda f: f"date_format(o_orderdate, '{f}')"
    sql = _DATES.format(fmt("dd/MM/yyyy"), fmt("yyyy-MM-dd"), fmt("d MMM yyyy"), fmt("yyyy-MM-dd HH:mm:ss"), "{orders}")
    return spark.sql(sql, orders=table(spark, d, "orders")).select("id", N.to_day("raw").alias("day"))


@query(f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'card' WHEN id % 5 = 1 THEN 'neft' WHEN regexp_matches(t, '\\bupi\\b|upvdr|upi/') THEN 'upi' WHEN regexp_matches(t, '\\bpos\\b|pos atm') THEN 'pos' WHEN regexp_matches(t, '\\batm\\b|atm wdl|atm cash') THEN 'atm' WHEN regexp_matches(t, '\\bneft\\b') THEN 'neft' WHEN regexp_matches(t, '\\bimps\\b') THEN 'imps' WHEN regexp_matches(t, '\\binb\\b|internet banking') THEN 'inb' WHEN regexp_matches(t, 'visa|mastercard|rupay') THEN 'card' ELSE 'unknown' END AS method FROM (SELECT id, lower(description) AS t FROM {duck('lines')})""")
def nrm16_method(spark, d):
    x = adapted(spark, d, "lines")
    col = F.when(F.col("id") % 5 == 0, " Card").otherwise("")
    parsed = F.when(F.col("id") % 5 == 1, "NEFT")
    return x.select("id", N.payment_method(col, parsed, F.col("description")).alias("method"))


@query(f"SELECT id, CASE WHEN amount < 0 THEN 'debit' ELSE 'credit' END AS direction FROM {duck('ledger')}")
def nrm23_direction(spark, d):
    return adapted(spark, d, "ledger").select("id", N.direction(F.col("amount")).alias("direction"))


@query(f"SELECT id, CAST(id % 50 - id % 30 AS DECIMAL(12,2)) AS amount FROM {duck('ledger')}")
def nrm06_debit_credit(spark, d):
    rows = adapted(spark, d, "ledger").select(F.col("id").cast("string").alias("Description"), (F.col("id") % 30).cast("string").alias("Debit"), (F.col("id") % 50).cast("string").alias(" Credit "))
    return R.normalised(rows).select(F.col("description").cast("bigint").alias("id"), "amount")


_HITS = ", ".join(f"('{b}', '{p}')" for b, ps in V.BANK_DESCRIPTIONS.items() for p in ps)


@query(f"""WITH h AS (SELECT * FROM (SELECT user_id % 25 AS file, upper(description) AS d, row_number() OVER (PARTITION BY user_id % 25 ORDER BY id) AS r FROM {duck('lines')}) WHERE r <= 100), p(bank, pattern) AS (VALUES {_HITS}),
n AS (SELECT file, count(*) AS n FROM h GROUP BY 1) SELECT n.file, p.bank, round(sum((SELECT count(*) FROM h WHERE h.file = n.file AND regexp_matches(h.d, p.pattern)))::DOUBLE / any_value(n.n), 4) AS score FROM n, p GROUP BY 1, 2""")
def agg24_bank_scores(spark, d):
    lines = adapted(spark, d, "lines").withColumn("file", F.col("user_id") % 25)
    return R.bank_scores(lines, "file", "id").withColumn("score", F.round("score", 4))
