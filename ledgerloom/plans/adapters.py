"""The test tables as ledgers: each adapter is SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders as a batch ledger.
LEDGER = """
SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS transaction_date,
  CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(12,2)) AS amount,
  o_orderpriority AS category, o_orderstatus AS status,
  CASE o_orderkey % 13 WHEN 0 THEN 'SWIGGY' WHEN 1 THEN 'Zomato*Order' WHEN 2 THEN '' WHEN 3 THEN 'Uber India' WHEN 4 THEN 'Netflix.com' WHEN 5 THEN 'Unknown' ELSE concat('Shop ', CAST(o_custkey % 50 AS STRING)) END AS merchant_name,
  concat('POS ', CAST(o_orderkey % 400 AS STRING), ' SHOP ', CAST(o_custkey % 7 AS STRING)) AS description
FROM orders
"""

#: The same rows as the ledgers of 25 branches, each with years of days.
BRANCHES = f"SELECT id, user_id % 25 AS user_id, transaction_date, amount FROM ({LEDGER.strip()})"

#: Lines with merchants.
PURCHASES = """
SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS user_id, CAST(l_shipdate AS DATE) AS transaction_date,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(12,2)) AS amount,
  p_name AS merchant_name, p_type AS category, l_linestatus AS payment_method, p_brand AS description
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""

#: Events as a ledger of a month.
MOVES = """
SELECT event_id AS id, user_id, ts, CAST(ts AS DATE) AS transaction_date, event_type AS category,
  CAST(CASE WHEN event_type IN ('purchase', 'click') THEN -value ELSE value END AS DECIMAL(12,2)) AS amount
FROM events
"""

#: Bank-style descriptions of many shapes.
LINES = """
SELECT id, user_id, name, CASE id % 20
  WHEN 0 THEN concat('WDL TFR UPI/DR/', CAST(600000000000 + id AS STRING), '/', name, '/BNKA/', lower(name), CAST(id % 97 AS STRING), '/Appx')
  WHEN 1 THEN concat('POS ATM PURCH OTHPG ', CAST(4400000000 + id AS STRING), ' ', CAST(id % 90 + 10 AS STRING), 'Sto*', name, ' COUNTER RIVERTON')
  WHEN 2 THEN concat('ATM WDL ATM CASH ', CAST(id % 9000 + 1000 AS STRING), ' MQ HILL ROAD, EASTPORT')
  WHEN 3 THEN concat('WDL TFR INB ', name, ' Web Store AT 07741 HILL EASTPORT')
  WHEN 4 THEN 'CASH DEPOSIT SELF AT 07741 HILL EASTPORT'
  WHEN 5 THEN concat('CEMTEX DEP ', CAST(10000000 + id AS STRING), ' 111111 ', name, ' COUNTER')
  WHEN 6 THEN concat('NEFT/', CAST(id AS STRING), '/', name, '/BNKB/x')
  WHEN 7 THEN concat('DEP TFR BNKX', CAST(id AS STRING), 'Q7731 OF Mr ', upper(name), ' FIELD MO')
  WHEN 8 THEN concat('UPI-', upper(name), '-', CAST(id AS STRING), '@bnka')
  WHEN 9 THEN concat('IMPS-ABC-', CAST(id AS STRING), '-', name, '-done')
  WHEN 10 THEN concat(name, ' order #', CAST(id AS STRING), '-31 TXN_', CAST(id AS STRING))
  WHEN 11 THEN concat('UPI/PAYTM/', CAST(100000 + id AS STRING), '/', name, '/bank')
  WHEN 12 THEN concat('payment 03/11/2025 INR 75.50 to ', name, ' 2025-11-03')
  WHEN 13 THEN concat('salary credited by ', name)
  WHEN 14 THEN concat('DEP TFR VISA-IN-RMT:', CAST(300000000000 + id AS STRING), upper(name))
  WHEN 15 THEN concat('WDL TFR UPVDR/', CAST(600000000000 + id AS STRING), '/', upper(name), './BNKC/xyz')
  WHEN 16 THEN concat('Contact ', lower(name), '@example.org or 555.867.', CAST(1000 + id % 9000 AS STRING))
  WHEN 17 THEN concat('NEFT-BNKA000', CAST(id % 10000 AS STRING), '-RENT ', name)
  WHEN 18 THEN ''
  ELSE concat('Unknown   Store ', name, ' ', CAST(id AS STRING)) END AS description
FROM (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderkey % 17
  WHEN 0 THEN 'Swiggy' WHEN 1 THEN 'Zomatofo' WHEN 2 THEN 'Uber' WHEN 3 THEN 'Phonepe' WHEN 4 THEN 'Amazon' WHEN 5 THEN 'Netflix' WHEN 6 THEN 'Faridha'
  WHEN 7 THEN 'Gymkhana' WHEN 8 THEN 'Apollo' WHEN 9 THEN 'Zerodha' WHEN 10 THEN 'Kirana' WHEN 11 THEN 'Mcdonalds' WHEN 12 THEN 'Metro' WHEN 13 THEN 'Bigmart'
  WHEN 14 THEN 'Paytm' WHEN 15 THEN 'Irctc' ELSE 'Rahul' END AS name FROM orders)
"""

TABLES = {"ledger": LEDGER, "branches": BRANCHES, "purchases": PURCHASES, "moves": MOVES, "lines": LINES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = TABLES[name]
    used = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "events") if f" {t}" in sql.replace("\n", " ")}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **used)


def duck(name: str) -> str:
    """The adapter as a subquery for DuckDB."""
    return f"({TABLES[name].replace('STRING', 'VARCHAR').strip()}\n)"


def last_day(df: DataFrame, date: str = "transaction_date"):
    """The last day of a ledger, as a subquery of one row: it stands for today."""
    return df.agg(F.max(F.to_date(date)).alias("last")).scalar()
