"""Queries over statement files, which are made from the orders, and over what becomes of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..operators import imports as M
from ..operators import ledger as L
from ..sources import readers as R
from ..sources import sinks as K
from ..sources import statements as S
from ..sources.ledger_store import held
from ..staging import fresh_path
from .adapters import adapted, duck, table
from .registry import query

_L = duck("ledger")

#: Orders as lines of statements: a day, a description with commas, quotes and letters beyond ASCII, and an amount on one of two sides.
_LINES = """
SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS income, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(12,2)) AS STRING) AS price,
  concat('Café "', CAST(o_custkey % 50 AS STRING), '", no. ', CAST(o_orderkey AS STRING)) AS description
FROM orders
"""
_SQL = f"""SELECT id, day AS date, CAST(CASE WHEN income THEN price ELSE '-' || price END AS DECIMAL(12,2)) AS amount, description FROM ({_LINES.replace("STRING", "VARCHAR")})"""


#: The orders' numbers of one file lie within a stretch of this length: whoever they belong to, it stays under the limit of a file.
_STRETCH = 1 << 16


def _lines(spark, d):
    return spark.sql(_LINES.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def _files(df, header: str, line, suffix: str, charset: str = "UTF-8", begin: str = "", end: str = "", between: str = "\n"):
    """(path, content): the lines as files of customers' numbers modulo 23, of a stretch of the orders' numbers each: more lines make more files, not larger ones."""
    rows = df.select(F.concat_ws("-", F.col("user_id") % 23, F.expr(f"id div {_STRETCH}")).alias("f"), F.struct("id", line.alias("t")).alias("r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), between)
    grouped = rows.groupBy("f").agg(text.alias("t"))
    return grouped.select(F.concat(F.lit("in/"), "f", F.lit(suffix)).alias("path"), F.encode(F.concat(F.lit(f"{begin}{header}"), F.col("t"), F.lit(end)), charset).alias("content"))


def _delimited(df, sep: str, suffix: str, header: str = "Date,Description,Debit,Credit", charset: str = "UTF-8"):
    quoted = F.concat(F.lit('"'), F.replace(F.col("description"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(sep, F.date_format("day", "dd/MM/yyyy"), quoted, F.when(F.col("income"), "").otherwise(F.col("price")), F.when(F.col("income"), F.col("price")).otherwise(""))
    return _files(df, header.replace(",", sep) + "\n", line, suffix, charset)


def _as_objects(df, begin: str, end: str):
    amount = F.when(F.col("income"), F.col("price")).otherwise(F.concat(F.lit("-"), F.col("price"))).cast("decimal(12,2)")
    line = F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), "description", amount.alias("amount")))
    return _files(df, "", line, ".json", begin=begin, end=end, between=",")


def _read(files, **options):
    lines = S.canonical(S.statement_rows(files, **options))
    return lines.select(F.regexp_extract("description", r"no\. (\d+)$", 1).cast("bigint").alias("id"), "date", "amount", "description")


@query(_SQL)
def src01_csv(spark, d):
    return _read(_delimited(_lines(spark, d), ",", ".csv"))


@query(_SQL)
def src02_unknown_suffix(spark, d):
    return _read(_delimited(_lines(spark, d), ",", ".dat"), guarded=False)


@query(_SQL)
def src03_json_array(spark, d):
    return _read(_as_objects(_lines(spark, d), "[", "]"))


@query(_SQL)
def src03_json_object(spark, d):
    return _read(_as_objects(_lines(spark, d), '{"transactions": [', "]}"))


@query(_SQL)
def src04_tsv(spark, d):
    return _read(_delimited(_lines(spark, d), "\t", ".tsv"))


@query(_SQL)
def src07_latin1(spark, d):
    return _read(_delimited(_lines(spark, d), ",", ".csv", charset="ISO-8859-1"))


@query(_SQL)
def src09_semicolons(spark, d):
    return _read(_delimited(_lines(spark, d), ";", ".txt"))


@query(_SQL)
def src10_bars_in_pdf(spark, d):
    return _read(_delimited(_lines(spark, d), "|", ".pdf"), guarded=False)


@query(_SQL)
def nrm02_statement_headers(spark, d):
    return _read(_delimited(_lines(spark, d), ",", ".csv", "Value Date,Narration,Withdrawal,Deposit"), synonyms=V.STATEMENT_SYNONYMS)


_GUARD = "CASE o_orderkey % 4 WHEN 0 THEN 'unsupported file type' WHEN 1 THEN 'empty file' WHEN 2 THEN 'Password required' END"


def _guarded(spark, d):
    k = F.col("o_orderkey") % 4
    path = F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.when(k == 0, ".exe").otherwise(".xls"))
    content = F.when(k == 1, F.lit("").cast("binary")).when(k == 2, F.unhex(F.lit("D0CF11E0A1B11AE1"))).otherwise(F.encode(F.lit("Date,Amount\n"), "UTF-8"))
    return table(spark, d, "orders").select(path.alias("path"), content.alias("content"), F.length(content).cast("bigint").alias("length"))


@query(f"SELECT 'in/' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.exe' ELSE '.xls' END AS path, {_GUARD} AS error, sha256(CASE o_orderkey % 4 WHEN 1 THEN ''::BLOB WHEN 2 THEN unhex('D0CF11E0A1B11AE1') ELSE encode('Date,Amount' || chr(10)) END) AS file_hash FROM orders")
def src15_hashes_and_guards(spark, d):
    return R.check_files(_guarded(spark, d)).select("path", "error", "file_hash")


@query(f"SELECT 'in/' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.exe' ELSE '.xls' END AS file, {_GUARD} AS error FROM orders WHERE o_orderkey % 4 < 3")
def src16_failures(spark, d):
    return S.failures(S.statement_rows(_guarded(spark, d)))


@query(f"SELECT id, CAST(day AS VARCHAR) AS day, description FROM ({_LINES.replace('STRING', 'VARCHAR')})")
def src11_header_rows(spark, d):
    f = F.col("user_id") % 23
    lines = _lines(spark, d).select(f.alias("f"), (F.col("id") + 30).cast("int").alias("row_idx"), F.array(F.col("id").cast("string"), F.lit(None).cast("string"), F.col("day").cast("string"), F.col("description")).alias("cells"))
    files = lines.select("f").distinct()
    # a title, and the header some rows below
    head = files.select("f", (F.col("f") % 19).cast("int").alias("row_idx"), F.array(F.lit("Amount"), F.lit(" "), F.lit(" Txn Date "), F.lit("Narration")).alias("cells"))
    title = files.where("f % 19 > 0").select("f", F.lit(0).alias("row_idx"), F.array(F.lit("Statement"), F.lit(None).cast("string"), F.lit(""), F.lit("")).alias("cells"))
    grid = title.unionByName(head).unionByName(lines).withColumn("path", F.col("f").cast("string"))
    v = F.col("values")
    return R.grid_table(grid).select(v["Amount"].cast("bigint").alias("id"), v["Txn Date"].alias("day"), v["Narration"].alias("description"))


def _canonical(spark, d):
    return S.canonical(S.statement_rows(_delimited(_lines(spark, d), ",", ".csv")))


@query(f"SELECT id, CAST(date AS DATE) AS date, amount, length(description) > 0 AS described FROM ({_SQL})")
def nrm22_records(spark, d):
    r = M.records(_canonical(spark, d))
    # a fingerprint is the hash of what stands in the row
    same = F.col("fingerprint") == F.sha2(F.concat_ws("|", F.col("date").cast("string"), F.regexp_replace(F.col("amount").cast("string"), r"(\.\d)0$", "$1"), F.upper(F.trim("merchant"))), 256)
    return r.where(same).select(F.regexp_extract("description", r"no\. (\d+)$", 1).cast("bigint").alias("id"), "date", "amount", (F.length("description") > 0).alias("described"))


@query(f"SELECT id, 'u' AS user_id, CAST(date AS VARCHAR) AS transaction_date, amount, description, 'Uncategorized' AS category, CASE WHEN amount < 0 THEN 'expense' ELSE 'income' END AS type, '' AS method FROM ({_SQL})")
def nrm20_payloads(spark, d):
    p = M.payloads(_canonical(spark, d), F.lit("u"))
    return p.select(F.regexp_extract("description", r"no\. (\d+)$", 1).cast("bigint").alias("id"), "user_id", "transaction_date", "amount", "description", "category", "type", F.col("raw_data")["method"].alias("method"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'Parsed' WHEN merchant_name <> '' THEN merchant_name WHEN id % 5 = 0 THEN 'Zomato' WHEN id % 5 = 1 THEN 'Swiggy Instamart' ELSE 'Unknown' END AS merchant FROM {_L}")
def nrm17_merchant(spark, d):
    parsed = F.when(F.col("id") % 3 == 0, "Parsed").otherwise("Unknown")
    text = F.when(F.col("id") % 5 == 0, "paid ZOMATO").when(F.col("id") % 5 == 1, "instamart by swiggy").otherwise("shop")
    return adapted(spark, d, "ledger").select("id", M.merchant_by_precedence(parsed, F.col("merchant_name"), text).alias("merchant"))


@query(f"SELECT id, user_id, transaction_date, amount, CASE WHEN merchant_name = '' THEN 'Unknown Merchant' ELSE merchant_name END AS merchant_name, category, 'Cash' AS payment_method, CASE WHEN id % 2 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN amount >= 0 THEN 'credit' ELSE 'debit' END AS type FROM {_L}")
def nrm21_displayed(spark, d):
    rows = adapted(spark, d, "ledger").withColumns({"payment_method": F.lit(" "), "type": F.lit(None).cast("string"), "status": F.when(F.col("id") % 2 == 1, F.col("status"))})
    return M.displayed(rows).drop("description")


_FORMATS = ["%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%Y/%m/%d", "%d %b %Y", "%d %B %Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S"]
_JAVA = ["dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "dd MMMM yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]


def _spelled(spark, d, formats: list[str]):
    day = F.col("o_orderdate").cast("timestamp")
    raw = F.when(F.lit(False), "")
    for i, f in enumerate(formats):
        raw = raw.when(F.col("o_orderkey") % len(formats) == i, F.date_format(day, f))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders")
def nrm13_statement_dates(spark, d):
    return _spelled(spark, d, _JAVA).select("id", N.to_day("raw", V.STATEMENT_DATES).alias("day"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 IN (2, 5) AND year(o_orderdate) < 2000 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 100 YEAR AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders WHERE NOT (o_orderkey % 7 IN (2, 5) AND month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
def nrm14_import_dates(spark, d):
    odd = _spelled(spark, d, ["d/M/yyyy H:mm", "d-M-yyyy H:mm:ss", "d-M-yy H:mm", "d MMM yyyy, H:mm", "d/M/yyyy", "d/M/yy H:mm:ss", "d MMMM yyyy"])
    leap = (F.col("id") % 7).isin(2, 5) & F.col("raw").rlike("^29[-/]2[-/]")
    return odd.where(~leap).select("id", N.to_day("raw").alias("day"))


@query(f"SELECT id, user_id, amount FROM {_L} WHERE user_id = 7")
def flt04_user(spark, d):
    return L.for_user(adapted(spark, d, "ledger"), 7).select("id", "user_id", "amount")


@query("SELECT event_id AS id, ts FROM events WHERE ts >= (SELECT min(ts) FROM events) AND ts <= date_trunc('day', (SELECT min(ts) FROM events)) + INTERVAL 3 DAY")
def flt05_times(spark, d):
    moves = adapted(spark, d, "moves")
    first = moves.agg(F.min("ts").alias("a"), (F.date_trunc("day", F.min("ts")) + F.expr("interval 3 days")).alias("b")).first()
    return M.between_times(moves, "ts", str(first["a"]), str(first["b"])).select("id", "ts")


@query(f"SELECT id, amount FROM {_L} WHERE amount < 0")
def flt09_debit_tab(spark, d):
    return M.tab(adapted(spark, d, "ledger"), "debit").select("id", "amount")


@query(f"SELECT id, amount FROM {_L} WHERE amount >= 0")
def flt09_credit_tab(spark, d):
    return M.tab(adapted(spark, d, "ledger"), "credit").select("id", "amount")


@query(f"SELECT id, category FROM {_L} WHERE id % 3 = 2")
def flt12_categorised(spark, d):
    rows = adapted(spark, d, "ledger").withColumn("category", F.when(F.col("id") % 3 == 0, "Uncategorized").when(F.col("id") % 3 == 2, F.col("category")))
    return M.categorised(rows).select("id", "category")


@query(f"SELECT id, merchant_name AS raw, upper(merchant_name) AS cleaned FROM {_L} WHERE merchant_name <> upper(merchant_name) ORDER BY id LIMIT 100")
def flt13_changed(spark, d):
    return M.changed_by(adapted(spark, d, "ledger"), "merchant_name", F.upper("merchant_name"), "id")


@query(f"SELECT id, CASE WHEN description LIKE '%SHOP 3' THEN 'Third' ELSE category END AS category FROM {_L}")
def joi05_found_categories(spark, d):
    rows = adapted(spark, d, "ledger")
    found = rows.select("description").distinct().withColumn("category", F.when(F.col("description").like("%SHOP 3"), "Third").otherwise(""))
    return M.with_categories(rows, found).select("id", "category")


@query(f"SELECT id, category FROM {_L} WHERE category IN ('1-URGENT', '5-LOW')")
def joi06_known_categories(spark, d):
    anchors = spark.createDataFrame([("1-URGENT", [1.0]), ("5-LOW", [2.0]), ("other", [0.0])], "label string, mean array<double>")
    return M.of_known_categories(adapted(spark, d, "ledger"), anchors).select("id", "category")


@query(f"SELECT id, description, length(description) AS size, upper(description) AS large FROM {_L}")
def exp02_expanded(spark, d):
    rows = adapted(spark, d, "ledger").select("id", "description", F.struct(F.length("description").cast("bigint").alias("size"), F.upper("description").alias("large")).alias("s"))
    return M.expanded(rows, "s")


@query(f"SELECT id, user_id, date_trunc('month', transaction_date)::DATE AS month, CAST(row_number() OVER (PARTITION BY user_id, date_trunc('month', transaction_date) ORDER BY transaction_date DESC, id DESC) AS INT) AS place FROM {_L}")
def top04_by_month(spark, d):
    return M.by_month(adapted(spark, d, "ledger")).select("id", "user_id", "month", "place")


@query(f"SELECT user_id, description, CASE WHEN min(CASE WHEN id % 2 = 0 THEN id END) IS NULL THEN min(id) ELSE min(CASE WHEN id % 2 = 0 THEN id END) END AS id FROM {_L} GROUP BY 1, 2")
def snk01_appended(spark, d):
    rows, path = adapted(spark, d, "ledger").select("user_id", "description", "id"), fresh_path(spark, "ledger")
    for part in (rows.where("id % 2 = 0"), rows, rows):
        K.append_new(part, path, ["user_id", "description"], "id")
    return held(spark, path, ["user_id", "description"])


@query(f"SELECT CAST(transaction_date AS VARCHAR) || ',' || CASE WHEN regexp_matches(d, '[\",]') THEN '\"' || replace(d, '\"', '\"\"') || '\"' ELSE d END || ',' || merchant_name || ',' || category || ',' || amount || ',expense' AS line FROM (SELECT *, description || CASE id % 3 WHEN 0 THEN ', \"x\"' ELSE '' END AS d FROM {_L}) WHERE merchant_name <> ''")
def snk04_export(spark, d):
    rows, path = adapted(spark, d, "ledger"), fresh_path(spark, "export")
    K.export_csv(rows.where("merchant_name <> ''").withColumns({"description": F.concat("description", F.when(F.col("id") % 3 == 0, ', "x"').otherwise("")), "type": F.lit(None).cast("string")}), path)
    return spark.read.text(path).where("not value like 'transaction_date,%'").select(F.col("value").alias("line"))


@query(f"SELECT id, user_id FROM {_L} WHERE user_id <> 7")
def snk06_without_user(spark, d):
    return K.without_user(adapted(spark, d, "ledger"), 7).select("id", "user_id")


@query(f"SELECT user_id, description, category AS original_category, 'Food' AS corrected_category FROM {_L} WHERE id % 2 = 0")
def snk07_corrections(spark, d):
    path = fresh_path(spark, "corrections")
    rows = adapted(spark, d, "ledger").where("id % 2 = 0").withColumns({"original_category": F.col("category"), "corrected_category": F.lit("Food")})
    for half in (rows.where("id % 4 = 0"), rows.where("id % 4 = 2")):
        K.append_corrections(half, path)
    return spark.read.parquet(path)
