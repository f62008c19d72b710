"""Every ledger query against its SQL in DuckDB, and the functions on small examples."""

import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import ORACLES, QUERIES
from ledgerloom.functions import augment as A
from ledgerloom.functions import fingerprint as P
from ledgerloom.functions import text as T
from ledgerloom.functions import vectors as X
from ledgerloom.operators import clusters as C
from ledgerloom.operators import jobs as J
from ledgerloom.operators import ledger as L
from ledgerloom.sources import readers as R
from ledgerloom.streaming import ingest as I

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def values(spark, texts, fn):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r[0] for r in rows.orderBy("i").select(fn("t")).collect()]


def test_merchants(spark):
    got = values(spark, ["swiggy instamart order", "UPI/123456/Asha Kumar/ybl", "", None], T.extract_merchant)
    assert got == ["Swiggy Instamart", "Asha Kumar", "", ""]


def test_placeholders(spark):
    assert values(spark, ["Order #123-456", "Txn_99 done", "paid 12345678", None], T.group_key) == ["order #ORDER", "txn_XXXXX done", "paid XXXXX", ""]


def test_redaction(spark):
    assert values(spark, ["mail a.b@c.org or 555-123-4567"], T.redact) == ["mail [EMAIL_REDACTED] or [PHONE_REDACTED]"]


def test_debit_and_credit_columns(spark):
    rows = spark.createDataFrame([("2026-01-02", "Salary", None, "5000"), ("03/01/2026", "Rent", "2000", None)], "Date string, Description string, Debit string, Credit string")
    got = {r.description: (str(r.date), float(r.amount)) for r in R.normalised(rows).collect()}
    assert got == {"Salary": ("2026-01-02", 5000.0), "Rent": ("2026-01-03", -2000.0)}


def test_lone_debit_column_uses_the_amount(spark):
    rows = spark.createDataFrame([("2026-01-02", "a", "7", "9")], "Date string, Description string, Debit string, Amount string")
    assert float(R.normalised(rows).first().amount) == 9.0


def test_fingerprints_fold_case_and_blanks(spark):
    rows = spark.createDataFrame([("2026-01-02", 150.0, " Shop "), ("2026-01-02", 150.0, "SHOP"), ("2026-01-02", 150.1, "SHOP")], "d string, a double, m string")
    a, b, c = [r[0] for r in rows.select(P.three_fields(F.col("d").cast("date"), F.col("a"), "m")).collect()]
    assert a == b != c and len(a) == 64


def test_distance_on_the_ball(spark):
    zero, half = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.0))
    assert abs(spark.range(1).select(X.distance(zero, half)).first()[0] - 2 * math.atanh(0.5)) < 1e-9


def test_expmap_and_logmap_are_inverse(spark):
    v = F.array(F.lit(0.3), F.lit(-0.4))
    assert [round(x, 9) for x in spark.range(1).select(X.logmap0(X.expmap0(v))).first()[0]] == [0.3, -0.4]


def test_kmeans_separates(spark):
    points = [(i, [s * (0.5 + 0.01 * j), 0.01 * j]) for i, (s, j) in enumerate([(s, j) for s in (-1, 1) for j in range(3)])]
    df = spark.createDataFrame(points, "id long, v array<double>")
    labels = {r.id: r.label for r in C.nearest(df, F.col("v"), C.kmeans(df, "id", "v", 2)).collect()}
    assert labels[0] == labels[1] == labels[2] != labels[3] == labels[4] == labels[5]


def test_rules_come_before_the_model(spark):
    df = spark.createDataFrame([(1, "NETFLIX.COM"), (2, None), (3, "qzx")], "id long, d string")
    got = {r.id: r for r in C.predict(df, "d").collect()}
    assert got[1].category == "Entertainment" and got[1].confidence == 1.0 and len(got) == 3 and got[3].confidence < 1


def test_jobs_move_by_the_rules(spark):
    jobs = spark.createDataFrame([(1, "pending", 0, 5), (2, "processing", 2, 4)], "id long, status string, attempts int, created_at long")
    assert J.next_pending(jobs).first().id == 1
    assert J.moved(jobs, 1, "pending", "processing").where("id = 1").first().status == "processing"
    assert J.failed_or_retried(jobs, 2).where("id = 2").first().status == "failed"
    with pytest.raises(ValueError):
        J.moved(jobs, 1, "completed", "pending")


def test_dropout_never_empties_a_text(spark):
    df = spark.createDataFrame([(1, "a a a b"), (2, "c"), (3, "")], "id long, t string")
    got = {r.id: r.view for r in A.frequency_dropout(df, "id", "t", A.term_frequency(df, "t"), p=5.0).collect()}
    assert got[1] and got[2] == "c"


def test_ingest_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3)], "user_id long, fingerprint string, id long")
    source, ledger = f"{tmp_path}/in", f"{tmp_path}/ledger"
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        I.ingest(spark, source, rows.schema, ledger, f"{tmp_path}/state", ["user_id", "fingerprint"], "id").awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(ledger).collect()) == [1, 3]


def test_anonymised_ledgers_hold_nothing_that_names_a_user(spark):
    rows = [(1, "u", 5.0, "2024-01-02", "Food", "Cafe", "to a.b@c.org 5551234567"), (2, "u", -1.0, None, None, None, None), (3, None, 2.0, "2024-01-03", "", "", "")]
    df = spark.createDataFrame(rows, "id long, user_id string, amount double, transaction_date string, category string, merchant_name string, description string").withColumns({"date": F.lit("x"), "merchant": F.lit("y")})
    keep = [("Food", "Cafe", "to [EMAIL_REDACTED] [PHONE_REDACTED]"), (None, None, None), ("", "", None)]
    got = L.anonymised(df)
    assert got.columns == ["amount", "date", "category", "merchant", "description"]
    assert [tuple(r)[2:] for r in got.collect()] == keep
    masked = [tuple(r)[3:] for r in L.anonymised(df, mask_merchant=True, scrub=False).collect()]
    assert masked == [("Food_Merchant", "to a.b@c.org 5551234567"), ("null_Merchant", None), ("_Merchant", None)]
    assert L.anonymised(df.limit(0)).collect() == []
