"""Statement files, imports and sinks on small hand-made cases, with results worked out by hand."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.functions import text as T
from ledgerloom.operators import clusters as C
from ledgerloom.operators import imports as M
from ledgerloom.operators import ledger as L
from ledgerloom.operators import series as S
from ledgerloom.plans import imports as PI
from ledgerloom.sources import readers as R
from ledgerloom.sources import sinks as K
from ledgerloom.sources import statements as ST


def put(folder, files):
    for name, content in files.items():
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def lines(spark, folder, files, **options):
    rows = ST.canonical(ST.read_statements(spark, put(folder, files), **options)).orderBy("file", "row_idx").collect()
    return [(str(r.date), float(r.amount), r.description, r.merchant, r.method) for r in rows]


def test_debit_and_credit_files(spark, tmp_path):
    got = lines(spark, tmp_path, {"a.csv": "Date,Description,Debit,Credit\n2026-02-12,Salary,,5000.00\n2026-02-13,Rent,2000.00,\n"})
    assert [x[:3] for x in got] == [("2026-02-12", 5000.0, "Salary"), ("2026-02-13", -2000.0, "Rent")]


def test_each_file_has_its_own_columns(spark, tmp_path):
    files = {
        "a.csv": "Date,Description,Amount\n2026-02-12,Coffee,-5.00\n\n2026-02-13,Refund,10.00\n",
        "b.TSV": "Amount\tDate\tDescription\n7\t14/02/2026\tTea\n",
        "c.txt": "Date|Description|Amount\n1 Feb 2026|Cake|INR 3\n",
        "d.json": '[{"date": "2026-02-15", "amount": 1.5, "description": "Bun"}]',
        "e.csv": "Date,Description,Amount\n2026-02-16,Café,9\n".encode("latin-1"),
        "f.csv": "﻿Date,Description,Amount\n2026-02-17,Pie,8\n",
    }
    got = lines(spark, tmp_path, files)
    assert [x[:3] for x in got] == [("2026-02-12", -5.0, "Coffee"), ("2026-02-13", 10.0, "Refund"), ("2026-02-14", 7.0, "Tea"), ("2026-02-01", 3.0, "Cake"), ("2026-02-15", 1.5, "Bun"), ("2026-02-16", 9.0, "Café"), ("2026-02-17", 8.0, "Pie")]


def test_status_decides_on_signs_where_no_amount_is_negative(spark, tmp_path):
    head = '"Time","Transaction ID","Description","Product","Payment method","Status","Amount"\n'
    a = head + '"7 Feb 2026, 17:13",G1,Music,Tube,Visa 3534,Complete,INR 299.00\n"7 Feb 2026, 09:44",G2,Cloud,One,UPI,Refunded,INR 129.00\n"6 Feb 2026, 23:26",G3,Play,Apps,UPI,Cancelled,INR 149.00\n'
    b = head + '"7 Feb 2026, 17:13",G1,Music,Tube,Card,Complete,-1\n"7 Feb 2026, 17:13",G1,Music,Tube,Card,Complete,2\n'
    got = lines(spark, tmp_path, {"a.csv": a, "b.csv": b})
    assert [x[1] for x in got] == [-299.0, 129.0, 0.0, -1.0, 2.0] and got[0][4] == "Visa 3534" and got[0][0] == "2026-02-07"


def test_files_that_cannot_be_read(spark, tmp_path):
    files = {"a.exe": "x", "c.json": "{", "d.json": "[1]", "e.xls": bytes.fromhex("D0CF11E0A1B11AE1"), "f.csv": "\n\n", "g.csv": "Date,Amount\n2026-01-01,1\n"}
    rows = ST.read_statements(spark, put(tmp_path, files))
    # Spark's reader leaves empty files out, so that one is put in by hand
    rows = rows.unionByName(ST.statement_rows(spark.createDataFrame([("b.csv", bytearray())], "path string, content binary")))
    got = {r.file.rpartition("/")[2]: r.error for r in ST.failures(rows).collect()}
    assert set(got) == set("a.exe b.csv c.json d.json e.xls f.csv".split())
    assert (got["a.exe"], got["b.csv"], got["d.json"], got["e.xls"], got["f.csv"]) == ("unsupported file type", "empty file", "rows have to be objects", "Password required", "no rows")
    assert ST.canonical(rows).count() == 1


def test_separators(spark):
    assert [R.sniff_separator(x) for x in ("a,b;c", "a\tb;c", "a|b;c", "a;b", "abc", "a;b;c,d")] == [",", "\t", "|", ";", ",", ";"]


def test_header_rows():
    grid = [["Bank", None], ["Txn Date", "Narration", "Debit"], ["x", "y", "z"]]
    assert [R.header_row(grid, k) for k in ("statement", "wide")] == [1, 1]
    assert R.header_row([["Date", "Details"]], "ledger") == R.header_row([["some details"]], "details") == 0
    with pytest.raises(ValueError):
        R.header_row(grid, "ledger")


def test_grids_keep_their_own_headers(spark):
    rows = [("a", 0, ["Date", "Description", "Amount"]), ("a", 1, ["1", "x", "2"]), ("b", 0, ["title"]), ("b", 1, ["Amount", "Date", "Description", "", "Date"]), ("b", 2, ["3", "4", "y", "z", "no"]), ("b", 3, ["", " ", None])]
    got = {(r.path, r.row_idx): r["values"] for r in R.grid_table(spark.createDataFrame(rows, "path string, row_idx int, cells array<string>")).collect()}
    assert got == {("a", 1): {"Date": "1", "Description": "x", "Amount": "2"}, ("b", 2): {"Amount": "3", "Date": "4", "Description": "y", "column_3": "z"}}
    assert R.grid_table(spark.createDataFrame([], "path string, row_idx int, cells array<string>")).count() == 0


def test_headers_by_parts():
    assert R.resolve_by_parts(["Txn Date", "Value Date", "Narration", "Dr", "Credit", "Cr Balance"]) == {"Date": "Txn Date", "Details": "Narration", "Debit": "Dr", "Credit": "Credit"}


def test_import_twice_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = put(tmp_path / "in", {"a.csv": "Date,Description,Amount\n2026-02-12,Coffee,-5.00\n2026-02-12,Coffee,-5.00\n2026-02-30,none,1\n", "b.doc": "?"})
    fresh, bad = M.import_files(spark, folder, "u1", f"{tmp_path}/ledger")
    assert fresh.count() == 1 and bad.count() == 1
    r = spark.read.parquet(f"{tmp_path}/ledger").first()
    assert (r.user_id, r.transaction_date, r.category, r.type) == ("u1", "2026-02-12", "Uncategorized", "expense")
    assert r.fingerprint == hashlib.sha256(b"2026-02-12|-5.00|COFFEE|COFFEE||").hexdigest()
    assert M.import_files(spark, folder, "u1", f"{tmp_path}/ledger")[0].count() == 0


def test_records_have_the_fingerprint_of_what_they_show(spark, tmp_path):
    r = M.records(ST.canonical(ST.read_statements(spark, put(tmp_path, {"a.csv": "Date,Description,Amount\n2026-02-12,Swiggy order,150\n"})))).first()
    assert r.merchant == "Swiggy" and r.fingerprint == hashlib.sha256(b"2026-02-12|150.0|SWIGGY").hexdigest()


def test_null_keys_are_equal(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 1), (1, None, 2), (None, "a", 3), (1, "a", None)], "u long, k string, id long")
    for _ in range(3):
        K.append_new(rows, f"{tmp_path}/l", ["u", "k"], "id")
    assert sorted((r.u or 0, r.k or "", r.id or 0) for r in spark.read.parquet(f"{tmp_path}/l").collect()) == [(0, "a", 3), (1, "", 1), (1, "a", 0)]
    maps = rows.withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    assert L.new_rows(maps, maps.limit(0), ["u", "k"], "id").count() == 3


def values(spark, texts, fn):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


def test_payment_methods_by_words(spark):
    none = F.lit(None).cast("string")
    texts = ["cash deposit", "POS ATM PURCH", "WDL TFR UPVDR/1", "upi/1", "cupid shop", "ATM WDL", "whatsapp atmosphere", "NEFT x", "imps-1", "internet banking", "Visa 1", "card", None]
    assert values(spark, texts, lambda t: N.payment_method(none, none, t)) == ["unknown", "pos", "upi", "upi", "unknown", "atm", "unknown", "neft", "imps", "inb", "card", "unknown", "unknown"]


def test_dates_of_imports(spark):
    texts = ["01-02-2024 10:11", "1/2/24 10:11", "1-2-24", "7 Feb 2026, 17:13", "7 Sept 2026", "3/4/2025 1:02:03", "2026-02-30", "x", ""]
    day = datetime.date
    assert values(spark, texts, N.to_day) == [day(2024, 2, 1), day(2024, 2, 1), day(2024, 2, 1), day(2026, 2, 7), day(2026, 9, 7), day(2025, 4, 3), None, None, None]


def test_listed_words_are_plain_text(spark):
    assert values(spark, ["paid applexcom", "paid apple.com now"], lambda t: T.first_listed(t, [("Apple", ["apple.com"])], 99)) == [None, "Apple"]


def test_similar_counts(spark):
    rows = [(1, "a", "M"), (2, "a", "N"), (3, "b", "M"), (4, "a", "M"), (5, "c", ""), (6, "d", ""), (7, "e", "Unknown"), (8, None, "Unknown"), (9, None, None)]
    df = spark.createDataFrame(rows, "id long, description string, merchant_name string")
    pairs = L.similar_to(df, df).groupBy("chosen_id").count()
    want = {r.chosen_id: r["count"] for r in pairs.collect()}
    assert {r.id: r.n_similar for r in L.similar_counts(df).collect()} == {i: want.get(i, 0) for i, *_ in rows}


def test_training_view_in_blocks(spark):
    df = spark.createDataFrame([("a", f"t{i % 40}") for i in range(100)] + [("b", "x"), (None, "y"), ("b", None)], "category string, description string")
    got = L.training_view(df, 10).collect()
    assert sorted(t for r in got if r.category == "a" for t in r.descriptions) == sorted(f"t{i}" for i in range(40))
    assert len({r.block for r in got if r.category == "a"}) > 1 and [r.descriptions for r in got if r.category is None] == [["y"]]


def test_nearest_anchor(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, None)], "id long, v array<double>")
    anchors = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [4.0, 5.0])], "label string, mean array<double>")
    assert [(r.id, r.nearest) for r in C.nearest_anchor(df, "v", anchors).orderBy("id").collect()][:3] == [(1, "a"), (1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        C.nearest_anchor(df, "v", anchors, most=1)


def test_median_depth(spark):
    df = spark.createDataFrame([(i, [x / 10.0]) for i, x in enumerate([1, 2, 3, 4])], "id long, v array<double>")
    assert {r.id: r.level for r in C.taxonomy(df, "id", "v").collect()} == {0: "macro", 1: "micro", 2: "micro", 3: "micro"}


def test_quantile_forecast(spark):
    day = datetime.date(2026, 1, 1)
    rows = [(1, day + datetime.timedelta(n), 100 if n % 30 == 0 else 0, 1) for n in range(0, 120)] + [(2, day, 5, 0)]
    got = S.quantile_forecast(spark.createDataFrame(rows, "user_id long, date date, daily_income long, daily_spend long"), 3).collect()
    own = [r for r in got if r.user_id == 1]
    assert len(own) == 3 and all(r.p10 <= r.p50 <= r.p90 and r.error is None for r in own)
    # 400 in and 120 out so far; the first day ahead is a first of May, and firsts are paydays: 99, -1, -1, 99; a plain day costs 1
    assert [r.p50 for r in own] == [329.0, 328.0, 327.0]
    assert [r.error for r in got if r.user_id == 2] == ["at least 90 days of history are needed, got 1"]


def test_models_are_kept_and_removed(spark, tmp_path):
    store = K.ModelStore(spark, f"{tmp_path}/models", keep=2)
    for i, metric in enumerate([0.5, 0.1, 0.3]):
        store.save({"n": i}, metric)
    assert store.latest() == {"n": 2} and store.best() == {"n": 1}
    assert store.table().count() == store.listing().count() == 2


def test_files_made_from_many_orders_stay_readable(spark, tmp_path):
    n = 300_000
    orders = spark.range(n).selectExpr("id AS o_orderkey", "1L AS o_custkey", "timestamp'1998-02-06' AS o_orderdate", "'F' AS o_orderstatus", "1000.25D AS o_totalprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    # one file of all lines would be over the limit and give an error in their stead
    files = PI._delimited(PI._lines(spark, str(tmp_path)), ",", ".csv")
    assert files.agg(F.max(F.length("content"))).first()[0] < R.MOST_BYTES < files.agg(F.sum(F.length("content"))).first()[0]
    assert PI._read(files).agg(F.count_distinct("id")).first()[0] == n



def test_similar_sums_are_those_of_the_pairs(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x"), (5, "c", ""), (6, "d", ""), (7, None, "Unknown"), (8, "", "Unknown"), (9, "e", None), (10, "f", "z"), (11, "a", None)]
    df = spark.createDataFrame(rows, "id long, description string, merchant_name string")
    chosen = df.where("id <> 2")
    pairs = L.similar_to(df, chosen).groupBy("chosen_id").agg(F.count(F.lit(1)).alias("n"), F.sum("similar_id").alias("ids"))
    want = sorted(map(tuple, pairs.collect()))
    sums = L.similar_sums(df, chosen)
    assert sorted(map(tuple, sums.collect())) == want and (7, 1, 8) in want
    # no row of df meets a row of the chosen ones but by its group
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3



def test_whole_groups_of_many_blocks(spark):
    df = spark.range(1000).selectExpr("concat('t', id) AS t")
    blocks = L.grouped_texts(df, "t", F.lit("g"), block=100)
    assert blocks.count() > 1
    got = L.whole_groups(blocks, "grouped", "members").collect()
    assert [(r.grouped, r.members) for r in got] == [("g", sorted(f"t{i}" for i in range(1000)))]



def test_depths_that_differ_by_rounding_are_one_depth(spark):
    # the median is 1's; 0 is as deep but for the last places of its sum, and 3 is nearer by more than that
    rows = [(0, [0.3 - 1e-13, 0.0]), (1, [0.3, 0.0]), (2, [0.5, 0.0]), (3, [0.3 - 1e-6, 0.0]), (4, [0.6, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {r.id: r.level for r in C.taxonomy(df, "id", "v").collect()} == {0: "micro", 1: "micro", 2: "micro", 3: "macro", 4: "micro"}


def test_forecasts_of_many_users_share_a_task(spark):
    start = datetime.date(2025, 1, 1)
    rows = [(u, start + datetime.timedelta(d), 100 + u if d % 30 == 0 else 0, d % 7 + u) for u in range(600) for d in ((0, 30, 60, 95) if u else (0, 5))]
    rows += [(None, start + datetime.timedelta(d), 5, 0) for d in (0, 99)]
    found = S.quantile_forecast(spark.createDataFrame(rows, "user_id long, date date, daily_income long, daily_spend long"), 2)
    # no function call for each user
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert len(got) == 600 * 2 + 1 and {r.user_id for r in got} == {None, *range(600)}
    assert [(r.date, r.p50, r.error) for r in got if r.user_id == 0] == [(None, None, "at least 90 days of history are needed, got 6")]
    assert sorted(str(r.date) for r in got if r.user_id is None) == ["2025-04-11", "2025-04-12"]
