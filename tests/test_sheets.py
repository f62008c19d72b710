"""Workbooks, and files that break their parsers, on small hand-made cases."""

import tracemalloc
import zipfile

import pyarrow as pa
import pytest

from ledgerloom.operators import imports as M
from ledgerloom.plans import sheets as PS
from ledgerloom.plans.sheets import workbook
from ledgerloom.sources import sheets as X
from ledgerloom.sources import statements as ST

SHEET = """<row r="2"><c r="A2" t="s"><v>0</v></c></row>
<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4" t="inlineStr"><is><t>Details</t></is></c><c r="AA4" t="str"><v>Amount</v></c></row>
<row r="5"><c r="A5" s="1"><v>45000</v></c><c r="B5" t="s"><v>2</v></c><c r="AA5"><v>-100.10000000000001</v></c></row>
<row><c s="2"><v>45000.75</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c s="3"><v>7</v></c></row>
<row r="9"><c r="B9" t="s"><v>3</v></c></row>"""
SHARED = ["My <bank> & co", "Date", "Tea", " "]


def test_cells_as_text():
    assert dict(X.first_sheet(workbook(SHEET, SHARED))) == {
        1: ["My <bank> & co"],
        3: ["Date", "Details", *[None] * 24, "Amount"],
        4: ["2023-03-15", "Tea", *[None] * 24, "-100.1"],
        5: ["2023-03-15 18:00:00", "TRUE", None, "7"],
    }


def test_serials():
    assert [X.day_text(s, late) for s, late in ((1, False), (59, False), (60, False), (61, False), (0, True), (45000.5, False), (45000.999999, False))] == ["1900-01-01", "1900-02-28", "1900-02-28", "1900-03-01", "1904-01-01", "2023-03-15 12:00:00", "2023-03-16"]
    assert [X._shows_time("9", {"9": c}) for c in ("0.00", '"days" 0', "[Red]0", "yyyy-mm", "h:mm", "@", "\\d0", "#,##0_d")] == [False, False, False, True, True, False, False, False]


def test_dates_from_1904():
    (_, cells), *_ = X.first_sheet(workbook('<row r="1"><c r="A1" s="1"><v>1</v></c></row>', [], late=True))
    assert cells == ["1904-01-02"]


def write(folder, files):
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return str(folder)


def test_a_workbook_is_a_statement(spark, tmp_path):
    rows = ST.canonical(ST.read_statements(spark, write(tmp_path, {"a.xlsx": workbook(SHEET, SHARED)}), {"date": ["date"], "description": ["details"], "amount": ["amount"]}))
    assert [(str(r.date), float(r.amount), r.description) for r in rows.orderBy("row_idx").collect()] == [("2023-03-15", -100.1, "Tea"), ("2023-03-15", 0.0, "TRUE")]


def test_no_file_ends_the_import_of_the_others(spark, tmp_path):
    good, empty = workbook(SHEET, SHARED), workbook("", [])
    files = {
        "a.json": b"[" * 100_000,
        "b.xlsx": good[: len(good) // 2],
        "c.xlsx": empty,
        "d.xlsx": b"PK\x03\x04" + b"\0" * 100,
        "e.csv": b"Date,Description,Amount\n2026-01-01," + b"x" * 200_000 + b",5\n",
        "f.csv": b"Date;Description;Amount\n2026-01-02;a, b;6\n",
        "g.xlsx": workbook("<row><c><v>x</v></c></row>", []),
        "h.xlsx": workbook('<row><c t="s"><v>9</v></c></row>', []),
        "i.xlsx": workbook("<row><broken></row>", []),
        "j.csv": b'Date,Description,Amount\n2026-01-03,"a;b;c;d",7\n',
    }
    fresh, bad = M.import_files(spark, write(tmp_path, files), "u", f"{tmp_path}/ledger")
    assert sorted((r.transaction_date, float(r.amount), len(r.description)) for r in fresh.collect()) == [("2026-01-01", 5.0, 200_000), ("2026-01-02", 6.0, 4), ("2026-01-03", 7.0, 7)]
    errors = {r.file.rpartition("/")[2]: r.error for r in bad.collect()}
    assert set(errors) == {"a.json", *(f"{c}.xlsx" for c in "bcdghi")} and all(errors.values())
    assert errors["c.xlsx"] == "no rows"


def test_a_file_is_taken_apart_once(spark, tmp_path):
    files = {"a.csv": b"Date,Description,Amount,Status\n2026-01-01,x,5,done\n"}
    plan = ST.canonical(ST.read_statements(spark, write(tmp_path, files)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("text,want", [("INR 3", 3.0), ("₹-4.5", -4.5), ("1,000", 0.0), ("nan", 0.0), ("5d", 0.0), (" 7 ", 7.0), (None, 0.0), ("-1e2", -100.0)])
def test_numbers_as_the_columns_read_them(spark, text, want):
    from ledgerloom.functions import normalize as N

    assert ST.plain_number(text) == want == spark.createDataFrame([(text,)], "t string").select(N.plain_amount("t")).first()[0]


def test_an_archive_that_unpacks_to_too_much(monkeypatch):
    monkeypatch.setattr(X, "MOST_UNPACKED", 100)
    with pytest.raises(ValueError):
        list(X.first_sheet(workbook(SHEET, SHARED)))
    with pytest.raises(zipfile.BadZipFile):
        list(X.first_sheet(b"PK\x03\x04"))


def test_workbooks_of_a_batch_are_made_one_at_a_time():
    sheets = pa.RecordBatch.from_pydict({"f": list(range(64)), "t": [f"<row>{'x' * (1 << 20)}</row>"] * 64})
    tracemalloc.start()
    made = [(b.num_rows, b.column("path")[0].as_py()) for b in PS._zipped(iter([sheets]), "")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == [(1, f"in/{i}.xlsx") for i in range(64)] and peak < 16 << 20
