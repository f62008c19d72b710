"""Queries over workbooks that are made from the orders: archives of XML parts, with dates as serial numbers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import statements as S
from .imports import _LINES, _SQL, _lines, _read
from .registry import query

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook(sheet: str, shared: list[str], late: bool = False) -> bytes:
    """An archive with a second sheet before the first in the list of parts; style 1 is a day, style 2 a format of its own."""
    parts = {
        "xl/worksheets/sheet1.xml": f'{_HEAD}<worksheet {_MAIN}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>',
        "xl/workbook.xml": f'{_HEAD}<workbook {_MAIN} xmlns:r="{_REL}"><workbookPr date1904="{int(late)}"/><sheets><sheet name="S" sheetId="2" r:id="rId7"/><sheet name="T" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="{_REL}/worksheet"/><Relationship Id="rId7" Target="/xl/worksheets/other.xml" Type="{_REL}/worksheet"/></Relationships>',
        "xl/styles.xml": f'{_HEAD}<styleSheet {_MAIN}><numFmts count="2"><numFmt numFmtId="164" formatCode="dd\\-mmm\\-yyyy;@"/><numFmt numFmtId="165" formatCode="&quot;day &quot;0.00[Red]"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"{_HEAD}<sst {_MAIN}>{''.join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in shared)}</sst>",
        "xl/worksheets/other.xml": f"{_HEAD}<worksheet {_MAIN}><sheetData>{sheet}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _sheet_rows(spark, d):
    """(path, content): files of a thousand orders' numbers: a title, 16 rows on the header, and rows from 21 on with gaps between them and within."""
    lines = _lines(spark, d)
    f = F.expr("id div 1000")
    r = (F.col("id") % 1000 + 21).cast("string")
    cell = lambda column, body: F.concat(F.lit(f'<c r="{column}'), r, F.lit('" '), *body)
    day = cell("B", [F.concat(F.lit('s="'), (F.col("id") % 2 + 1).cast("string"), F.lit('"><v>'), F.datediff("day", F.lit("1899-12-30")).cast("string"), F.lit("</v></c>"))])
    plain = F.replace(F.replace(F.col("description"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = cell("C", [F.when(F.col("id") % 3 == 0, F.concat(F.lit('t="inlineStr"><is><r><t>'), F.substring(plain, 1, 4), F.lit("</t></r><r><t>"), F.expr("substring(description, 5)"), F.lit("</t></r><rPh><t>no</t></rPh></is></c>"))).otherwise(F.concat(F.lit('t="str"><v>'), plain, F.lit("</v></c>")))])
    price = F.when(F.col("income"), cell("F", [F.lit("><v>"), F.col("price"), F.lit("</v></c>")])).otherwise(cell("E", [F.lit('s="3"><v>'), F.col("price"), F.lit("</v></c>")]))
    row = F.concat(F.lit('<row r="'), r, F.lit('">'), day, text, price, F.lit("</row>"))
    return lines.select(f.alias("f"), F.struct("id", row.alias("t")).alias("r")).groupBy("f").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["t"]), "").alias("t"))


def _zipped(batches: Iterator[pa.RecordBatch], title: str) -> Iterator[pa.RecordBatch]:
    """A workbook at a time: the sheets of a batch are many times as large as their archives."""
    for batch in batches:
        for f, t in zip(batch.column("f"), batch.column("t"), strict=True):
            content = workbook(title + t.as_py(), ["Statement of <account> & co", "Txn Date", "Description", "Debit", "Credit"])
            yield pa.RecordBatch.from_pydict({"path": [f"in/{f.as_py()}.xlsx"], "content": pa.array([content], pa.binary())})


def _workbooks(spark, d):
    title = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="17">' + "".join(f'<c r="{c}17" t="s"><v>{i}</v></c>' for i, c in enumerate("BCEF", 1)) + "</row>"

    return _sheet_rows(spark, d).mapInArrow(lambda batches: _zipped(batches, title), "path string, content binary")


@query(_SQL)
def src05_workbooks(spark, d):
    return _read(_workbooks(spark, d), synonyms={"date": ["txn date"], "description": ["description"], "debit": ["debit"], "credit": ["credit"]})


@query(f"SELECT 'in/' || f || '.xlsx' AS file, f % 2 = 1 AS broken, CASE WHEN f % 2 = 0 THEN n ELSE 0 END AS n_rows FROM (SELECT o_orderkey // 1000 AS f, count(*) AS n FROM ({_LINES.replace('STRING', 'VARCHAR')}) JOIN orders ON id = o_orderkey GROUP BY 1)")
def src05_broken_archives(spark, d):
    """Every other archive breaks off half way: one row with an error for each, and all rows of the others."""
    f = F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint")
    half = F.expr("substring(content, 1, length(content) div 2)")
    rows = S.statement_rows(_workbooks(spark, d).withColumn("content", F.when(f % 2 == 1, half).otherwise(F.col("content"))))
    return rows.groupBy("file").agg((F.count("error") > 0).alias("broken"), F.count_if(F.col("error").isNull()).alias("n_rows"))
