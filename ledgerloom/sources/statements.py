"""Statement files of any kind, many at once, to rows by target column.

A file is small (uploads are bounded), and files are many: each is taken apart where it is read, one at a time, and its
rows go on as cells by target. What follows, amounts, dates, merchants, is column expressions over all rows.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.text import extract_merchant
from .readers import ALLOWED, HEADER_ROWS, MOST_BYTES, OUTPUT, SUFFIXES, header_row, resolve_headers, sniff_separator, suffix_of
from .sheets import first_sheet

ROWS = "file string, error string, row_idx int, has array<string>, up boolean, cells map<string,string>"
#: A field may be as long as its file.
csv.field_size_limit(MOST_BYTES)


def plain_number(text: str | None) -> float:
    """normalize.plain_amount of one cell."""
    rest = re.sub(r"^[A-Za-z₹$€£¥]+\s*", "", text or "", flags=re.ASCII).strip(" ")
    return float(rest) if re.fullmatch(N.NUMBER, rest, re.ASCII) else 0.0


def none_negative(cells: list[dict[str, str | None]], has: list[str]) -> bool:
    """NRM-11: whether no amount of a file is under 0; a file's rows are all at hand where it is read."""
    if "debit" in has and "credit" in has:
        return all(plain_number(c["credit"]) >= plain_number(c["debit"]) for c in cells)
    return "amount" not in has or all(plain_number(c["amount"]) >= 0 for c in cells)


def decoded(content: bytes) -> str:
    """SRC-07: UTF-8, with or without a mark at its start, or else Latin-1, which any bytes are."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def kind_of(path: str, content: bytes) -> str:
    """SRC-02, SRC-08: the suffix, but spreadsheets by their first bytes; an unknown suffix counts as CSV."""
    if content[:4] == b"PK\x03\x04":
        return ".xlsx"
    if content[:4] == b"\xd0\xcf\x11\xe0":
        return ".xls"
    end = suffix_of(path)
    return end if end in SUFFIXES and SUFFIXES[end] != "grid" else ".csv"


def _sheet(content: bytes, kind: str, password: str | None) -> tuple[list[list[str | None]], int]:
    """SRC-05, SRC-06, SRC-11: the first sheet's rows that hold anything, and which of them is the header."""
    if kind == ".xls":
        raise ValueError("Invalid password" if password else "Password required")
    rows = list(first_sheet(content))
    # the header is looked for among the first rows as they stand, empty ones counted
    top: list[list[str | None]] = [[] for _ in range(HEADER_ROWS)]
    for at, cells in rows:
        if at < HEADER_ROWS:
            top[at] = cells
    head = header_row(top, "statement")
    return [cells for _, cells in rows], max(0, sum(at <= head for at, _ in rows) - 1)


def _objects(text: str) -> list[list[str | None]]:
    """SRC-03: an array of objects, or an object that holds one under `transactions`, as a grid with its header."""
    found = json.loads(text, parse_int=str, parse_float=str)
    rows = found.get("transactions", []) if isinstance(found, dict) else found
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("rows have to be objects")
    names = list(dict.fromkeys(k for r in rows for k in r))
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return [names, *([plain(r.get(n)) for n in names] for r in rows)] if names else []


def grid_of(path: str, content: bytes, password: str | None = None) -> tuple[list[list[str | None]], int]:
    """A file's cells, and which row is the header."""
    kind = kind_of(path, content)
    if SUFFIXES[kind] == "grid":
        return _sheet(content, kind, password)
    text = decoded(content)
    if kind == ".json":
        return _objects(text), 0
    # SRC-01, SRC-04, SRC-09, SRC-10
    sep = SUFFIXES[kind] or sniff_separator(next((x for x in text.splitlines() if x.strip()), ""))
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(c.strip() for c in r)], 0


def statement_rows(files: DataFrame, synonyms: dict[str, list[str]] | None = None, password: str | None = None, guarded: bool = True) -> DataFrame:
    """ROWS of files (path, content): a row for each line of a statement, with its cells by target, and which targets the file has.

    A file that can't be read, for whatever reason, or that the guards keep out (SRC-16: suffix, size, emptiness), gives one row with its error; others aren't touched by it.
    """

    def wrong(path: str, content: bytes) -> str | None:
        if guarded and suffix_of(path) not in ALLOWED:
            return "unsupported file type"
        return "empty file" if not content else "file too large" if len(content) > MOST_BYTES else None

    def of(path: str, content: bytes) -> list[tuple]:
        error = wrong(path, content)
        if error is None:
            try:
                grid, head = grid_of(path, content, password)
            except Exception as e:  # what one file does to a parser mustn't end the others' import
                error = str(e) if isinstance(e, (ValueError, csv.Error)) and str(e) else f"{type(e).__name__}: {e}"
        if error is None and not grid:
            error = "no rows"
        if error is not None:
            return [(path, error, None, None, None, None)]
        names = [(n or "").strip() or f"column_{i}" for i, n in enumerate(grid[head])]
        found = resolve_headers(names, synonyms)
        at = {t: names.index(n) for t, n in found.items()}
        cells = [{t: r[k] if k < len(r) and r[k] != "" else None for t, k in at.items()} for r in grid[head + 1 :]]
        up = none_negative(cells, list(at))
        return [(path, None, i, list(at), up, c) for i, c in enumerate(cells)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "error", "row_idx", "has", "up", "cells"]).astype({"row_idx": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows += of(path, bytes(content or b""))
                while len(rows) >= 10_000:
                    yield frame(rows[:10_000])
                    rows = rows[10_000:]
        if rows:
            yield frame(rows)

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_statements(spark: SparkSession, path: str, synonyms: dict[str, list[str]] | None = None, password: str | None = None) -> DataFrame:
    """ROWS of all files at a path."""
    return statement_rows(spark.read.format("binaryFile").load(path), synonyms, password)


def canonical(rows: DataFrame, day=N.to_day) -> DataFrame:
    """NRM-01 to 19 over ROWS: (file, row_idx) and OUTPUT of every line; files with an error give none."""
    c = lambda t: F.col("cells")[t]
    has = lambda t: F.array_contains("has", t)
    text = lambda t: F.coalesce(c(t), F.lit(""))
    net = F.when(has("debit") & has("credit"), N.plain_amount(c("credit")) - N.plain_amount(c("debit"))).when(has("amount"), N.plain_amount(c("amount"))).otherwise(0.0)
    base = rows.where("error is null").withColumn("amount", net)
    base = base.withColumn("amount", F.when(has("status"), N.status_signed(F.col("amount"), c("status"), F.col("up"))).otherwise(F.col("amount")))
    raw = F.when(has("merchant"), text("merchant")).otherwise(text("description"))
    made = {
        "date": day(c("date")),
        "amount": N.money(F.col("amount")),
        "description": text("description"),
        "merchant": extract_merchant(F.when(F.length(raw) > 2, raw).otherwise(text("description"))),
        "method": text("method"),
        "meta": F.from_json(F.lit("{}"), "map<string,string>"),
        "status": text("status"),
    }
    return base.select("file", "row_idx", *[made.get(o, F.lit("")).alias(o) for o in OUTPUT])


def failures(rows: DataFrame) -> DataFrame:
    """(file, error) of the files that couldn't be read."""
    return rows.where("error is not null").select("file", "error")


def either(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)
