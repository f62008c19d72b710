"""From statement lines to ledger rows, and the rows as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as P
from ..functions import vocabulary as V
from ..functions.text import first_listed, readable, safe
from ..sources.sinks import append_new
from ..sources.statements import canonical, either, failures, read_statements
from ..staging import materialize


def records(lines: DataFrame) -> DataFrame:
    """NRM-22: of canonical lines those with a date and an amount: (file, row_idx, date, amount, description, merchant, fingerprint)."""
    named = either(F.col("merchant"), F.col("description"))
    kept = lines.where("date is not null and amount is not null")
    return kept.select("file", "row_idx", "date", "amount", "description", "merchant", P.three_fields(F.col("date"), F.col("amount"), named).alias("fingerprint"))


def payloads(lines: DataFrame, user_id: Column) -> DataFrame:
    """NRM-20: ledger rows of canonical lines: day as text, no category yet, the type by sign, the other columns as a map."""
    kept = lines.where("date is not null and amount is not null")
    extra = [x for name in ("method", "entity", "ref", "location", "type") for x in (F.lit(name), safe(name))]
    return kept.select(
        user_id.alias("user_id"),
        F.date_format("date", "yyyy-MM-dd").alias("transaction_date"),
        "amount",
        "description",
        F.col("merchant").alias("merchant_name"),
        F.lit("Uncategorized").alias("category"),
        F.when(F.col("amount") < 0, "expense").otherwise("income").alias("type"),
        P.six_fields(F.col("date"), F.col("amount"), "merchant", "description", F.lit(""), F.lit("")).alias("fingerprint"),
        F.create_map(*extra).alias("raw_data"),
        "file",
        "row_idx",
    )


def import_files(spark: SparkSession, path: str, user_id, ledger: str, password: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One call from files to the ledger at `ledger`: the rows that were new, and the files that couldn't be read."""
    # written once: lines and failures are both read from it, and no file is taken apart again
    rows = materialize(read_statements(spark, path, password=password), "statements")
    fresh = payloads(canonical(rows), F.lit(user_id)).withColumn("place", F.struct("file", "row_idx")).drop("file", "row_idx")
    return append_new(fresh, ledger, ["user_id", "fingerprint"], "place"), failures(rows)


def merchant_by_precedence(parsed: Column, column: Column, description: Column) -> Column:
    """NRM-17: the parser's merchant unless unknown, the file's column, a known merchant in the description, or 'Unknown'."""
    known = F.nullif(F.nullif(parsed, F.lit("Unknown")), F.lit(""))
    return F.coalesce(known, F.nullif(F.trim(safe(column)), F.lit("")), first_listed(F.lower(safe(description)), V.MERCHANTS), F.lit("Unknown"))


def displayed(df: DataFrame) -> DataFrame:
    """NRM-21: ledger rows with what is shown where a column says nothing."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    amount = F.coalesce("amount", F.lit(0))
    raw = F.coalesce(text("description"), text("merchant_name"), F.lit("Imported transaction"))
    return df.select(
        "id",
        "user_id",
        "transaction_date",
        amount.alias("amount"),
        F.coalesce(text("merchant_name"), readable(raw)).alias("description"),
        F.coalesce(text("merchant_name"), F.lit("Unknown Merchant")).alias("merchant_name"),
        F.coalesce(text("category"), F.lit("Uncategorized")).alias("category"),
        F.coalesce(text("payment_method"), F.lit("Cash")).alias("payment_method"),
        F.coalesce(text("status"), F.lit("completed")).alias("status"),
        F.coalesce(text("type"), F.when(amount >= 0, "credit").otherwise("debit")).alias("type"),
    )


def between_times(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """FLT-05: from start to end, both included, as points in time: an end without an hour is that day's midnight."""
    out = df if start is None else df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    return out if end is None else out.where(F.col(column) <= F.lit(end).cast("timestamp"))


def tab(df: DataFrame, name: str) -> DataFrame:
    """FLT-09: debit (below 0), credit (0 and above), or all."""
    return df.where("amount < 0") if name == "debit" else df.where("amount >= 0") if name == "credit" else df


def categorised(df: DataFrame, category: str = "category") -> DataFrame:
    """FLT-12: rows with a category that says something."""
    return df.where((safe(category) != "") & (F.col(category) != "Uncategorized"))


def changed_by(df: DataFrame, raw: str, cleaned: Column, order: str, n: int = 100) -> DataFrame:
    """FLT-13: the first n rows, by `order`, whose cleaned text differs."""
    return df.select(order, F.col(raw).alias("raw"), cleaned.alias("cleaned")).where("raw <> cleaned").orderBy(order).limit(n)


def with_categories(df: DataFrame, found: DataFrame, text: str = "description") -> DataFrame:
    """JOI-05: the category that was found for the text, or else the row's own; found: (text, category), one row a text."""
    given = found.select(F.col(text), F.nullif("category", F.lit("")).alias("__found"))
    return df.join(given, text, "left").withColumn("category", F.coalesce("__found", "category")).select(df.columns)


def of_known_categories(df: DataFrame, anchors: DataFrame, label: str = "label") -> DataFrame:
    """JOI-06: rows whose category has an anchor."""
    return df.join(anchors.select(F.col(label).alias("category")).distinct(), "category", "left_semi")


def expanded(df: DataFrame, column: str) -> DataFrame:
    """EXP-02: a struct's fields as columns, beside the others."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def by_month(df: DataFrame, date: str = "transaction_date", key: str = "id") -> DataFrame:
    """TOP-04: months newest first, days newest first within, `place` from 1 within each month."""
    month = F.trunc(date, "month")
    w = Window.partitionBy("user_id", "month").orderBy(F.desc(date), F.desc(key))
    return df.withColumn("month", month).withColumn("place", F.row_number().over(w)).orderBy("user_id", F.desc("month"), "place")
