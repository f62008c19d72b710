"""Amounts, signs, dates, status and payment methods out of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import safe

MONEY = "decimal(12,2)"
#: What counts as a number: Spark's casts also take 'nan' and '5d', which statements don't mean.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Formats of dates in statements, in order, after ISO.
DATE_FORMATS = ["yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "d/M/yy", "d-M-yy", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yy H:m:s", "d/M/yy H:m", "d-M-yyyy H:m:s", "d-M-yyyy H:m", "d-M-yy H:m:s", "d-M-yy H:m", "d MMM yyyy, H:m", "d MMMM yyyy, H:m"]

# What tells a payment method in a description in small letters, in order.
METHOD_WORDS = [("upi", r"\bupi\b|upvdr|upi/"), ("pos", r"\bpos\b|pos atm"), ("atm", r"\batm\b|atm wdl|atm cash"), ("neft", r"\bneft\b"), ("imps", r"\bimps\b"), ("inb", r"\binb\b|internet banking"), ("card", r"visa|mastercard|rupay")]


def number(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def money(col: Column) -> Column:
    return F.round(col, 2).cast(MONEY)


def plain_amount(col: Column | str) -> Column:
    """NRM-06: a currency word or sign in front goes; what is no number then is 0 (so also '1,000')."""
    return F.coalesce(number(F.regexp_replace(safe(col), r"^[A-Za-z₹$€£¥]+\s*", "")), F.lit(0.0))


def net_amount(columns: list[str]) -> Column:
    """NRM-06: credit less debit if there are both, else the amount, else 0."""
    if "debit" in columns and "credit" in columns:
        return plain_amount("credit") - plain_amount("debit")
    return plain_amount("amount") if "amount" in columns else F.lit(0.0)


def bank_amount(col: Column | str) -> Column:
    """NRM-07: without currency signs, blanks and commas; in brackets negative; no number is 0."""
    text = F.regexp_replace(safe(col), r"[₹$€£¥\s]", "")
    text = F.when(text.contains("(") & text.contains(")"), F.concat(F.lit("-"), F.regexp_replace(text, r"[()]", ""))).otherwise(text)
    return F.coalesce(number(F.replace(text, F.lit(","), F.lit(""))), F.lit(0.0))


def signed_by_type(amount: Column, kind: Column | str | None) -> Column:
    """NRM-08: debit words before credit words; without any the sign stays."""
    if kind is None:
        return amount
    text = F.lower(safe(kind))
    return F.when(text.rlike("debit|dr|withdrawal|out"), -F.abs(amount)).when(text.rlike("credit|cr|deposit|in"), F.abs(amount)).otherwise(amount)


def import_amount(col: Column | str) -> Column:
    """NRM-09: the number at the front once INR, signs, commas, blanks and brackets are gone; null without one."""
    text = F.regexp_replace(F.regexp_replace(safe(col), "(?i)INR", ""), "[₹,\\s ()]", "")
    return F.nullif(F.regexp_extract(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def import_sign(amount: Column, deposit: Column, withdrawal: Column, kind: Column | str) -> Column:
    """NRM-10: a deposit counts up, a withdrawal down, an income word up, and all else down."""
    return F.when(deposit > 0, deposit).when(withdrawal > 0, -withdrawal).when(F.lower(safe(kind)).rlike("income|credit|deposit"), F.abs(amount)).otherwise(-F.abs(amount))


def status_signed(amount: Column, status: Column | str, none_negative: Column) -> Column:
    """NRM-11: in a file without negative amounts, cancelled is 0, refunded stays, all else counts down."""
    state = F.lower(F.trim(safe(status)))
    return F.when(~none_negative, amount).when(state == "cancelled", F.lit(0.0)).when(state == "refunded", amount).otherwise(-F.abs(amount))


def to_day(col: Column | str, formats: list[str] | None = None) -> Column:
    """NRM-12 to 14: a date by the first format that fits; ISO is never read day first; null if none fits."""
    text = F.regexp_replace(F.trim(safe(col)), "(?i)\\bSept\\b", "Sep")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats or DATE_FORMATS]).cast("date")


def status_name(col: Column | str) -> Column:
    """NRM-15"""
    text = F.lower(F.trim(safe(col)))
    return F.when(text.contains("refund"), "refunded").when(text.contains("cancel"), "cancelled").when(text.contains("fail"), "failed").when(text.contains("complete") | text.contains("success"), "completed").when(text == "", "completed").otherwise(text)


def payment_method(column: Column, parsed: Column, description: Column) -> Column:
    """NRM-16: the column, the parser's method, or a word of the description."""
    text = F.lower(safe(description))
    guess = F.coalesce(*[F.when(text.rlike(p), name) for name, p in METHOD_WORDS], F.lit("unknown"))
    return F.coalesce(F.nullif(F.lower(F.trim(safe(column))), F.lit("")), F.nullif(F.lower(F.trim(safe(parsed))), F.lit("")), guess)


def direction(amount: Column) -> Column:
    """NRM-23"""
    return F.when(amount < 0, "debit").otherwise("credit")
