"""Fingerprints by which repeated transactions are known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import safe


def float_text(amount: Column) -> Column:
    """A money amount as Python writes the float: at least one decimal place, no others than needed."""
    text = amount.cast("decimal(12,2)").cast("string")
    return F.regexp_replace(text, r"(\.\d)0$", "$1")


def three_fields(day: Column, amount: Column, merchant: Column | str) -> Column:
    """FPR-01: sha256 of date|amount|MERCHANT."""
    return F.sha2(F.concat_ws("|", day.cast("string"), float_text(amount), F.upper(F.trim(safe(merchant)))), 256)


def six_fields(when: Column, amount: Column, merchant: Column | str, description: Column | str, method: Column | str, reference: Column | str) -> Column:
    """FPR-02: sha256 of the date's first 19 characters, the amount with two places and four trimmed texts in capitals."""
    texts = [F.upper(F.trim(safe(c))) for c in (merchant, description, method, reference)]
    return F.sha2(F.concat_ws("|", F.substring(when.cast("string"), 1, 19), amount.cast("decimal(12,2)").cast("string"), *texts), 256)


def plain_key(when: Column, amount: Column, description: Column | str, merchant: Column | str) -> Column:
    """FPR-03: date, amount, and description and merchant in small letters."""
    return F.concat_ws("|", F.substring(when.cast("string"), 1, 19), amount.cast("decimal(12,2)").cast("string"), F.lower(F.trim(safe(description))), F.lower(F.trim(safe(merchant))))
