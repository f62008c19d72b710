"""Merchant names, cleaning and grouping of descriptions, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

def chain(col: Column, steps: list[tuple[str, str]]) -> Column:
    """Replaces pattern after pattern."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


def safe(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def title(col: Column) -> Column:
    """Each run of letters with its first letter large and the others small, as Python's str.title()."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))), "")


def word_title(col: Column) -> Column:
    """Each word between single blanks with its first letter large, blanks squeezed."""
    words = F.filter(F.split(F.lower(col), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def first_listed(text: Column, listing: list[tuple[str, list[str]]], whole_words_to: int = 0) -> Column:
    """The name of the first entry one of whose words occurs in the text, which is in small letters; null if none.

    Words of at most `whole_words_to` letters have to stand alone.
    """

    def occurs(word: str) -> Column:
        return text.rlike(rf"\b{re.escape(word)}\b") if len(word) <= whole_words_to else text.contains(word)

    out = None
    for name, words in listing:
        any_word = reduce(lambda a, b: a | b, [occurs(w) for w in words])
        out = F.when(any_word, name) if out is None else out.when(any_word, name)
    return out


def extract_merchant(col: Column | str, word_boundary: bool = False) -> Column:
    """MER-01: a known merchant; else the name in a transfer's reference; else what is left without noise, as a title."""
    raw = safe(col)
    low = F.lower(raw)
    known = first_listed(low, V.MERCHANTS, 99 if word_boundary else 0)
    name = F.trim(F.regexp_replace(F.trim(F.regexp_extract(low, V.P2P_NAME, 1)), r"[0-9._-]+$", ""))
    rest = chain(low, [(f"(?i){p}", " ") for p in V.MERCHANT_NOISE] + [(r"[^a-zA-Z\s]", " "), (r"\s+", " ")])
    return F.when(raw == "", "").otherwise(F.coalesce(known, F.when((F.length(name) > 2) & ~name.rlike(r"^\d+$"), title(name)), title(F.trim(rest))))


def clean_description(col: Column | str) -> Column:
    """CLN-01: capitals only, without handles, references, dates and generic words."""
    return F.trim(chain(F.upper(safe(col)), V.CLEAN_STEPS))


def clean_details(col: Column | str) -> Column:
    """CLN-02: details without prefixes, codes, dates and numbers; the case stays."""
    return F.trim(chain(safe(col), V.DETAIL_STEPS))


def group_key(col: Column | str) -> Column:
    """CLN-03: small letters, with placeholders for what varies between similar descriptions."""
    return chain(F.lower(F.trim(safe(col))), V.GROUP_STEPS)


def is_noise_segment(col: Column) -> Column:
    """CLN-05"""
    up = F.upper(F.trim(col))
    return (up == "") | up.rlike(r"^[A-Z0-9._-]{10,}$") | up.rlike(r"^[0-9]{6,}$") | up.rlike(r"^ICI[A-Z0-9]+$") | up.rlike(r"^[A-Z]{2,5}\d{6,}$") | up.isin(V.NOISE_SEGMENTS)


def _known_or_title(name: Column, longer_than: int = 2) -> Column:
    return F.when(F.length(name) > longer_than, F.coalesce(first_listed(F.lower(name), V.MERCHANTS), word_title(name)))


def readable(col: Column | str) -> Column:
    """CLN-04: a readable name of a transaction, by the first of several readings that fits."""
    src = F.trim(safe(col))
    flat = F.trim(F.regexp_replace(src, r"\s+", " "))
    person = F.trim(F.regexp_replace(F.trim(F.regexp_extract(flat, V.READ_PERSON, 1)), r"[0-9._-]+$", ""))
    shop = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(flat, V.READ_SHOP, 1), r"\*", "")), r"\s+\d+$", ""))
    refund = F.trim(F.regexp_extract(flat, V.READ_REFUND, 1))
    machine = F.trim(F.regexp_replace(F.regexp_replace(flat, r"(?i)CEMTEX\s+DEP", ""), r"\b\d+\b", ""))
    online = F.trim(F.regexp_replace(F.regexp_replace(flat, r"(?i)\b(WDL|TFR|INB)\b", ""), r"(?i)\bAT\s+\d+.*", ""))
    segments = F.filter(F.transform(F.split(flat, r"[/|>]"), F.trim), lambda p: (p != "") & ~is_noise_segment(p) & (F.length(p) >= 3) & ~p.contains("@"))
    segment = F.when(flat.contains("/") & (F.size(segments) > 0), word_title(F.regexp_replace(F.try_element_at(segments, F.lit(1)), r"[._-]+", " ")))
    bare = F.trim(chain(flat, V.READ_BARE))
    short = F.when(bare == "", "Imported transaction").when(F.length(bare) <= 64, word_title(bare)).otherwise(F.concat(word_title(F.trim(F.substring(bare, 1, 61))), F.lit("...")))
    return F.when(src == "", "Imported transaction").otherwise(
        F.coalesce(
            first_listed(F.lower(src), V.MERCHANTS),
            F.when(~person.rlike(r"^\d+$"), _known_or_title(person)),
            _known_or_title(shop),
            F.when(refund != "", F.coalesce(first_listed(F.lower(refund), V.MERCHANTS), F.when(F.length(refund) > 2, word_title(refund)))),
            F.when(flat.rlike(r"(?i)ATM\s+WDL"), F.lit("ATM Withdrawal")),
            F.when(flat.rlike(r"(?i)CASH\s+DEPOSIT"), F.lit("Cash Deposit")),
            F.when(flat.rlike(r"(?i)CEMTEX\s+DEP"), F.coalesce(_known_or_title(machine), F.lit("Cash Deposit"))),
            F.when(flat.rlike(r"(?i)\bINB\b"), _known_or_title(online)),
            segment,
            F.when(flat.rlike(r"(?i)^[A-Z]{2,5}\.[A-Z0-9-]{8,}$"), F.lit("Card/UPI transaction")),
            short,
        )
    )


def redact(col: Column | str) -> Column:
    """PII-01: e-mail addresses and ten-digit telephone numbers as marks."""
    return F.regexp_replace(F.regexp_replace(safe(col), V.EMAIL, "[EMAIL_REDACTED]"), V.PHONE, "[PHONE_REDACTED]")


def keyword_category(col: Column | str) -> Column:
    """CAT-01: the first rule that matches; null without one."""
    return first_listed(F.lower(safe(col)), V.KEYWORD_RULES, 4)


def bank_category(description: Column | str, merchant: Column | str, method: Column | str) -> Column:
    """CAT-02: by the merchant, then the description, then the method."""
    how = safe(method)
    return F.coalesce(
        first_listed(F.lower(safe(merchant)), V.BANK_CATEGORIES),
        first_listed(F.lower(safe(description)), V.BANK_CATEGORIES),
        F.when(how == "ATM", "Cash").when(how.isin("UPI", "NEFT", "IMPS"), "Transfer"),
        F.lit("Uncategorized"),
    )


def import_category(description: Column | str, merchant: Column | str) -> Column:
    """CAT-03"""
    text = F.lower(F.concat_ws(" ", safe(description), safe(merchant)))
    return F.coalesce(first_listed(text, V.IMPORT_CATEGORIES, 4), F.lit("Uncategorized"))


def salary_guard(category: Column, description: Column | str) -> Column:
    """CAT-04: salary only where a word says so."""
    said = F.lower(safe(description)).rlike("salary|payroll|stipend|credited|wage")
    return F.when((category == "Salary") & ~said, F.lit("Misc")).otherwise(category)
