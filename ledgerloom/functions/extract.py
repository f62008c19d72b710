"""Structured details of bank descriptions: method, entity, reference, place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import chain, extract_merchant, first_listed, safe, title
from .vectors import let


def _meta(**parts: Column) -> Column:
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])


def _details(method: str, entity: Column, ref: Column, location: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), entity.alias("entity"), ref.alias("reference"), location.alias("location"))


def _merchant_or_title(text: Column) -> Column:
    found = extract_merchant(text)
    return F.when(found != "", found).otherwise(title(text))


def method_details(col: Column | str) -> Column:
    """EXT-01: {method, entity, reference, location} of the first pattern that fits anywhere; else the merchant alone."""
    text = F.trim(safe(col))
    none = F.lit("")
    group = lambda p, n: F.regexp_extract(text, p, n)
    out = F.when(text == "", _details("", none, none, none))
    for method, patterns in V.METHOD_PATTERNS:
        for nth, p in enumerate(patterns):
            if method == "UPI":
                name = F.trim(F.regexp_replace(group(p, 3), r"[0-9._-]+$", ""))
                got = _details(method, _merchant_or_title(name), group(p, 2), none)
            elif method == "POS":
                shop = F.trim(group(p, 2)) if nth == 0 else text
                last = F.element_at(F.split(shop, r"\s+"), -1)
                place = F.when((F.length(last) > 2) & (last == F.upper(last)) & (last != F.lower(last)), last).otherwise("")
                got = _details(method, _merchant_or_title(shop), group(p, 1), place)
            elif method == "ATM":
                got = _details(method, F.lit("ATM Withdrawal"), group(p, 1), F.trim(group(p, 2)) if nth == 0 else none)
            elif method == "INB":
                got = _details(method, _merchant_or_title(group(p, 1)), none, none)
            elif method in ("NEFT", "IMPS"):
                got = _details(method, title(F.trim(group(p, 2))), group(p, 1), none)
            else:
                got = _details(method, F.lit("Cash Transaction"), none, F.trim(group(p, 1)))
            out = out.when(text.rlike(p), got)
    return out.otherwise(_details("", extract_merchant(text), none, none))


def statement_details(col: Column | str) -> Column:
    """EXT-02: {method, entity, ref, location, type, meta} by case-sensitive marks, first that fits."""
    text = F.trim(safe(col))
    none = F.lit("")
    no_meta = F.from_json(F.lit("{}"), "map<string,string>")

    def made(method: Column | str, entity: Column = none, ref: Column = none, location: Column = none, kind: Column | str = "DEBIT", meta: Column = no_meta) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(method).alias("method"), entity.alias("entity"), ref.alias("ref"), location.alias("location"), lit(kind).alias("type"), meta.alias("meta"))

    g = lambda p, n: F.regexp_extract(text, p, n)
    upi = V.STATEMENT_UPI
    parts = F.split(text, "/")
    app = F.element_at(F.split(F.trim(F.element_at(parts, -1)), r"\s+"), 1)
    upi_meta = F.map_filter(_meta(bank=F.trim(g(upi, 4)), upi_id=F.trim(g(upi, 5)), app=F.when((F.size(parts) > 6) & (app != ""), app)), lambda k, v: v.isNotNull())
    # card: what is left without prefixes and reference; the last word is the place
    ref = g(r"\b(\d{10,})\b", 1)
    left = F.filter(F.split(F.replace(chain(text, [(rf"(?i)\b{p}\b", "") for p in V.CARD_WORDS]), F.when(ref == "", "\u0000").otherwise(ref), none), r"\s+"), lambda w: w != "")
    place = F.coalesce(F.try_element_at(left, F.lit(-1)), none)
    shop = F.trim(chain(F.array_join(F.slice(left, F.lit(1), F.greatest(F.size(left) - 1, F.lit(0))), " "), [(r"^\d+[^*]*\*", ""), (r"^\d+", ""), (r"^[A-Za-z0-9]+\*", ""), (r"^[A-Za-z0-9]+_", "")]))
    # cash machine: digits and capitals in front are its number
    cash = F.trim(F.regexp_replace(text, "ATM WDL|ATM CASH", ""))
    number = F.trim(F.regexp_extract(cash, r"^(\d+\s*[A-Z]*)", 1))
    online = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "WDL|TFR|INB", "")), r"\bAT \d+.*", ""))
    wire = V.STATEMENT_WIRE
    person = F.trim(F.regexp_replace(F.trim(g(V.STATEMENT_PERSON, 1)), r"\s+(?:MO|AT|M)\s*$", ""))
    return (
        F.when(text.rlike(upi), made("UPI", F.trim(g(upi, 3)), g(upi, 2), kind=F.when(g(upi, 1) == "CR", "CREDIT").otherwise("DEBIT"), meta=upi_meta))
        .when(text.contains("POS") & text.contains("PURCH"), made("POS", F.when(shop == "", place).otherwise(shop), ref, F.when(shop == "", "").otherwise(place)))
        .when(text.contains("ATM WDL"), made("ATM", none, number, F.when(number == "", cash).otherwise(F.trim(F.replace(cash, number, none)))))
        .when(text.contains("INB"), made("INB", online))
        .when(text.contains("CASH DEPOSIT") | text.contains("CEMTEX"), made("CASH", location=F.when(text.contains("CASH DEPOSIT"), F.trim(g("AT (.*)", 1))).otherwise(""), kind="DEPOSIT"))
        .when(text.rlike(wire), made(F.when(text.contains("NEFT"), "NEFT").otherwise("RTGS"), F.trim(g(wire, 2)), F.trim(g(wire, 1)), kind=F.when(text.contains("DEP") | text.contains("CR"), "CREDIT").otherwise("DEBIT"), meta=_meta(bank=F.trim(g(wire, 3)))))
        .when(text.contains("TFR") & ~text.contains("UPI"), made("TRANSFER", person, none, F.trim(g(r"\bAT\s+(\d{4,}\s+.*)", 1)), F.when(text.contains("DEP"), "CREDIT").otherwise("DEBIT")))
        .otherwise(made("OTHERS"))
    )


def brand(*fields: Column) -> Column:
    """MER-02: a bank's brand, first in the text without blanks, then in the text; null if none."""
    tight = lambda text: let(F.regexp_replace(text, r"\s+", ""), lambda t: first_listed(t, V.SBI_BRANDS))
    return let(F.lower(F.concat_ws(" ", *fields)), lambda text: F.coalesce(tight(text), first_listed(text, V.SBI_BRANDS)))


def _tidy(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"\s{2,}", " "), r"[._-]+$", ""))


def sbi_details(col: Column | str) -> Column:
    """EXT-03: {merchant, clean_description, type, meta} of one bank's descriptions; patterns start at the text's start."""
    text = safe(col)
    g = lambda p, n: F.regexp_extract(text, p, n)
    no_meta = F.from_json(F.lit("{}"), "map<string,string>")

    def made(merchant: Column, said: Column, kind: str, meta: Column = no_meta) -> Column:
        return F.struct(merchant.alias("merchant"), said.alias("clean_description"), F.lit(kind).alias("type"), meta.alias("meta"))

    upi = V.SBI_UPI
    name, handle, app = _tidy(g(upi, 4)), _tidy(g(upi, 6)), _tidy(g(upi, 7))
    payee = F.coalesce(brand(name, handle, app), name)
    pos = V.SBI_POS
    words = F.filter(F.split(g(pos, 3), r"\s+"), lambda w: w != "")
    place = F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise("")
    raw = F.array_join(F.when(F.size(words) > 1, F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words), " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\d+[a-zA-Z0-9]*\*", ""), r"^\*", ""))
    shop = F.coalesce(brand(bare, raw), bare)
    atm = V.SBI_ATM
    tokens = F.filter(F.split(g(atm, 1), r"\s+"), lambda w: w != "")
    two = (F.size(tokens) > 1) & (F.length(F.try_element_at(tokens, F.lit(2))) <= 3)
    at = F.when(two, 2).otherwise(1)
    machine = F.array_join(F.slice(tokens, F.lit(1), at), " ")
    where = F.array_join(F.slice(tokens, at + 1, F.greatest(F.size(tokens) - at, F.lit(0))), " ")
    inb = V.SBI_INB
    bought = F.coalesce(brand(_tidy(g(inb, 1))), _tidy(g(inb, 1)))
    branch = F.trim(F.regexp_replace(text, r"^CASH DEPOSIT SELF\s+AT\s*", ""))
    cdm = V.SBI_CDM
    any_brand = brand(text)
    dep, wdl = brand(g(r"^DEP TFR\s+(.*)", 1)), brand(g(r"^WDL TFR\s+(.*)", 1))
    suffix = lambda s, c, e: F.when(c != "", F.concat(F.lit(s), c, F.lit(e))).otherwise("")
    return (
        F.when(text.rlike(upi), made(payee, F.concat(F.when(g(upi, 2) == "CR", "UPI Received from ").otherwise("UPI Transfer to "), payee), "upi", _meta(utr=g(upi, 3), bank=g(upi, 5), mode=g(upi, 2), app=app)))
        .when(text.rlike(pos), made(shop, F.concat(F.lit("POS Purchase at "), shop, suffix(" (", place, ")")), "pos", _meta(ref=g(pos, 2), location=place, gateway=g(pos, 1))))
        .when(text.rlike(atm), made(F.lit("ATM Withdrawal"), F.concat(F.lit("ATM Cash Withdrawal"), suffix(" at ", where, "")), "atm", _meta(atmId=machine, location=where)))
        .when(text.rlike(inb), made(bought, F.concat(F.when(bought.startswith("Gift"), "Online Transfer: ").otherwise("Online Transfer to "), bought), "inb"))
        .when(text.startswith("CASH DEPOSIT SELF"), made(F.lit("Self Deposit"), F.concat(F.lit("Cash Deposit"), suffix(" at ", branch, "")), "cash_deposit", _meta(branch=branch)))
        .when(text.rlike(cdm), made(F.coalesce(any_brand, F.lit("Cash Deposit Machine")), F.concat(F.coalesce(F.concat(F.lit("CDM Deposit via "), any_brand), F.lit("CDM Deposit")), F.lit(" (Ref: "), g(cdm, 1), F.lit(")")), "cash_deposit", _meta(ref=g(cdm, 1))))
        .when(text.rlike("^DEP TFR\\s+") & dep.isNotNull(), made(dep, F.concat(F.lit("Refund from "), dep), "upi"))
        .when(text.rlike("^WDL TFR\\s+") & wdl.isNotNull(), made(wdl, F.concat(F.lit("Payment to "), wdl), "upi"))
        .otherwise(made(F.lit("Unknown"), text, "unknown"))
    )


def best_name(entity: Column, details: Column) -> Column:
    """EXT-04: the entity if it has over two letters, else the cleaned details."""
    from .text import clean_details

    return F.when(F.length(entity) > 2, entity).otherwise(clean_details(details))
