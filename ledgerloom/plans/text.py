"""Queries on bank-style descriptions; the SQL is built from the same word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import ledger as L
from .adapters import adapted, duck
from .registry import query

_X = duck("lines")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain_sql(x: str, steps) -> str:
    for p, r in steps:
        x = f"regexp_replace({x}, {q(p)}, {q(r.replace('$', chr(92)))}, 'g')"
    return x


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda t: upper(t[1:1]) || t[2:]), '')"


def listed_sql(x: str, listing, whole_to: int = 0) -> str:
    def one(w: str) -> str:
        return f"regexp_matches({x}, {q(chr(92) + 'b' + w + chr(92) + 'b')})" if len(w) <= whole_to else f"contains({x}, {q(w)})"

    return "CASE " + " ".join(f"WHEN {' OR '.join(one(w) for w in ws)} THEN {q(n)}" for n, ws in listing) + " END"


def merchant_sql(x: str) -> str:
    name = f"trim(regexp_replace(trim(regexp_extract(lower({x}), {q(V.P2P_NAME)}, 1)), '[0-9._-]+$', ''))"
    rest = chain_sql(f"lower({x})", [(f"(?i){p}", " ") for p in V.MERCHANT_NOISE] + [(r"[^a-zA-Z\s]", " "), (r"\s+", " ")])
    return f"CASE WHEN {x} = '' THEN '' ELSE coalesce({listed_sql(f'lower({x})', V.MERCHANTS)}, CASE WHEN length({name}) > 2 AND NOT regexp_matches({name}, '^\\d+$') THEN {title_sql(name)} END, {title_sql(f'trim({rest})')}) END"


@query(f"SELECT id, {merchant_sql('description')} AS merchant FROM {_X}")
def mer01_merchant(spark, d):
    return adapted(spark, d, "lines").select("id", T.extract_merchant("description").alias("merchant"))


@query(f"SELECT id, {listed_sql('lower(description)', V.MERCHANTS, 99)} AS merchant FROM {_X}")
def mer01_word_boundary(spark, d):
    return adapted(spark, d, "lines").select("id", T.first_listed(F.lower("description"), V.MERCHANTS, 99).alias("merchant"))


_TIGHT = "regexp_replace(lower(name || ' ' || description), '\\s+', '', 'g')"


@query(f"SELECT id, coalesce({listed_sql(_TIGHT, V.SBI_BRANDS)}, {listed_sql(_TIGHT.replace(_TIGHT, 'lower(name || chr(32) || description)'), V.SBI_BRANDS)}) AS brand FROM {_X}")
def mer02_brand(spark, d):
    return adapted(spark, d, "lines").select("id", E.brand(F.col("name"), F.col("description")).alias("brand"))


@query(f"SELECT id, trim({chain_sql('upper(description)', V.CLEAN_STEPS)}) AS cleaned FROM {_X}")
def cln01_clean_description(spark, d):
    return adapted(spark, d, "lines").select("id", T.clean_description("description").alias("cleaned"))


@query(f"SELECT id, trim({chain_sql('description', V.DETAIL_STEPS)}) AS cleaned FROM {_X}")
def cln02_clean_details(spark, d):
    return adapted(spark, d, "lines").select("id", T.clean_details("description").alias("cleaned"))


@query(f"SELECT id, {chain_sql('lower(trim(description))', V.GROUP_STEPS)} AS grouped FROM {_X}")
def cln03_group_key(spark, d):
    return adapted(spark, d, "lines").select("id", T.group_key("description").alias("grouped"))


@query(f"SELECT grouped, count(DISTINCT description) AS n, array_to_string(list_sort(list(DISTINCT description)), '|') AS members FROM (SELECT description, {chain_sql('lower(trim(description))', V.GROUP_STEPS)} AS grouped FROM {_X}) GROUP BY 1")
def agg17_groups(spark, d):
    found = L.whole_groups(L.grouped_texts(adapted(spark, d, "lines"), "description", T.group_key("description")), "grouped", "members")
    return found.select("grouped", F.size("members").cast("bigint").alias("n"), F.array_join("members", "|").alias("members"))


# What each kind of line should give is written down by kind (id % 20), apart from names that are looked up in lists.


def words_sql(x: str) -> str:
    """Each word with its first letter large, blanks squeezed."""
    return f"array_to_string(list_transform(list_filter(string_split(lower({x}), ' '), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def by_kind(kinds: dict[int, str], rest: str) -> str:
    return "CASE id % 20 " + " ".join(f"WHEN {k} THEN {v}" for k, v in kinds.items()) + f" ELSE {rest} END"


_NAME = words_sql("name")
_READ = by_kind(
    {
        0: _NAME,
        1: "'Sto' || lower(name) || ' Counter Riverton'",
        2: "'ATM Withdrawal'",
        3: f"{_NAME} || ' Web Store'",
        4: "'Cash Deposit'",
        5: f"{_NAME} || ' Counter'",
        6: _NAME,
        7: f"'Bnkx Q Of Mr ' || {_NAME} || ' Field Mo'",
        8: f"{_NAME} || ' Bnka'",
        9: f"'Abc ' || {_NAME} || ' Done'",
        10: f"{_NAME} || ' Order Txn'",
        11: "'Paytm'",
        12: "'Payment 03'",
        13: f"'Salary Credited By ' || {_NAME}",
        15: _NAME,
        16: f"'Contact ' || {_NAME} || ' Example Org Or'",
        17: f"'Bnka Rent ' || {_NAME}",
        18: "'Imported transaction'",
        19: f"'Unknown Store ' || {_NAME}",
    },
    "'?'",
)


@query(f"SELECT id, coalesce({listed_sql('lower(description)', V.MERCHANTS)}, {_READ}) AS title FROM {_X}")
def cln04_readable(spark, d):
    return adapted(spark, d, "lines").select("id", T.readable("description").alias("title"))


@query(f"SELECT id, {title_sql('description')} AS title FROM {_X}")
def cln06_title(spark, d):
    return adapted(spark, d, "lines").select("id", T.title(F.col("description")).alias("title"))


@query(f"SELECT id, {listed_sql('lower(description)', V.KEYWORD_RULES, 4)} AS category FROM {_X}")
def cat01_keyword(spark, d):
    return adapted(spark, d, "lines").select("id", T.keyword_category("description").alias("category"))


_METHOD = "CASE id % 3 WHEN 0 THEN 'ATM' WHEN 1 THEN 'UPI' ELSE '' END"


@query(f"SELECT id, coalesce({listed_sql('lower(name)', V.BANK_CATEGORIES)}, {listed_sql('lower(description)', V.BANK_CATEGORIES)}, CASE {_METHOD} WHEN 'ATM' THEN 'Cash' WHEN 'UPI' THEN 'Transfer' END, 'Uncategorized') AS category FROM {_X}")
def cat02_bank(spark, d):
    method = F.when(F.col("id") % 3 == 0, "ATM").when(F.col("id") % 3 == 1, "UPI").otherwise("")
    return adapted(spark, d, "lines").select("id", T.bank_category("description", "name", method).alias("category"))


@query(f"SELECT id, coalesce({listed_sql('lower(description || chr(32) || name)', V.IMPORT_CATEGORIES, 4)}, 'Uncategorized') AS category FROM {_X}")
def cat03_import(spark, d):
    return adapted(spark, d, "lines").select("id", T.import_category("description", "name").alias("category"))


@query(f"SELECT id, CASE WHEN regexp_matches(lower(description), 'salary|payroll|stipend|credited|wage') THEN 'Salary' ELSE 'Misc' END AS category FROM {_X}")
def cat04_salary_guard(spark, d):
    return adapted(spark, d, "lines").select("id", T.salary_guard(F.lit("Salary"), "description").alias("category"))


@query(f"WITH k AS (SELECT id, {chain_sql('lower(trim(description))', V.GROUP_STEPS)} AS g FROM {_X}) SELECT id, coalesce({listed_sql('g', V.KEYWORD_RULES, 4)}, 'none') AS category FROM k")
def joi04_classify_distinct(spark, d):
    df = adapted(spark, d, "lines").select("id", "description")
    return L.classify_distinct(df, "description", T.group_key("description"), lambda k: F.coalesce(T.keyword_category(k), F.lit("none"))).select("id", "category")


@query(f"SELECT id, regexp_replace(regexp_replace(description, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', '[EMAIL_REDACTED]', 'g'), '\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b', '[PHONE_REDACTED]', 'g') AS description FROM {_X}")
def pii01_lines(spark, d):
    return adapted(spark, d, "lines").select("id", T.redact("description").alias("description"))


def _flat(col, *names):
    return [F.coalesce(col[n], F.lit("")).alias(n) for n in names]


def _entity(x: str) -> str:
    """A merchant, or else the text as a title."""
    return f"coalesce(nullif({merchant_sql(x)}, ''), {title_sql(x)})"


_NUMBER, _SHOP = "CAST(4400000000 + id AS VARCHAR)", "CAST(id % 90 + 10 AS VARCHAR) || 'Sto*' || name || ' COUNTER RIVERTON'"
_KIND1 = by_kind({0: "'UPI'", 1: "'POS'", 2: "'ATM'", 3: "'INB'", 4: "'CASH'", 9: "'IMPS'", 11: "'UPI'", 17: "'NEFT'"}, "''")
_ENTITY1 = by_kind({0: _entity("name"), 1: _entity(f"('ATM PURCH OTHPG ' || {_NUMBER} || ' ' || {_SHOP})"), 2: "'ATM Withdrawal'", 3: _entity("(name || ' Web Store AT 07741 HILL EASTPORT')"), 4: "'Cash Transaction'", 9: title_sql("name"), 11: _entity("name"), 17: title_sql("'RENT ' || name")}, merchant_sql("description"))
_REF1 = by_kind({0: "CAST(600000000000 + id AS VARCHAR)", 9: "CAST(id AS VARCHAR)", 11: "CAST(100000 + id AS VARCHAR)", 17: "'000' || CAST(id % 10000 AS VARCHAR)"}, "''")
_PLACE1 = by_kind({1: "'RIVERTON'", 2: "'ATM CASH ' || CAST(id % 9000 + 1000 AS VARCHAR) || ' MQ HILL ROAD, EASTPORT'", 4: "'SELF AT 07741 HILL EASTPORT'"}, "''")


@query(f"SELECT id, {_KIND1} AS method, {_ENTITY1} AS entity, {_REF1} AS reference, {_PLACE1} AS location FROM {_X}")
def ext01_method_details(spark, d):
    return adapted(spark, d, "lines").withColumn("x", E.method_details("description")).select("id", *_flat(F.col("x"), "method", "entity", "reference", "location"))


_UPI = "UPI/([A-Z]+)/(\\d+)/([^/]+)/([^/]+)/([^/]+)"


@query(f"SELECT id, regexp_extract(description, '{_UPI}', 2) AS ref, trim(regexp_extract(description, '{_UPI}', 3)) AS entity, trim(regexp_extract(description, '{_UPI}', 4)) AS bank, trim(regexp_extract(description, '{_UPI}', 5)) AS upi_id FROM {_X} WHERE regexp_matches(description, '{_UPI}')")
def ext02_upi(spark, d):
    x = adapted(spark, d, "lines").withColumn("x", E.statement_details("description")).where("x.method = 'UPI'")
    return x.select("id", *_flat(F.col("x"), "ref", "entity"), F.col("x.meta")["bank"].alias("bank"), F.col("x.meta")["upi_id"].alias("upi_id"))


_KIND2 = by_kind({0: "'UPI'", 1: "'POS'", 2: "'ATM'", 3: "'INB'", 4: "'CASH'", 5: "'CASH'", 6: "'NEFT'", 7: "'TRANSFER'", 14: "'TRANSFER'", 15: "'TRANSFER'"}, "'OTHERS'")
_ENTITY2 = by_kind({0: "name", 1: "name || ' COUNTER'", 3: "name || ' Web Store'", 6: "name", 7: "upper(name) || ' FIELD'"}, "''")
_REF2 = by_kind({0: "CAST(600000000000 + id AS VARCHAR)", 1: _NUMBER, 2: "CAST(id % 9000 + 1000 AS VARCHAR) || ' MQ'", 6: "CAST(id AS VARCHAR)"}, "''")
_PLACE2 = by_kind({1: "'RIVERTON'", 2: "'HILL ROAD, EASTPORT'", 4: "'07741 HILL EASTPORT'"}, "''")
_TYPE2 = by_kind({4: "'DEPOSIT'", 5: "'DEPOSIT'", 7: "'CREDIT'", 14: "'CREDIT'"}, "'DEBIT'")
_META2 = by_kind({0: """'{"bank":"BNKA","upi_id":"' || lower(name) || CAST(id % 97 AS VARCHAR) || '","app":"Appx"}'""", 6: """'{"bank":"BNKB"}'"""}, "'{}'")


@query(f"SELECT id, {_KIND2} AS method, {_ENTITY2} AS entity, {_REF2} AS ref, {_PLACE2} AS location, {_TYPE2} AS type, {_META2} AS meta FROM {_X}")
def ext02_statement_details(spark, d):
    return adapted(spark, d, "lines").withColumn("x", E.statement_details("description")).select("id", *_flat(F.col("x"), "method", "entity", "ref", "location", "type"), F.to_json("x.meta").alias("meta"))


def _brand(x: str) -> str:
    tight = f"replace(lower({x}), ' ', '')"
    return f"coalesce({listed_sql(tight, V.SBI_BRANDS)}, {listed_sql(f'lower({x})', V.SBI_BRANDS)})"


_PAYEE = f"coalesce({_brand("name || ' ' || lower(name) || CAST(id % 97 AS VARCHAR) || ' Appx'")}, name)"
_BOUGHT = f"coalesce({_brand("name || ' COUNTER ' || CAST(id % 90 + 10 AS VARCHAR) || 'Sto*' || name || ' COUNTER'")}, name || ' COUNTER')"
_ONLINE = f"coalesce({_brand("name || ' Web Store'")}, name || ' Web Store')"
_ANY = _brand("description")
_DEP, _WDL = _brand("substr(description, 9)"), _brand("substr(description, 9)")
_MERCHANT3 = by_kind({0: _PAYEE, 1: _BOUGHT, 2: "'ATM Withdrawal'", 3: _ONLINE, 4: "'Self Deposit'", 5: f"coalesce({_ANY}, 'Cash Deposit Machine')", 7: f"coalesce({_DEP}, 'Unknown')", 14: f"coalesce({_DEP}, 'Unknown')", 15: f"coalesce({_WDL}, 'Unknown')"}, "'Unknown'")
_SAID3 = by_kind(
    {
        0: f"'UPI Transfer to ' || {_PAYEE}",
        1: f"'POS Purchase at ' || {_BOUGHT} || ' (RIVERTON)'",
        2: "'ATM Cash Withdrawal at HILL ROAD, EASTPORT'",
        3: f"'Online Transfer to ' || {_ONLINE}",
        4: "'Cash Deposit at 07741 HILL EASTPORT'",
        5: f"coalesce('CDM Deposit via ' || {_ANY}, 'CDM Deposit') || ' (Ref: ' || CAST(10000000 + id AS VARCHAR) || ')'",
        7: f"coalesce('Refund from ' || {_DEP}, description)",
        14: f"coalesce('Refund from ' || {_DEP}, description)",
        15: f"coalesce('Payment to ' || {_WDL}, description)",
    },
    "description",
)
_TYPE3 = by_kind({0: "'upi'", 1: "'pos'", 2: "'atm'", 3: "'inb'", 4: "'cash_deposit'", 5: "'cash_deposit'", **{k: f"CASE WHEN {_DEP} IS NULL THEN 'unknown' ELSE 'upi' END" for k in (7, 14, 15)}}, "'unknown'")
_META3 = by_kind(
    {
        0: """'{"utr":"' || CAST(600000000000 + id AS VARCHAR) || '","bank":"BNKA","mode":"DR","app":"Appx"}'""",
        1: f"""'{{"ref":"' || {_NUMBER} || '","location":"RIVERTON","gateway":"OTHPG"}}'""",
        2: """'{"atmId":"' || CAST(id % 9000 + 1000 AS VARCHAR) || ' MQ","location":"HILL ROAD, EASTPORT"}'""",
        4: """'{"branch":"07741 HILL EASTPORT"}'""",
        5: """'{"ref":"' || CAST(10000000 + id AS VARCHAR) || '"}'""",
    },
    "'{}'",
)


@query(f"SELECT id, {_MERCHANT3} AS merchant, {_SAID3} AS clean_description, {_TYPE3} AS type, {_META3} AS meta FROM {_X}")
def ext03_sbi_details(spark, d):
    return adapted(spark, d, "lines").withColumn("x", E.sbi_details("description")).select("id", *_flat(F.col("x"), "merchant", "clean_description", "type"), F.to_json("x.meta").alias("meta"))


@query(f"SELECT id, CASE WHEN length(name) > 4 THEN name ELSE trim({chain_sql('description', V.DETAIL_STEPS)}) END AS best FROM {_X}")
def ext04_best_name(spark, d):
    return adapted(spark, d, "lines").select("id", E.best_name(F.when(F.length("name") > 4, F.col("name")).otherwise(""), F.col("description")).alias("best"))
