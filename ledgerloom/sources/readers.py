"""Tables of text columns to one normal form: headers, separators, header rows of grids, banks, scans of ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V
from ..functions.text import extract_merchant

#: How a file is read: by a separator, by one that its first line tells (of equals the comma), as JSON or as a grid.
SUFFIXES = {".csv": None, ".tsv": "\t", ".txt": None, ".pdf": None, ".json": "json", ".xlsx": "grid", ".xlsm": "grid", ".xls": "grid"}
# What may be uploaded.
ALLOWED = [".csv", ".tsv", ".xls", ".xlsx", ".xlsm", ".json", ".txt"]
MOST_BYTES = 10 * 1024 * 1024
OUTPUT = ["date", "amount", "description", "merchant", "method", "entity", "ref", "location", "type", "meta", "status"]


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return f".{name.rpartition('.')[2].lower()}" if "." in name else ""


def check_files(files: DataFrame) -> DataFrame:
    """SRC-15, SRC-16: of a binaryFile table each file's hash, and what is wrong with it (null if nothing)."""
    end = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    wrong = F.when(~end.isin(*ALLOWED), "unsupported file type").when(F.col("length") == 0, "empty file").when(F.col("length") > MOST_BYTES, "file too large")
    locked = F.hex(F.substring(F.col("content"), 1, 8)) == "D0CF11E0A1B11AE1"
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"), F.coalesce(wrong, F.when(locked, "Password required")).alias("error"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SRC-01, SRC-04: all columns as text."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')


def sniff_separator(first_line: str) -> str:
    """SRC-09: the most frequent of comma, tab, bar and semicolon in the first line, of equals the first."""
    return max(",\t|;", key=first_line.count)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: delimited text whose separator the first line tells."""
    first = spark.read.text(path).first()
    return read_delimited(spark, path, sniff_separator(first["value"] if first else ","))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: an array of rows, or an object that holds them under `transactions`; all columns as text."""
    df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    return df.select(F.explode("transactions").alias("t")).select("t.*") if "transactions" in df.columns else df


#: Among how many rows a header is looked for.
HEADER_ROWS = 30
# Parts of the headers of statements.
_STATEMENT = [["date"], ["desc", "particular", "detail", "narration"], ["amount", "debit", "credit", "dr", "cr"]]
# Parts of the headers of tables of any kind.
_WIDE = ["date", "time", "desc", "detail", "narration", "particular", "amount", "debit", "credit", "withdrawal", "deposit", "balance", "merchant", "ref", "status", "type", "method"]


def header_row(grid: list[list[str | None]], kind: str = "statement") -> int:
    """SRC-11: which row of one file's grid is the header.

    statement: the first of 20 rows with a date, a description and an amount word, else the first row; ledger: the
    first of 30 rows with a cell 'date' and a word for details, else an error; details: the first of 30 with 'details',
    else an error; wide: the first of 30 with two cells that look like headers, else the first row.
    """
    for i, row in enumerate(grid[: 20 if kind == "statement" else HEADER_ROWS]):
        low = [(c or "").strip().lower() for c in row]
        holds = lambda words: any(w in c for c in low for w in words)  # noqa: B023, E731
        found = {
            "statement": lambda: all(holds(w) for w in _STATEMENT),  # noqa: B023
            "ledger": lambda: "date" in low and holds(["details", "description"]),  # noqa: B023
            "details": lambda: holds(["details"]),  # noqa: B023
            "wide": lambda: sum(any(w in c for w in _WIDE) for c in low) >= 2,  # noqa: B023
        }[kind]()
        if found:
            return i
    if kind in ("ledger", "details"):
        raise ValueError("no header row found")
    return 0


def grid_table(grid: DataFrame, kind: str = "statement") -> DataFrame:
    """SRC-11 over a table of grids (path, row_idx, cells array<string>): (path, row_idx, values map<header, text>) of the rows under each file's own header.

    The rules are header_row's. Blank rows go, blank headers get a name, of equal headers the first counts. A file without a header that needs one is an error.
    """
    low = grid.withColumn("low", F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))))
    has = lambda *w: F.exists("low", lambda x: x.rlike("|".join(w)))
    rows, found = {
        "statement": (20, has(*_STATEMENT[0]) & has(*_STATEMENT[1]) & has(*_STATEMENT[2])),
        "ledger": (30, F.array_contains("low", "date") & has("details", "description")),
        "details": (30, has("details")),
        "wide": (30, F.size(F.filter("low", lambda x: x.rlike("|".join(_WIDE)))) >= 2),
    }[kind]
    is_head = (F.col("row_idx") < rows) & found
    heads = low.groupBy("path").agg(F.min(F.when(is_head, F.struct("row_idx", "cells"))).alias("head"), F.min(F.struct("row_idx", "cells")).alias("first"))
    if kind in ("ledger", "details") and not heads.where("head is null").isEmpty():
        raise ValueError("no header row found")
    heads = heads.select("path", F.coalesce("head", "first").alias("head")).select("path", F.col("head.row_idx").alias("__at"), F.transform("head.cells", lambda x, i: F.coalesce(F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")), F.concat(F.lit("column_"), i.cast("string")))).alias("__names"))
    body = low.join(heads, "path").where((F.col("row_idx") > F.col("__at")) & F.exists("low", lambda x: x != ""))
    pairs = F.transform("__names", lambda n, i: F.struct(n.alias("n"), F.get("cells", i).alias("v"), F.array_position("__names", n).alias("first"), (i + 1).alias("i")))
    own = F.filter(pairs, lambda p: p["first"] == p["i"])
    return body.select("path", "row_idx", F.map_from_entries(F.transform(own, lambda p: F.struct(p["n"], p["v"]))).alias("values"))


def resolve_headers(columns: list[str], synonyms: dict[str, list[str]] | None = None) -> dict[str, str]:
    """NRM-01, NRM-02: target -> column, by the order of the synonyms; a column serves one target."""
    low: dict[str, str] = {}
    for c in columns:
        low.setdefault(c.strip().lower(), c)
    used, out = set(), {}
    for target, names in (synonyms or V.HEADER_SYNONYMS).items():
        hit = next((n for n in names if n in low and n not in used), None)
        if hit is not None:
            used.add(hit)
            out[target] = low[hit]
    return out


def resolve_by_parts(columns: list[str], parts: list[tuple[str, list[str], list[str]]] | None = None) -> dict[str, str]:
    """NRM-03: target -> the first column that is taken for it: each column serves the first target of whose words it holds one, and none of its exceptions."""
    out: dict[str, str] = {}
    for column in columns:
        low = column.lower()
        target = next((t for t, words, but in parts or V.DETAIL_PARTS if any(w in low for w in words) and not any(w in low for w in but)), None)
        if target is not None:
            out.setdefault(target, column)
    return out


def header_key(name: str) -> str:
    """NRM-04"""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def require(found: dict[str, str], needed: list[str]) -> None:
    """NRM-05"""
    missing = [n for n in needed if n not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def bank_of(columns: list[str]) -> str:
    """AGG-23: the bank half of whose headers, at least, occur; of equals the first."""
    low = [c.lower().strip() for c in columns]
    score = {b: sum(any(h in c for c in low) for h in hs) / len(hs) for b, hs in V.BANK_HEADERS.items()}
    best = max(score, key=score.get)
    return best if score[best] >= 0.5 else "generic"


def bank_scores(df: DataFrame, file: str, order: str, description: str = "description", rows: int = 100) -> DataFrame:
    """AGG-24: (file, bank, score): matches a description over each file's first hundred, by `order`; case doesn't count.

    The first hundred are cut in each task before the shuffle, so a large file is no large group.
    """
    first = F.row_number().over(Window.partitionBy(file).orderBy(order))
    head = df.where(F.col(description).isNotNull()).select(file, order, F.upper(F.col(description)).alias("__d")).withColumn("__r", first).where(F.col("__r") <= rows)
    sums = head.groupBy(file).agg(F.count(F.lit(1)).alias("__n"), *[sum((F.count_if(F.col("__d").rlike(p)) for p in ps), F.lit(0)).alias(f"__{b}") for b, ps in V.BANK_DESCRIPTIONS.items()])
    return sums.select(file, F.explode(F.array(*[F.struct(F.lit(b).alias("bank"), (F.col(f"__{b}") / F.col("__n")).alias("score")) for b in V.BANK_DESCRIPTIONS])).alias("s")).select(file, "s.*")


def normalised(df: DataFrame, file: Column | None = None) -> DataFrame:
    """NRM-01, 06, 11, 12, 18, 19: any table of text columns to OUTPUT. The rule for status needs to know of negative amounts in the whole file."""
    found = resolve_headers(df.columns)
    base = df.select(*[F.col(f"`{c}`").alias(t) for t, c in found.items()], *([file.alias("__file")] if file is not None else []))
    base = base.withColumn("amount", N.net_amount(list(found)))
    if "status" in found:
        key = ["__file"] if file is not None else []
        flag = base.groupBy(*key).agg((F.coalesce(F.min(F.when(F.col("amount") != 0, F.col("amount"))), F.lit(0.0)) >= 0).alias("__up"))
        base = (base.join(F.broadcast(flag)) if not key else base.join(flag, key)).withColumn("amount", N.status_signed(F.col("amount"), "status", F.col("__up"))).drop("__up")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in found else F.lit("")
    raw = F.col("merchant") if "merchant" in found else text("description")
    source = F.when(F.length(raw) > 2, raw).otherwise(text("description"))
    return base.select(
        (N.to_day("date") if "date" in found else F.lit(None).cast("date")).alias("date"),
        N.money(F.col("amount")).alias("amount"),
        text("description").alias("description"),
        extract_merchant(source).alias("merchant"),
        text("method").alias("method"),
        *[F.lit("").alias(c) for c in ("entity", "ref", "location", "type")],
        F.from_json(F.lit("{}"), "map<string,string>").alias("meta"),
        text("status").alias("status"),
        *([F.col("__file").alias("file")] if file is not None else []),
    )


def ledger_scan(spark: SparkSession, path: str, user_id, columns: list[str]) -> DataFrame:
    """SRC-12, SRC-13: one user's rows and columns, both pushed into the scan."""
    return spark.read.parquet(path).where(F.col("user_id") == user_id).select(*columns)


def changed_since(df: DataFrame, mark, column: str = "updated_at") -> DataFrame:
    """SRC-14: manual changes after the last run."""
    return df.where(F.col("is_manual") & (F.col(column) > F.lit(mark)))
