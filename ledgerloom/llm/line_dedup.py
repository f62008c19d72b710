"""Line deduplication across documents in built-in functions alone: explode, hash, count documents, drop, reassemble.

A line's key is the line without white space (U+0020, U+0009 to U+000D) at either end, ASCII capitals lower-cased. Lines
whose keys have at least `min_chars` code points are exploded with their positions; the keys' hashes are counted by
distinct doc_id, combined before each shuffle, so one line in a third of all documents is a few rows a task. Keys in at
least `min_docs` documents lose all their lines but those in the largest doc_id that holds them. Only the positions that
go are shuffled back; a text is taken apart once more beside them and the stretches between them are strung together.

The frequent keys are written before lines meet them, so that both sides of that join are shuffled as they are and
adaptive execution splits its hot keys; no list is longer than the lines of one text.

Null or empty text is one empty line; null text stays null. Rows without doc_id are no document of the count and keep their lines.
Rows that repeat a doc_id are one document, whether or not their texts differ; each row loses its own lines. Keys are
compared by 128 bits of hash. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, materialize

BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """lower() is quicker than translate() and the same on ASCII."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(11), key).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of each line whose key is long enough; row stands for the text."""
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), _lines(F.col("text")).alias("lines"))
    lines = texts.select("id", "row", F.posexplode("lines").alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("id", "row", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("id", "row", "pos", *_hashes(F.col("key")))


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(id, row, dropped): the ascending positions of the lines that go, for each text that loses any."""
    lines = line_keys(docs, min_chars)
    held = lines.select("h1", "h2", "id").distinct()
    frequent = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    frequent = materialize(frequent, "frequent-lines")
    gone = lines.join(frequent, ["h1", "h2"]).where(F.col("id") != F.col("keeper"))
    return gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines between the dropped positions, in time that grows with the lines alone."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    stretches = F.transform(F.sequence(F.lit(1), F.size(dropped) + 1), lambda k: F.slice(lines, F.element_at(edges, k) + 2, F.element_at(edges, k + 1) - F.element_at(edges, k) - 1))
    return F.flatten(stretches)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs with the lines that stay as text, and n_lines, n_dropped; columns of docs with these names give way."""
    own, row, cut, lines, made = free_names(docs, "id", "row", "dropped", "lines", "kept")
    gone = dropped_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_docs, min_chars)
    gone = gone.withColumnsRenamed({"id": own, "row": row, "dropped": cut})
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    text = F.col("text").cast("string")
    keyed = docs.select(*rest, text.alias("text"), F.col("doc_id").alias(own), F.xxhash64(text).alias(row))
    both = keyed.join(gone, [own, row], "left").withColumn(lines, _lines(F.col("text")))
    out = both.withColumn(made, F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.concat_ws("\n", _kept(F.col(lines), F.col(cut)))))
    counts = [F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*[F.col(made).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], *counts)


def line_digests(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM doc),
keyed AS (SELECT r, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT r, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN frequent USING (key)),
whole AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM doc JOIN whole USING (r)
"""
