"""Views of descriptions for contrastive training. What is random follows a hash of key, place and seed, so a rerun gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(key: Column, place: Column, seed: int) -> Column:
    """A number in [0, 1)."""
    return F.pmod(F.xxhash64(key, place, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0


def term_frequency(df: DataFrame, text: str) -> DataFrame:
    """AGG-16: (term, n, tf): counts of words in small letters, over the largest count."""
    words = df.select(F.explode(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+")).alias("term")).where("term <> ''")
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))  # one row
    return counts.join(F.broadcast(most)).select("term", "n", (F.col("n") / F.col("most")).alias("tf"))


def frequency_dropout(df: DataFrame, key: str, text: str, frequency: DataFrame, p: float = 0.3, seed: int = 0, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """AUG-01, AUG-02: words go the likelier the more frequent; unknown words count as half the most frequent. A text never becomes empty."""
    words = df.select(key, text, F.posexplode(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("pos", "word"))
    known = words.join(frequency.select("term", "tf"), F.lower("word") == F.col("term"), "left")
    drop = F.least(F.greatest(F.lit(p) * F.coalesce("tf", F.lit(0.5)), F.lit(least)), F.lit(most))
    kept = known.withColumn("stays", chance(F.col(key), F.col("pos"), seed) >= drop)
    out = kept.groupBy(key).agg(F.first(text).alias(text), F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("pos", "word")))).alias("w"))
    return out.select(key, F.when(F.size("w") > 0, F.array_join(F.transform("w", lambda x: x["word"]), " ")).otherwise(F.col(text)).alias("view"))


def substring_view(key: Column, text: Column, seed: int = 0) -> Column:
    """AUG-01: two or more consecutive words; texts of up to three words stay."""
    words = F.split(F.trim(text), r"\s+")
    n = F.size(words)
    begin = F.floor(chance(key, F.lit(1), seed) * (n - 2)).cast("int")
    size = 2 + F.floor(chance(key, F.lit(2), seed) * (n - begin - 1)).cast("int")
    return F.when(n <= 3, text).otherwise(F.array_join(F.slice(words, begin + 1, size), " "))
