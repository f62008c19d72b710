"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, dart_minhash, gear_dedup, langbloom, line_dedup, packing, preference, quality_rff, token_alignment, token_count, turn_repair, webp_columns, wu_manber
from .shared import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(documents(spark, sf_dir))



def op2_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp_columns.media_digests(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.find_contamination(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_pairs(*preference.with_foreign_replies(_table(spark, sf_dir, "conversations")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.read_ids(bitplane.write_ids(documents(spark, sf_dir)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_dedup.repeated_passages(documents(spark, sf_dir)).select("doc_id", "start", "length", "n_words", F.sha2(F.encode("passage", "utf-8"), 256).alias("passage_sha256"), "keep_doc_id", "keep_start")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.score_table(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langbloom.identify(documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_webp_media, op3_decontamination, op4_preference_pairs, op5_packing, op6_bit_planes, op7_substring_dedup, op8_token_counts, op9_quality, op10_language, op11_line_dedup, op12_turn_repair, op13_token_alignment)}
ORACLES = {"op4_preference_pairs": preference.SQL, "op11_line_dedup": line_dedup.SQL, "op12_turn_repair": turn_repair.SQL}
