"""Queries of the text operators over a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.leaks import leaks
from lodestack.llm.mixing import mix_sources
from lodestack.llm.mojibake import garbled
from lodestack.llm.near_duplicates import expand_pairs, groups, near_duplicates
from lodestack.llm.personal import personal_information, redact
from lodestack.sources.tables import table


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_cache").select(F.col("path").alias("id"), F.col("content").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(_cached(spark, sf_dir), threshold=0.6)
    return expand_pairs(members, links).select(F.col("id_a").alias("path_a"), F.col("id_b").alias("path_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates of each path, and its class of copies: each named by its smallest path; and how many
    other classes its class is linked to."""
    members, links = near_duplicates(_cached(spark, sf_dir), threshold=0.6)
    grouped = groups(members, links)
    least = grouped.groupBy("class", "group_id").agg(F.min("id").alias("class_path"))
    first = least.groupBy("group_id").agg(F.min("class_path").alias("group_path"))
    return grouped.join(least, ["class", "group_id"]).join(first, "group_id").select(
        F.col("id").alias("path"), "class_path", "group_path", "links"
    )


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = table(spark, sf_dir, "doc_cache").select(
        F.lit("doc_cache").alias("tab"), F.col("path").alias("rec_key"), F.concat(F.lit("doc_cache "), F.regexp_extract("path", r"^[^\\/]*[\\/]*[^\\/]*", 0)).alias("source"),
        F.col("content").alias("text"),
    )
    names = table(spark, sf_dir, "file_index").select(
        F.lit("file_index").alias("tab"), F.col("seq").cast("string").alias("rec_key"), F.concat_ws(" ", F.lit("file_index"), "volume").alias("source"),
        F.col("name").alias("text"),
    )
    return garbled(contents.unionByName(names))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("tab", "rec_key")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled records with the text as far as it can be restored, and the ciphers found in them."""
    return _garbled(spark, sf_dir)


def _leaks(spark: SparkSession, sf_dir: str, similar: bool) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), similar=similar)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, similar=False).where("exact").select("doc_id", "item_id")


def p6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with small changes: windows with a weighted shingle similarity of at least 0.8."""
    return _leaks(spark, sf_dir, similar=True).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "exact")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixture, by the smallest doc_id of each, and how often each is used."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: wanted and actual shares of the total tokens by source."""
    return _mix(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_information(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return redact(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_groups": p1_groups, "p4_found": p4_found, "p4_restored": p4_restored,
    "p6_found": p6_found, "p6_similar": p6_similar,
    "p7_copies": p7_copies, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_redacted": p8_redacted,
}
